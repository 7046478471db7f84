"""Token ids as Re-Pair compressed blocks in Parquet, with random access.

Documents are dealt into shards by ranges of their id and encoded in ascending order.  A block holds whole documents
of one shard.  Inside a block frequent pairs of neighbouring ids are replaced by nonterminals round by round; pairs
never span documents, so every document is a range of symbols.  Stored per block:

========== ==========================================================================
ids, known  the documents in order (``known`` is false for a null id)
counts     tokens of each document, end id included
bounds     range of symbols of each document
rules      two symbols per nonterminal; nonterminal ``base + i`` is rule ``i``
lengths    tokens that each rule expands to
symbols    the compressed sequence, 16 or 32 bits wide
========== ==========================================================================

With the expansion lengths a reader finds the symbols of any token range by a running sum and expands only these.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .words import MEMORY, lean, windows

END_ID = 0
BLOCK_TOKENS = 2_000_000
ROUNDS = 4
RULES_PER_ROUND = 3500
MIN_COUNT = 8
CACHED = 700_000

BLOCK_KIND = (
    "shard int, block int, n_docs long, n_tokens long, ids binary, known binary, counts binary, bounds binary, base long, "
    "rules binary, lengths binary, width int, symbols binary"
)


# ---- tokens -----------------------------------------------------------------------------------------------------

# A single space between two visible characters always begins a new piece, so both sides can be encoded apart.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which opens contractions
JOINED = 1000


class Encoder:
    """Ids of whole texts, as the tokenizer gives them without special tokens of its own.

    A word after a single space is encoded once and remembered, in two generations of bounded size.  A special token that
    is written out in a text has its own id and cuts the text at both ends, so such texts go to the tokenizer whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of a space and each word.  Words of visible characters go in long runs that are cut at their spaces."""
        plain, tailed, inner = [], [], []
        for word in words:
            if word.isalpha():
                plain.append(word)
            elif (head := word.rstrip(_MARKS)).isalpha():
                tailed.append((word, head))
            elif (parts := word.split()) == [word]:
                plain.append(word)
            elif len(parts) > 1 and not (word[0].isspace() or word[-1].isspace()):
                inner.append(word)
        # Letters and the marks behind them are pieces of their own, so words share the ids of their letters.
        heads = {head for _, head in tailed} - self.young.keys()
        marks = list({word[len(head):] for word, head in tailed} - self.marks.keys())
        self.marks.update(zip(marks, [i.tobytes() for i in self._ids(marks)]))
        plain.extend(heads.difference(plain))
        runs = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        for run, ids in zip(runs, self._ids([" " + " ".join(r) for r in runs])):
            data, at = ids.tobytes(), (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4).tolist()
            self.young.update(zip(run, [data[i:j] for i, j in zip(at, at[1:])]))
        self.young.update([(word, self.young[head] + self.marks[word[len(head):]]) for word, head in tailed])
        self.young.update(zip(inner, [i.tobytes() for i in self._ids([" " + w for w in inner])]))
        # Words that touch further white space are never remembered: their texts are cut with more care.

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) > CACHED:
            self.old, self.young, self.marks = self.young, {}, {}
        whole = [any(s in t for s in self.specials) for t in texts]
        special = iter(self._ids([t for t, w in zip(texts, whole) if w]))
        split = [[""] if w else t.split(" ") for t, w in zip(texts, whole)]
        heads = self._ids([s[0] for s in split])
        young = self.young
        wanted = {word for parts in split for word in parts[1:] if word not in young}
        known = wanted & self.old.keys()
        for word in known:
            self.young[word] = self.old[word]
        self._learn(list(wanted - known))
        get = self.young.__getitem__
        out = []
        for text, head, parts, direct in zip(texts, heads, split, whole):
            if direct:
                out.append(next(special))
                continue
            try:
                if len(parts) > 1 and (not parts[0] or parts[0][-1].isspace()):
                    raise KeyError
                out.append(np.frombuffer(head.tobytes() + b"".join(map(get, parts[1:])), dtype="<u4"))
            except KeyError:
                first, *rest = _CUT.split(text)
                out.append(np.concatenate(self._ids([first, *(" " + r for r in rest)])))
        return out


ENCODERS = "encoders"


def encoder(definition: str) -> Encoder:
    """One encoder per worker process, for as long as it encodes (``lean``)."""
    held = MEMORY.setdefault(ENCODERS, {})
    if definition not in held:
        held[definition] = Encoder(definition)
    return held[definition]


# ---- grammar ----------------------------------------------------------------------------------------------------


def _frequent(keys: np.ndarray, most: int, least: int) -> np.ndarray:
    """The most frequent keys, in ascending order."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(np.append(first, len(ordered)))
    good = np.flatnonzero(times >= least)
    if len(good) > most:
        good = good[np.argsort(-times[good], kind="stable")[:most]]
    return np.sort(ordered[first[good]])


def _positions(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` holds a chosen key, and which.  Of chosen keys that share a slot one is left for a later round."""
    shift, spread = np.uint64(44), np.uint64(0x9E3779B97F4A7C15)
    table = np.full(1 << 20, -1, dtype=np.int32)
    table[(chosen.astype(np.uint64) * spread) >> shift] = np.arange(len(chosen), dtype=np.int32)
    rank = table[(keys.astype(np.uint64) * spread) >> shift]
    near = np.flatnonzero(rank >= 0)
    rank = rank[near]
    hit = chosen[rank] == keys[near]
    return near[hit], rank[hit]


def compress(ids: np.ndarray, starts: np.ndarray, *, rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND,
             least: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (base, rules, lengths, symbols, starts of the documents in symbols).

    Each round replaces the most frequent pairs, from left to right where they overlap.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    room = (1 << 16) - base
    narrow = room >= 4096
    symbols = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    known = np.ones(base, dtype=np.int64)
    total = 0
    closed = np.zeros(len(symbols) + 1, dtype=bool)  # a document begins here
    closed[starts] = True
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        most = min(per_round, room - total) if narrow else per_round
        if narrow:
            keys = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        else:
            keys = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:].astype(np.uint64)
        inner = ~closed[1:len(symbols)]
        chosen = _frequent(keys[inner], most, least) if most > 0 else keys[:0]
        if not len(chosen):
            break
        at, rank = _positions(keys, chosen)
        free = inner[at]
        at, rank = at[free], rank[free]
        # Of pairs that overlap in a row take the first, third, ...
        leads = np.ones(len(at), dtype=bool)
        leads[1:] = at[1:] != at[:-1] + 1
        lead = np.maximum.accumulate(np.where(leads, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - lead) % 2 == 0
        at, rank = at[take], rank[take]
        used, rank = np.unique(rank, return_inverse=True)
        pairs = chosen[used]
        bits = np.uint64(16 if narrow else 32)
        left = (pairs.astype(np.uint64) >> bits).astype(np.uint32)
        right = (pairs.astype(np.uint64) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.uint32)
        grown = known[left] + known[right]
        rules.append(np.stack([left, right], axis=1))
        lengths.append(grown)
        known = np.concatenate([known, grown])
        symbols[at] = (base + total + rank).astype(np.uint32)
        total += len(used)
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        closed = np.append(closed[:-1][keep], True)
    flat_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    flat_lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    return base, flat_rules, flat_lengths, symbols, np.flatnonzero(closed[:-1])


class Block:
    """Reader of one stored block."""

    def __init__(self, row: dict):
        known = np.frombuffer(row["known"], dtype=bool)
        self.ids = [int(i) if k else None for i, k in zip(np.frombuffer(row["ids"], "<i8"), known)]
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.base = row["base"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")

    def _size(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each symbol stands for."""
        out = np.ones(len(symbols), dtype=np.int64)
        inner = symbols >= self.base
        out[inner] = self.lengths[symbols[inner].astype(np.int64) - self.base]
        return out

    def _levels(self, symbols: np.ndarray) -> np.ndarray:
        """All tokens of a run of symbols, one level of rules at a time."""
        out = symbols.astype(np.uint32)
        while len(out) and (inner := out >= self.base).any():
            width = 1 + inner.astype(np.int64)
            first = np.cumsum(width) - width
            grown = np.empty(int(width.sum()), dtype=np.uint32)
            grown[first] = out
            pair = self.rules[out[inner].astype(np.int64) - self.base]
            grown[first[inner]], grown[first[inner] + 1] = pair[:, 0], pair[:, 1]
            out = grown
        return out

    @cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Every symbol's tokens one after the other, and where each begins."""
        rules = self._levels(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32))
        begins = np.cumsum(self.lengths) - self.lengths
        return np.concatenate([np.arange(self.base, dtype=np.uint32), rules]), np.concatenate([np.arange(self.base), self.base + begins])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begins = self._flat
        size = self._size(symbols)
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, dtype=np.uint32)
        return flat[np.arange(ends[-1]) + np.repeat(begins[symbols] - (ends - size), size)]

    def tokens(self, place: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Tokens ``lo`` to ``hi`` of one document of the block; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.bounds[place]:self.bounds[place + 1]]
        hi = int(self.counts[place]) if hi is None else min(hi, int(self.counts[place]))
        if lo >= hi:
            return np.zeros(0, dtype=np.uint32)
        ends = np.cumsum(self._size(symbols))
        first, last = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left"))
        before = int(ends[first - 1]) if first else 0
        return self.expand(symbols[first:last + 1])[lo - before:hi - before]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        everything = self.expand(self.symbols)
        ends = np.cumsum(self.counts)
        for doc, lo, hi in zip(self.ids, ends - self.counts, ends):
            yield doc, everything[lo:hi]


# ---- jobs -------------------------------------------------------------------------------------------------------


def _block_row(shard: int, block: int, ids: list, texts: list[np.ndarray]) -> list:
    counts = np.array([len(t) for t in texts], dtype="<i8")
    starts = np.cumsum(counts) - counts
    base, rules, lengths, symbols, begins = compress(np.concatenate(texts), starts)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    known = np.array([i is not None for i in ids], dtype=bool)
    numbers = np.array([0 if i is None else i for i in ids], dtype="<i8")
    return [
        shard, block, len(ids), int(counts.sum()), numbers.tobytes(), known.tobytes(), counts.tobytes(),
        np.append(begins, len(symbols)).astype("<i8").tobytes(), base, rules.astype("<u4").tobytes(),
        lengths.astype("<i8").tobytes(), width, symbols.astype(f"<u{width}").tobytes(),
    ]


_BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
    ("known", pa.binary()), ("counts", pa.binary()), ("bounds", pa.binary()), ("base", pa.int64()), ("rules", pa.binary()),
    ("lengths", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary()),
])


def blocks(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Compressed blocks in ascending id order over (shard, block), null ids first.

    Null texts count as empty and hold the end id alone.  Rows that repeat an id are documents of their own, in the
    order of their texts.  A document is never cut, however long; an empty table gives no blocks.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = encoder(definition).encode
        ids, tokens, size, block = [], [], 0, 0

        def packed():
            row = _block_row(shard, block, ids, tokens)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for lo, hi in windows(batch.column("text")):
                texts = [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                for doc, found in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), encode(texts)):
                    ids.append(doc)
                    tokens.append(np.concatenate([found, end]))
                    size += len(found) + 1
                    if size >= block_tokens:
                        yield packed()
                        ids, tokens, size, block = [], [], 0, block + 1
        if ids:
            yield packed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lean(run, keep=ENCODERS), BLOCK_KIND)


def write(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    blocks(docs, tokenizer_path, **options).write.mode("overwrite").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, shard, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                reader = Block(row)
                found = [(d, len(t), zlib.crc32(t.astype("<u4").tobytes())) for d, t in reader.documents()]
                counts = np.array([f[1] for f in found], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f[0] for f in found], pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts),
                    pa.array([f[2] for f in found], pa.int64()), pa.array(np.full(len(found), row["shard"], np.int32)),
                    pa.array(np.full(len(found), row["block"], np.int32)),
                ], ["doc_id", "inside", "n_tokens", "ids_crc32", "shard", "block"])

    stored = spark.read.parquet(path)
    kept = ["shard", "block", "ids", "known", "counts", "bounds", "base", "rules", "lengths", "width", "symbols"]
    found = stored.select(kept).mapInArrow(lean(run), "doc_id long, inside long, n_tokens long, ids_crc32 long, shard int, block int")
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    sizes = stored.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(earlier.orderBy("shard")), F.lit(0)).alias("shard_start")
    )
    inside = F.coalesce(F.sum("n_tokens").over(earlier.partitionBy("shard").orderBy("block")), F.lit(0))
    starts = sizes.select("shard", "block", inside.alias("block_start")).join(shards, "shard")
    return found.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "block"
    )


def encoded(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared checkpoint folder and read the documents back from the files."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, **options)
    return read(docs.sparkSession, path)
