"""Harmonic packing of token ids into sequences of fixed capacity.

A piece of length l with C/(k+1) < l <= C/k is of class k, and a sequence of class k holds exactly k pieces, so a
worker needs one open sequence per class and never looks at another worker's.  A piece that lies more than ``slack``
below the top of its class would waste that much of its share, so its end is cut off until a piece of
floor(C/(k+1)) is left: the top of the next class.  The rest is dealt with in the same way and shrinks quadratically, so
a document gives few pieces and full sequences lack only what C leaves over when divided by k.

What stays open when a worker ends is joined class by class and cut into full sequences; the last one of a worker is cut
at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import ENCODERS, encoder
from .words import lean, windows

CAPACITY = 2048
SLACK = 1 / 128
END_ID = 1
PAD_ID = 0
ROWS_OUT = 256  # sequences per Arrow batch


@cache
def harmonic_cuts(rest: int, capacity: int = CAPACITY, slack: float = SLACK) -> tuple[int, ...]:
    """Lengths of the pieces of a rest shorter than the capacity."""
    out = []
    while rest:
        k = capacity // rest
        if capacity // k - rest <= slack * rest:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return tuple(out)


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Piece:
    """Tokens ``start`` to ``start + len(ids)`` of one document."""

    __slots__ = ("doc_id", "start", "doc_tokens", "ids")

    def __init__(self, doc_id: int | None, start: int, doc_tokens: int, ids: np.ndarray):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def split(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:length]),
            Piece(self.doc_id, self.start + length, self.doc_tokens, self.ids[length:]),
        )


Sequence = list[Piece]


class Packer:
    """One worker's open sequences: at most one per class, so their memory does not grow with the input."""

    def __init__(self, capacity: int, slack: float):
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, Sequence] = {}

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[Sequence]:
        """Cuts one document; yields the sequences that it fills."""
        full = len(ids) // self.capacity
        lengths = [self.capacity] * full + list(harmonic_cuts(len(ids) % self.capacity, self.capacity, self.slack))
        start = 0
        for length in lengths:
            k = self.capacity // length
            held = self.open.setdefault(k, [])
            held.append(Piece(doc_id, start, len(ids), ids[start:start + length]))
            start += length
            if len(held) == k:
                del self.open[k]
                yield held

    def rest(self) -> Iterator[Sequence]:
        """The open sequences, joined and cut: full ones, then one per power of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p.ids) for p in pieces)
        sizes = [self.capacity] * (left // self.capacity) + powers_of_two(left % self.capacity)
        pieces.reverse()
        for size in sizes:
            held: Sequence = []
            while size:
                piece = pieces.pop()
                if len(piece.ids) > size:
                    piece, after = piece.split(size)
                    pieces.append(after)
                held.append(piece)
                size -= len(piece.ids)
            yield held


_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())])
_SEQUENCE = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("padded", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])
SEQUENCE_KIND = (
    "sequence_id long, n_tokens long, padded long, ids binary, "
    "pieces array<struct<doc_id: long, start: long, length: long, offset: long, doc_tokens: long>>"
)


def _batch(first: int, rows: list[Sequence], capacity: int, pad_id: int) -> pa.RecordBatch:
    pieces = [p for row in rows for p in row]
    lengths = np.array([len(p.ids) for p in pieces], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    n_tokens = np.diff(ends[edges])
    exact = (n_tokens & (n_tokens - 1)) == 0
    padded = np.where(exact, n_tokens, capacity)
    ids = [
        np.concatenate([*(p.ids for p in row), np.full(size - n, pad_id)]).astype("<u4").tobytes()
        for row, n, size in zip(rows, n_tokens.tolist(), padded.tolist())
    ]
    offsets = ends[:-1] - np.repeat(ends[edges[:-1]], np.diff(edges))
    struct = pa.StructArray.from_arrays([
        pa.array([p.doc_id for p in pieces], pa.int64()), pa.array([p.start for p in pieces], pa.int64()), pa.array(lengths),
        pa.array(offsets), pa.array([p.doc_tokens for p in pieces], pa.int64()),
    ], fields=list(_PIECE))
    return pa.RecordBatch.from_arrays([
        pa.array(first + np.arange(len(rows), dtype=np.int64)), pa.array(n_tokens), pa.array(padded), pa.array(ids, pa.binary()),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), struct),
    ], schema=_SEQUENCE)


def sequences(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    slack: float = SLACK,
    end_id: int = END_ID,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Packed sequences: sequence_id, n_tokens, padded, ids, pieces (doc_id, start, length, offset, doc_tokens).

    ``ids`` holds little-endian unsigned 32-bit ids.  A sequence is padded to ``capacity`` (a power of two) unless its
    length is a power of two.  Every id of every document, its end id included, lies in one piece.  A null text is empty
    and holds the end id alone; rows that repeat an id or have none are documents of their own; other columns are
    ignored; an empty table gives no sequences.  A worker packs its own rows and numbers its sequences behind its
    partition's number, so a lost task is simply run again; there is no shuffle.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity has to be a power of two")
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(definition).encode, Packer(capacity, slack)
        first = TaskContext.get().partitionId() << 33

        def packed() -> Iterator[Sequence]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for lo, hi in windows(texts):
                    part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                    for doc, found in zip(ids.slice(lo, hi - lo).to_pylist(), encode(part)):
                        yield from packer.add(doc, np.concatenate([found, end]))
            yield from packer.rest()

        held: list[Sequence] = []
        for sequence in packed():
            held.append(sequence)
            if len(held) == ROWS_OUT:
                yield _batch(first, held, capacity, pad_id)
                first, held = first + len(held), []
        if held:
            yield _batch(first, held, capacity, pad_id)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run, keep=ENCODERS), SEQUENCE_KIND)


def pieces(packed: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  The crc is of the ids stored."""
    flat = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    stored = F.expr("substring(ids, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))")
    return flat.select(
        "p.doc_id", "p.start", "p.length", F.crc32(stored).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset"
    )


def padding(packed: DataFrame) -> DataFrame:
    """One row: sequences, tokens, padding (ids added), cuts (pieces that do not end their document)."""
    cut = F.expr("cast(size(filter(pieces, p -> p.start + p.length < p.doc_tokens)) as long)")
    return packed.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.col("padded") - F.col("n_tokens")), F.lit(0)).alias("padding"),
        F.coalesce(F.sum(cut), F.lit(0)).alias("cuts"),
    )
