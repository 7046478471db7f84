"""Repeated 200-byte strings by a distributed merge of front-coded sorted suffix runs.

A suffix starts at an anchor: of every 200-byte window the (leftmost) smallest hash among its 40-byte grams marks one
position, which depends on the window's bytes alone.  So equal windows have equal anchors at equal offsets, and each
window belongs to one suffix, the bytes from its anchor on, with up to 160 bytes before it.  A gram hash that occurs
once cannot belong to a repeated window; those suffixes are left out.

1. Tasks sort their suffixes into runs.  Equal entries are one, and runs are front-coded: each entry holds the length
   of the prefix that it shares with the one before it and the rest of its bytes.
2. Runs are exchanged by a hash of the gram, since suffixes of unequal grams share no window.
3. Each bucket merges its runs with a loser tree.  Every loser remembers the prefix that it shares with the winner
   it lost to, so a comparison starts behind what is known to agree and no byte of a known prefix is compared again.
4. The merge gives the shared prefixes of neighbours.  A window that starts o bytes before its anchor is repeated when
   another suffix of its neighbourhood with at least 200 - o shared bytes has the same o bytes before it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .token_files import scratch
from .words import _BYTES, mix, powers, raw_texts, windows

LENGTH = 200
GRAM = 40
BUCKETS = 2048
RUN_BYTES = 48 << 20
BROADCAST_ROWS = 2_000_000

_U = np.uint64
_odd = int(powers(2)[1])
_INVERSE = pow(_odd, -1, 1 << 64)
_inverses = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        steps = np.full(max(1024, 1 << int(n - 1).bit_length()), _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _inverses = np.cumprod(steps, dtype=np.uint64)
    return _inverses[:n]


class Segments:
    """Anchors of a run of texts and the windows that belong to each.

    ``doc``, ``anchor``, ``lo``, ``hi``: document, anchor, first and last window start (offsets in the document);
    ``gram``: hash of the anchor's gram.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        n = len(raw)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * powers(max(n, 1))[:n], out=sums[1:])
        inverse = _inverse_powers(n + 1)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        starts = np.repeat(bounds[:-1], np.diff(bounds))
        at = np.arange(n)
        span = length - gram + 1
        bits = _U(max(n, 2).bit_length())
        key = np.full(n + span, _U(0xFFFFFFFFFFFFFFFF))
        if n >= gram:
            hashes = mix((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
            inside = at[: n - gram + 1] + gram <= ends[: n - gram + 1]
            ordered = ((hashes >> bits) << bits) | at[: n - gram + 1].astype(np.uint64)
            key[: n - gram + 1] = np.where(inside, ordered, key[: n - gram + 1])
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width : span - width + n])
        valid = np.flatnonzero(at + length <= ends)
        anchors = (least[valid] & ((_U(1) << bits) - _U(1))).astype(np.int64)
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(valid))[: len(first)] - 1
        lo, hi, anchor = valid[first], valid[last], anchors[first]
        base = starts[lo] if len(lo) else lo
        self.doc = np.searchsorted(bounds[1:], lo, side="right")
        self.anchor, self.lo, self.hi = anchor - base, lo - base, hi - base
        self.gram = mix((sums[anchor + gram] - sums[anchor]) * inverse[anchor])


_SEGMENT = "g long, d long, at int, back short, span short"


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("d").to_numpy()
        for lo, hi in windows(batch.column("text")):
            s = Segments(*raw_texts(batch.column("text").slice(lo, hi - lo)))
            yield pa.RecordBatch.from_arrays([
                pa.array(s.gram.view(np.int64)), pa.array(names[lo + s.doc]), pa.array(s.anchor.astype(np.int32)),
                pa.array((s.anchor - s.lo).astype(np.int16)), pa.array((s.hi - s.lo).astype(np.int16)),
            ], ["g", "d", "at", "back", "span"])


# ---- runs -------------------------------------------------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are not compared."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    return known + len(commonprefix((a[known:n], b[known:n])))


def front_coded(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefixes, rest lengths, rests) of ascending entries."""
    shared, rests, before = [], [], b""
    for entry in entries:
        k = shared_prefix(before, entry)
        shared.append(k)
        rests.append(entry[k:])
        before = entry
    return np.array(shared, "<u2"), np.array([len(r) for r in rests], "<u2"), b"".join(rests)


class Run:
    """Cursor over a front-coded run; ``shared`` is the prefix that the entry shares with the one before."""

    def __init__(self, number: int, shared: bytes, sizes: bytes, rests: bytes):
        self.number = number
        self._shared = np.frombuffer(shared, "<u2").tolist()
        self._sizes = np.frombuffer(sizes, "<u2").tolist()
        self._rests, self._at, self.place = rests, 0, -1
        self.entry: bytes | None = b""
        self.shared = 0

    def advance(self) -> bool:
        self.place += 1
        if self.place == len(self._shared):
            self.entry = None
            return False
        self.shared = self._shared[self.place]
        end = self._at + self._sizes[self.place]
        self.entry = self.entry[: self.shared] + self._rests[self._at : end]
        self._at = end
        return True


def merged(runs: list[Run]) -> Iterator[tuple[Run, int, bytes, int]]:
    """(run, place, entry, prefix shared with the entry before) in ascending order.

    ``known[i]``: prefix that cursor i shares with the last entry given out.  Both sides of a match were compared with
    that entry.  The one that shares more with it comes first, and only at equal numbers are bytes read, behind
    the known prefix.  A loser keeps its shared prefix with the winner.
    """
    live = [r for r in runs if r.advance()]
    k = len(live)
    if not k:
        return
    known = [0] * k
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if live[b].entry is None:
            return a, b
        if live[a].entry is None:
            return b, a
        if known[a] != known[b]:  # the loser's prefix shared with the winner is the smaller number, its own
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = live[a].entry, live[b].entry
        n = shared_prefix(x, y, known[a])
        win, lose = (a, b) if x[n : n + 1] <= y[n : n + 1] else (b, a)
        known[lose] = n
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    top = build(1) if k > 1 else 0
    before = 0
    while live[top].entry is not None:
        run = live[top]
        yield run, run.place, run.entry, before
        if run.advance():
            known[top] = run.shared
        node, current = (top + k) // 2, top
        while node >= 1:
            win, lose = play(current, loser[node])
            loser[node], current = lose, win
            node //= 2
        top = current
        before = known[top]


# ---- jobs -------------------------------------------------------------------------------------------------------

_RUN_KIND = "run long, bucket int, shared binary, sizes binary, rests binary, lefts binary, left_sizes binary, spans binary, counts binary"
_MEMBER_KIND = "run long, bucket int, place int, d long, at int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs per bucket, with the members of every entry.

    An entry is a suffix (anchor to the end of its windows), the bytes before the anchor, and its window range.
    """
    partition = TaskContext.get().partitionId()
    entries: dict[int, dict] = {}
    size = number = 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal entries, size, number
        run = (partition << 24) + number
        number += 1
        rows = []
        for bucket in sorted(entries):
            keys = sorted(entries[bucket])
            shared, sizes, rests = front_coded([k[0] for k in keys])
            members = [entries[bucket][k] for k in keys]
            rows.append((
                run, bucket, shared.tobytes(), sizes.tobytes(), rests, b"".join(k[1] for k in keys), np.array([len(k[1]) for k in keys], "<u2").tobytes(),
                np.array([k[2] for k in keys], "<i4").tobytes(), np.array([len(m) for m in members], "<i8").tobytes(),
                np.array([p for p, m in enumerate(members) for _ in m], np.int32), np.array([d for m in members for d, _ in m], np.int64),
                np.array([a for m in members for _, a in m], np.int32),
            ))
        entries, size = {}, 0
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[j] for r in part], k) for j, k in enumerate(kinds)],
                 *[pa.array([r[j].tolist() for r in part], pa.list_(k)) for j, k in ((9, pa.int32()), (10, pa.int64()), (11, pa.int32()))]],
                ["run", "bucket", "shared", "sizes", "rests", "lefts", "left_sizes", "spans", "counts", "places", "ds", "ats"],
            )

    for batch in batches:
        raws = batch.column("raw")
        for i, (d, ats, backs, spans) in enumerate(zip(batch.column("d").to_pylist(), *(batch.column(c).to_pylist() for c in ("ats", "backs", "spans")))):
            text = raws[i].as_buffer().to_pybytes()
            for at, back, span in zip(ats, backs, spans):
                suffix, left = text[at : at - back + span + LENGTH], text[at - back : at]
                bucket = zlib.crc32(suffix[:GRAM]) % BUCKETS
                key = (suffix, left[::-1], span)
                found = entries.setdefault(bucket, {}).setdefault(key, [])
                if not found:
                    size += len(suffix) + len(left)
                found.append((d, at))
                size += 60
            if size > RUN_BYTES * 4:
                yield from packed()
    if entries:
        yield from packed()


def repeated_windows(entries: list[tuple[bytes, bytes, int]], copies: list[int], shared: list[int]) -> list[list[tuple[int, int]]]:
    """Per distinct entry (suffix, reversed left bytes, windows - 1), in order and with the prefixes shared by
    neighbours: the ranges of window offsets (bytes before the anchor) that occur elsewhere too."""
    whole = [[(len(left) - spread, len(left))] for _, left, spread in entries]
    if len(entries) == 1:
        return whole if copies[0] > 1 else [[]]
    seen: dict[tuple, int] = {}
    stretch: dict[int, list[int]] = {}
    for i, (_, left, spread) in enumerate(entries):
        for o in range(len(left) - spread, len(left) + 1):
            if o not in stretch:  # neighbours that share the bytes of such a window behind the anchor
                numbers, number = [], 0
                for k in shared:
                    number += k < LENGTH - o
                    numbers.append(number)
                stretch[o] = numbers
            key = (o, stretch[o][i], left[:o])
            seen[key] = seen.get(key, 0) + copies[i]
    out = []
    for i, (_, left, spread) in enumerate(entries):
        if copies[i] > 1:
            out.append(whole[i])
            continue
        ranges: list[tuple[int, int]] = []
        for o in range(len(left) - spread, len(left) + 1):
            if seen[(o, stretch[o][i], left[:o])] > 1:
                if ranges and ranges[-1][1] == o - 1:
                    ranges[-1] = (ranges[-1][0], o)
                else:
                    ranges.append((o, o))
        out.append(ranges)
    return out


def _merge_bucket(rows: list[tuple]) -> Iterator[tuple]:
    """(run, bucket, place, first offset, last offset) of repeated windows."""
    runs, extra = [], {}
    for run, bucket, shared, sizes, rests, lefts, left_sizes, spans, counts in rows:
        runs.append(Run(run, shared, sizes, rests))
        ends = np.cumsum(np.frombuffer(left_sizes, "<u2").astype(np.int64)).tolist()
        extra[run] = (lefts, [0, *ends], np.frombuffer(spans, "<i4").tolist(), np.frombuffer(counts, "<i8").tolist())
    bucket = rows[0][1]
    group: dict[tuple, int] = {}  # distinct entries in order
    copies, shared_of, names = [], [], []

    def closed():
        found = repeated_windows(list(group), copies, shared_of)
        for run, place, i in names:
            for lo, hi in found[i]:
                yield run, bucket, place, lo, hi

    least = 0  # prefix shared with the last new entry
    for run, place, entry, shared in merged(runs):
        least = min(least, shared) if group else 0
        if group and shared < GRAM:
            yield from closed()
            group, copies, shared_of, names = {}, [], [], []
        lefts, ends, spans, counts = extra[run.number]
        key = (entry, lefts[ends[place] : ends[place + 1]], spans[place])
        if key not in group:
            group[key] = len(group)
            copies.append(0)
            shared_of.append(least if len(copies) > 1 else 0)
            least = len(entry)
        copies[group[key]] += counts[place]
        names.append((run.number, place, group[key]))
    if group:
        yield from closed()


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive one after the other."""
    rows: list[tuple] = []
    found: list[tuple] = []

    def packed():
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], k) for j, k in enumerate(kinds)], ["run", "bucket", "place", "first", "last"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("run", "bucket", "shared", "sizes", "rests", "lefts", "left_sizes", "spans", "counts"))):
            if rows and rows[0][1] != row[1]:
                found.extend(_merge_bucket(rows))
                rows = []
                if len(found) > 100_000:
                    yield packed()
                    found = []
            rows.append(row)
    if rows:
        found.extend(_merge_bucket(rows))
    if found:
        yield packed()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeated bytes."""
    for batch in batches:
        out = []
        los, his, raws = batch.column("los"), batch.column("his"), batch.column("raw")
        for i in range(batch.num_rows):
            raw = np.frombuffer(raws[i].as_buffer(), dtype=np.uint8)
            marks = np.zeros(len(raw) + 1, dtype=np.int64)
            if los[i].is_valid and len(los[i].values):
                np.add.at(marks, los[i].values.to_numpy(), 1)
                np.add.at(marks, his[i].values.to_numpy(), -1)
            gone = np.cumsum(marks)[:-1] > 0
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
            kept = raw[~gone].tobytes()
            out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping ranges of a text become one."""
    for batch in batches:
        rows = []
        for los, his in zip(batch.column("los"), batch.column("his")):
            lo, hi = los.values.to_numpy(), his.values.to_numpy()
            order = np.argsort(lo, kind="stable")
            lo, reach = lo[order], np.maximum.accumulate(hi[order])
            new = np.ones(len(lo), dtype=bool)
            new[1:] = lo[1:] > reach[:-1]
            rows.append((lo[new].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(lo)) - 1].tolist()))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["d", "los", "his"])


def _sized(df: DataFrame) -> DataFrame:
    """With a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(d, los, his): disjoint byte ranges that repeat, of every text ``raw`` that has some."""
    spark = rows.sparkSession
    segments = rows.select("d", F.col("raw").cast("string").alias("text")).mapInArrow(_segmented, _SEGMENT)
    grams = segments.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    shared = segments.join(grams, "g")
    wanted = cut_lineage(shared.groupBy("d").agg(F.collect_set(F.struct("at", "back", "span")).alias("s")).select(
        "d", F.col("s.at").alias("ats"), F.col("s.back").alias("backs"), F.col("s.span").alias("spans")
    ))
    # Every row of a text that repeats is an occurrence of its own, so rows are not made distinct here.
    path = scratch(spark, "suffixes")
    ready = rows.select("d", "raw").join(_sized(wanted.select("d")), "d", "left_semi").join(wanted, "d")
    kind = f"{_RUN_KIND}, places array<int>, ds array<long>, ats array<int>"
    ready.mapInArrow(_runs, kind).write.option("compression", "zstd").parquet(path)
    runs = spark.read.parquet(path)
    columns = ["run", "bucket", "shared", "sizes", "rests", "lefts", "left_sizes", "spans", "counts"]
    found = runs.select(columns).repartition("bucket").sortWithinPartitions("bucket", "run").mapInArrow(
        _merging, "run long, bucket int, place int, first int, last int"
    )
    members = runs.select("run", "bucket", F.explode(F.arrays_zip("places", "ds", "ats")).alias("m")).select(
        "run", "bucket", F.col("m.places").alias("place"), F.col("m.ds").alias("d"), F.col("m.ats").alias("at")
    )
    spans = members.join(found, ["run", "bucket", "place"]).select(
        "d", (F.col("at") - F.col("last")).alias("lo"), (F.col("at") - F.col("first") + LENGTH).alias("hi")
    )
    gathered = spans.groupBy("d").agg(F.collect_set(F.struct("lo", "hi")).alias("s")).select("d", F.col("s.lo").alias("los"), F.col("s.hi").alias("his"))
    return cut_lineage(gathered.mapInArrow(_joined, "d long, los array<int>, his array<int>"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"), F.xxhash64(id_col, text_col).alias("d"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Every byte goes that lies in a 200-byte string which also starts elsewhere in the input, in the same text or
    another; strings never cross texts.  Null and empty texts have no bytes.  Rows that repeat are occurrences of their
    own, so texts of 200 bytes or more that occur twice vanish whole.  Other columns are ignored; an empty table gives
    no rows.  ``kept`` holds the remaining bytes (which may be cut inside a character).
    """
    rows = _named(docs, id_col, text_col)
    spans = repeated_spans(rows)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.join(_sized(spans), "d", "left").select("doc_id", "raw", "los", "his").mapInArrow(_cut, kind)
