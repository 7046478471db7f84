"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), which is linear in the
number of features.  Features are made by one numpy pass per Arrow batch over whole texts; the model is fitted in one
task on at most ``fit_rows`` labelled rows (those with the smallest hashes, so every size takes a fair share of all
labels) and has a fixed size, so that it can travel with the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, raw_texts, windows

FIT_ROWS = 6000
HASHED = 1 << 13
FACTORS = 8
THRESHOLD = 0.7

STATS = (
    "words", "upper", "digits", "symbols", "stops", "lines", "beyond_ascii", "word_length", "distinct", "top_word",
    "symbol_words", "bars", "metadata_known", "metadata_chars", "metadata_off",
)
BIAS = HASHED + len(STATS)

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91] = 1  # upper
_KIND[48:58] = 2  # digit
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3  # symbol
_KIND[[ord("."), ord(","), ord("'"), ord("-")]] = 4  # stop
_KIND[10] = 5  # line end
_KIND[128:] = 6


def bucket(key: Column, parts: int) -> Column:
    """crc32 of an id as text modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def _per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, feature numbers and values; feature numbers of a row are distinct."""
    raw, bounds = raw_texts(texts)
    w = Words(raw, bounds)
    docs, counts = len(texts), w.counts
    kind = _KIND[raw]
    size = np.maximum(np.diff(bounds), 1).astype(np.float64)
    share = {k: _per_document(kind == k, bounds) / size for k in range(1, 7)}

    owner = np.repeat(np.arange(docs), counts)
    hashes = w.hashes()
    key = owner.astype(np.int64) * HASHED + (hashes & np.uint64(HASHED - 1)).astype(np.int64)
    pairs, times = np.unique(key, return_counts=True)
    doc, feature = pairs // HASHED, pairs % HASHED
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=docs))
    value = value / np.maximum(norm, 1e-9)[doc]

    n = np.maximum(counts, 1).astype(np.float64)
    last = w.text[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
    symbol_end = (_KIND[last] == 3).astype(np.float64)
    top = np.zeros(docs)
    np.maximum.at(top, doc, times)
    chars = size - _per_document((raw & 0xC0) == 0x80, bounds)
    known = np.asarray(n_chars.is_valid().to_numpy(zero_copy_only=False), dtype=np.float64)
    told = np.maximum(n_chars.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
    stats = np.stack([
        np.log1p(counts) / 8, share[1] * 3, share[2] * 3, share[3] * 5, share[4] * 5, share[5] * 10, share[6] * 2,
        np.minimum((np.diff(bounds) / n) / 10, 3), np.bincount(doc, minlength=docs) / n, top / n * 2,
        np.bincount(owner, weights=symbol_end, minlength=docs) / n * 2, _per_document(raw == ord("|"), bounds) / n * 2,
        known, np.log1p(told) / 10, known * np.minimum(np.abs(np.log1p(told) - np.log1p(chars)), 3),
    ], axis=1)
    row = np.concatenate([doc, np.repeat(np.arange(docs), len(STATS))])
    number = np.concatenate([feature, np.tile(np.arange(HASHED, HASHED + len(STATS)), docs)])
    values = np.concatenate([value, stats.ravel()])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(docs + 1)), number[order].astype(np.int32), values[order]


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, bounds: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every row has its statistics, so no row is empty."""
        v = self.factors[number] * value[:, None]
        pairs = np.add.reduceat(v, bounds[:-1]) ** 2 - np.add.reduceat(v * v, bounds[:-1])
        return self.bias + np.add.reduceat(self.linear[number] * value, bounds[:-1]) + 0.5 * pairs.sum(axis=1)

    def score(self, *row) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(*row), -30, 30)))


def constant(rate: float) -> Model:
    rate = min(max(rate, 1e-12), 1 - 1e-12)
    return Model(float(np.log(rate / (1 - rate))), np.zeros(BIAS), np.zeros((BIAS, FACTORS)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 12, rate: float = 0.02,
        batch: int = 64, decay: float = 1e-5, seed: int = 7) -> Model:
    """Adam on the logistic loss.  Without labels every score is 1, with labels of one class it is their smoothed rate."""
    if not len(labels):
        return constant(1.0)
    if labels.min() == labels.max():
        return constant((labels.sum() + 1) / (len(labels) + 2))
    random = np.random.default_rng(seed)
    p = np.zeros((BIAS, FACTORS + 1))
    p[:, 1:] = random.normal(0, 0.05, (BIAS, FACTORS))
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    m, s, step = np.zeros_like(p), np.zeros_like(p), 0
    mb = sb = 0.0
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for lo in range(0, len(order), batch):
            chosen = order[lo:lo + batch]
            number = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            sizes = np.array([len(rows[i][0]) for i in chosen])
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = p[number, 1:] * value[:, None]
            sums = np.add.reduceat(v, start)
            raw = bias + np.add.reduceat(p[number, 0] * value, start)
            raw += 0.5 * (sums**2 - np.add.reduceat(v * v, start)).sum(axis=1)
            off = 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]
            g = np.repeat(off / len(chosen), sizes) * value
            grad = np.empty((len(number), FACTORS + 1))
            grad[:, 0] = g
            grad[:, 1:] = g[:, None] * (np.repeat(sums, sizes, axis=0) - v)
            used, where = np.unique(number, return_inverse=True)
            total = np.stack([np.bincount(where, weights=grad[:, j]) for j in range(FACTORS + 1)], axis=1) + decay * p[used]
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * total
            s[used] = 0.999 * s[used] + 0.001 * total**2
            p[used] -= rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-8)
            gb = off.mean()
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
    return Model(bias, p[:, 0].copy(), p[:, 1:].copy())


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in windows(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            bounds, number, value = features(part.column("text"), part.column("chars"))
            yield pa.RecordBatch.from_arrays([
                part.column("key"), part.column("label"),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(number, pa.int32())),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value, pa.float64())),
            ], ["key", "label", "number", "value"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for key, label, number, value in zip(
            batch.column("key").to_pylist(), batch.column("label").to_pylist(), batch.column("number"), batch.column("value")
        ):
            rows.append((key, label, number.values.to_numpy(), value.values.to_numpy()))
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    model = fit([r[2:] for r in rows], np.array([r[1] for r in rows], dtype=np.float64))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.bias]), pa.array([model.linear.tobytes()]), pa.array([model.factors.tobytes()])],
        ["bias", "linear", "factors"],
    )


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          chars_col: str | None = "n_chars", held_out: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows that are not held out; ids, languages and sources are no features.

    Null labels and null ids are left out.  At most ``fit_rows`` rows are fitted, those with the smallest id hashes.
    """
    held_out = (bucket(F.col("key"), 4) == 2) if held_out is None else held_out
    marks = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("double").alias("label")).filter(
        F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out
    )
    chosen = marks.orderBy(F.xxhash64("key"), "key", "label").limit(fit_rows)
    chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), chars.alias("chars"))
    rows = (
        texts.join(chosen, "key").select("key", "label", "text", "chars")
        .mapInArrow(_featured, "key long, label double, number array<int>, value array<double>")
        .orderBy(F.xxhash64("key"), "key").limit(fit_rows)  # an id that repeats adds rows
    )
    row = rows.repartition(1).mapInArrow(_fitted, "bias double, linear binary, factors binary").first()
    linear, factors = (np.frombuffer(row[c], dtype=np.float64) for c in ("linear", "factors"))
    return Model(row["bias"], linear, factors.reshape(BIAS, FACTORS))


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
           carry: list[str] = ()) -> DataFrame:
    """``carry`` columns as the struct ``row`` (null if none), doc_id and score of every row; null texts count as empty."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in windows(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                score = model.score(*features(part.column("text"), part.column("chars")))
                rest = [part.column(n) for n in ("row", "doc_id") if n in part.schema.names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*(["row"] if carry else []), "doc_id", "score"])

    chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    taken = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    rows = docs.select(*taken, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), chars.alias("chars"))
    fields = [f"row {rows.schema['row'].dataType.simpleString()}"] if carry else []
    return rows.mapInArrow(scored, ", ".join([*fields, "doc_id long", "score double"]))


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from ``threshold`` on).  An empty table gives no rows."""
    out = scores(docs, train(docs, labels, **options))
    return out.select(
        "doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` with a score from ``threshold`` on, all columns as they are."""
    return scores(docs, train(docs, labels, **options), carry=docs.columns).filter(F.col("score") >= threshold).select("row.*")
