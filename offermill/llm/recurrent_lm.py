"""Gated recurrent language model over whole documents, in numpy inside Spark tasks.

Words get ids by their counts over all training documents.  The output is factored into classes: a softmax over
classes, then the word within its class.  The ``HEAD`` most frequent words fill classes of ``SPAN`` words with
softmaxes of their own that see the state; further known words are classed by the magnitude of their count and
distributed inside a class by (count + 1); all words outside the ``KNOWN`` table, unseen ones included, form the last
class, inside which the count comes by a join.  So every word has its own probability and they sum to one.

Training: a short warm-up on a bounded sample gives all tasks one start; then every task runs truncated
backpropagation over all of its training documents, and the tasks' parameters are averaged by tokens in a tree.  States
run on across windows inside a document, in training (without gradient) and in scoring, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .factorization import bucket
from .token_files import scratch
from .words import lean, windows, word_runs

HIDDEN = 20
SPAN = 32
HEAD = 1024
KNOWN = 200_000
STEPS = 24
LANES = 256
RATE = 0.01
SLICE_BYTES = 4 << 20  # of text that a task lays out at a time, however many rows its batches have
SLOT_BITS = 19
SUMMED = 16
WARM_DOCUMENTS = 512
WARM_TOKENS = 300_000
END = -7046029254386353131  # stands for the end of a document among the word hashes


def _slot(hashes: np.ndarray) -> np.ndarray:
    """The leading bits, in the order of the signed hashes."""
    return ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Known words, sorted by hash, with ids by rank; fixed size."""

    hashes: np.ndarray
    ids: np.ndarray  # rank by count
    counts: np.ndarray  # by rank
    kinds: np.ndarray  # class by rank
    inner: np.ndarray  # log10 probability inside the class, by rank (0 for head words)
    head: int
    classes: int
    other_mass: float
    total: int
    distinct: int

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, head: int = HEAD) -> Vocabulary:
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        n = len(counts)
        head = min(head, n) // SPAN * SPAN
        kinds = np.arange(n) // SPAN
        groups = head // SPAN
        size = np.log2(counts[head:] + 1).astype(np.int64)
        used, place = np.unique(size, return_inverse=True)
        kinds[head:] = groups + place
        mass = np.bincount(place, weights=counts[head:] + 1.0, minlength=len(used))
        inner = np.zeros(n)
        inner[head:] = np.log10((counts[head:] + 1.0) / mass[place])
        by_hash = np.argsort(hashes)
        other = float(total - counts.sum() + distinct - n + 1)
        return Vocabulary(hashes[by_hash], by_hash.astype(np.int64), counts, kinds, inner, head, groups + len(used) + 1, other, total, distinct)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Ids, -1 for words outside."""
        out = np.full(len(hashes), -1)
        slot = _slot(hashes)
        at, end, asked = self.slots[slot], self.slots[slot + 1], np.arange(len(hashes))
        while len(asked):
            some = np.flatnonzero(at < end)
            at, end, asked = at[some], end[some], asked[some]
            hit = self.hashes[at] == hashes[asked]
            out[asked[hit]] = self.ids[at[hit]]
            at, end, asked = at[~hit] + 1, end[~hit], asked[~hit]
        return out

    @cached_property
    def slots(self) -> np.ndarray:
        """Where the words of each range of hashes begin."""
        return np.searchsorted(_slot(self.hashes), np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the input table: head words by themselves, others by class; the last row begins a document."""
        groups = self.head // SPAN
        return np.where((ids >= 0) & (ids < self.head), ids, self.head + self.kind(ids) - groups)

    def kind(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.kinds):
            return np.zeros(len(ids), dtype=np.int64)
        return np.where(ids >= 0, self.kinds[np.maximum(ids, 0)], self.classes - 1)

    @property
    def begin(self) -> int:
        return self.head + self.classes - self.head // SPAN


def _log_softmax(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural log probability of one row per column; ``logits`` becomes the gradient of its negative."""
    logits -= logits.max(axis=0)
    columns = np.arange(len(chosen))
    out = logits[chosen, columns]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    out -= np.log(total)
    logits /= total
    logits[chosen, columns] -= 1
    return out


class Model:
    """GRU with one-hot inputs: gates (reset, update, new) = X[word] + h U; h' = (1 - update) new + update h."""

    NAMES = ("X", "U", "C", "c", "W", "w")

    def __init__(self, v: Vocabulary, seed: int = 11, hidden: int = HIDDEN):
        random = np.random.default_rng(seed)
        groups = v.head // SPAN
        self.v, self.hidden = v, hidden
        self.p = {
            "X": random.normal(0, 0.1, (v.begin + 1, 3 * hidden)), "U": random.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "C": random.normal(0, 0.1, (hidden, v.classes)), "c": np.zeros(v.classes),
            "W": random.normal(0, 0.1, (groups, hidden, SPAN)), "w": np.zeros((groups, SPAN)),
        }
        mass = np.full(v.classes, 1.0)
        mass[-1] += v.other_mass
        if len(v.counts):
            mass += np.bincount(v.kinds, weights=v.counts, minlength=v.classes)
            self.p["w"] = np.log(v.counts[: v.head].reshape(groups, SPAN) + 1.0)
        self.p["c"] = np.log(mass / mass.sum())
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.memory = None

    def pack(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES]).astype("<f4").tobytes()

    def load(self, data: bytes) -> Model:
        flat, at = np.frombuffer(data, "<f4"), 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).copy()
            at += n
        return self

    def run(self, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States of a window [steps, lanes], with what the way back needs; ``keep`` is 0 where a document begins."""
        n, u = self.hidden, self.parts()
        x = self.p["X"][inputs].reshape(*inputs.shape, 3, n).transpose(0, 2, 1, 3).copy()  # [steps, gate, lanes, hidden]
        x[:, :2] *= -1  # sigmoid(a) = 1 / (1 + exp(-a))
        u[:2] *= -1
        before, inner, new, states = np.empty((4, *inputs.shape, n), dtype=np.result_type(x, h))
        gates = np.empty((len(inputs), 2, *states.shape[1:]), dtype=states.dtype)
        with np.errstate(over="ignore"):  # 1 / inf is 0
            for t in range(len(inputs)):
                b, gate, w = before[t], gates[t], new[t]
                b[:] = h
                b[keep[t] == 0] = 0
                g = b @ u
                inner[t] = g[2]
                np.add(x[t, :2], g[:2], out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(gate[0], g[2], out=w)
                w += x[t, 2]
                np.tanh(w, out=w)
                h = states[t]
                np.subtract(b, w, out=h)
                h *= gate[1]
                h += w
        return states, (before, inner, gates, new)

    def parts(self) -> np.ndarray:
        """U as one matrix for each of reset, update and new."""
        return self.p["U"].reshape(self.hidden, 3, self.hidden).transpose(1, 0, 2).copy()

    def outputs(self, states: np.ndarray, kinds: np.ndarray, ids: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of class and head word, and the gradient of their negative sum by the states."""
        e = self.p["C"].T @ states.T  # [classes, tokens]: sums over classes run along memory
        e += self.p["c"][:, None]
        out, back = _log_softmax(e, kinds), None
        if grad is not None:
            grad["C"], grad["c"] = (e @ states).T, e.sum(axis=1)
            back = (self.p["C"] @ e).T
            grad["W"], grad["w"] = np.zeros_like(self.p["W"]), np.zeros_like(self.p["w"])
        inside = np.flatnonzero(kinds < self.v.head // SPAN)
        order = inside[np.argsort(kinds[inside].astype(np.min_scalar_type(self.v.classes)), kind="stable")]
        if not len(order):
            return out, back
        of, s = kinds[order], states[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        runs = list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)]))
        e = np.empty((SPAN, len(of)), dtype=states.dtype)
        for k, lo, hi in runs:
            np.matmul(self.p["W"][k].T, s[lo:hi].T, out=e[:, lo:hi])
        e += self.p["w"][of].T
        out[order] += _log_softmax(e, ids[order] - of * SPAN)
        if grad is not None:
            more = np.empty_like(s)
            for k, lo, hi in runs:
                part = e[:, lo:hi]
                np.matmul(s[lo:hi].T, part.T, out=grad["W"][k])
                np.matmul(part.T, self.p["W"][k].T, out=more[lo:hi])
            grad["w"][of[first]] = np.add.reduceat(e, first, axis=1).T
            back[order] += more
        return out, back

    def gradients(self, inputs, keep, h, mask, kinds, ids) -> tuple[dict, np.ndarray, float]:
        """Of the negative log probability of one window (truncated there), with the last state and the sum."""
        n, u = self.hidden, self.parts().transpose(0, 2, 1).copy()
        states, (before, inner, gates, new) = self.run(inputs, keep, h)
        grad: dict = {}
        live = np.flatnonzero(mask.ravel())
        out, back = self.outputs(states.reshape(-1, n)[live], kinds.ravel()[live], ids.ravel()[live], grad)
        d_states = np.zeros((inputs.size, n), dtype=states.dtype)
        d_states[live] = back
        d_states = d_states.reshape(states.shape)
        r, z = gates[:, 0], gates[:, 1]
        by_new, by_z, by_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), inner * r * (1 - r)
        d_new, d_g = np.empty_like(states), np.empty((len(inputs), 3, *states.shape[1:]), dtype=states.dtype)
        d_h = np.zeros_like(states[0])
        for t in range(len(inputs) - 1, -1, -1):
            d, g, w = d_states[t], d_g[t], d_new[t]
            d += d_h
            np.multiply(d, by_new[t], out=w)
            np.multiply(w, by_r[t], out=g[0])
            np.multiply(d, by_z[t], out=g[1])
            np.multiply(w, r[t], out=g[2])
            back = g @ u
            d_h = back[0]
            d_h += back[1]
            d_h += back[2]
            d *= z[t]
            d_h += d
            d_h[keep[t] == 0] = 0
        flat = before.reshape(-1, n).T
        grad["U"] = np.concatenate([flat @ d_g[:, k].reshape(-1, n) for k in range(3)], axis=1)
        d_g[:, 2] = d_new  # now by the inputs
        d_x = d_g.transpose(0, 2, 1, 3).reshape(-1, 3 * n)
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.min_scalar_type(self.v.begin)), kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        grad["X"] = (flat[first], np.add.reduceat(d_x[order], first))
        return grad, states[-1], float(out.sum())

    def step(self, grad: dict, tokens: int, rate: float) -> None:
        """Adagrad with clipped gradients per token."""
        if self.memory is None:
            self.memory = {k: np.full_like(a, 1e-4) for k, a in self.p.items()}
        scale = 1.0 / max(tokens, 1)
        rows, d_x = grad.pop("X")
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()) + float((d_x * d_x).sum())) * scale
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        for k, g in grad.items():
            g = g * scale
            self.memory[k] += g * g
            self.p[k] -= rate * g / np.sqrt(self.memory[k])
        g = d_x * scale
        self.memory["X"][rows] += g * g
        self.p["X"][rows] -= rate * g / np.sqrt(self.memory["X"][rows])


class Lanes:
    """Documents laid out one behind the other on parallel lanes, window by window."""

    def __init__(self, v: Vocabulary, ids: np.ndarray, bounds: np.ndarray, lanes: int = LANES):
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        lanes = max(1, min(lanes, len(sizes)))
        parts: list[list[int]] = [[] for _ in range(lanes)]
        load = np.zeros(lanes, dtype=np.int64)
        for lo in range(0, len(order), lanes):  # longest documents to the shortest lanes
            group = order[lo : lo + lanes]
            for lane, doc in zip(np.argsort(load, kind="stable").tolist(), group.tolist()):
                parts[lane].append(doc)
                load[lane] += sizes[doc]
        rank = np.argsort(-load, kind="stable")
        self.size = load[rank]
        docs = np.array([d for lane in rank.tolist() for d in parts[lane]], dtype=np.int64)
        reps = sizes[docs]
        ends = np.cumsum(reps)
        self.flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(bounds[docs] - (ends - reps), reps)
        self.start = np.cumsum(self.size) - self.size
        self.ids, self.kinds = ids, v.kind(ids)
        previous = np.empty(len(ids), dtype=np.int64)
        previous[1:] = v.inputs(ids)[:-1]
        begins = bounds[:-1][sizes > 0]
        previous[begins] = v.begin
        self.previous = previous
        self.keep = np.ones(len(ids), dtype=np.float32)
        self.keep[begins] = 0

    def windows(self, steps: int = STEPS) -> Iterator[tuple]:
        """(token positions [steps, live lanes], mask) until all lanes end; lanes only ever leave at the end."""
        at = 0
        longest = int(self.size[0]) if len(self.size) else 0
        while at < longest:
            live = int(np.searchsorted(-self.size, -at, side="left"))
            steps_now = min(steps, longest - at)
            offset = at + np.arange(steps_now)[:, None]
            mask = offset < self.size[None, :live]
            place = self.flat[np.where(mask, self.start[None, :live] + offset, self.start[None, :live])]
            yield place, mask
            at += steps_now


def learn(model: Model, lanes: Lanes, rate: float, most: int | None = None) -> int:
    h = np.zeros((len(lanes.size), model.hidden), dtype=np.float32)
    done = 0
    for place, mask in lanes.windows():
        n = place.shape[1]
        grad, h, _ = model.gradients(lanes.previous[place], lanes.keep[place], h[:n], mask, lanes.kinds[place], lanes.ids[place])
        tokens = int(mask.sum())
        model.step(grad, tokens, rate)
        done += tokens
        if most and done >= most:
            break
    return done


def log_probabilities(model: Model, lanes: Lanes) -> np.ndarray:
    """Natural log probability per token (class, and word inside a head class)."""
    out = np.zeros(len(lanes.ids))
    h = np.zeros((len(lanes.size), model.hidden), dtype=np.float32)
    for place, mask in lanes.windows():
        n = place.shape[1]
        states, _ = model.run(lanes.previous[place], lanes.keep[place], h[:n])
        h = states[-1]
        at = place[mask]
        out[at] = model.outputs(states[mask], lanes.kinds[at], lanes.ids[at])[0]
    return out


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end per text, and bounds."""
    parts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, words in word_runs(column):
        parts.append(np.insert(words.hashes().view(np.int64), words.first[1:], END))
        sizes.append(words.counts + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of a batch by ``SLICE_BYTES`` of text, and their texts; a longer text is a slice of its own."""
    for lo, hi in windows(batch.column("text"), SLICE_BYTES):
        yield batch.slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(_tokens(column)[0], return_counts=True) for _, column in _slices(batch)]
        hashes, times = (np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int64)]) for j in (0, 1))
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
        sums = np.add.reduceat(times[order], first) if len(first) else times
        yield pa.RecordBatch.from_arrays([pa.array(hashes[first]), pa.array(sums)], ["h", "c"])


_PARAMETERS = "weight double, total binary"


def _blob(weight: float, total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["weight", "total"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, total = 0.0, None
    for batch in batches:
        for w, data in zip(batch.column("weight").to_pylist(), batch.column("total")):
            part = np.frombuffer(data.as_buffer(), "<f8")
            total = part.copy() if total is None else total + part
            weight += w
    yield from _blob(weight, total)


def _trained(vocabulary: Vocabulary, start: bytes | None, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(vocabulary)
        if start is not None:
            model.load(start)
        done = 0
        for batch in batches:
            if most and done >= most:
                continue
            for _, column in _slices(batch):
                hashes, bounds = _tokens(column)
                lanes = Lanes(vocabulary, vocabulary.look_up(hashes), bounds, 32 if most else LANES)
                done += learn(model, lanes, RATE * (3 if most else 1), most)
        if done:
            yield from _blob(float(done), np.frombuffer(model.pack(), "<f4").astype(np.float64) * done)

    return lean(run)


def _parameters(trained: DataFrame) -> bytes | None:
    """Mean of the tasks' parameters, summed in a tree: a task adds up about ``SUMMED`` of them however many there are."""
    tasks = trained.rdd.getNumPartitions()
    while tasks > SUMMED:
        tasks = -(-tasks // SUMMED)
        trained = trained.repartition(tasks).mapInArrow(_summed, _PARAMETERS)
    row = trained.repartition(1).mapInArrow(_summed, _PARAMETERS).first()
    if row is None:
        return None
    return (np.frombuffer(row["total"], "<f8") / row["weight"]).astype("<f4").tobytes()


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Rows whose crc32(id as text) mod 7 is 2 are held out, a null id counts as empty text.  Words are lower-cased in
    A-Z; every text ends with one end token, which is all that null, empty and blank texts have.  ``base_score`` is the
    add-one unigram score by counts over all training tokens; without training rows every count is 0 and the model is
    the start with all mass on unseen words.  Repeated rows are counted and scored each; an empty table gives no rows.  Words
    are known by 64-bit hashes.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.xxhash64(id_col, text_col).alias("d"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        (bucket(F.col(id_col).cast("long"), 7) == 2).alias("held_out"),
    )
    training = rows.filter("NOT held_out")
    path = scratch(spark, "counts")
    training.select("text").mapInArrow(lean(_counted), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).write.parquet(path)
    counts = spark.read.parquet(path)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "h").limit(known).toArrow()
    v = Vocabulary.build(top.column("h").to_numpy().astype(np.int64), top.column("c").to_numpy().astype(np.int64), int(total), int(distinct))

    sample = training.orderBy(F.xxhash64("d"), "d").limit(WARM_DOCUMENTS).select("text").repartition(1)
    start = _parameters(sample.mapInArrow(_trained(v, None, WARM_TOKENS), _PARAMETERS))
    parameters = _parameters(training.select("text").mapInArrow(_trained(v, start, None), _PARAMETERS))

    stored = scratch(spark, "scored")
    kind = "d long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<long>"
    rows.mapInArrow(_scored(v, parameters), kind).write.parquet(stored)
    scored = spark.read.parquet(stored)
    rare = scored.select("d", F.explode("rare").alias("h")).join(counts, "h", "left")
    sums = rare.groupBy("d").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_logs"), F.count("c").alias("rare_known")
    )
    # Rows of one id and text share their sums.
    alike = F.count(F.lit(1)).over(W.partitionBy("d"))
    out = scored.drop("rare").withColumn("alike", alike).join(sums, "d", "left").fillna(0, ["rare_logs", "rare_known"])
    logs = F.col("rare_logs") / F.col("alike")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known") / F.col("alike")).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def _scored(v: Vocabulary, parameters: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(v)
        if parameters is not None:
            model.load(parameters)
        for batch, column in (part for whole in batches for part in _slices(whole)):
            hashes, bounds = _tokens(column)
            ids = v.look_up(hashes)
            known = ids >= 0
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            n = len(bounds) - 1
            logs = np.log10(v.counts[ids[known]] + 1.0)
            tokens = log_probabilities(model, Lanes(v, ids, bounds)) / np.log(10)
            tokens[known] += v.inner[ids[known]]
            tokens[~known] -= np.log10(v.other_mass)
            rare = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=n))])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("d", "doc_id", "held_out")), pa.array(np.diff(bounds)), pa.array(np.bincount(doc[known], minlength=n)),
                pa.array(np.bincount(doc[known], weights=logs, minlength=n)), pa.array(np.bincount(doc, weights=tokens, minlength=n)),
                pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(hashes[~known])),
            ], ["d", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"])

    return lean(run)
