"""Token files, joins, passages, suffixes, models and chat: brute force, round trips, held-out rows, odd rows."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from offermill.llm import chat, components, factorization, jaccard_join, passages, recurrent_lm, suffix_dedup, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "a b"), (None, None), (6, "x" * 30_000), (7, "é ü\n ß  <|endoftext|> it's")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({n: F.lit(7) for n in ("n", "d", "h", "x", "size", "row", "score", "raw", "start", "shard")})


def small(spark, sf, n=None):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return rows[:n] if n else rows


# ---- token files


def test_encoder_equals_the_tokenizer():
    plain = Tokenizer.from_file(PATH)
    encoder = token_files.Encoder(open(PATH).read())
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", " ", "!", "...", "é", "1", "'s", "\t", "\x1c", "word", " ", "<|endoftext|>", "🙂"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(1500)]
    assert [e.tolist() for e in encoder.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("top", [200, 70_000])
def test_repair_round_trip(top):
    r = np.random.default_rng(4)
    loops = np.tile(r.integers(0, top, 50), 200)
    ids = np.concatenate([loops, np.zeros(999, int), np.minimum(r.zipf(1.3, 20_000), top)]).astype(np.uint32)
    starts = np.unique(np.concatenate([[0], r.integers(0, len(ids), 300)]))
    texts = np.split(ids, starts[1:])
    row = dict(zip([f.name for f in token_files._BLOCK_SCHEMA], token_files._block_row(0, 0, list(range(len(texts))), texts)))
    block = token_files.Block(row)
    assert len(block.symbols) < len(ids) * 0.8 and len(block.rules)
    assert all((a == b).all() for (_, a), b in zip(block.documents(), texts))
    for _ in range(200):
        i = int(r.integers(len(texts)))
        lo, hi = sorted(r.integers(0, len(texts[i]) + 2, 2).tolist())
        assert (block.tokens(i, lo, hi) == texts[i][lo:hi]).all()


def test_token_files(spark, sf):
    rows = small(spark, sf) + [(1000 + (i or 0), t) for i, t in ODD] + [(None, "zz"), (5, "again")]
    got = token_files.encoded(frame(spark, rows), PATH, block_tokens=5000).toPandas()
    plain = Tokenizer.from_file(PATH)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    ids = [e.ids + [0] for e in plain.encode_batch([t or "" for _, t in ordered], add_special_tokens=False)]
    starts = np.cumsum([0] + [len(i) for i in ids])[:-1]
    want = [(d, int(s), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), s, i in zip(ordered, starts, ids)]
    found = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.sort_values("start").itertuples()]
    assert found == want
    assert token_files.encoded(frame(spark, []), PATH).count() == 0


# ---- Jaccard join


def linked(spark, rows):
    out = jaccard_join.clusters(frame(spark, rows).repartition(3)).collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_jaccard_against_brute_force(spark, sf):
    r = random.Random(8)
    rows = small(spark, sf, 120) + ODD
    for i in range(80):  # chains of edits
        w = (rows[i % 20][1] or "").split()
        for _ in range(r.randint(0, 1 + len(w) // 40)):
            w[r.randrange(len(w))] = r.choice(["q", "zz", "y"])
        rows.append((2000 + i, " ".join(w)))
    assert linked(spark, rows) == brute.jaccard_components(rows)


def test_jaccard_large_cells(spark, monkeypatch):
    """Common passages, families of copies and sizes at the threshold, with small limits so that every step runs."""
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(90):
        own = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 8, 15, 60]))]
        rows.append((i, " ".join(common[: r.choice([10, 25, 30])] + own)))
    for i in range(60):
        w = rows[r.randrange(90)][1].split()
        w[r.randrange(len(w))] = "zz"
        rows.append((200 + i, " ".join(w)))
    assert linked(spark, rows) == brute.jaccard_components(rows)


def test_one_per_group(spark):
    rows = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (9, "z"), (None, "z z"), (1, None)]
    df = frame(spark, rows)
    out = jaccard_join.one_per_group(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 9, None]
    assert jaccard_join.clusters(df.limit(0)).count() == 0


# ---- passages


def spans_of(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out


def test_chains_are_optimal_on_small_cases():
    r = random.Random(3)
    for _ in range(200):
        links = sorted({(r.randrange(40), r.randrange(40)) for _ in range(8)})
        best = [0.0] * len(links)
        for i, (x, y) in enumerate(links):
            before = [best[j] - passages.GAP * (x - a + y - b) for j, (a, b) in enumerate(links[:i]) if a < x and b < y]
            best[i] = passages.GAIN + max([0.0, *before])
        found = passages.chains(np.array([x for x, _ in links]), np.array([y for _, y in links]))
        for chain in found:
            assert all(links[a][0] < links[b][0] and links[a][1] < links[b][1] for a, b in zip(chain, chain[1:]))
        if found:
            gain = sum(passages.GAIN for _ in found[0])
            gaps = sum(passages.GAP * (links[b][0] - links[a][0] + links[b][1] - links[a][1]) for a, b in zip(found[0], found[0][1:]))
            assert gain - gaps == pytest.approx(max(best))


def test_passages(spark, sf):
    r = random.Random(6)
    rows = [(i, t) for i, t in small(spark, sf, 100) if t]
    vocabulary = [f"v{i}" for i in range(5000)]
    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, loop = fresh(60), ["of"] * 80
    planted = {}
    for i in range(30):
        w, before = list(passage), fresh(r.randint(0, 90))
        if i % 3 == 1:
            w[r.randrange(5, 55)] = "edited"
        if i % 3 == 2:
            del w[r.randrange(5, 55)]
        planted[3000 + i] = (len(before), len(before) + len(w))
        rows.append((3000 + i, " ".join(before + w + fresh(r.randint(0, 90)))))
    rows += [(4000, " ".join(loop)), (4001, " ".join(fresh(9) + loop)), (4002, " ".join(fresh(300)))] + ODD
    got = spans_of(passages.repeats(frame(spark, rows)))
    for doc, (lo, hi) in planted.items():
        assert len(set(range(lo, hi)) - got[doc]) <= 6 and len(got[doc]) <= hi - lo + 6
    assert not got[4002]
    exact = brute.shared_words(rows, 50)
    missed = sum(len(s - got[d]) for d, s in exact.items() if d is not None)
    assert missed <= 0.01 * sum(map(len, exact.values()))
    loose = brute.shared_words(rows, 12)
    assert all(loose[d] for d in got if got[d])
    assert passages.repeats(frame(spark, [])).count() == 0


def test_passages_hash_a_document_once(monkeypatch):
    """Chains of one document side by side share its word hashes, with the cuts each would have alone."""
    seen, real = [], passages.Words
    monkeypatch.setattr(passages, "Words", lambda raw, bounds: seen.append(len(raw)) or real(raw, bounds))
    texts = [" ".join(f"{name}{i}" for i in range(900)) for name in "ab"]
    at = [[k, k + 20] for k in range(0, 800, 20)]
    rows = {"d": [1] * 40 + [2] * 40, "p": [9] * 80, "mine": at * 2, "other": at * 2, "text": [texts[0]] * 40 + [texts[1]] * 40}
    kinds = pa.schema([("d", pa.int64()), ("p", pa.int64()), ("mine", pa.list_(pa.int32())), ("other", pa.list_(pa.int32())), ("text", pa.string())])
    batch = pa.RecordBatch.from_pydict(rows, schema=kinds)
    got = pa.Table.from_batches(passages._sliced(iter([batch])))
    assert sum(seen) == sum(map(len, texts))
    alone = [pa.Table.from_batches(passages._sliced(iter([batch.slice(i, 1)]))) for i in range(80)]
    assert got.to_pylist() == pa.concat_tables(alone).to_pylist()


def test_passages_around_another_middle(spark):
    """Two exact passages in one order with different words between them are found both."""
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, wanted = [], {}
    for size, middle in [(55, 50), (60, 100), (100, 100), (100, 200), (300, 300), (300, 500)] * 3:
        head, tail = fresh(size), fresh(size)
        for _ in range(2):
            wanted[len(rows)] = {*range(size), *range(size + middle, 2 * size + middle)}
            rows.append((len(rows), " ".join(head + fresh(middle) + tail)))
    got = spans_of(passages.repeats(frame(spark, rows)))
    assert [d for d, places in wanted.items() if not got[d] >= places] == []


def test_passages_among_many_quotations(spark):
    """Documents that hold a passage whole find each other though most holders of each of its seeds quote a part."""
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, wanted = [], {}
    for case in range(5):
        passage, whole = fresh(60), set(r.sample(range(400), 4))
        for i in range(400):
            at = r.randrange(31)
            before, part = fresh(r.randrange(20)), passage if i in whole else passage[at:at + 30]
            if i in whole:
                wanted[len(rows)] = set(range(len(before), len(before) + 60))
            rows.append((len(rows), " ".join(before + part + fresh(20))))
    got = spans_of(passages.repeats(frame(spark, rows)))
    assert [d for d, places in wanted.items() if not got[d] >= places] == []


def test_passages_with_edits_among_quotations(spark):
    """Holders of a passage with an edit each find each other however many documents quote parts of it (F8)."""
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, wanted = [], {}
    for case in range(5):
        passage, holders = fresh(60), set(r.sample(range(300), 4))
        for i in range(300):
            at, before, part = r.randrange(31), fresh(r.randrange(20)), list(passage)
            if i in holders:
                part[r.randrange(20, 40)] = f"edit{i}"
                wanted[len(rows)] = set(range(len(before), len(before) + 60))
            rows.append((len(rows), " ".join(before + (part if i in holders else part[at:at + 30]) + fresh(20))))
    got = spans_of(passages.repeats(frame(spark, rows)))
    assert [d for d, places in wanted.items() if len(places - got[d]) > 2] == []


def test_passages_of_copies_and_loops(spark):
    """Copies of a text hold all of it; a long run of one word is covered by a short one; the smallest partner is told."""
    text, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(20))
    rows = [(9, text), (4, text), (6, text), (6, text), (2, f"{text} {other}"), (30, " ".join(["of"] * 200)), (31, f"{other} " + "of " * 60 + "end")]
    rows += [(40, " ".join(f"c{i}" for i in range(30))), (41, " ".join(f"c{i}" for i in range(30)))]
    got = {tuple(x) for x in passages.repeats(frame(spark, rows)).collect()}
    assert got == {
        (9, 0, 50, 50, 2, 1.0), (4, 0, 50, 50, 2, 1.0), (6, 0, 50, 50, 2, 1.0), (2, 0, 50, 50, 4, 1.0), (30, 0, 200, 200, 31, 1.0), (31, 20, 80, 60, 30, 1.0),
    }
    assert {r.partner_id for r in passages.repeats(frame(spark, rows[:3])).collect() if r.doc_id == 4} == {6}


def test_passages_in_blocks_and_short_pieces(spark):
    """Seeds with more holders than a block, and short pieces looked at from both sides, give what plain alignment gives."""
    r = random.Random(7)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line, rows, wanted = fresh(17), [], {}
    for i in range(700):
        rows.append((i, " ".join(fresh(r.randrange(9)) + line + fresh(r.randrange(12)))))
    for i in range(700, 720, 2):  # the line grown by pieces too short for a seed of their own
        tail = sum((fresh(6) + ["x"] for _ in range(5)), [])
        for k in (0, 1):
            before = fresh(9)
            wanted[i + k] = set(range(9, 9 + 17 + 34))
            rows.append((i + k, " ".join(before + line + [f"{w}{k}" if w == "x" else w for w in tail] + fresh(5))))
    got = spans_of(passages.repeats(frame(spark, rows)))
    assert {d for d in got if got[d]} == set(wanted)
    assert [d for d, places in wanted.items() if len(places - got[d]) > 2] == []


# ---- suffixes


def test_loser_tree():
    r = random.Random(3)
    for _ in range(200):
        runs, everything = [], []
        for k in range(r.randint(1, 7)):
            entries = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12))})
            shared, sizes, rests = suffix_dedup.front_coded(entries)
            runs.append(suffix_dedup.Run(k, shared.tobytes(), sizes.tobytes(), rests))
            everything += entries
        before = b""
        got = []
        for _, _, entry, shared in suffix_dedup.merged(runs):
            assert shared == suffix_dedup.shared_prefix(before, entry)
            before = entry
            got.append(entry)
        assert got == sorted(everything)


def test_suffix_dedup(spark, sf):
    r = random.Random(7)
    letters = "abcdefghij klmno"
    base = ["".join(r.choice(letters) for _ in range(r.randint(0, 900))) for _ in range(20)]
    rows = ODD + small(spark, sf, 40)
    for i in range(100):
        x, y, kind = r.choice(base), r.choice(base), r.random()
        p = r.randint(0, len(x))
        text = x if kind < 0.2 else x[:p] + "ZZ" + x[p:] if kind < 0.5 else x[:p] + y[50:400] + "é" + x[:180] if kind < 0.8 else "ab" * r.randint(90, 200)
        rows.append((5000 + i, text))
    rows += [rows[-1], rows[-3], rows[-3]]
    out = suffix_dedup.deduplicated(frame(spark, rows).repartition(4)).drop("kept").collect()
    want = brute.repeated_bytes([t for _, t in rows])
    assert Counter(tuple(x) for x in out) == Counter((d, *w) for (d, _), w in zip(rows, want))
    assert suffix_dedup.deduplicated(frame(spark, [])).count() == 0


# ---- models


def test_recurrent_gradients():
    r = np.random.default_rng(0)
    v = recurrent_lm.Vocabulary.build(np.arange(100) * 7, np.sort(r.integers(1, 500, 100))[::-1].copy(), 50_000, 200, 64)
    ids, bounds = r.integers(-1, 100, 40), np.array([0, 9, 9, 22, 40])
    m = recurrent_lm.Model(v)
    m.p = {k: a.astype(np.float64) for k, a in m.p.items()}
    lanes = recurrent_lm.Lanes(v, ids, bounds, 2)
    place, mask = next(lanes.windows(30))
    assert sorted(place[mask].tolist()) == list(range(40))
    args = (lanes.previous[place], lanes.keep[place], r.normal(0, 0.3, (2, recurrent_lm.HIDDEN)), mask, lanes.kinds[place], lanes.ids[place])
    grad = m.gradients(*args)[0]
    rows, d_x = grad.pop("X")
    dense = np.zeros_like(m.p["X"])
    dense[rows] = d_x
    for k, g in {**grad, "X": dense}.items():
        for _ in range(8):
            at = tuple(int(r.integers(0, s)) for s in g.shape)
            old, e = m.p[k][at], 1e-4
            m.p[k][at] = old + e
            up = m.gradients(*args)[2]
            m.p[k][at] = old - e
            down = m.gradients(*args)[2]
            m.p[k][at] = old
            assert g[at] == pytest.approx(-(up - down) / (2 * e), abs=1e-3)


def test_recurrent_probabilities_sum_to_one():
    v = recurrent_lm.Vocabulary.build(np.arange(90) * 3, np.arange(90)[::-1] + 1, 9000, 120, 64)
    m = recurrent_lm.Model(v)
    states = np.random.default_rng(1).normal(0, 1, (1, m.hidden)).astype(np.float32)
    total = 0.0
    for i in range(90):
        ids = np.array([i])
        total += np.exp(m.outputs(states, v.kind(ids), ids)[0][0]) * 10 ** v.inner[i]
    unseen = np.array([-1])
    total += np.exp(m.outputs(states, v.kind(unseen), unseen)[0][0])  # all words outside together
    assert total == pytest.approx(1.0, abs=1e-5)


def test_recurrent_lm(spark, sf):
    rows = small(spark, sf) + [(9000 + i, t) for i, t in enumerate(["", None, " ", "new words here only", "x y z"])] + [(3, "a b c"), (3, "a b c"), (None, "zzz")]
    got = recurrent_lm.scores(frame(spark, rows), known=500).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*brute.words(t), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        w = tokens(t)
        want[d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert recurrent_lm.scores(frame(spark, [])).count() == 0


def test_recurrent_memory_of_a_batch():
    """A task lays out a bounded piece of a batch, however large the batch is."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 3000, 600)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"d": list(range(4000)), "doc_id": list(range(4000)), "held_out": [False] * 4000, "text": texts})
    counted = pa.Table.from_batches(recurrent_lm._counted(iter([batch])))
    hashes, counts = counted.column("h").to_numpy(), counted.column("c").to_numpy()
    assert len(set(hashes.tolist())) == len(hashes) == 3001 and counts.sum() == 4000 * 601
    v = recurrent_lm.Vocabulary.build(hashes, counts, int(counts.sum()), len(hashes))
    assert (v.look_up(hashes) >= 0).all() and (v.look_up(hashes ^ 1) == -1).all()
    tracemalloc.start()
    rows = sum(b.num_rows for b in recurrent_lm._scored(v, None)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 150e6


def test_factorization_identity():
    r = np.random.default_rng(2)
    m = factorization.Model(0.3, r.normal(size=factorization.BIAS), r.normal(size=(factorization.BIAS, factorization.FACTORS)))
    number, value = r.choice(factorization.BIAS, 12, replace=False), r.normal(size=12)
    pairs = sum(m.factors[a] @ m.factors[b] * x * y for i, (a, x) in enumerate(zip(number, value)) for b, y in list(zip(number, value))[:i])
    assert m.raw(np.array([0, 12]), number, value)[0] == pytest.approx(0.3 + m.linear[number] @ value + pairs)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = factorization.quality(docs, labels)
    assert got.count() == docs.count()
    out = got.filter("held_out").join(labels, "doc_id").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93
    assert out[out.quality == 1].predicted.mean() > 0.97
    ids = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id}
    assert all(ids.values())


def test_quality_odd_rows(spark):
    docs = frame(spark, ODD)
    marks = spark.createDataFrame([(1, 1), (1, None), (None, 0), (77, 0)], "doc_id long, quality int")
    for labels in (marks, marks.limit(0)):
        got = factorization.quality(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == pytest.approx(1) for r in got)  # without labels nothing speaks against a document
    assert factorization.accepted(docs, marks.limit(0)).columns == docs.columns
    assert factorization.quality(docs.limit(0), marks).count() == 0


# ---- chat


def test_guard_round_trip():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["<", "|", "\\", ">", "a", "\n", chat.START, chat.END]) for _ in range(r.randrange(9)))
        assert chat.unguard(chat.guard(text)) == text
        assert chat.parse(chat.formatted_turn(text, text) * 2) == [(text, text)] * 2


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 20), (5, 0)])
def test_chat(spark, sf, budget, history):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    mark = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", mark), (-1, 1, "assistant", mark), (-2, None, None, None), (-3, 1, "assistant", "x"), (-3, 1, "assistant", "x"), (None, 0, "system", "s"), (None, 1, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit(1), "tokens": F.lit(2)})
    windows = chat.formatted(df, budget=budget, history=history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        body = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(body.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        shown = chat.parse(w.formatted)
        assert len(shown) == w.context_turns + w.span_turns
        first = sorted(groups[w.conv_id])[0]
        if w.window and first[2] == "system":
            assert shown[0] == ("system", first[3])
    assert chat.formatted(df.limit(0)).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        rows = [tuple(x) for x in before.select("doc_id", "text").collect()]
        docs = stage(spark, before, sf)
        kept = [x.doc_id for x in docs.select("doc_id").collect()]
        counts.append(len(kept))
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            marks = dict(map(tuple, labels.select("doc_id", "quality").collect()))
            clean = [d for d, _ in rows if marks.get(d) == 1]
            assert len(set(clean) & set(kept)) >= 0.97 * len(clean)
            # some sixty labels to learn from at this size; test_quality holds the accuracy on more
            assert sum(marks.get(d) == 0 for d in kept) <= 0.3 * sum(q == 0 for q in marks.values())
        if name == "near_duplicates":
            assert sorted(kept) == sorted(d for d, _, c in brute.jaccard_components(rows) if d == c)
        if name == "decontamination":
            held = {d for d, _ in brute.item_matches(rows, items)}
            assert sorted(kept) == sorted(d for d, _ in rows if d not in held)
        if name == "mix":
            times = Counter(kept)
            assert max(times.values()) <= 2
    assert counts[-1] == counts[-2]
