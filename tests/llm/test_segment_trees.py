"""Distances and over-used terms against plain Python; shared nodes; odd rows; one group with a third of all rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offermill.llm import segment_trees

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=30, top=50):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for (x, t), n in docs.items() if x == lang and n >= least}
        own = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in own:
            whole.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            used = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", used, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return out


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(parts)
    return df.withColumns({n: F.lit("7") for n in ("n", "term", "terms", "docs", "total", "tile", "block", "rank", "value", "a b")})


def check(spark, rows, **options):
    got = [tuple(r) for r in segment_trees.audit(frame(spark, rows), **options).collect()]
    want = brute(rows, options.get("least_docs", 30), options.get("top", 50))
    assert sorted(got) == sorted(want)
    return got


ODD = [(None, None, None), ("", "", ""), ("en", None, "a A b"), (None, "s1", "É é ſ K\x00x 1a2 [b]"), ("xx", "only", "zzz"), ("yy", "a", None), ("yy", "b", "1 2")]


def corpus(n, sources, seed=1):
    r = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopq'[i // 10 % 7]}{'é' * (i // 70)}" for i in range(300)]
    rows = []
    for _ in range(n):
        source = "hot" if r.random() < 1 / 3 else f"s{r.randrange(sources)}"
        lang = "en" if r.random() < 0.7 else "fr"
        shift = sum(source.encode()) % 40
        rows.append((lang, source, " ".join(r.choice(words[shift:shift + r.choice([3, 200])]) for _ in range(r.randrange(20))).upper()))
    return rows


def test_against_plain_python(spark):
    rows = corpus(900, 7) + ODD + ODD
    check(spark, rows)
    got = check(spark, rows, least_docs=2)
    assert {g[2] for g in got} == {"pair", "term"} and max(g[5] for g in got if g[2] == "term") == 50
    check(spark, rows, least_docs=2, top=5)


def test_blocks_and_tiles(spark):
    """Small blocks and tiles give the same sums."""
    check(spark, corpus(600, 12, seed=2) + ODD, block=16, tile=3, least_docs=4)


def test_given_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    check(spark, rows, least_docs=5)


def test_flushes_and_long_texts(spark, monkeypatch):
    """Small limits inside one task: counts that leave in several batches and texts read in several runs are the same."""
    monkeypatch.setattr(segment_trees, "HELD_TERMS", 20)
    monkeypatch.setattr(segment_trees, "CHUNK_BYTES", 7)
    rows = [("en", "s", "some words here and some there"), ("en", "t", "word" * 50 + " é é word"), ("en", "s", "")] * 20
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in segment_trees._count(iter([batch])):
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n["s", "some"] == 40 and docs["s", "some"] == 20 and n["t", "é"] == 40 and docs["t", "word" * 50] == 20 and n["s", None] == 0


def test_nodes_are_shared():
    """Equal subtrees are one node, and equal node pairs are priced once."""
    counts = np.zeros((3, 1000), dtype=np.int64)
    counts[1, 3], counts[2, 900] = 5, 5
    trees = segment_trees.Trees(counts)
    assert sum(map(len, trees.levels)) + len(trees.leaves) < 60
    prices = segment_trees._leaf_prices(trees, [5000, 5005, 5005])
    share = segment_trees.share
    want = 999 * abs(share(0, 5000) - share(0, 5005)) + abs(share(0, 5000) - share(5, 5005))
    assert trees.distances(0, np.array([1, 2]), prices).tolist() == [want, want]
    assert trees.distances(1, np.array([2]), prices).tolist() == [2 * abs(share(5, 5005) - share(0, 5005))]


def test_large_counts_stay_exact(spark):
    """Counts whose products pass 64 bits."""
    kept = spark.createDataFrame(
        [("en", s, t, n, n) for s, ns in (("a", [10**13, 7]), ("b", [3, 10**12])) for t, n in zip("xy", ns)] + [("en", s, None, 0, 0) for s in "ab"],
        "lang string, source string, term string, n long, lang_n long",
    )
    totals = {"a": 10**13 + 17, "b": 10**12 + 13}
    groups = spark.createDataFrame([("en", s, 2, n) for s, n in totals.items()], "lang string, source string, terms long, total long")
    share = segment_trees.share
    want = abs(share(10**13, totals["a"]) - share(3, totals["b"])) + abs(share(7, totals["a"]) - share(10**12, totals["b"]))
    assert {r.value for r in segment_trees.distances(kept, groups).collect()} == {want}


def test_empty_table(spark):
    assert segment_trees.audit(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        segment_trees.distances(frame(spark, []), frame(spark, []), block=1 << 16, tile=64)
