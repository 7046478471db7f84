"""Exact dedup, mixing and decontamination: brute force, SQL, odd rows, plans."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from offermill.llm import decontaminate, exact_dedup, mixing

ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (5, "a  b"), (None, "ab"), (None, None), (6, "x" * 50_000)]


def frame(spark, rows, extra=""):
    """Documents with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({n: F.lit(7) for n in ("n", "digest", "salt", "rank", "size", "copies", "words", "h", "d", "x", "row")})


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(word in plan for word in ("Python", "Arrow", "CartesianProduct", "NestedLoop"))


def kept_of(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        text = text or ""
        groups["".join(c for c in text if c not in " \t\n\x0b\x0c\r")].append((-len(text), doc is None, doc))
    out = []
    for doc, text in rows:
        text = text or ""
        squeezed = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        size, _, keep = min(groups[squeezed], key=lambda g: (g[0], g[1], g[2] or 0))
        kept = doc == keep and len(text) == -size
        out.append((doc, keep, len(groups[squeezed]), kept, hashlib.sha256(squeezed.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    r = random.Random(1)
    rows = ODD + [(i, "".join(r.choice("ab \t") for _ in range(r.randint(0, 7)))) for i in range(100, 400)]
    digest = (lambda c: F.length(c).cast("string")) if weak else exact_dedup.sha256  # a weak digest must not merge contents
    got = exact_dedup.duplicates(frame(spark, rows), digest=digest)
    if not weak:
        assert native(got)
    assert sorted(map(tuple, got.collect()), key=str) == kept_of(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup.duplicates(frame(spark, [])).count() == 0


def sources(spark, n, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(int(r.paretovariate(1)) % 400)), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(n)]
    rows += [(None, None, "a"), (1, "", "b"), (1, "", "b"), (7, None, "empty")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "copies", "_n", "row", "target")})


def test_mixing_against_sql(spark):
    rows, df = sources(spark, 1500)
    got = mixing.taken(df)
    assert native(got)
    pdf = got.toPandas()
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = con.sql(mixing.oracle("documents")).df()
    order = ["doc_id", "size", "taken", "target"]
    a, b = (d[order].astype(float).fillna(-1).sort_values(order).to_numpy() for d in (pdf, want))
    assert (abs(a - b) < 1e-9).all() and len(a) == len(rows)


def test_mixing_targets(spark):
    rows, df = sources(spark, 3000)
    out = mixing.allot(df, carry=["source"]).toPandas()
    total = out["size"].sum()
    by = out.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"))
    taken = (out["size"] * out["copies"]).groupby(out["source"], dropna=False).sum()
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 * total
    assert (by.target <= 2 * by["size"] + 1e-9).all() and (out.copies <= 2).all()
    assert (abs(taken - by.target) <= 3 * out["size"].max()).all()
    copies = mixing.mixed(df)
    assert copies.columns == df.columns and copies.count() == out.copies.sum()


def test_mixing_empty(spark):
    _, df = sources(spark, 3)
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_decontamination(spark, sf):
    r = random.Random(9)
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    base = [x[0] for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(30).collect()]
    docs = []
    for n, (item, text) in enumerate(items * 2):
        w = text.split()
        edit = r.choice(["none", "change", "insert", "drop", "head", "tail"])
        at, edge = r.randrange(len(w)), r.randint(1, max(1, (len(w) - 4) // 7))
        if edit == "change":
            w[at] = "zzz"
        elif edit == "insert":
            w.insert(at, "zzz")
        elif edit == "drop":
            del w[at]
        elif edit in ("head", "tail"):
            w = w[edge:] if edit == "head" else w[:-edge]
        x = r.choice(base).split()[:120]
        p = r.randrange(len(x) + 1)
        docs.append((n, " ".join(x[:p] + w + x[p:])))
    docs += [(1000 + i, t) for i, t in enumerate(base[:10])]
    found = decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.similarity for x in found.collect()}
    assert got == pytest.approx(brute.item_matches(docs, items))


def test_decontamination_at_the_threshold(spark):
    """Items that lack as many words at one end as the threshold allows are all found."""
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    docs, items = [], []
    for size, lost in [(39, 5), (60, 8), (100, 13), (200, 28)] * 100:
        w = fresh(size)
        items.append((len(items), " ".join(w)))
        docs.append((len(docs), " ".join(fresh(9) + w[:-lost] + fresh(lost + 9))))
    found = decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.similarity for x in found.collect()}
    assert set(got) == {(i, i) for i in range(len(items))} and min(got.values()) == 0.75


def test_decontamination_plan(spark, sf):
    found = decontaminate.matches(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")))
    assert native(found)


def test_decontamination_odd_rows(spark):
    odd = frame(spark, [(1, None), (2, ""), (3, "a b c"), (None, "a b c"), (3, "a b c"), (4, "x A  B\tc y"), (5, "a b")])
    items = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "a b c")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, items).collect()}
    assert got == {(d, i) for d in (3, None, 4) for i in (1, None)}
    left = decontaminate.cleaned(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert decontaminate.cleaned(odd, items.limit(0)).count() == 7
    assert decontaminate.matches(odd.limit(0), items).count() == 0


def test_simhash_blocks_reach_the_radius():
    r = random.Random(2)
    listed = set(decontaminate.MASKS)
    for _ in range(2000):
        bits = r.sample(range(64), decontaminate.RADIUS)
        value = sum(1 << b for b in bits)
        assert any((value >> (16 * b)) & 0xFFFF in listed for b in range(decontaminate.BLOCKS))
