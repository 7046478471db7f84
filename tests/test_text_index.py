"""Trigram search against the scan, and how much of the table it reads."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from offermill.operators import text_index

FIELDS = ["title", "merchant"]
R = random.Random(9)
PARTS = ["Happy", "hour", "LUNCH", "50%", "a_b", "Σίγμα", "ΟΔΟΣ", "İstanbul", "straße", "日本語", "ab", "x", "\\", "pizza", "Joe's"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [(i, " ".join(R.choice(PARTS) for _ in range(R.randrange(5))) or None, R.choice(PARTS) if i % 3 else None) for i in range(3000)]
    rows += [(5000, "needle in a haystack", None), (5001, "", ""), (5002, None, "NEEDLE")]
    df = spark.createDataFrame(rows, "id long, title string, merchant string")
    root = str(tmp_path_factory.mktemp("index"))
    text_index.write_index(df, root, FIELDS, partitions=7)
    return df, root


QUERIES = [
    "", "a", "ab", "happy", "HAPPY H", "ppy_hou", "hap%our", "50\\%", "50%", "a\\_b", "a_b", "σίγ", "οδος", "ΟΔΟΣ", "istanbul", "İST", "strasse", "straße",
    "日本語", "日本", "needle", "nee%stack", "zzz", "joe's", "%", "___", "hour lunch",
]


@pytest.mark.parametrize("q", QUERIES)
def test_equals_the_scan(spark, indexed, q):
    df, root = indexed
    want = {r.id for r in df.filter(reduce(lambda a, b: a | b, [F.col(f).ilike(f"%{q}%") for f in FIELDS])).collect()}
    assert sorted(r.id for r in text_index.matching(spark, root, q, FIELDS).collect()) == sorted(want)


def test_rows_read_shrink(spark, indexed):
    _, root = indexed
    read = {q: text_index.matching(spark, root, q, FIELDS, verified=False).count() for q in ("", "happy", "needle", "zzz")}
    assert read[""] == 3003 > read["happy"] > read["needle"] == 2 and read["zzz"] == 0
    found = text_index.matching(spark, root, "needle", FIELDS)
    found.collect()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark, tmp_path):
    text_index.write_index(spark.createDataFrame([], "id long, title string, merchant string"), str(tmp_path), FIELDS)
    for q in ("happy", "", "zz"):
        assert text_index.matching(spark, str(tmp_path), q, FIELDS).count() == 0


def test_a_query_indexes_the_fields_it_searches(spark, monkeypatch):
    from offermill.plans import serving
    from offermill.plans.registry import Tables

    written = []
    write = text_index.write_index
    monkeypatch.setattr(text_index, "write_index", lambda deals, root, fields, **kw: (written.append((set(deals.columns), fields)), write(deals, root, fields, **kw)))
    t = Tables(spark, "/root/testdata/sf0.001")
    assert serving.q.filter_deals(text_index.matching(spark, serving._indexed(t, ["location"]), "area 1", ["location"])).count() > 0
    assert [w[1] for w in written] == [["location"]] and {"title", "description", "merchant"} <= written[0][0]
