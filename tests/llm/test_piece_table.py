"""Fill-in-the-middle outputs against plain Python, round trips and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from offermill.llm import piece_table

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, z = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc, len(units), "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return doc, len(units), "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


def texts():
    r = random.Random(3)
    parts = ["a", "Zz", " ", "\n", "\r\n", "é", "ſ", "🙂", "<", "<P", "P>", ">", "S>", "<M", "0", "_", "\x00", " ", "é", "日本"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(12)))) for i in range(2000)]
    rows += [(i, f"left {m} right") for i in range(2000, 2030) for m in ("<P>", "<S>", "<M>", "<P >")]
    rows += [(3000, None), (3001, ""), (None, "no id"), (None, None), (3002, "word " * 60_000), (3003, "x" * 300_000), (-5, "again"), (-5, "again")]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({n: F.lit("7") for n in ("n", "form", "output", "restored_sha256", "a b", "prefix_chars")})


def test_against_plain_python(spark):
    rows = texts()
    out = piece_table.transformed(frame(spark, rows).repartition(3))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [(*brute(*r), sha(brute(*r)[5])) for r in rows]
    got = [tuple(r) for r in out.select(*names, "output_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_round_trip(spark):
    rows = texts()
    back = piece_table.restored(piece_table.transformed(frame(spark, rows)))
    got = [(r.doc_id, r.text, r.restored_sha256) for r in back.collect()]
    assert sorted(got, key=repr) == sorted([(d, t or "", sha(t or "")) for d, t in rows], key=repr)
    thin = piece_table.restored(piece_table.transformed(frame(spark, rows)), keep_text=False)
    assert "output" not in thin.columns and "text" not in thin.columns
    assert sorted(r.restored_sha256 for r in thin.collect()) == sorted(g[2] for g in got)


def test_outputs_of_another_hand(spark):
    """Restoring reads the output and its form alone, whatever made them."""
    rows = [("<P>ab<<S>c<M>", "psm"), ("<S><P><M>xé", "spm"), ("as <P> is", "plain"), (None, "psm"), ("x", None)]
    df = spark.createDataFrame(rows, "output string, form string")
    got = {r.output: r.text for r in piece_table.restored(df).collect()}
    assert got == {"<P>ab<<S>c<M>": "ab<c", "<S><P><M>xé": "xé", "as <P> is": "as <P> is", None: None, "x": None}
    with pytest.raises(Exception, match="lacks a sentinel"):
        piece_table.restored(spark.createDataFrame([("no marks", "psm")], "output string, form string")).collect()


def test_empty_table_and_other_shares(spark):
    assert piece_table.restored(piece_table.transformed(frame(spark, []))).count() == 0
    rows = [(i, "some words here") for i in range(400)]
    forms = [r.form for r in piece_table.transformed(frame(spark, rows), plain_percent=0, spm_percent=100, seed="2").collect()]
    assert set(forms) == {"spm"}
