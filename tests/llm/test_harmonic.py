"""Packed sequences against the plain tokenizer: every id once, no gaps, little padding, odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offermill.llm import harmonic

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "a b"), (None, None), (6, "x " * 30_000), (7, "é ü\n ß  <|endoftext|> it's")]


def frame(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumns({n: F.lit(7) for n in ("ids", "pieces", "start", "length", "offset", "sequence_id", "n_tokens")})


def plain_ids(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [(d, e.ids + [1]) for (d, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False))]


def check(rows, packed, capacity=2048):
    """The contract, document by document and sequence by sequence."""
    held, total = defaultdict(list), 0
    for row in packed:
        ids = np.frombuffer(row.ids, "<u4")
        assert 0 < row.n_tokens <= capacity
        assert row.padded == len(ids) == (row.n_tokens if row.n_tokens & (row.n_tokens - 1) == 0 else capacity)
        at = 0
        for p in row.pieces:
            assert p.offset == at and p.length > 0
            held[p.doc_id, p.doc_tokens].append((p.start, tuple(ids[at:at + p.length].tolist())))
            at += p.length
        assert at == row.n_tokens and not ids[at:].any()
        total += row.n_tokens
    want = plain_ids(rows)
    assert total == sum(len(i) for _, i in want)
    copies = Counter((d, tuple(i)) for d, i in want)
    for (doc, ids), times in copies.items():
        pieces = Counter(held[doc, len(ids)])
        parts = [p for p, n in pieces.items() if ids[p[0]:p[0] + len(p[1])] == p[1]]
        at = Counter()  # how often each token is held
        for start, part in parts:
            for i in range(start, start + len(part)):
                at[i] += pieces[start, part]
        alike = sum(n for (d, other), n in copies.items() if d == doc and len(other) == len(ids))
        assert all(times <= at[i] <= alike for i in range(len(ids)))
    assert len({r.sequence_id for r in packed}) == len(packed)


def rows_of(spark, sf, n=None):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return rows[:n] if n else rows


@pytest.mark.parametrize("capacity", [1, 2, 64, 2048])
def test_cuts(capacity):
    for n in range(capacity):
        cuts = harmonic.harmonic_cuts(n, capacity)
        assert sum(cuts) == n and all(c > 0 for c in cuts) and len(cuts) <= 6
        for c in cuts:
            k = capacity // c
            assert capacity / (k + 1) < c and capacity // k - c <= harmonic.SLACK * c


def test_packer_classes():
    """Full sequences hold as many pieces as their class says; only the last ones of a worker are shorter."""
    r = random.Random(2)
    packer = harmonic.Packer(2048, harmonic.SLACK)
    full = [s for d in range(3000) for s in packer.add(d, np.arange(r.choice([1, 5, 300, 683, 1500, 2048, 5000]) + r.randrange(3)))]
    for s in full:
        assert {2048 // len(p.ids) for p in s} == {len(s)}
    assert sum(2048 - sum(len(p.ids) for p in s) for s in full) < 0.005 * 2048 * len(full)
    last = [sum(len(p.ids) for p in s) for s in packer.rest()]
    assert all(n & (n - 1) == 0 for n in last) and sum(n < 2048 for n in last) <= 11


def test_against_the_tokenizer(spark, sf):
    rows = rows_of(spark, sf) + [(1000 + (i or 0), t) for i, t in ODD] + ODD
    for parts in (1, 5):
        packed = harmonic.sequences(frame(spark, rows, parts), PATH)
        check(rows, packed.collect())
        figures = harmonic.padding(packed).first()
        assert figures.padding <= 0.005 * figures.tokens


def test_pieces(spark, sf):
    rows = rows_of(spark, sf, 60)
    ids = dict(plain_ids(rows))
    got = harmonic.pieces(harmonic.sequences(frame(spark, rows, 3), PATH)).collect()
    for p in got:
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(p.length for p in got) == sum(map(len, ids.values()))


def test_one_source_of_one_length(spark):
    """Rows of one length fill the sequences of one class."""
    rows = [(i, "a b c d") for i in range(5000)]
    figures = harmonic.padding(harmonic.sequences(frame(spark, rows, 2), PATH)).first()
    assert figures.tokens == 25_000 and figures.padding <= 3 * 25_000 // 2045  # 409 pieces of 5 tokens leave 3


def test_empty_and_bad_capacity(spark):
    assert harmonic.pieces(harmonic.sequences(frame(spark, []), PATH)).count() == 0
    assert harmonic.padding(harmonic.sequences(frame(spark, []), PATH)).first().tokens == 0
    with pytest.raises(ValueError):
        harmonic.sequences(frame(spark, []), PATH, capacity=1000)
