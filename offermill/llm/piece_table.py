"""Fill-in-the-middle documents from a piece table.

Texts are never edited.  A document is a row of descriptors (buffer, first byte, bytes) over two immutable buffers: the
texts of an Arrow batch and the three sentinels.  Cutting splits a descriptor, an arrangement permutes the row, the
inverse permutation puts it back, and hashes run over the descriptors' bytes without joining them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import raw_texts, windows

SENTINELS = (b"<P>", b"<S>", b"<M>")
SEED = "1"
PLAIN_PERCENT = 10
SPM_PERCENT = 20

TEXT, MARKS = 0, 1  # buffers
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")

# Rows of a cut document: sentinels P, S, M, then prefix, middle, suffix.  An arrangement lists them in output order.
ORDERS = {PSM: np.array([0, 3, 1, 5, 2, 4]), SPM: np.array([1, 5, 0, 3, 2, 4])}
SPLIT = np.array([3, 4, 5])  # the document itself


class PieceTable:
    """Documents as rows of descriptors; ``pieces`` has the shape (documents, pieces, 3)."""

    def __init__(self, buffers: tuple[memoryview, ...], pieces: np.ndarray):
        self.buffers = buffers
        self.pieces = pieces

    @classmethod
    def whole(cls, buffers: tuple[memoryview, ...], bounds: np.ndarray) -> PieceTable:
        """One descriptor a document, over buffer 0."""
        ends = np.stack([np.zeros(len(bounds) - 1, dtype=np.int64), bounds[:-1], np.diff(bounds)], axis=1)
        return cls(buffers, ends[:, None, :])

    def rows(self, chosen: np.ndarray) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[chosen])

    def cut(self, at: np.ndarray) -> PieceTable:
        """Splits the one descriptor of each document at ascending buffer positions, of shape (documents, cuts)."""
        buffer, start, length = self.pieces[:, 0, :].T
        edges = np.concatenate([start[:, None], at, (start + length)[:, None]], axis=1)
        owner = np.broadcast_to(buffer[:, None], edges[:, 1:].shape)
        return PieceTable(self.buffers, np.stack([owner, edges[:, :-1], np.diff(edges, axis=1)], axis=2))

    def after(self, buffer: int, lengths: list[int]) -> PieceTable:
        """The pieces of another buffer, of these lengths in a row, in front of every document."""
        ends = np.cumsum(lengths)
        piece = np.stack([np.full(len(ends), buffer), ends - lengths, lengths], axis=1)
        front = np.broadcast_to(piece, (len(self.pieces), *piece.shape))
        return PieceTable(self.buffers, np.concatenate([front, self.pieces], axis=1))

    def arrange(self, order: np.ndarray) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[:, order])

    def restore(self, order: np.ndarray) -> PieceTable:
        return self.arrange(np.argsort(order))

    def spans(self) -> Iterator[list[memoryview]]:
        for row in self.pieces.tolist():
            yield [self.buffers[b][s:s + n] for b, s, n in row]

    def texts(self) -> list[bytes]:
        return [b"".join(row) for row in self.spans()]

    def digests(self) -> list[str]:
        out = []
        for row in self.spans():
            digest = hashlib.sha256()
            for span in row:
                digest.update(span)
            out.append(digest.hexdigest())
        return out


# ---- where to cut -----------------------------------------------------------------------------------------------

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def units(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of the tokens: a run of ASCII letters, or one other code point."""
    begins = (raw & 0xC0) != 0x80
    letter = _LETTER[raw]
    inside = letter[1:] & letter[:-1]
    begins[1:] &= ~inside
    begins[bounds[:-1][np.diff(bounds) > 0]] = True  # a run never reaches into the next document
    return np.flatnonzero(begins)


def _holds_sentinel(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    found = np.zeros(len(bounds) - 1, dtype=bool)
    for mark in SENTINELS:
        places = np.flatnonzero(raw[:max(len(raw) - len(mark) + 1, 0)] == mark[0])
        for i, byte in enumerate(mark[1:], 1):
            places = places[raw[places + i] == byte]
        owner = np.searchsorted(bounds, places, side="right") - 1
        found[owner[places + len(mark) <= bounds[owner + 1]]] = True
    return found


def _draws(ids: list[int | None], seed: str) -> np.ndarray:
    """Four unsigned numbers per document from its id alone; a null id counts as an empty string."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").reshape(-1, 4).astype(np.int64)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output", pa.string()), ("output_sha256", pa.string()),
])


def _transform(ids: pa.Array, texts: pa.Array, seed: str, plain_percent: int, spm_percent: int) -> pa.RecordBatch:
    raw, bounds = raw_texts(texts)
    starts = units(raw, bounds)
    first = np.searchsorted(starts, bounds)
    n = np.diff(first)
    h = _draws(ids.to_pylist(), seed)
    picks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cuts = np.append(starts, len(raw))[first[:-1, None] + picks]
    plain = (n == 0) | _holds_sentinel(raw, bounds) | (h[:, 2] % 100 >= 100 - plain_percent)
    form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points in front of a byte
    prefix, middle = before[cuts[:, 0]] - before[bounds[:-1]], before[cuts[:, 1]] - before[cuts[:, 0]]

    table = PieceTable.whole((memoryview(raw), memoryview(b"".join(SENTINELS))), bounds)
    output, digest = np.empty(len(n), dtype=object), np.empty(len(n), dtype=object)
    for kind in (PLAIN, PSM, SPM):
        rows = np.flatnonzero(form == kind)
        arranged = table.rows(rows)
        if kind != PLAIN:
            arranged = arranged.cut(cuts[rows]).after(MARKS, [len(m) for m in SENTINELS]).arrange(ORDERS[kind])
        output[rows], digest[rows] = arranged.texts(), arranged.digests()
    return pa.RecordBatch.from_arrays([
        ids, pa.array(n), pa.array([FORMS[f] for f in form], pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain),
        pa.array(output.tolist(), pa.binary()).cast(pa.string()), pa.array(digest.tolist(), pa.string()),
    ], schema=_OUT)


def transformed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = SEED,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output, output_sha256.

    Where to cut and which form to take follow from the seed and the id alone, so reruns agree and rows of one id and
    text come out alike.  A null text is empty; empty texts and texts that hold a sentinel stay plain, as do
    ``plain_percent`` of the rest; their lengths are null.  A null id counts as an empty one.  Other columns are
    ignored; an empty table gives no rows.  Documents do not meet, so there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in windows(texts):
                yield _transform(ids.slice(lo, hi - lo), texts.slice(lo, hi - lo), seed, plain_percent, spm_percent)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


# ---- and back ---------------------------------------------------------------------------------------------------


def _sentinel_edges(data: bytes, lows: np.ndarray, highs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The five inner borders of the pieces of each output, found by its sentinels.

    A sentinel begins with the one ``<`` it holds and texts that hold one are plain, so the first hit is the border.
    """
    out = []
    for lo, hi in zip(lows.tolist(), highs.tolist()):
        edges, at = [], lo
        for mark in [SENTINELS[piece] for piece in order if piece < len(SENTINELS)]:
            found = data.find(mark, at, hi)
            if found < 0:
                raise ValueError("the output lacks a sentinel")
            at = found + len(mark)
            edges += [found, at]
        out.append(edges[1:])
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def restored(outputs: DataFrame, *, keep_text: bool = True) -> DataFrame:
    """``outputs`` (as ``transformed`` gives them) with ``restored_sha256`` and, if wanted, ``text``.

    Only ``output`` and ``form`` are read.  A null form or output gives nulls; an output without its sentinels is an
    error.  An empty table gives no rows.
    """
    read = [c for c in outputs.columns if c not in ("text", "restored_sha256")]
    kept = [c for c in read if c != "output" or keep_text]
    fields = [f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in kept]
    fields += ["text string"] * keep_text + ["restored_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in windows(batch.column("output")):
                part = batch.slice(lo, hi - lo)
                raw, bounds = raw_texts(part.column("output"))
                forms = np.array(part.column("form").to_pylist(), dtype=object)
                gone = np.array(part.column("output").is_null())
                data = raw.tobytes()
                table = PieceTable.whole((memoryview(data),), bounds)
                texts, digests = np.full(len(forms), None, dtype=object), np.full(len(forms), None, dtype=object)
                for kind, name in enumerate(FORMS):
                    rows = np.flatnonzero((forms == name) & ~gone)
                    if not len(rows):
                        continue
                    found = table.rows(rows)
                    if kind != PLAIN:
                        edges = _sentinel_edges(data, bounds[:-1][rows], bounds[1:][rows], ORDERS[kind])
                        found = found.cut(edges).restore(ORDERS[kind]).arrange(SPLIT)
                    digests[rows] = found.digests()
                    if keep_text:
                        texts[rows] = found.texts()
                columns = {c: part.column(c) for c in kept}
                if keep_text:
                    columns["text"] = pa.array(texts.tolist(), pa.binary()).cast(pa.string())
                columns["restored_sha256"] = pa.array(digests.tolist(), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return outputs.select(*[f"`{c}`" for c in read]).mapInArrow(run, ", ".join(fields))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), d AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, coalesce(array_to_string(units[1:lo], ''), '') AS a, coalesce(array_to_string(units[lo + 1:hi], ''), '') AS b,
         coalesce(array_to_string(units[hi + 1:n], ''), '') AS z
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b
              ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
