r"""Fill-in-middle transformation with piece tables.

A document becomes descriptors (buffer, start, length) over two immutable buffers: its UTF-8 bytes and the sentinels
``<P><S><M>``. Cutting splits the one descriptor of a text into prefix, middle and suffix; an arrangement permutes these
and the three sentinels; the inverse permutation restores the text. Bytes are copied once, when the output column is
written; hashes stream the descriptors.

Units are tokens ``[A-Za-z]+|[^A-Za-z]`` over code points, ``n`` of them. ``h1`` to ``h4`` are the first four 8-digit
groups of the hex SHA-256 of ``seed:doc_id``. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units,
the middle after the larger. The form is ``plain`` (the text itself) if the text is empty or holds a sentinel, or if
h3 % 100 >= ``fim_percent``; else ``spm`` if h4 % 100 < ``spm_percent``; else ``psm``.

Null texts are empty, so plain. A null id hashes as the empty string. Rows stay as they are: repeated rows give repeated
results, rows that share an id but not a text are cut by the same hashes; other columns are carried, columns named like
a result are replaced. An empty table gives an empty result. Texts are worked on whole; a task holds a slice of
about a megabyte of text, or one text that is larger, and some twenty bytes beside each byte of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textarrays import Texts, slices, texts_of

SENTINELS = b"<P><S><M>"
TEXT, SENTINEL = 0, 1  # buffers
# Pieces before arranging: the sentinels P, S, M, then prefix, middle, suffix.
ARRANGEMENTS = {"psm": (0, 3, 1, 5, 2, 4), "spm": (1, 5, 0, 3, 2, 4)}
PIECE = "array<struct<buffer:int,start:bigint,length:bigint>>"
OUT = {
    "n": "bigint",
    "form": "string",
    "prefix_chars": "bigint",
    "middle_chars": "bigint",
    "pieces": PIECE,
    "output": "string",
    "output_sha256": "string",
}
DRAWS = "_fim_draws"


def draws(doc_id: Column, seed: int) -> Column:
    """h1 to h4 of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def sentinel_places(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all sentinels, and the text each lies in."""
    data = texts.data
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.zeros(256, bool)
    letters[list(b"PSM")] = True
    found = np.flatnonzero((data[:-2] == ord("<")) & letters[data[1:-1]] & (data[2:] == ord(">")))
    owner = np.searchsorted(texts.offsets, found, "right") - 1
    inside = found + 3 <= texts.offsets[owner + 1]
    return found[inside], owner[inside]


def unit_starts(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte places at which a unit begins, and their number before each text."""
    data = texts.data
    letter = np.zeros(256, bool)
    letter[ord("a") : ord("z") + 1] = letter[ord("A") : ord("Z") + 1] = True
    inside = letter[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(inside[1:] & inside[:-1])
    edges = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    begins[edges] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, texts.offsets)


def char_counts(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    before = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=before[1:])
    return before[ends] - before[starts]


def arranged(order: tuple[int, ...], buffers: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tables (a row per text, a column per piece) with their columns permuted."""
    index = list(order)
    return buffers[:, index], starts[:, index], lengths[:, index]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(np.argsort(order).tolist())


class Pieces:
    """Descriptors of the texts of a slice: those of text i lie from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n_texts: int):
        """``tables``: (rows of the texts, buffers, starts, lengths); a text has one row in one table."""
        counts = np.zeros(n_texts, np.int64)
        for rows, buffers, _, _ in tables:
            counts[rows] = buffers.shape[1]
        self.offsets = np.append(0, np.cumsum(counts))
        self.buffers, self.starts, self.lengths = (np.zeros(self.offsets[-1], np.int64) for _ in range(3))
        for rows, *columns in tables:
            places = self.offsets[rows][:, None] + np.arange(columns[0].shape[1])
            for mine, theirs in zip((self.buffers, self.starts, self.lengths), columns, strict=True):
                mine[places] = theirs

    def views(self, sources: tuple[memoryview, ...]) -> list[memoryview]:
        spans = zip(self.buffers.tolist(), self.starts.tolist(), (self.starts + self.lengths).tolist(), strict=True)
        return [sources[buffer][start:end] for buffer, start, end in spans]

    def column(self, views: list[memoryview]) -> pa.Array:
        """The texts that the descriptors spell."""
        ends = np.append(0, np.cumsum(self.lengths))[self.offsets]
        kind, width = (pa.large_string(), np.int64) if ends[-1] >= 1 << 31 else (pa.string(), np.int32)
        buffers = [None, pa.py_buffer(ends.astype(width).tobytes()), pa.py_buffer(b"".join(views))]
        return pa.Array.from_buffers(kind, len(self.offsets) - 1, buffers).cast(pa.string())

    def digests(self, views: list[memoryview]) -> pa.Array:
        out, bounds = [], self.offsets.tolist()
        for low, high in zip(bounds, bounds[1:]):
            digest = hashlib.sha256()
            for view in views[low:high]:
                digest.update(view)
            out.append(digest.hexdigest())
        return pa.array(out, pa.string())

    def listed(self, text_starts: np.ndarray) -> pa.Array:
        """As a list column; starts in the text buffer count from the text's own begin."""
        own = self.starts - np.where(self.buffers == TEXT, np.repeat(text_starts, np.diff(self.offsets)), 0)
        kinds = {"buffer": pa.int32(), "start": pa.int64(), "length": pa.int64()}
        fields = [pa.array(v, k) for v, k in zip((self.buffers, own, self.lengths), kinds.values(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(kinds)))


def cut_and_arrange(texts: Texts, h: np.ndarray, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns ``OUT`` for the texts of a slice; ``h``: a row of four draws per text."""
    starts, first = unit_starts(texts)
    n = np.diff(first)
    units = h[:, :2] % (n + 1)[:, None]
    borders = [texts.offsets[:-1]]
    padded = np.append(starts, len(texts.data))
    for unit in (units.min(axis=1), units.max(axis=1)):
        borders.append(np.where(unit < n, padded[first[:-1] + unit], texts.offsets[1:]))
    borders.append(texts.offsets[1:])
    plain = (n == 0) | (h[:, 2] % 100 >= fim_percent)
    plain[sentinel_places(texts)[1]] = True
    spm = ~plain & (h[:, 3] % 100 < spm_percent)
    rows = np.flatnonzero(plain)
    low, high = texts.offsets[:-1][rows], texts.offsets[1:][rows]
    tables = [(rows, np.full((len(rows), 1), TEXT), low[:, None], (high - low)[:, None])]
    for form, chosen in (("psm", ~plain & ~spm), ("spm", spm)):
        rows = np.flatnonzero(chosen)
        edges = np.stack(borders, axis=1)[rows]
        table = (
            np.tile([SENTINEL] * 3 + [TEXT] * 3, (len(rows), 1)),
            np.concatenate([np.tile([0, 3, 6], (len(rows), 1)), edges[:, :3]], axis=1),
            np.concatenate([np.full((len(rows), 3), 3), np.diff(edges, axis=1)], axis=1),
        )
        tables.append((rows, *arranged(ARRANGEMENTS[form], *table)))
    pieces = Pieces(tables, len(texts))
    views = pieces.views((memoryview(texts.data), memoryview(SENTINELS)))
    chars = [pa.array(char_counts(texts, borders[i], borders[i + 1]), mask=plain) for i in (0, 1)]
    forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [pa.array(n), pa.array(forms, pa.string()), *chars, pieces.listed(texts.offsets[:-1]), pieces.column(views), pieces.digests(views)]


def fill_in_middle(docs: DataFrame, fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """``docs`` with the columns ``OUT``: units, form, code points of prefix and middle, descriptors (in bytes of the
    text's UTF-8, or of ``SENTINELS``), output text and its SHA-256."""
    kept = docs.drop(*OUT)
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in OUT.items())).fields])
    place = kept.columns.index("text")
    drawn = kept.withColumn(DRAWS, draws(F.col("doc_id"), seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                h = np.asarray(part.column(part.num_columns - 1).flatten()).reshape(-1, 4)
                made = cut_and_arrange(texts_of(part.column(place)), h, fim_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    return drawn.mapInArrow(run, schema)


def inverted(texts: Texts, forms: np.ndarray) -> Pieces:
    """Descriptors over the outputs that spell the texts they were made of."""
    places, owner = sentinel_places(texts)
    tables = []
    for form in ("plain", *ARRANGEMENTS):
        rows = np.flatnonzero(forms == form)
        low, high = texts.offsets[:-1][rows], texts.offsets[1:][rows]
        if form == "plain":
            tables.append((rows, np.full((len(rows), 1), TEXT), low[:, None], (high - low)[:, None]))
            continue
        mine = np.isin(owner, rows)
        signs = places[mine]
        order = ARRANGEMENTS[form]
        letters = np.frombuffer(SENTINELS, np.uint8)[[1 + 3 * i for i in order[::2]]]
        if len(signs) != 3 * len(rows) or (np.bincount(owner[mine], minlength=len(texts))[rows] != 3).any():
            raise ValueError(f"an output of form {form} without exactly one of each sentinel")
        at = signs.reshape(-1, 3)
        if (texts.data[at + 1] != letters).any() or (at[:, 0] != low).any():
            raise ValueError(f"the sentinels of an output are not in the order of form {form}")
        edges = np.concatenate([at, high[:, None]], axis=1)
        starts = np.stack([edges[:, 0], edges[:, 0] + 3, edges[:, 1], edges[:, 1] + 3, edges[:, 2], edges[:, 2] + 3], axis=1)
        ends = np.concatenate([starts[:, 1:], high[:, None]], axis=1)
        back = arranged(inverse(order), np.full(starts.shape, TEXT), starts, ends - starts)
        tables.append((rows, *(column[:, 3:] for column in back)))
    if sum(len(table[0]) for table in tables) != len(texts):
        raise ValueError("a form other than plain, psm and spm")
    return Pieces(tables, len(texts))


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``restored`` (the text made of ``output`` and ``form`` alone) and ``restored_sha256``."""
    kept = outputs.drop("restored", "restored_sha256")
    schema = T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType()), T.StructField("restored_sha256", T.StringType())])
    place, form_place = kept.columns.index("output"), kept.columns.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                texts = texts_of(part.column(place))
                pieces = inverted(texts, np.asarray(part.column(form_place).to_pylist(), dtype=object))
                views = pieces.views((memoryview(texts.data),))
                yield pa.RecordBatch.from_arrays([*part.columns, pieces.column(views), pieces.digests(views)], names=schema.names)

    return kept.mapInArrow(run, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs, fim_percent=90, spm_percent=20, seed=1)
    digests = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restore(made.select(*digests, "output")).select(*digests, "restored_sha256")


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, [CAST('0x' || s[i:i + 7] AS BIGINT) FOR i IN [1, 9, 17, 25]] AS h FROM texts
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, n, form, x, coalesce(array_to_string(units[1:a], ''), '') AS p,
    coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s
  FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM parts
"""
