"""Substring dedup: words inside passages that occur more than once, by windows grouped under a shared block.

The named method is prefix-partitioned suffix trees; this is a stand-in for its cut at one depth. A suffix starts at each
word and only its first ``window`` words matter. Suffixes are partitioned by a block of words inside these (the least by
hash, so not a prefix in the strict sense), and a 64-bit hash of the window's words, compared inside a group, stands for the
node at that depth. No suffixes are sorted, no tree or common prefix lengths are built, and the lengths of maximal repeats
are not found as such: they are the runs of neighbouring marked windows.

1. Texts with equal word sequences form a class (128-bit digest); copies of a class repeat every window.
2. Census of prefixes: each window is filed under its least block of ``BLOCK`` words, the same block wherever the same
   words stand, so that neighbouring suffixes mostly share one entry. Blocks that occur once head no inner node; their
   windows go no further. What is left is a small part of an ordinary corpus.
3. Groups: suffixes under one block. Where a block heads more than ``GROUP_MOST`` entries the prefix is lengthened by
   the suffix's own first block, and if the same words simply occur that often, the group is dealt out over salts: each
   salt keeps one entry per deep node, and a second, aggregated level joins what the salts found.
4. A task reads its groups in order and holds one at a time. Suffixes that share a deep node are marked. Suffixes of one
   text that share one are marked where the text is, and only one of them goes into a group.
5. Every word covered by a marked window is removed from its class's text.

Null and empty texts, and texts with fewer words than the window, lose nothing. Classes do not use ids: rows with
null or equal ids, and repeated rows, are handled like others (a row given twice repeats all its windows). Input columns
named like a result are replaced. No row is dropped and no count is capped. Very long texts are read whole; a task holds a
slice of about a megabyte of text, or one longer text, and some ten 8-byte values for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.stages import drop_stages
from tidemark.llm.text_stats import keyed, per_text
from tidemark.llm.textarrays import U, mix, odd_multipliers, run_hashes, slices, span_hashes, texts_of, unpacked, word_spans
from tidemark.sources.stages import write_stage

BLOCK = 7
GROUP_MOST = 1000
RUN_MOST = 64
SEGMENT = "key long, salt int, d1 long, d2 long, start int, digests array<long>"
MARK = "key long, salted boolean, digest long, d1 long, d2 long, start int, length int"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, by doubling."""
    least, span = values, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class Windows:
    """Words, least blocks and owners of all windows of a slice of texts."""

    def __init__(self, column: pa.Array, window: int):
        self.texts = texts_of(column)
        self.starts, self.ends, self.words = word_spans(self.texts)
        self.hashes = span_hashes(self.texts.data, self.starts, self.ends)
        self.sizes = np.diff(self.words)
        owner = np.repeat(np.arange(len(self.texts)), self.sizes)
        n = max(0, len(self.hashes) - window + 1)
        self.blocks = run_hashes(self.hashes, BLOCK, odd_multipliers(BLOCK, 5))
        inside = owner[:n] == owner[window - 1 :] if n else np.zeros(0, bool)
        self.places = np.flatnonzero(inside)  # word numbers where a window starts
        self.least = sliding_least(self.blocks, window - BLOCK + 1)[self.places] if n else self.blocks[:0]
        self.owner = owner[self.places]

    def window_hashes(self, window: int) -> np.ndarray:
        return run_hashes(self.hashes, window, odd_multipliers(window, 9))[self.places]

    def block_is_twice(self, blocks: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether each block stands at two places or more of its text."""
        owners = np.repeat(np.arange(len(self.texts)), self.sizes)[: len(self.blocks)]
        own = keyed(self.blocks, owners)
        return np.isin(keyed(blocks, owner), own[pd.Series(own).duplicated().to_numpy()])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each text's word sequence."""
        place = (np.arange(len(self.hashes)) - np.repeat(self.words[:-1], self.sizes)).astype(U)
        out = []
        with np.errstate(over="ignore"):
            for seed in (0x8F1BBCDCBFA53E0B, 0xCA273ECEEA26619D):
                terms = mix(self.hashes + mix(place + U(seed)))
                sums = np.append(U(0), np.cumsum(terms, dtype=U))[self.words]
                out.append(mix(sums[1:] - sums[:-1] + self.sizes.astype(U)).view(np.int64))
        return out[0], out[1]

    def joined(self, row: int, keep: np.ndarray | None = None) -> bytes:
        low, high = self.words[row], self.words[row + 1]
        words = self.texts.data[self.texts.offsets[row] : self.texts.offsets[row + 1]].tobytes().split()
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep[low:high].tolist(), strict=True) if k])


def census(docs: DataFrame, window: int) -> DataFrame:
    """A row per text: the other columns, n_words, digests, sha256 of its joined words, and its windows' least blocks.

    ``counts`` says how often a block stands in the text as a least block: 1, or 2 for twice and more.
    """
    texts = docs.drop("n_words", "d1", "d2", "sha", "blocks", "counts")
    ordered = texts.select(*[c for c in texts.columns if c != "text"], "text")
    out = "n_words long, d1 long, d2 long, sha string, blocks array<long>, counts array<long>"
    others = [f for f in ordered.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.columns[-1]):
                part = batch.slice(low, high - low)
                w = Windows(part.columns[-1], window)
                d1, d2 = w.digests()
                change = np.ones(len(w.least), bool)
                change[1:] = (w.least[1:] != w.least[:-1]) | (w.owner[1:] != w.owner[:-1])
                begins = np.flatnonzero(change)
                owner, least = w.owner[begins], w.least[begins]
                twice = w.block_is_twice(least, owner)
                runs = pd.DataFrame({"owner": owner, "block": least.view(np.int64), "n": np.where(twice, 2, 1)})
                runs = runs.groupby(["owner", "block"], sort=True)["n"].sum().clip(upper=2).reset_index()
                cuts = np.searchsorted(runs["owner"].to_numpy(), np.arange(len(w.sizes) + 1)).astype(np.int32)
                sha = [hashlib.sha256(w.joined(i)).hexdigest() for i in range(len(w.sizes))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array(w.sizes.astype(np.int64)),
                        pa.array(d1),
                        pa.array(d2),
                        pa.array(sha),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(runs["block"].to_numpy(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(runs["n"].to_numpy(np.int64))),
                    ],
                    names=[*part.schema.names[:-1], "n_words", "d1", "d2", "sha", "blocks", "counts"],
                )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], out])
    return ordered.mapInArrow(run, schema)


def class_texts(docs: DataFrame) -> DataFrame:
    """(d1, d2, packed): compressed joined words of each class, once for each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            for low, high in slices(batch.column(0)):
                w = Windows(batch.column(0).slice(low, high - low), BLOCK)
                rows = []
                for i, key in enumerate(zip(*(d.tolist() for d in w.digests()), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        rows.append((*key, pack.compress(w.joined(i))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                    names=["d1", "d2", "packed"],
                )

    return docs.select("text").mapInArrow(run, "d1 long, d2 long, packed binary")


def suspects(classes: DataFrame) -> DataFrame:
    """(d1, d2, hits): classes with windows under blocks that occur elsewhere too; hits are (block, occurrences)."""
    entries = classes.select("d1", "d2", F.inline(F.arrays_zip("blocks", "counts"))).withColumnRenamed("blocks", "block")
    totals = entries.groupBy("block").agg(F.sum("counts").alias("n")).filter("n > 1")
    return entries.join(totals, "block").groupBy("d1", "d2").agg(F.collect_list(F.struct("block", "n")).alias("hits"))


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are unpacked at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def segments(texts: DataFrame, window: int) -> DataFrame:
    """SEGMENT rows: neighbouring suffixes of a class under one prefix, with the hash of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            column = unpacked(batch.column(2))
            hits = batch.column(3)
            for low, high in slices(column):
                w = Windows(column.slice(low, high - low), window)
                part = hits.slice(low, high - low)
                flat = part.flatten()
                blocks = np.asarray(flat.field(0), dtype=np.int64).view(U)
                sizes = np.asarray(flat.field(1), dtype=np.int64)
                where = np.repeat(np.arange(high - low), np.asarray(pa.compute.list_value_length(part)))
                with np.errstate(over="ignore"):
                    tell = pd.Series(sizes, index=mix(blocks + where.astype(U) * U(0x9FB21C651E98DF25)))
                    found = tell.reindex(mix(w.least + w.owner.astype(U) * U(0x9FB21C651E98DF25))).fillna(0).to_numpy(np.int64)
                at = np.flatnonzero(found > 1)
                digests = w.window_hashes(window)[at]
                # A window that stands in a text twice is known to repeat (see cut): one of them speaks for it.
                first = ~pd.Series(keyed(digests, w.owner[at])).duplicated().to_numpy()
                at, digests = at[first], digests[first]
                owner, least, n = w.owner[at], w.least[at], found[at]
                hot = n > GROUP_MOST
                with np.errstate(over="ignore"):
                    key = np.where(hot, mix(least ^ (w.blocks[w.places[at]] * U(0xD6E8FEB86659FD93))), least)
                new = np.ones(len(at), bool)
                new[1:] = hot[1:] | (np.diff(at) != 1) | (np.diff(owner) != 0) | (least[1:] != least[:-1])
                begins = np.flatnonzero(new)
                begins = np.union1d(begins, np.concatenate([np.arange(a, b, RUN_MOST) for a, b in zip(begins, np.append(begins[1:], len(at)), strict=True) if b - a > RUN_MOST] or [begins]))
                d1 = np.asarray(batch.column(0))[low + owner[begins]]
                d2 = np.asarray(batch.column(1))[low + owner[begins]]
                salts = np.maximum(1, -(-4 * n[begins] // GROUP_MOST))
                salt = np.where(hot[begins], 1 + mix(d1.view(U) ^ d2.view(U)) % salts.astype(U), 0).astype(np.int32)
                start = (w.places[at][begins] - w.words[owner[begins]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), pa.array(digests.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[begins].view(np.int64)), pa.array(salt), pa.array(d1), pa.array(d2), pa.array(start), lists],
                    names=["key", "salt", "d1", "d2", "start", "digests"],
                )

    return texts.select("d1", "d2", "packed", "hits").mapInArrow(run, SEGMENT)


def deep_nodes(rows: DataFrame) -> DataFrame:
    """MARK rows. Marked places have a length; rows without one are what a salt tells the second level about a node."""

    def marks(table: pa.Table) -> pa.RecordBatch:
        lists = table.column("digests").combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
        digests = np.asarray(lists.flatten(), dtype=np.int64)
        key, salt, d1, d2, start = (np.asarray(table.column(i)) for i in range(5))
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            node = pd.Series(mix(digests.view(U) + mix(key.view(U) + salt.astype(U))[row]))
        twice = node.duplicated(keep=False).to_numpy()
        marked = np.flatnonzero(twice)
        new = np.ones(len(marked), bool)
        new[1:] = (np.diff(marked) != 1) | (np.diff(row[marked]) != 0)
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(marked)))
        first = marked[begins]
        told = np.flatnonzero((salt[row] > 0) & ~node.duplicated().to_numpy())
        at = np.concatenate([first, told])
        known = np.concatenate([lengths, np.where(twice[told], -1, 0)])  # -1: already marked in its salt
        salted = np.concatenate([np.zeros(len(first), bool), np.ones(len(told), bool)])
        columns = [key[row[at]], salted, digests[at], d1[row[at]], d2[row[at]], (start[row[at]] + place[at]).astype(np.int32), known.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "salted", "digest", "d1", "d2", "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt = (np.asarray(batch.column(i)) for i in (0, 1))
            changes = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            if held:
                last = held[-1]
                if (last.column(0)[-1].as_py(), last.column(1)[-1].as_py()) != (int(key[0]), int(salt[0])):
                    yield marks(pa.Table.from_batches(held))
                    held = []
            if len(changes):
                yield marks(pa.Table.from_batches([*held, batch.slice(0, changes[-1])]))
                held = [batch.slice(changes[-1])]
            else:
                held.append(batch)
        if held:
            yield marks(pa.Table.from_batches(held))

    ordered = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return ordered.mapInArrow(run, MARK)


def marked_windows(found: DataFrame) -> DataFrame:
    """(d1, d2, start, length) from MARK rows: windows that start at start .. start + length - 1 occur elsewhere too."""
    told = found.filter("salted")
    joint = told.groupBy("key", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    late = told.filter("length = 0").join(joint, ["key", "digest"], "left_semi")
    places = found.filter("NOT salted").select("d1", "d2", "start", "length")
    return places.union(late.select("d1", "d2", "start", F.lit(1)))


def cut(texts: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """(d1, d2, n_removed, kept_sha256, kept): texts of classes that lose words.

    Marked windows are those of ``places`` and those that stand in the text itself twice.
    """
    spans = places.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    wide = texts.select("d1", "d2", "packed").join(spans, ["d1", "d2"], "left").select("d1", "d2", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            column = unpacked(batch.column(2))
            for low, high in slices(column):
                w = Windows(column.slice(low, high - low), window)
                edge = np.zeros(len(w.hashes) + 1, np.int64)
                own = w.places[pd.Series(keyed(w.window_hashes(window), w.owner)).duplicated(keep=False).to_numpy()]
                np.add.at(edge, own, 1)
                np.add.at(edge, own + window, -1)
                for row in range(low, high):
                    spans = batch.column(3)[row]
                    if spans.is_valid:
                        begin = np.asarray(spans.values.field(0), dtype=np.int64) + w.words[row - low]
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, begin + np.asarray(spans.values.field(1)) - 1 + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed = per_text(gone, w.words)
                rows = []
                for row in np.flatnonzero(removed).tolist():
                    kept = w.joined(row, ~gone)
                    place = low + row
                    rows.append((batch.column(0)[place].as_py(), batch.column(1)[place].as_py(), int(removed[row]), hashlib.sha256(kept).hexdigest(), kept.decode()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "n_removed", "kept_sha256", "kept"])

    return wide.mapInArrow(run, "d1 long, d2 long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """The census of ``docs`` (its columns but the text, n_words, d1, d2, sha, copies), and ``cut`` of the changed classes.

    Classes with two or more copies lose every word if they have a window; they are not in the second table.
    """
    counted = write_stage(census(docs, window), "census")
    grouped = counted.filter(F.col("n_words") >= window).groupBy("d1", "d2")
    classes = write_stage(grouped.agg(F.count("*").alias("copies"), F.first("blocks").alias("blocks"), F.first("counts").alias("counts")), "classes")
    texts = class_texts(docs).join(suspects(classes), ["d1", "d2"]).dropDuplicates(["d1", "d2"])
    texts = write_stage(texts, "suspect_texts")
    single = texts.join(classes.filter("copies = 1").select("d1", "d2"), ["d1", "d2"], "left_semi")
    nodes = write_stage(deep_nodes(segments(texts, window)), "deep_nodes")
    changed = write_stage(cut(single, marked_windows(nodes), window), "cut_texts")
    drop_stages(texts, nodes)
    several = classes.filter("copies > 1").select("d1", "d2", "copies")
    named = counted.drop("blocks", "counts").join(several, ["d1", "d2"], "left")
    return named, changed


def repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """The columns of ``docs`` but the text, and n_words, n_removed, kept_sha256 of the kept words joined by spaces."""
    named, changed = remove_repeats(docs.drop("n_removed", "kept_sha256", "copies"), window)
    wide = named.join(changed.drop("kept"), ["d1", "d2"], "left")
    copied = F.col("copies").isNotNull()
    removed = F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(copied, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha"))
    out = wide.withColumns({"n_removed": removed.cast("long"), "kept_sha256": sha})
    return out.drop("d1", "d2", "sha", "copies")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with the repeated words cut from ``text`` (and n_chars, if there, counted anew), and ``emptied``.

    Texts without a repeated word stay as they are, white space included; others become the kept words joined by single
    spaces. ``emptied`` says that a text lost all its words. Two rows equal in all columns stay two rows.
    """
    columns = [c for c in docs.columns if c != "emptied"]
    named, changed = remove_repeats(docs.select("text"), window)
    several = named.filter("copies IS NOT NULL").select("d1", "d2").distinct()
    lost = several.select("d1", "d2", F.lit("").alias("kept")).unionByName(changed.select("d1", "d2", "kept"))
    lost = write_stage(lost, "lost_words")
    wide = with_digests(docs.select(*columns)).join(lost, ["d1", "d2"], "left")
    text = F.when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col("text"))
    out = wide.withColumn("emptied", F.coalesce(F.col("kept") == "", F.lit(False))).withColumn("text", text)
    if "n_chars" in columns:
        recount = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", recount.cast(docs.schema["n_chars"].dataType))
    return out.select(*columns, "emptied")


def with_digests(docs: DataFrame) -> DataFrame:
    """``docs`` with d1 and d2 of the text's word sequence."""
    wide = docs.drop("d1", "d2").withColumns({"d1": F.lit(0).cast("long"), "d2": F.lit(0).cast("long")})
    place = wide.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [Windows(batch.column(place).slice(low, high - low), BLOCK).digests() for low, high in slices(batch.column(place))]
            both = [pa.array(np.concatenate([x[i] for x in d]) if d else np.zeros(0, np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *both], schema=batch.schema)

    return wide.mapInArrow(run, wide.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_words(docs, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")
