r"""Exact dedup with an extendible-hash index on shared files, with Spark expressions only.

Texts are equal if their normalised bytes are: every run of ``[\x20\x09-\x0D]`` is one space, null is empty.

Entries. One pass over the texts writes the entries: id, key (a 64-bit hash of the normalised text) and SHA-256. Keys are
counted with map-side combine; a key that occurs once needs no further work.

Directory. Buckets are key ranges: all keys with the same leading bits. A bucket with more than ``capacity`` distinct keys
splits in two by its next bit, others keep their depth, and the directory doubles until nothing is overfull: it has
a slot for each value of the longest prefix, and slots of a shallow bucket share it. Counts by prefix give several
doublings from one aggregate; only keys of buckets that are still overfull are counted again. Keys that agree in all
bits cannot be split; their bucket overflows into its chains.

Owners. Texts whose key repeats are collapsed where they lie (group by key and bytes, combined before the shuffle), so of
a group of copies at most one text leaves each task. The directory sends what is left to the owner of its bucket. There
texts of one key are compared byte by byte: different ones form a chain of collisions, one link each, and links are
the classes. Rows of keys with one link take the class by key; rows of chained keys by key and bytes.

Of a class the row with the smallest id stays (null ids last); of several rows with that id exactly one. Repeated rows
are rows of their own, so each gets a row in the result. Empty and null texts form one class. Long texts are hashed and
compared whole. Columns other than the id and the text are not read. An empty table gives an empty result.

Broadcast are: keys with at least 1/``HEAVY`` of all rows, so at most ``HEAVY`` of them, and the list of repeated keys if
it has at most ``BROADCAST_KEYS``; beyond that rows of light keys are joined by shuffling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stages import Stage, write_stage

KEY_BITS = 64
CAPACITY = 1 << 15  # distinct keys of a bucket
HEAVY = 1024
BROADCAST_KEYS = 500_000  # 8 bytes each


@dataclass(frozen=True)
class HashIndex:
    entries: DataFrame  # doc_id, key, sha, row: of every row
    directory: DataFrame  # slot, bucket, depth
    global_depth: int
    repeated: DataFrame  # key, n, first_id, first_row: keys of several rows
    classes: DataFrame  # bucket, key, chain, chains, keep_id, n, text (of chained keys): links of repeated keys
    total: int


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def key_of(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), KEY_BITS - bits)


def prefix(key: Column, depth: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, bits - depth) if depth else F.lit(0).cast("long")


def split_overfull(keys: DataFrame, opened: DataFrame | None, low: int, high: int, capacity: int, bits: int, stage: Stage) -> DataFrame:
    """Children (bucket, depth, n, full) below overfull nodes of depth ``low`` to ``high``; ``opened``: those of depth ``low``."""
    if opened is not None:
        keys = keys.join(opened.select("bucket"), prefix(F.col("key"), low, bits) == F.col("bucket"), "left_semi")
    fine = keys.groupBy(prefix(F.col("key"), high, bits).alias("fine")).agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    levels = fine.select("fine", "n", level)
    levels = levels.withColumn("bucket", F.expr(f"shiftright(fine, {high} - depth)"))
    nodes = stage(levels.groupBy("depth", "bucket").agg(F.sum("n").alias("n")), "directory_nodes")
    split = nodes.filter((F.col("n") > capacity) & (F.col("depth") < high))
    children = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
    counted = children.join(nodes, ["depth", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = (F.col("n") > capacity) & (F.col("depth") < bits)
    return counted.select("bucket", "depth", "n", full.alias("full"))


def grow_directory(keys: DataFrame, capacity: int, bits: int, stage: Stage) -> tuple[DataFrame, int]:
    """(slot, bucket, depth, n) for distinct ``keys``, and the global depth."""
    spark, n_keys = keys.sparkSession, keys.count()
    if n_keys <= capacity or not bits:
        return spark.range(1).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("depth"), F.lit(n_keys).cast("long").alias("n")), 0
    low, high, opened, leaves = 0, min(bits, math.ceil(math.log2(n_keys / capacity)) + 2), None, None
    while True:
        children = split_overfull(keys, opened, low, high, capacity, bits, stage)
        # An overfull node above ``high`` was split on the spot; one at ``high`` has to be counted more finely.
        children = stage(children.filter(~F.col("full") | (F.col("depth") == high)), "directory_children")
        closed = children.filter(~F.col("full"))
        leaves = closed if leaves is None else leaves.unionByName(closed)
        opened = children.filter("full")
        if opened.isEmpty():
            break
        low, high = high, min(bits, high + 4)
    depth = leaves.agg(F.max("depth")).first()[0]
    shift = f"{depth} - depth"
    slots = F.expr(f"sequence(shiftleft(bucket, {shift}), shiftleft(bucket + 1, {shift}) - 1)")
    # A bucket is known by its first slot: prefixes of different depths could be the same number.
    return stage(leaves.select(F.explode(slots).alias("slot"), F.expr(f"shiftleft(bucket, {shift})").alias("bucket"), "depth", "n"), "directory"), depth


def with_text(docs: DataFrame, bits: int) -> DataFrame:
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    return texts.select("doc_id", key_of(F.col("text"), bits).alias("key"), "text")


def rows_of_keys(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """The rows whose key is in ``keys`` (key, n; distinct)."""
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys.select("key")), "key", "left_semi")
    heavy, light = by_weight(keys, total)
    return rows.join(F.broadcast(heavy.select("key")), "key", "left_semi").unionByName(rows.join(light.select("key"), "key", "left_semi"))


def by_weight(keys: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Keys with at least 1/HEAVY of all rows, and the others."""
    heavy = F.col("n") * HEAVY >= total
    return keys.filter(heavy), keys.filter(~heavy)


def build_index(docs: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS, stage: Stage = write_stage) -> HashIndex:
    texts = with_text(docs, bits)
    sha = F.unhex(F.sha2(F.col("text"), 256))
    entries = stage(texts.select("doc_id", "key", sha.alias("sha"), F.monotonically_increasing_id().alias("row")), "entries")
    first_row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    counted = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), first_row.alias("first_row"))
    keys = stage(counted, "keys")
    directory, depth = grow_directory(keys, capacity, bits, stage)
    repeated = stage(keys.filter("n > 1"), "repeated_keys")
    total = entries.count()

    alike = rows_of_keys(texts, repeated, total).groupBy("key", "text").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"))
    placed = alike.withColumn("slot", prefix(F.col("key"), depth, bits)).join(directory.select("slot", "bucket"), "slot")
    owned = placed.repartition("bucket")
    chained = owned.selectExpr(
        "bucket",
        "key",
        "row_number() OVER (PARTITION BY bucket, key ORDER BY keep_id NULLS LAST, text) AS chain",
        "count(*) OVER (PARTITION BY bucket, key) AS chains",
        "keep_id",
        "n",
        "text",
    )
    classes = stage(chained.withColumn("text", F.when(F.col("chains") > 1, F.col("text"))), "classes")
    return HashIndex(entries, directory, depth, repeated, classes, total)


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS, stage: Stage = write_stage) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) of every row."""
    index = build_index(docs, capacity, bits, stage)
    links = index.classes.filter("chains = 1").select("key", "n", "keep_id").join(index.repeated.select("key", "first_row"), "key")
    known = stage(links, "links")
    chained = index.classes.filter("chains > 1")
    collided = not chained.isEmpty()
    entries = index.entries
    if collided:
        chains = stage(chained.groupBy("key").agg(F.sum("n").alias("n")), "chained_keys")
        entries = entries.join(chains.select("key"), "key", "left_anti")
    heavy, light = by_weight(known, index.total)
    first = entries.join(F.broadcast(heavy), "key")
    rest = entries.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key", "left")
    alone = {"n": F.coalesce("n", F.lit(1)), "keep_id": F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "first_row": F.coalesce("first_row", "row")}
    labelled = first.unionByName(rest.withColumns(alone).select(first.columns))
    if collided:
        texts = rows_of_keys(with_text(docs, bits), chains, index.total)
        rows = stage(texts.select("*", F.unhex(F.sha2("text", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "chained_rows")
        first_row = F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("first_row")
        firsts = rows.groupBy("key", "text").agg(first_row)
        named = chained.select("key", "text", "n", "keep_id").join(firsts, ["key", "text"])
        labelled = labelled.unionByName(rows.join(named, ["key", "text"]).select(labelled.columns))
    return labelled.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs)


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""
