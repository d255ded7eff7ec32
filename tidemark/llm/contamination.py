"""Benchmark decontamination: short test items inside long documents, with Spark expressions only.

An item is found in a document that holds at least ``percent`` of its distinct shingles (``width`` words, lower case).

Search. Items are partitioned by size, in powers of two. An item keeps a MinHash sketch: its shingles with the least
hashes, as many as the largest item of its partition may miss, and one more. A document that contains the item to the
wanted share lacks fewer shingles than the sketch has, so at least one sketch entry is among its own: every true pair
becomes a candidate, long as the document may be. All shingles of a document stream past the sketch table; nothing is
kept for shingles without a hit.

Verification. Shingles of candidate documents are compared as text with all shingles of their items, and counted.

The sketch table and the items' shingles are broadcast if they measure at most ``BROADCAST_BYTES``; beyond that Spark joins by
shuffling on the hash, or on the shingle.

Null and empty documents and items have no shingles and match nothing. One with fewer words than ``width`` has its whole
sequence as its one shingle, so a short item is found in a document that is just that. Documents and items are told by id
and text together: rows without an id are judged by themselves, rows that share an id but not a text are documents
(items) of their own, repeated rows give one result. Ties do not arise: all pairs are returned. Texts are read whole,
long ones too. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stages import write_stage

BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64  # of a row in a hash table, beside its text
ITEM = ("item_id", "item_hash")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), "")


def places(words: Column, width: int) -> Column:
    """Numbers of the words at which a shingle starts."""
    last = F.greatest(F.size(words) - width, F.lit(0))
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def shingle_hash(words: Column, place: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, place + j) for j in range(width)])


def shingle_text(words: Column, place: Column, width: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, place + j) for j in range(width)])


def sliding(rows: DataFrame, width: int) -> DataFrame:
    """A row per shingle: the columns of ``rows`` (with ``_words``) and its place."""
    return rows.select("*", F.explode(places(F.col("_words"), width)).alias("_place"))


def item_shingles(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(item_id, item_hash, shingle, hash, n_item, in_sketch) of each distinct shingle; item_hash tells texts of an id apart."""
    each = sliding(items.select("item_id", F.xxhash64("text").alias("item_hash"), words_of(F.col("text")).alias("_words")), width)
    text = shingle_text(F.col("_words"), F.col("_place"), width)
    hashed = each.select(*ITEM, text.alias("shingle"), shingle_hash(F.col("_words"), F.col("_place"), width).alias("hash"))
    sets = hashed.groupBy(*ITEM).agg(F.sort_array(F.collect_set(F.struct("hash", "shingle"))).alias("_set"))
    size = F.size("_set")
    largest = F.pow(F.lit(2), F.ceil(F.log2(size)))  # of the partition
    kept = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    listed = sets.select(*ITEM, size.cast("long").alias("n_item"), kept.alias("_kept"), F.posexplode("_set").alias("_rank", "_entry"))
    return listed.select(*ITEM, "n_item", "_entry.shingle", "_entry.hash", (F.col("_rank") < F.col("_kept")).alias("in_sketch"))


def sized(table: DataFrame, measured: int) -> DataFrame:
    return F.broadcast(table) if measured <= BROADCAST_BYTES else table


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, item_id, item_hash, n_item, n_shared): pairs with 100 * n_shared >= percent * n_item."""
    known = write_stage(item_shingles(items, width, percent), "item_shingles")
    sketch = known.filter("in_sketch").select("hash", *ITEM)
    b_sketch, b_known = known.agg(
        F.coalesce(F.count_if("in_sketch") * ROW_BYTES, F.lit(0)), F.coalesce(F.sum(F.octet_length("shingle") + ROW_BYTES), F.lit(0))
    ).first()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("_words"))
    stream = sliding(texts, width)
    hashed = stream.select("doc_id", "text_hash", shingle_hash(F.col("_words"), F.col("_place"), width).alias("hash"))
    found = hashed.join(sized(sketch, b_sketch), "hash").select("doc_id", "text_hash", *ITEM).distinct()
    candidates = write_stage(found, "candidates")

    keys = candidates.select("doc_id", "text_hash").distinct()
    same = texts["doc_id"].eqNullSafe(keys["doc_id"]) & (texts["text_hash"] == keys["text_hash"])
    wanted = sliding(texts.join(keys, same, "left_semi"), width)
    spelled = wanted.select("doc_id", "text_hash", shingle_text(F.col("_words"), F.col("_place"), width).alias("shingle"))
    shared = spelled.join(sized(known.select(*ITEM, "n_item", "shingle"), b_known), "shingle").distinct()
    counted = shared.groupBy("doc_id", "text_hash", *ITEM, "n_item").agg(F.count("*").alias("n_shared"))
    # Pairs that only the verification met lack the sketch entry that a true pair must have.
    return counted.filter(100 * F.col("n_shared") >= percent * F.col("n_item"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    pairs = contaminated(docs, items, width=5, percent=80)
    containment = (F.col("n_shared") / F.col("n_item")).alias("containment")
    return pairs.select("doc_id", "item_id", "n_item", "n_shared", containment).distinct()


def _sql_shingles(table: str, key: str) -> str:
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"
    return f"""
      SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS shingle
      FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
            FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"""


OP2_SQL = f"""
WITH own_items AS (SELECT *, row_number() OVER () AS item FROM benchmark), own_docs AS (SELECT *, row_number() OVER () AS doc FROM documents),
items AS ({_sql_shingles("own_items", "item")}),
sizes AS (SELECT item, count(*) AS n_item FROM items GROUP BY item),
docs AS ({_sql_shingles("own_docs", "doc")}),
shared AS (SELECT doc, item, count(*) AS n_shared FROM docs JOIN items USING (shingle) GROUP BY doc, item)
SELECT DISTINCT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item) JOIN own_items USING (item) JOIN own_docs USING (doc) WHERE 100 * n_shared >= 80 * n_item
"""
