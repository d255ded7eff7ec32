"""A corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the
columns of ``documents``. ``run`` applies them to the documents of ``sf_dir``. Stage results are written as Parquet and
read back between stages.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, language_id, near_duplicates, packing, repeats
from tidemark.sources.stages import write_stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Cosine with the best language profile below which a text resembles none of them, by its distinct letter triples. Below
# FEW_GRAMS chance (a deviation of 1/32 per language) and clean texts overlap, so nothing goes. From there the border
# rises with the logarithm, to LONG_COSINE from MANY_GRAMS on. On sf0.01 documents reach 0.21 from 20 triples on, 0.29 from
# 40, 0.48 from 80 and 0.69 from 160; random letters, consonants, base64 and unknown scripts stay under 0.18.
FEW_GRAMS, SHORT_COSINE = 20, 0.15
MANY_GRAMS, LONG_COSINE = 160, 0.35
# A profile of few texts is the direction of these texts rather than of their language, so the border of a language counts
# in proportion to n^2 / (n^2 + FAMILIAR^2), n being the texts it was learnt from: half at 25, a hundredth at 2.5.
FAMILIAR = 25


def least_cosine(grams: Column) -> Column:
    place = F.log(grams / FEW_GRAMS) / math.log(MANY_GRAMS / FEW_GRAMS)
    rising = F.least(F.lit(LONG_COSINE), SHORT_COSINE + (LONG_COSINE - SHORT_COSINE) * place)
    return F.when(grams < FEW_GRAMS, 0.0).otherwise(rising)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, with null text, or like no known language; profiles come from all documents.

    The less a language was taught the lower its border; where no document has a language, all those with a letter stay.
    """
    profiles = language_id.learn_profiles(docs, F.lit(True))
    taught = docs.filter("text IS NOT NULL AND lang IS NOT NULL").groupBy("lang").count().collect()  # a row per language
    found = language_id.identify_languages(docs.select(*COLUMNS), profiles, evidence=True)
    weights = F.create_map(F.lit(language_id.UNDETERMINED), F.lit(0.0), *[F.lit(v) for row in taught for v in (row["lang"], row["count"] ** 2 / (row["count"] ** 2 + FAMILIAR**2))])
    border = least_cosine(F.col("n_grams")) * F.coalesce(F.try_element_at(weights, F.col("lang_pred")), F.lit(0.0))
    return found.filter(F.col("text").rlike(r"\p{L}") & (F.col("score") >= border)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8): that of the least id.

    Rows of one id are one document here: its different texts all stay or all go. Of rows that share id and text one stays;
    rows without an id all stay.
    """
    judged = near_duplicates.near_duplicates(docs, width=5, percent=80)
    gone = judged.filter("NOT kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    several = judged.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    # Few rows, if any, go this way.
    doubled = kept.join(several, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_row"))
    single = kept.join(several, "doc_id", "left_anti")
    return single.unionByName(doubled.select("doc_id", "text", "_row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside passages of 35 words that occur more than once are cut; a document that loses all of them goes.

    A text that loses words becomes its other words joined by single spaces; other texts stay as they are.
    """
    return repeats.without_repeats(docs.select(*COLUMNS), window=35).filter("NOT emptied").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of the five-word shingles of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = contamination.contaminated(docs, items, width=5, percent=80)
    hits = write_stage(pairs.select(F.col("doc_id").alias("_id"), "text_hash").distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("text_hash"))
    return docs.select(*COLUMNS).join(hits, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids in sequences; ``ids_crc32`` stands for the ids."""
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Profiles, token ids and the packing order are beyond SQL: tests hold run() against a plain Python pipeline.
ORACLE_SQL = None
