"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

1. Texts with equal shingle sets form a class; only the class with its least id goes on.
2. A signature has ``CHUNKS`` chunks of ``PER_CHUNK`` b-bit symbols. By the pigeonhole principle two signatures that
   differ in at most 2 * CHUNKS - 1 symbols differ in at most one symbol of some chunk. All such errors are enumerated
   as keys that leave one symbol of a chunk out, so each pair within that distance shares a key. (At a similarity of 0.8
   a symbol differs with probability 0.2, and a pair shares no key with probability 3e-6.)
3. Pairs of a bucket are not all emitted. First each member is compared with the bucket's least member; the confirmed
   links give components. Only members of one bucket that are still in different components are compared after that,
   so that every pair with a common key is either confirmed, refuted or already connected: no link is lost. Where they
   are many (variants just below the similarity, beside a large component) blocks of them meet blocks of the component
   inside tasks of bounded size, and only links come out.
4. Before whole sets are compared, pairs are dropped whose sizes exclude the similarity, or whose signatures differ in
   more than ``FAR`` symbols (six standard deviations from what similarity 0.8 gives).

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows without an id keep
their row, with a null component, and are kept. Rows that share an id are one document, which has the links of each of
its texts. Repeated rows are equal. The component is the least id in it. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shingles import minhash, shared, shingle_sets
from tidemark.llm.stages import drop_stages
from tidemark.llm.textarrays import U, cuts, mix, packed, slices, unpacked
from tidemark.sources.stages import write_stage

CHUNKS, PER_CHUNK, BITS = 12, 6, 11
SYMBOLS = CHUNKS * PER_CHUNK
FAR = 35
BROADCAST_IDS = 1_000_000  # of 8 bytes each
LISTED_MOST = 1024  # undecided pairs of a part up to which they are listed one by one
BLOCK_SHINGLES = 250_000  # of a block of texts that a task holds


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, symbols): two hashes of the set, and the signature as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                values, offsets = shingle_sets(batch.column(1).slice(low, high - low), width)
                symbols = minhash(values, offsets, SYMBOLS, BITS)
                with np.errstate(over="ignore"):
                    sums = [np.append(U(0), np.cumsum(mix(values ^ U(seed)), dtype=U))[offsets] for seed in (1, 2)]
                    h1, h2 = (s[1:] - s[:-1] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array([row.tobytes() for row in symbols], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "symbols"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, symbols binary")


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): for each chunk and each symbol left out, the chunk's other symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, PER_CHUNK)
            keys = np.empty((len(symbols), CHUNKS, PER_CHUNK), np.int64)
            chunk = np.arange(CHUNKS, dtype=np.int64)
            for gap in range(PER_CHUNK):
                key = np.broadcast_to(chunk * PER_CHUNK + gap, symbols.shape[:2]).copy()
                for j in range(PER_CHUNK):
                    if j != gap:
                        key = (key << BITS) | symbols[:, :, j]
                keys[:, :, gap] = key
            nodes_of = np.repeat(np.asarray(batch.column(0)), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes_of)], names=["key", "node"])

    return nodes.select("node", "symbols").mapInArrow(run, "key long, node long")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose sizes and signatures allow the similarity."""
    sides = [nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("symbols").alias(f"s_{x}")) for x in "ab"]
    wide = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
    fitting = wide.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            near = pa.array((a != b).sum(axis=1) <= FAR)
            yield batch.select(["a", "b"]).filter(near)

    return fitting.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def texts_of_nodes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, packed, size) of the wanted ids: compressed texts, since joins repeat them, and their bytes before.

    Up to ``BROADCAST_IDS`` ids go to the texts, beyond that Spark moves both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).fill_null("")
            sizes = pa.compute.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(text), sizes], names=["doc_id", "packed", "size"])

    ids = write_stage(wanted.distinct(), "wanted")
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(near, "doc_id", "left_semi")
    return write_stage(texts.mapInArrow(run, "doc_id long, packed binary, size long"), "linked_texts")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v): pairs whose full shingle sets have the similarity."""
    sides = [texts.select(F.col("doc_id").alias(x), F.col("packed").alias(f"t_{x}"), F.col("size").alias(f"n_{x}")) for x in "ab"]
    # The pivot of many pairs is joined last: Spark splits that side and repeats its one text.
    wide = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "t_a", "t_b", F.expr("n_a + n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in cuts(np.asarray(batch.column(4))):
                part = batch.slice(low, high - low)
                common, union = shared(unpacked(part.column(2)), unpacked(part.column(3)), width)
                linked = pa.array((common > 0) & (100 * common >= percent * union))
                kept = part.select(["a", "b"]).filter(linked)
                yield pa.RecordBatch.from_arrays(kept.columns, names=["u", "v"])

    return wide.mapInArrow(run, "u long, v long")


def undecided(members: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, node, odd): for parts that share a bucket with nodes of other parts, their nodes and those others.

    A part is a component, or a node without a link. In a bucket of several parts the one with most nodes is the main
    part and the nodes of others are odd there. Every pair of the bucket that is not yet decided is a pair of an odd
    node with a node of the main part or with another odd node.
    """
    part = F.coalesce("component", nodes["node"])
    own = nodes.join(found, nodes["node"] == found["node"], "left").select(nodes["node"], part.alias("part"))
    placed = members.filter("n > 2").join(own, "node").select("key", "node", "part")
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.count("*").alias("parts"))
    mixed = placed.join(main.filter("parts > 1").select("key", "main"), "key").filter("part <> main")
    odd = write_stage(mixed.select(F.col("main").alias("part"), "node").distinct(), "odd_nodes")
    whole = own.join(odd.select("part").distinct(), "part", "left_semi").select("part", "node")
    both = whole.withColumn("odd", F.lit(False)).unionByName(odd.withColumn("odd", F.lit(True)))
    return write_stage(both.join(nodes.select("node", "n_shingles", "symbols"), "node"), "undecided")


def undecided_links(docs: DataFrame, groups: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) among undecided pairs, and the table of texts they are read from.

    Few pairs of a part are listed; many are compared block by block inside tasks, and only links leave these.
    """
    totals = groups.groupBy("part").agg(
        F.count_if("odd").alias("n_odd"),
        F.count("*").alias("n_all"),
        F.sum(F.when(F.col("odd"), F.col("n_shingles"))).alias("s_odd"),
        F.sum("n_shingles").alias("s_all"),
    )
    many = F.col("n_odd") * F.col("n_all") > LISTED_MOST
    few = groups.join(totals.filter(~many).select("part"), "part", "left_semi").select("part", "node", "odd")
    x, y = few.filter("odd").select("part", F.col("node").alias("x")), few.select("part", F.col("node").alias("y"))
    pairs = x.join(y, "part").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    nodes = groups.select("node", "n_shingles", "symbols").distinct()
    listed = write_stage(plausible(pairs, nodes, percent), "pairs")

    blocks = lambda name: F.ceil(F.col(name) / BLOCK_SHINGLES).cast("int")
    dealt = totals.filter(many).select("part", blocks("s_odd").alias("b_odd"), blocks("s_all").alias("b_all"))
    large = groups.join(dealt, "part")
    own = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    others = F.sequence(F.lit(0), F.col("b_all") - 1)
    queries = large.filter("odd").select("part", "node", F.lit(True).alias("query"), own("b_odd").alias("bx"), F.explode(others).alias("by"))
    against = large.select("part", "node", F.lit(False).alias("query"), own("b_all").alias("by"), F.explode(F.sequence(F.lit(0), F.col("b_odd") - 1)).alias("bx"))
    rows = queries.unionByName(against.select(*queries.columns))
    one = nodes.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("symbols").alias("symbols"))
    texts = texts_of_nodes(docs, large.select(F.col("node").alias("doc_id")).union(ends_of(listed)))
    kept = texts.withColumnRenamed("doc_id", "node")
    full = rows.join(one, "node").join(kept, "node").select("part", "bx", "by", "node", "query", "n_shingles", "symbols", "packed")

    def compare(table: pa.Table) -> pa.Table:
        ids, query = np.asarray(table.column("node")), np.asarray(table.column("query"))
        sizes = np.asarray(table.column("n_shingles"))
        symbols = np.frombuffer(b"".join(table.column("symbols").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        values, offsets = shingle_sets(unpacked(table.column("packed").combine_chunks()), width)
        right = np.flatnonzero(~query)
        links = []
        for i in np.flatnonzero(query).tolist():
            fits = 100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i])
            near = right[fits & (ids[right] != ids[i])]
            near = near[(symbols[near] != symbols[i]).sum(axis=1) <= FAR]
            if not len(near):
                continue
            mine = np.sort(values[offsets[i] : offsets[i + 1]])
            counts = offsets[near + 1] - offsets[near]
            ends = np.cumsum(counts)
            theirs = values[np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(offsets[near], counts)]
            found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            common = np.diff(np.append(0, np.cumsum(found))[np.append(0, ends)])
            linked = near[100 * common >= percent * (len(mine) + counts - common)]
            links += [(max(ids[i], ids[j]), min(ids[i], ids[j])) for j in linked]
        out = np.array(sorted(set(links)), np.int64).reshape(-1, 2)
        return pa.table({"u": out[:, 0], "v": out[:, 1]})

    blocked = full.groupBy("part", "bx", "by").applyInArrow(compare, "u long, v long")
    return confirmed(listed, texts, width, percent).unionByName(blocked), texts


def link_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, (node, component) of all class representatives with a link, and the classes."""
    signed = write_stage(signatures(docs, width), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("symbols").alias("symbols"))
    nodes = write_stage(classes, "classes")
    keys = bucket_keys(nodes)
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    members = write_stage(keys.join(buckets, "key").select("key", "node", "pivot", "n"), "buckets")
    first = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    pairs = write_stage(plausible(first, nodes, percent), "pairs")
    texts = texts_of_nodes(docs, ends_of(pairs))
    links = write_stage(confirmed(pairs, texts, width, percent), "links")
    drop_stages(texts, pairs)
    # Rows that share an id but not a set: their classes are one document.
    several = usable.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high")
    same = usable.join(several, "doc_id", "left_semi").join(nodes.drop("symbols"), ["h1", "h2", "n_shingles"])
    links = links.union(same.select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    found = components(links)
    groups = undecided(members, found, nodes)
    if groups.limit(1).count():
        more, texts = undecided_links(docs, groups, width, percent)
        more = write_stage(more, "links")
        drop_stages(texts, groups)
        found = components(links.union(more))
    return signed, found, nodes


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; texts link at a Jaccard similarity >= percent / 100."""
    signed, found, nodes = link_components(docs, width, percent)
    named = nodes.join(found, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2, percent=80)
