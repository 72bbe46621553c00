"""Near copies by the Jaccard similarity of word shingles: SimHash balls and MinHash bands name candidates, whole sets decide.

A document is the set of its word shingles. The SimHash operator goes over all of them: fingerprints of the shingles, ball
hashing around meeting points, stars in place of pairs. It finds what is within three bits. Sets of similarity 0.8 differ in
about 10 of 64 bits, half of which is a radius whose balls have 8 million points, so bands find the rest. Sets that agree in all minima of a band meet in a bucket; two sets of
similarity s share one of the BANDS buckets with probability 1 - (1 - s^DEPTH)^BANDS, 0.99999 at 0.8. Whatever met is
verified on the whole sets, so no link rests on an estimate.

Members of a bucket are never paired with all others. Each is held against one centre of those it met, and links are joined
into components. What the bands leave open goes on by rare shingles: with a set's shingles in order of how many sets have them,
two similar sets share the rarest one that they have in common, and from it on each has at most so many shingles that others
have too. So a set is in the buckets of its rarest fifth alone, whoever cannot be similar to anything in its bucket by these
counts leaves it, and near copies of one text that went too far apart are told from the rest without a pair. The centres are
those whose shingles are the most common: what others were copied from. Whoever is of another component than a centre is held
against it; the centres leave the bucket, and buckets that still hold two components go on with more centres. So every pair
that met is verified, ruled out by counts, or joined by others, after rounds that are logarithmic in the largest bucket. Sets
are read from texts once, for documents that met another.

Defined results: words and null texts are as for SimHash; a text shorter than a shingle is one shingle; texts without words
are equal; equal sets are one node; a null identifier names a component only where no other is in it; very long texts are
whole sets, their minima taken a piece at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.llm import simhash
from catalens.llm.components import connected_components
from catalens.llm.runtime import free_shuffles, join_labels, materialise, partitions

#: Words of a shingle, and the least similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of minima, and minima in each.
BANDS, DEPTH = 30, 5
SEED = 42
#: How many times as many centres a bucket has in each round as in the one before, where it has one in the first: the buckets of
#: a large group then choose few different ones.
CENTRES = 8
#: Classes of set sizes in a doubling, for which a bucket's counts are kept.
CLASSES = 32
#: Shingles whose minima are taken at a time, and rows that are sent on at a time.
CHUNK, ROWS = 1 << 12, 500
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_ODD = (np.random.default_rng(SEED).integers(0, 1 << 32, BANDS * DEPTH, np.uint32) | np.uint32(1))[:, None]
_FLIP = np.random.default_rng(SEED + 1).integers(0, 1 << 32, BANDS * DEPTH, np.uint32)[:, None]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = max(min(1, len(words)), len(words) - size + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        found = (found ^ hashes[k : k + n]) * _A
        found ^= found >> _B
    return np.unique(found)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band: its place and its minima, hashed."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), CHUNK):
        np.minimum(least, ((short[i : i + CHUNK] ^ _FLIP) * _ODD).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64) * _A
    for column in least.reshape(BANDS, DEPTH).T:
        keys = (keys ^ column) * _A
        keys ^= keys >> _B
    return keys.view(np.int64)


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                found = [shingles(t or b"", size) for t in texts]
                prints = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
                sims = np.array([simhash.fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
                cols = [part.column(0), part.column(1), pa.array(prints), pa.array([len(s) for s in found], pa.int64()), pa.array(sims), pa.array([bands(s) for s in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "fp", "n", "sim", "bands"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found = [shingles(t or b"", size).view(np.int64) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["fp", "s"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b, ...) of prints whose sets are that similar."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = both.withColumn("same", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("same") >= similar * (F.size("sa") + F.size("sb") - F.col("same"))).drop("sa", "sb", "same")


def _met(rows: DataFrame) -> DataFrame:
    """(key, fp, n) of prints in buckets that hold two or more; n is the size of the set."""
    spark = rows.sparkSession
    prints = rows.groupBy("fp").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    # The count and the rows that it selects read one exchange.
    keys = prints.select("fp", "n", F.explode("bands").alias("key")).repartition(partitions(spark), "key")
    met = keys.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most").select("key")
    return materialise(keys.join(met, "key", "left_semi"), "met")


def _centres(live: DataFrame, total: int, most: int, fresh: bool) -> DataFrame:
    """(key, b, rb, nb) of each open bucket: up to `most` members outside its largest component, any in fresh buckets, where all
    may be a centre. Members have an order of their own, the most common shingles first where live has `common`, so the buckets
    of one group choose the same ones."""
    outside = live
    if not fresh:
        roots = live.groupBy("key", "root").agg(F.count("*").alias("n"))
        main = roots.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("rows"))
        outside = join_labels(live, main, ["key"], total, "rows").where("root != main")
    further = [k for k in ("c",) if k in live.columns]
    order = F.min(F.struct(*[-F.col(k) for k in ("common",) if k in live.columns], F.xxhash64("fp").alias("h"), "fp", "root", "n", *further))
    first = outside.groupBy("key", F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.lit(most)).alias("slot")).agg(order.alias("c"))
    return first.select("key", F.col("c.fp").alias("b"), F.col("c.root").alias("rb"), F.col("c.n").alias("nb"), *[F.col(f"c.{k}").alias(f"{k}b") for k in further])


def _rarest(sets: DataFrame, similar: float) -> DataFrame:
    """(key, fp, n, c, common): the shingles by one of which every similar set meets a set of n. c counts those of its shingles
    that other sets have too, from the most common one to this; no set whose rarest shingle in common this is shares more.
    common is the mean logarithm of how many sets have its shingles."""
    # The count and the rows that it selects read one exchange.
    items = sets.select("fp", F.size("s").alias("n"), F.explode("s").alias("key")).repartition(partitions(sets.sparkSession), "key")
    often = items.groupBy("key").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    own = W.partitionBy("fp")
    common = F.sum(F.log2("df")).over(own) / F.col("n")
    found = items.join(often, "key").select("key", "fp", "n", F.row_number().over(own.orderBy(F.desc("df"), "key")).alias("c"), common.cast("float").alias("common"))
    return materialise(found.where(F.col("c") >= similar * F.col("n")), "rarest")


def _may_link(n: Column, c: Column, other_n: Column, other_c: Column, similar: float) -> Column:
    """Whether sets of these sizes can be similar, if they share no more than the lesser of the counts."""
    return F.least(c, other_c) >= similar * (n + other_n - F.least(c, other_c))


def _open(live: DataFrame, total: int, similar: float) -> DataFrame:
    """The rows of buckets with two components that may link with something in the bucket, by the largest count of each class of sizes."""
    classes = live.groupBy("key", F.floor(CLASSES * F.log2("n")).alias("class")).agg(
        F.max("c").alias("c"), F.min("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows")
    )
    keys = classes.groupBy("key").agg(F.collect_list(F.struct("n", "c")).alias("classes"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
    both = join_labels(live, keys.where("low != high").drop("low", "high"), ["key"], total, "rows")
    return both.where(F.exists("classes", lambda x: _may_link(F.col("n"), F.col("c"), x["n"], x["c"], similar))).drop("classes", "rows")


def _within_bits(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of prints by the SimHash operator: each with the first one of its fingerprint, and the first ones along its stars."""
    sims = rows.groupBy("fp").agg(F.min("sim").alias("sim"))
    firsts = materialise(sims.groupBy("sim").agg(F.min("fp").alias("first")), "fingerprints")
    own = sims.join(firsts, "sim").where("fp != first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    stars = simhash.links(firsts.select(F.col("sim").alias("fp")))
    along = stars.join(firsts.toDF("a", "u"), "a").join(firsts.toDF("b", "v"), "b").select("u", "v")
    return materialise(own.union(along).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "within-bits")


def groups(rows: DataFrame, texts: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(node, root) of the prints of rows (row, fp, n, sim, bands) that are near copies of others. texts has (row, text) of every row."""
    spark, within = rows.sparkSession, _within_bits(rows)
    free_shuffles(spark)
    live = _met(rows)
    both = live.select("fp").union(within.select("a")).union(within.select("b")).distinct()
    asked = rows.join(both, "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("row"))
    asked = asked.select("fp", *[F.col(f"row.{k}").alias(k) for k in ("id", "h1", "h2")])
    whole = texts.select(F.col("row.id").alias("tid"), F.col("row.h1").alias("th1"), F.col("row.h2").alias("th2"), "text")
    read = whole.join(asked, F.expr("id <=> tid AND h1 = th1 AND h2 = th2")).select("fp", "text").dropDuplicates(["fp"])
    sets = materialise(read.mapInArrow(_sets(size), "fp bigint, s array<bigint>"), "sets")
    del asked, both, whole, read
    free_shuffles(spark)

    # Each member is held against what is within bits of it, and against one centre, the first of those it met: large groups join by that.
    live = live.withColumn("root", F.col("fp"))
    against = live.join(materialise(_centres(live, live.count(), 1, True), "centres"), "key").where("root != rb")
    met = against.where(F.least("n", "nb") >= similar * F.greatest("n", "nb")).groupBy("fp").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b"))["b"].alias("b"))
    pairs = met.union(within).select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()
    named = connected_components(materialise(_verified(pairs, sets, similar), "verified").select("a", "b"))
    del live, against, met, pairs
    free_shuffles(spark)

    live, most = _rarest(sets, similar), 1
    live = materialise(live.join(named.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "met")
    while True:
        live = materialise(_open(live, live.count(), similar), "open")
        # Written, so that the join may split a bucket with a large share of all members.
        centres = materialise(_centres(live, live.count(), most, most == 1), "centres")
        if not centres.count():
            return named
        against = live.join(centres, "key").where("root != rb").where(_may_link(F.col("n"), F.col("c"), F.col("nb"), F.col("cb"), similar))
        pairs = against.select("root", "rb", F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b"))
        new = materialise(_verified(pairs.groupBy("a", "b").agg(F.any_value(F.struct("root", "rb")).alias("roots")), sets, similar), "verified")
        # Links join components; later rounds see those alone.
        joined = connected_components(new.select(F.col("roots.root").alias("a"), F.col("roots.rb").alias("b")))
        over = joined.toDF("root", "new")
        before = named.join(over, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        named = materialise(before.union(joined.join(named, "node", "left_anti")), "named")
        # The members of open buckets, less the centres that all others were held against.
        left = live.join(centres.select("key", F.col("b").alias("fp")), ["key", "fp"], "left_anti")
        left = left.join(over, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        live, most = materialise(left, "met"), CENTRES * most
        free_shuffles(spark)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, row, fp, component_id, first) of every row; component_id is the smallest identifier reachable over links, first
    the first row of the component by simhash.row_of()."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), simhash.row_of(doc_id, text).alias("row"), F.col(text).cast("string").alias("text"))
    kind = "struct<late:boolean,id:bigint,h1:bigint,h2:bigint>"
    rows = materialise(plain.mapInArrow(_sketches(size), f"doc_id bigint, row {kind}, fp bigint, n bigint, sim bigint, bands array<bigint>"), "sketches")
    return simhash.components_of(rows.select("doc_id", "row", "fp"), groups(rows, plain.select("row", "text"), size, similar))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Of documents that near copies link, the row with the smallest identifier, with all columns."""
    found = near_copies(docs, doc_id, text, size, similar)
    firsts = found.select("row", "first").where(F.expr("row <=> first")).select("first.*").distinct()
    return simhash.keep_one_of_each(docs, firsts, doc_id, text)
