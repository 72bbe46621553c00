"""Exact duplicates by content sort.

Sampled splitters, weighed by the bytes of their texts, range-partition the normalised texts; within a partition an external sort places equal texts next to
each other, and each row is compared in full with its neighbour. The partitioning key is (first bytes, content hash,
identifier): equal texts are contiguous in it, and a group of copies that is larger than a partition is cut between
identifiers. Such a group holds a splitter, so its parts, one row for each partition, are joined afterwards.

Defined results: a null text is the empty text; a null identifier sorts last; of repeated rows with the smallest
identifier one stays; an empty table gives an empty result; further columns are carried only when asked for.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.llm.runtime import bisect, let, materialise, partitions, text_of

#: Sampled rows for each splitter.
OVERSAMPLE = 12
#: Characters of a text that lead its partitioning key.
LEAD = 24
#: Separator runs that are not yet one space.
_UNEVEN = " [\\x20\\x09-\\x0D]+|[\\x09-\\x0D][\\x20\\x09-\\x0D]*"

#: What a row weighs beside its text.
ROW_BYTES = 100


def normalised(text):
    return F.regexp_replace(text, _UNEVEN, " ")


def _key(norm, doc_id: str):
    return F.struct(F.substring(norm, 1, LEAD).alias("lead"), F.xxhash64(norm).alias("hash"), F.col(doc_id).isNull().alias("late"), F.col(doc_id).cast("bigint").alias("id"))


def _splitters(docs: DataFrame, doc_id: str, text: str, parts: int) -> list:
    """At most parts - 1 keys that cut the sorted rows into runs of about equal bytes; from a sample of parts x OVERSAMPLE rows or
    so, which long texts enter by their bytes."""
    sized = docs.select(doc_id, text, (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).alias("__weight"))
    total = sized.agg(F.sum("__weight")).first()[0] or 0
    if parts < 2 or not total:
        return []
    step = total / (parts * OVERSAMPLE)
    drawn = sized.where(F.rand(11) * step < F.col("__weight"))
    drawn = drawn.select(_key(normalised(text_of(text)), doc_id).alias("key"), F.greatest("__weight", F.lit(step)).alias("weight"))
    keys = sorted(((tuple(r["key"]), r["weight"]) for r in drawn.collect()), key=lambda k: (k[0][0].encode(), k[0][1], k[0][2], k[0][3] or 0))
    drawn_total, found, so_far = sum(w for _, w in keys), [], 0
    for key, weight in keys:
        # A key opens the partition that its bytes reach into.
        if len(found) < parts - 1 and so_far * parts >= (len(found) + 1) * drawn_total:
            found.append(key)
        so_far += weight
    return found


def _literal(values: list, schema: str):
    """An array as one literal, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of docs with its group: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`, and the columns in carry."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    found = _splitters(docs, doc_id, text, parts)
    carried = [F.col(c).alias(f"__row_{i}") for i, c in enumerate(carry or [])]
    rows = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("__text"), *carried)
    own = _key(F.col("__norm"), "__id")
    heads = sorted({(a, b) for a, b, _, _ in found}, key=lambda k: (k[0].encode(), k[1]))
    if found:
        cuts = _literal([{"lead": a, "hash": b, "late": c, "id": d} for a, b, c, d in found], "lead:string,hash:bigint,late:boolean,id:bigint")
        rows = rows.withColumn("__norm", normalised(F.col("__text"))).withColumn("__part", bisect(cuts, own)).drop("__text")
    else:
        rows = rows.withColumns({"__norm": normalised(F.col("__text")), "__part": F.lit(0)}).drop("__text")
    rows = rows.repartitionById(parts, "__part")

    order = W.partitionBy("__part").orderBy("__norm", F.col("__id").asc_nulls_last())
    before = F.lag("__norm").over(order)
    rows = rows.withColumn("__first", before.isNull() | (before != F.col("__norm")))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    head = F.struct(F.substring("__norm", 1, LEAD).alias("lead"), F.xxhash64("__norm").alias("hash"))
    cut = F.lit(False)
    if heads:
        cut_heads = _literal([{"lead": a, "hash": b} for a, b in heads], "lead:string,hash:bigint")
        cut = let(head, lambda h: F.get(cut_heads, bisect(cut_heads, h) - 1).eqNullSafe(h))
    rows = rows.select(
        "__id", "__part", "__first", *[c for c in rows.columns if c.startswith("__row_")],
        F.sum(F.col("__first").cast("bigint")).over(so_far).alias("__run"),
        F.last(F.when(F.col("__first"), F.struct("__id")), ignorenulls=True).over(so_far)["__id"].alias("__keep"),
        F.sha2("__norm", 256).alias("__sha"),
        cut.alias("__cut"),
    )
    rows = rows.withColumn("__size", F.count("*").over(W.partitionBy("__part", "__run")))
    rows = materialise(rows, "content-sort")

    # A group that partitions share has one part in each; there are fewer such groups than partitions.
    parts_of = rows.where("__cut AND __first").groupBy("__sha").agg(F.min(F.struct("__part", F.col("__keep").alias("keep"))).alias("low"), F.sum("__size").alias("size"), F.count("*").alias("n")).where("n > 1")
    whole = parts_of.select(F.col("__sha").alias("__sha2"), F.col("low.__part").alias("__low"), F.col("low.keep").alias("__keep2"), F.col("size").alias("__size2"), F.lit(True).alias("__cut2"))
    rows = rows.join(F.broadcast(whole), (F.col("__sha") == F.col("__sha2")) & (F.col("__cut") == F.col("__cut2")), "left")
    return rows.select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("__low").isNotNull(), F.col("__keep2")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size2", "__size").alias("group_size"),
        (F.col("__first") & (F.col("__low").isNull() | (F.col("__low") == F.col("__part")))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *[F.col(f"__row_{i}").alias(f"__row_{i}") for i in range(len(carry or []))],
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    names = docs.columns
    unique = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    at = {c: f"__c{i}" for i, c in enumerate(names)}
    tagged = exact_groups(unique, at[doc_id], at[text], unique.columns)
    return tagged.where("kept").select(*[F.col(f"__row_{i}").alias(c) for i, c in enumerate(names)])
