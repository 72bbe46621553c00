"""Mixing sources to target weights by entropy balancing.

Each document gets the rate that is nearest, in token-weighted relative entropy, to one pass over the corpus while the
tokens taken from every source meet its target. The convex dual has one multiplier for each source; its gradient and its
diagonal Hessian are distributed sums over documents, which for these constraints reduce to one sum for each source, and
Newton steps on them give the exponential tilt exp(multiplier) of the source's documents.

Rates become copies by systematic rounding down the documents of a source in order of size, which leaves an error below
the largest document. Copies are then added or taken away, of the smallest documents first and as many as MOST allows, until
what is left is below the next document's size, and one more whose size is nearest to it where that helps. So no source misses
its target by more than half of the smallest document that could still move that way, unless all stand at MOST copies.
Ranks come from counts of (source, size, bucket) cells, so no source is ever sorted in one task.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; sources without words have
target 0; repeated rows are separate documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.llm.runtime import WORD, materialise, text_of

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: The most copies of a document, and so the most of its source's size that a target can be.
MOST = 3
#: Newton steps; each brings a multiplier below its root one nearer at least, then the error squares.
STEPS = 60
#: Cells that the documents of one size and source are spread over.
BUCKETS = 256
KEY = ["null_source", "source_key"]


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def bucket_of(doc_id: Column) -> Column:
    """0 to BUCKETS - 1 from the identifier, by a rule that plain SQL can follow."""
    return F.pmod(F.pmod(F.coalesce(doc_id.cast("bigint"), F.lit(0)), F.lit(1000003)) * 7919, F.lit(BUCKETS)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds `target` and `rate` to a table of (null_source, source_key, source_size), one row for each source.

    The share of each source follows its weight; a target stops at `most` times its source, and the rest goes on by weight.
    Filling the sources in order of what they can hold for their weight finds that division at once.
    """
    order = W.orderBy(*KEY)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rows = rows.withColumn("room", F.col("cap") / F.col("weight"))
    all_rows, filled = W.partitionBy(), W.orderBy("room", *KEY).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(all_rows).alias("total"),
        F.sum("weight").over(all_rows).alias("weights"),
        F.coalesce(F.sum("cap").over(filled), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(filled), F.lit(0)).alias("weight_before"),
    )
    rows = rows.withColumn("full", F.col("room") <= (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    rest = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_rows), F.lit(0))) / F.nullif(F.col("weights") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(all_rows), F.lit(0)), F.lit(0))
    rows = rows.withColumn("rest", rest).withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest")))

    # The dual of the source is size * exp(x) - target * x: a Newton step divides its gradient by its second derivative.
    def step(x: Column, _: Column) -> Column:
        tilted = F.col("source_size") * F.exp(x)
        return x - (tilted - F.col("target")) / tilted

    multiplier = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)
    rate = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.round(F.exp(multiplier), 9)).otherwise(F.lit(0.0))
    return rows.select(*KEY, "source_size", "target", F.least(rate, F.lit(float(most))).alias("rate"))


def _extras(first: Column, n: Column, part: Column) -> Column:
    """How many of the n documents from rank `first` get one copy more, when the fraction `part` of all does."""
    return (F.floor((first + n) * part + 0.5) - F.floor(first * part + 0.5)).cast("bigint")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Copies of each row of a table (doc_id, source, size): adds `source_size`, `target`, `copies` and `taken`."""
    rows = rows.withColumns({"null_source": F.col("source").isNull(), "source_key": F.coalesce(F.col("source").cast("string"), F.lit("")), "bucket": bucket_of(F.col("doc_id"))})
    cells = rows.groupBy(*KEY, "size", "bucket").agg(F.count("*").alias("n"))
    sizes = cells.groupBy(*KEY, "size").agg(F.sum("n").alias("n"))
    plan = targets(sizes.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)

    by_source = W.partitionBy(*KEY)
    ranked = sizes.withColumn("first", F.coalesce(F.sum("n").over(by_source.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(plan, KEY)
    ranked = ranked.withColumn("whole", F.floor("rate").cast("bigint")).withColumn("part", F.col("rate") - F.floor("rate"))
    ranked = ranked.withColumn("extras", _extras(F.col("first"), F.col("n"), F.col("part")))
    taken = F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("extras"))).over(by_source)
    ranked = ranked.withColumn("missing", F.floor(F.col("target") - taken + 0.5).cast("bigint"))
    # Copies that the documents of a size can still take, where words are missing, or give, where there are too many.
    up = F.col("missing") > 0
    can = F.when(up, F.when(F.col("whole") < most, F.col("n") * (most - F.col("whole")) - F.col("extras")).otherwise(0)).otherwise(F.col("n") * F.col("whole") + F.col("extras"))
    ranked = ranked.withColumn("can", F.when(F.col("size") > 0, can).otherwise(F.lit(0)).cast("bigint"))
    before = F.coalesce(F.sum(F.col("can") * F.col("size")).over(by_source.orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moved = F.greatest(F.lit(0), F.least(F.col("can"), F.floor((F.abs("missing") - before) / F.greatest(F.col("size"), F.lit(1))))).cast("bigint")
    ranked = ranked.withColumn("moved", moved)
    # One copy more moves where that comes nearer: of the size that is nearest to what is left.
    rest = F.abs("missing") - F.sum(F.col("moved") * F.col("size")).over(by_source)
    ranked = ranked.withColumn("rest", rest)
    nearest = F.min(F.when(F.col("can") > F.col("moved"), F.struct(F.abs(F.col("rest") - F.col("size")).alias("gap"), "size"))).over(by_source)
    ranked = ranked.withColumn("nearest", nearest)
    one_more = (F.col("nearest.size") == F.col("size")) & (F.col("nearest.gap") < F.col("rest"))
    ranked = ranked.withColumn("moved", F.col("moved") + F.when(one_more, 1).otherwise(0))

    in_size = W.partitionBy(*KEY, "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cell_first", F.coalesce(F.sum("n").over(in_size), F.lit(0))).drop("n")
    cells = cells.join(ranked.select(*KEY, "size", "source_size", "target", "first", "n", "whole", "part", "extras", "missing", "moved"), [*KEY, "size"])

    in_cell = W.partitionBy(*KEY, "size", "bucket").orderBy("doc_id")
    rows = rows.withColumn("place", F.row_number().over(in_cell) - 1).join(cells, [*KEY, "size", "bucket"])
    rows = rows.withColumn("place", F.col("place") + F.col("cell_first"))
    extra = _extras(F.col("first") + F.col("place"), F.lit(1), F.col("part"))
    gone_by = _extras(F.col("first"), F.col("place"), F.col("part"))
    rows = rows.withColumn("extra", extra).withColumn("extras_before", gone_by)
    # The first copies that move make all documents of the size alike; the rest goes round them by place.
    up, alike = F.col("missing") > 0, F.when(F.col("missing") > 0, F.col("n") - F.col("extras")).otherwise(F.col("extras"))
    rank = F.when(up, F.col("place") - F.col("extras_before")).otherwise(F.col("extras_before"))
    evened = F.when((F.col("extra") == F.when(up, 0).otherwise(1)) & (rank < F.col("moved")), 1).otherwise(0)
    beyond = F.greatest(F.col("moved") - alike, F.lit(0))
    round_ = F.floor(beyond / F.col("n")) + (F.col("place") < F.pmod(beyond, F.col("n"))).cast("bigint")
    change = (evened + round_) * F.when(up, 1).otherwise(-1)
    copies = (F.col("whole") + F.col("extra") + change).cast("bigint")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The slim table that the mix works on, written once: texts are read a single time."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text_of(text)).alias("size"))
    return materialise(slim, "sizes")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, source, text and others), each as often as the mix takes it, with their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    at = {c: f"__c{i}" for i, c in enumerate(names)}
    # Equalities of columns without nulls: the window and the join then read one exchange of the texts.
    keys = lambda doc_id, source, size: {"__late": doc_id.isNull(), "__id": F.coalesce(doc_id, F.lit(0)), "__null": source.isNull(), "__source": F.coalesce(source.cast("string"), F.lit("")), "__size": size}
    plan = mix(sized(docs))
    plan = plan.select(*[v.alias(k) for k, v in keys(F.col("doc_id"), F.col("source"), F.col("size")).items()], "copies")
    cell = plan.columns[:-1]
    # Of the rows with one identifier, source and size, how many are taken up to 0, 1, ... times: the n-th by text is taken as often
    # as the n-th by copies.
    up_to = F.array(*[F.count_if(F.col("copies") <= k) for k in range(MOST)])
    plan = plan.groupBy(*cell).agg(up_to.alias("__up_to"), F.max("copies").alias("__most")).where("__most > 0")
    keyed = plain.withColumns(keys(F.col(at["doc_id"]), F.col(at["source"]), size_of(text_of(at["text"]))))
    keyed = keyed.withColumn("__nth", F.row_number().over(W.partitionBy(*cell).orderBy(at["text"])))
    taken = keyed.join(plan, cell).withColumn("__copies", F.size(F.filter("__up_to", lambda n: n < F.col("__nth"))))
    taken = taken.where("__copies > 0")
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
