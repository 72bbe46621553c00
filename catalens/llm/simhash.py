"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart have a point x between them that is within one bit of one and two of the other,
so the groups follow from shuffling each fingerprint's ball on its points: whatever has x within one bit is linked with
all else that has it within two. By the triangle inequality such members differ in three bits at most, so one star for a
point stands for all its pairs, and no pairs of a group are ever listed.

A whole ball has 2,081 points. Two fingerprints that differ in three bits agree in a half of their 64 bits but for one
bit, so first only that half is varied, 33 points for each half; the rest of a ball is emitted only where another
fingerprint was met in the half. Equal fingerprints are one row from the start.

Defined results: a null text is the empty text, with fingerprint zero; a null identifier names a component only where no
other is in it; repeated rows have one fingerprint and so one component; a very long text is hashed a piece at a time, whole;
ties in a bit (as many ones as zeros) give 0; an empty table gives an empty result; other columns are not read.

The half-balls tell apart what to look at further while 66 rows a fingerprint are few against 2^32 halves: up to some 10^8
distinct fingerprints. Beyond that nearly all meet another, and each emits its 3,170 points. Results are the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.llm.components import connected_components
from catalens.llm.runtime import join_labels, materialise, named_again, partitions, positions

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text; bytes.split() and bytes.lower() know the six separators and A-Z alone."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return digest(joined, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))[: len(words) - size + 1].tolist()
    stops = stops[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        found = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp has the 64 bits as a signed integer."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def links(prints: DataFrame) -> DataFrame:
    """Stars (a, b) over distinct fingerprints `fp` that have the components of all links at RADIUS bits or fewer."""
    flips = [0, *(1 << i for i in range(32))]
    one = F.array(*[F.lit(x).cast("bigint") for x in flips])
    two = F.array(*[F.lit(x).cast("bigint") for x in [*flips, *((1 << i) | (1 << j) for i, j in combinations(range(32), 2))]])

    # Each half with at most one bit changed; shift is where the half lies, moved counts the bits changed so far.
    parts = partitions(prints.sparkSession)
    halves = prints.repartition(parts, "fp").select("fp", F.explode(F.array(F.lit(0), F.lit(32))).alias("shift")).select("fp", "shift", F.explode(one).alias("flip"))
    value = F.when(F.col("shift") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    halves = halves.select("fp", "flip", value.bitwiseXOR(F.col("flip")).alias("half")).repartition(parts, "half")
    # The count and the rows that it selects read one exchange.
    met = halves.groupBy("half").agg(F.count("*").alias("n"), F.max((F.col("flip") == 0).cast("int")).alias("own")).where("n > 1 AND own = 1")
    live = materialise(halves.join(met, "half", "left_semi"), "half-balls")

    low = F.col("half") < F.lit(1 << 32)
    at = live.select(
        "fp",
        F.when(F.col("flip") == 0, 0).otherwise(1).alias("moved"),
        low.alias("low"),
        F.col("fp").bitwiseXOR(F.when(low, F.col("flip")).otherwise(F.shiftleft("flip", 32))).alias("at"),
    )
    points = at.select("fp", "moved", "low", "at", F.explode(F.when(F.col("moved") == 0, two).otherwise(one)).alias("flip"))
    points = points.select(
        "fp",
        F.col("at").bitwiseXOR(F.when(F.col("low"), F.shiftleft("flip", 32)).otherwise(F.col("flip"))).alias("x"),
        (F.col("moved") + F.bit_count("flip")).alias("moved"),
    ).repartition(parts, "x")
    centres = points.groupBy("x").agg(F.min(F.when(F.col("moved") <= 1, F.col("fp"))).alias("centre"), F.min("fp").alias("least"), F.max("fp").alias("most"))
    centres = centres.where("centre IS NOT NULL AND least != most").select("x", "centre")
    pairs = points.join(centres, "x").where("fp != centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest identifier reachable over links."""
    rows = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    return components_of(rows, connected_components(links(rows.select("fp").distinct()))).select("doc_id", "fp", "component_id")


def row_of(doc_id: str, text: str):
    """What a row is known by: its identifier and 128 bits of its text. Structs of it are in the order of identifiers, null last."""
    plain = F.col(text).cast("string")
    return F.struct(F.col(doc_id).isNull().alias("late"), F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(SEED), plain).alias("h2"))


def components_of(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (fp, doc_id and others), of whose prints roots (node, root) names the linked ones' components, with `component_id`, the smallest identifier of the
    component, and `first`, its first row where rows has a `row` by row_of()."""
    own = F.col("row") if "row" in rows.columns else F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"))
    prints = rows.groupBy("fp").agg(F.min(own).alias("low"), F.count("*").alias("n"))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "roots")
    sizes = named.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("n"))
    labels = join_labels(named.select("fp", "root", F.col("n").alias("rows")), sizes, ["root"], named.count())
    labels = labels.select("fp", "first", F.col("first.id").alias("component_id"), F.col("rows").alias("n"))
    return join_labels(rows, labels, ["fp"], rows.count()).drop("n")


def hex_of(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_of_each(docs: DataFrame, firsts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the first row, with all columns of docs: the smallest identifier, then the smallest digest of the text.

    firsts has that row of each component once, by row_of(). Rows with one identifier, or none, and different texts are
    different rows; of rows that agree in both, one stays.
    """
    plain, at = positions(docs)
    key = row_of(at[doc_id], at[text])
    # Equalities of columns without nulls: the join and the window then read one exchange of the texts.
    whole = lambda row: {"late": row["late"], "id": F.coalesce(row["id"], F.lit(0)), "h1": row["h1"], "h2": row["h2"]}
    plain = plain.withColumns({f"__{k}": v for k, v in whole(key).items()})
    names = [f"__{k}" for k in whole(key)]
    stay = plain.join(firsts.select(*[v.alias(f"__{k}") for k, v in whole(firsts).items()]), names, "left_semi")
    # Only rows that are copies in identifier and text have company here.
    same = W.partitionBy(*names).orderBy(F.xxhash64(*[F.col(c) for c, t in plain.dtypes if not t.startswith("map")]))
    return named_again(stay.withColumn("__nth", F.row_number().over(same)).where("__nth = 1"), docs.columns)
