"""What all operators share: scratch tables on shared storage, word patterns, code shipped to executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six separators that end a word: space, and tab to carriage return.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Slim rows, of a few numbers each, that any one task may hold.
FEW_ROWS = 1 << 20

_LOCAL: dict[str, str] = {}

# Executors need not have the package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules["catalens"])


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Where that is unset and everything runs in one process, a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="catalens-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table on shared storage and read it back: this cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/catalens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results not yet written become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/catalens-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what is no longer referred to: it does so when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_labels(rows: DataFrame, labels: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """rows with the columns of labels, which has one row for each key and counts the rows of the key.

    Keys that more than a partition's share of the `total` rows have are fewer than partitions: their labels are broadcast,
    so that no task gets all rows of a hot key. The others are shuffled, as all are where any task could hold all rows.
    """
    if total <= FEW_ROWS:
        return rows.join(labels, keys)
    hot = F.col(count) * partitions(rows.sparkSession) > total
    few = F.broadcast(labels.where(hot))
    rest = rows.join(F.broadcast(labels.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(labels.where(~hot), keys))


def positions(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by place, `__c0` and so on, and the name that each column now has: no name clashes with an operator's own."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))]), {c: f"__c{i}" for i, c in enumerate(df.columns)}


def named_again(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def bisect(keys: Column, own: Column) -> Column:
    """How many of the sorted keys are not above own; null where own is."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(keys, mid) <= own
        nearer = F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(nearer)

    found = F.aggregate(F.sequence(F.lit(0), F.lit(32)), F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(own.isNotNull(), found)
