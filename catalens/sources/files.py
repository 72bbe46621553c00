"""Texts as sources: SQL files of a project, and the raw material that context is measured against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are never read, and what is read by default.
NOISE = ("node_modules", "target", "bin", "obj", ".git", ".catalens", "dist", "build")
INCLUDE = ("migrations/**", "sql/**", "db/**")


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** crosses directories, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def _texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.regexp_replace(F.col("path"), "^" + re.escape(base).replace("file:/", "file:/+") + "/", "")
    return rows.select(path.alias("source_path"), F.decode("content", "UTF-8").alias("content"))


def sql_files(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(source_path, content) of the SQL files under root, read where they lie, in the order of paths."""
    rows = _texts(spark, root.rstrip("/"), "*.sql")
    clean = ~F.col("source_path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, NOISE)) + ")/")
    wanted = F.lit(False)
    for g in include:
        wanted = wanted | F.col("source_path").rlike(glob_pattern(g))
    for g in exclude:
        wanted = wanted & ~F.col("source_path").rlike(glob_pattern(g))
    return rows.where(clean & wanted).orderBy("source_path")


def materials(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, content) of all texts that someone without a catalog would read."""
    rows = _texts(spark, root.rstrip("/"), "*.{sql,md,json,toml}")
    return rows.where(~F.col("source_path").rlike(r"(?:^|/)(?:target|node_modules|\.git|\.catalens)/")).orderBy("source_path")
