"""Quality rules as a bitmask ledger.

Each rule is evaluated once for a document and leaves one bit and its measurements in the ledger. Policies are versioned
masks over those bits: applying one, or asking what each of its rules does alone, reads only the ledger.

Defined results: a null text has no words; an empty table gives an empty ledger; rows are independent, so repeated rows
give repeated results; other columns are neither read nor changed. Windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.runtime import SEPARATORS, let, text_of, words_of

SYMBOLS = "[^#*$%&|<>]+"


def _count_repeats(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def repeated(found: Column) -> Column:
        same = F.filter(found, lambda e, k: F.get(found, k - 1)["h"].eqNullSafe(e["h"]) | F.get(found, k + 1)["h"].eqNullSafe(e["h"]))
        return let(F.sort_array(F.transform(same, lambda e: e["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(pairs, repeated))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(hashes, windows))


def measurements(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words>, all bigint."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(text, SEPARATORS, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            _count_repeats(w).alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, an SQL predicate over the measurements, is true. The place of its bit never changes."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "4 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 25 * n_words"),
    Rule(5, "repeated_lines", "n_dup_lines >= 10"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        unknown = set(self.rules) - {r.name for r in rules}
        if unknown:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        return sum(1 << r.bit for r in rules if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_windows", "many_symbols", "short_words", "long_words"))


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of the rules that the measurements in scope fail."""
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: its id, the measurements and `failed_bits`."""
    measured = docs.select(F.col(doc_id).alias("doc_id"), measurements(text_of(text)).alias("m"))
    return measured.select("doc_id", "m.*").withColumn("failed_bits", failure_bits(rules))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0


def ablations(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    patterns = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    mask = policy.mask(rules)
    used = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in rules if r.name in policy.rules])
    rows = patterns.select("n", F.col("failed_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits"), F.explode(used).alias("r"))
    hit = rows["bits"].bitwiseAND(F.col("r.bit"))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(rows["bits"] == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when((rows["bits"] - hit) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_passing(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their columns as they are."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    measured = plain.withColumn("__m", measurements(text_of(f"__c{names.index(text)}"))).select(*plain.columns, "__m.*")
    kept = measured.withColumn("__bits", failure_bits()).where(passes(policy, bits="__bits"))
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
