"""Fixtures of the operators' tests: rows with what must not break them."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size string, __part int, copies int"


def docs(spark, rows):
    """rows (doc_id, text) or (doc_id, text, source), with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, None, "x", 1, None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, words=120, vocabulary=400):
    r = random.Random(seed)
    out = [f"w{r.randrange(vocabulary)}" + r.choice(["", "", ",", "."]) for _ in range(words)]
    return " ".join(out)


def awkward():
    """Null and empty texts, blanks, repeated rows, ties, a null identifier, one very long text."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \t\n\x0b"), (4, prose(2)), (4, prose(2)), (5, prose(2)), (6, prose(2).upper()), (7, long), (8, long + " end"), (9, "one two"), (None, prose(3)), (10, prose(3)), (11, "é\u00a0ü  x\ny"), (12, "a\x00b 😀 \u2028 c")]
