"""Personal data in texts: fixed patterns, and further spans found by weak supervision.

Every text is read once. Fixed patterns give the base spans. Wider patterns give candidates for further spans, on which
labelers vote for, against or not at all: the candidate's shape, its mix of characters, a gazetteer of words that
introduce such data, the marks right before it, and what surrounds it. What the corpus says of the labelers is a count for
each pattern of votes, kind and look (classes of length and of the share of digits), a table of fixed size;
expectation-maximisation on it estimates each labeler's reliabilities, and a logistic span classifier over votes, kind and
look is trained on the probabilities that follow. Its decision for each such pattern then selects the candidates.

What defines candidates: parts of a spelt-out address have up to 64 characters, as addresses do, and passwords too; labelers
read CONTEXT characters before a candidate and 8 after it.

Defined results: a null text is the empty text; whole texts are read, however long, in time linear in them; a candidate that
overlaps a base span or an earlier candidate, by kind and then place, is none, while base spans of different kinds may
overlap; rows are independent once the classifier is trained, so repeated rows give repeated results; a pattern that is as
likely true as not is accepted; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.runtime import let, materialise

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "email_spelt", "national_id", "password", "phone_local", "secret")
KINDS = BASE_KINDS + MORE_KINDS

# The base patterns. A match of the first two can only begin where a run of their first characters does.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_AT_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_INTRODUCED = re.compile(r"(?i:pass|pwd|pin)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    m = _EMAIL_AT_RUN.search(text)
    while m:
        yield m
        # Right after a match one may begin within a run.
        m = _EMAIL.match(text, m.end()) or _EMAIL_AT_RUN.search(text, m.end())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the base patterns, by kind, then start."""
    found = []
    if not _ANY.search(text):
        return found
    if "@" in text:
        found += [(0, m.start(), m.end()) for m in _emails(text)]
    if "." in text:
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# Candidates for further spans, each beginning where its run of characters does; of a pattern with a group, what that holds.
_CANDIDATES = (
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("email_spelt", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,64}){1,4}")),
    ("national_id", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("password", re.compile(r"\b(?:password|passwd|passphrase|passcode|passwort|pwd|pin)\b[\"']?\x20?(?:[=:]|is\b)\x20?[\"'`]?([^\s\"'`,;]{4,64})", re.I)),
    ("phone_local", re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])|(?<![0-9+().,-])\(?0[0-9]{1,4}\)?(?:[\x20/-][0-9]{2,8}){1,4}(?![0-9.,-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")),
)
# The gazetteer of words that introduce such data, and of words that introduce other numbers.
_FOR = re.compile(r"\b(?:token|secret|password|passwd|passphrase|passcode|passwort|pwd|pin|key|apikey|credential|credentials|bearer|auth|iban|account|konto|compte|cuenta|ssn|insurance|phone|tel|telephone|mobile|call|fax|telefon|mail|email|contact|write)\b", re.I)
_AGAINST = re.compile(r"\b(?:isbn|issn|doi|version|page|pages|figure|table|order|article|sha|commit|revision|chapter|part|serial|invoice|http|https|www)\b", re.I)
_MARK = re.compile(r"[=:]\s*[\"'`(\[<]?\s*\Z|[\"'`]\Z")
_HEX = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
#: North American numbers: neither area nor exchange begins with 0 or 1.
_NATIONAL = re.compile(r"[2-9][0-9]{2}[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}\Z")
#: Prefixes that issuers give to keys.
_ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}\Z|(?:ghp|gho|sk|pk|rk|xox[abp])[_-]")
#: Characters before a candidate that labelers read.
CONTEXT = 24

LABELERS = 5
VOTES = (-1, 0, 1)


def _iban(value: str) -> bool:
    packed = value.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def votes(kind: str, text: str, start: int, stop: int) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 for, -1 against, 0 nothing."""
    value, before, after = text[start:stop], text[max(0, start - CONTEXT) : start], text[stop : stop + 8]
    digits, letters = sum(map(str.isdigit, value)), sum(map(str.isalpha, value))
    if kind == "secret":
        shape = 1 if _HEX.match(value) or _ISSUED.match(value) else 0
        mixed = 1 if digits >= 4 and letters >= 4 and len(set(value)) >= 8 or _ISSUED.match(value) else -1
    elif kind == "account":
        shape, mixed = (1 if _iban(value) else -1), (1 if digits >= 10 else 0)
    elif kind == "email_spelt":
        shape, mixed = 1, (0 if letters else -1)
    elif kind == "national_id":
        # Areas 000, 666 and 900 on, group 00 and serial 0000 are not issued.
        area, group, serial = value.split("-")
        shape, mixed = (-1 if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000" else 1), (1 if len(set(value)) >= 5 else -1)
    elif kind == "password":
        shape = 1 if digits and letters or not value.isalnum() and len(value) >= 6 else 0
        mixed = 1 if len(set(value)) >= 4 else -1
    else:
        shape, mixed = (1 if value[0] in "(0" or _NATIONAL.match(value) else 0), (1 if len(set(filter(str.isdigit, value))) >= 4 and 7 <= digits <= 15 else -1)
    known = 1 if _FOR.search(before) else -1 if _AGAINST.search(before) else 0
    mark = 1 if _MARK.search(before) else 0
    around = -1 if after[:1].isalnum() or before[-1:] in "/\\#$" and before else 1 if after[:1] in "\"'`)]>" and after else 0
    return shape, mixed, known, mark, around


def look_of(value: str) -> int:
    """The look of a candidate: three classes of length, three of the share of digits."""
    digits = sum(map(str.isdigit, value))
    return 3 * ((len(value) >= 12) + (len(value) >= 24)) + (4 * digits >= len(value)) + (4 * digits >= 3 * len(value))


def code_of(kind: int, vote: tuple[int, ...], look: int = 0) -> int:
    code = look * len(MORE_KINDS) + kind
    for v in vote:
        code = code * 3 + v + 1
    return code


def votes_of(code: int) -> tuple[int, tuple[int, ...]]:
    vote = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        vote.append(v - 1)
    return code % len(MORE_KINDS), tuple(reversed(vote))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, stop, code) of further candidates; none overlaps a base span or an earlier candidate."""
    if not _ANY.search(text) and "(at)" not in text and "[at]" not in text and not _INTRODUCED.search(text):
        return []
    taken, found = sorted((a, b) for _, a, b in base), []
    for k, (kind, pattern) in enumerate(_CANDIDATES):
        for m in pattern.finditer(text):
            a, b = m.span(1) if m.re.groups else m.span()
            if kind == "secret" and not any(map(str.isdigit, m[0])) or any(x < b and a < y for x, y in taken):
                continue
            taken.append((a, b))
            found.append((len(BASE_KINDS) + k, a, b, code_of(k, votes(kind, text, a, b), look_of(text[a:b]))))
    return found


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("code", pa.int32())])


def _find(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            more = candidates(text or "", base)
            rows.append([{"kind": k, "start": a, "stop": b, "code": -1} for k, a, b in base] + [{"kind": k, "start": a, "stop": b, "code": c} for k, a, b, c in more])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], names=["doc_id", "spans"])


def found_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: base spans with code -1, candidates with the code of their votes."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_find, f"doc_id {kind}, spans array<struct<kind:int,start:bigint,stop:bigint,code:int>>")


def reliabilities(counts: dict[tuple[int, ...], float], steps: int = 60) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counts of vote patterns: the share of true spans, P(vote | class) for each labeler,
    class and vote, and each pattern's probability of being true. Labelers start as better than chance, with that belief
    as a few votes that no data outweigh at once."""
    prior = np.zeros((LABELERS, 2, 3))
    prior[:, 1], prior[:, 0] = (1, 4, 5), (5, 4, 1)
    share, table = 0.5, prior / prior.sum(axis=2, keepdims=True)
    patterns = list(counts)
    weight = np.array([counts[p] for p in patterns], float)
    at = np.array(patterns, int).reshape(-1, LABELERS) + 1
    truth = np.full(len(patterns), 0.5)
    for _ in range(steps):
        if not len(patterns):
            break
        odds = math.log(share) - math.log(1 - share) + sum(np.log(table[i, 1, at[:, i]]) - np.log(table[i, 0, at[:, i]]) for i in range(LABELERS))
        truth = 1 / (1 + np.exp(-odds))
        share = float(np.clip((weight @ truth + 5) / (weight.sum() + 10), 1e-3, 1 - 1e-3))
        table = prior.copy()
        for i, v in product(range(LABELERS), range(3)):
            here = at[:, i] == v
            table[i, 1, v] += weight[here] @ truth[here]
            table[i, 0, v] += weight[here] @ (1 - truth[here])
        table /= table.sum(axis=2, keepdims=True)
    return share, table, dict(zip(patterns, truth.tolist(), strict=True))


def _features(code: int) -> list[float]:
    kind, vote = votes_of(code)
    size, share = divmod(code // 3**LABELERS // len(MORE_KINDS), 3)
    row = [1.0, float(size >= 1), float(size == 2), float(share >= 1), float(share == 2)] + [float(kind == k) for k in range(len(MORE_KINDS))]
    for v in vote:
        row += [float(v == 1), float(v == -1)]
    return row


def train_classifier(codes: dict[int, int], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, set[int]]:
    """Weights of the span classifier, trained on the probabilities of the vote patterns, and the codes that it accepts."""
    pooled: dict[tuple[int, ...], float] = {}
    for code, n in codes.items():
        vote = votes_of(code)[1]
        pooled[vote] = pooled.get(vote, 0) + n
    truth = reliabilities(pooled)[2]
    known = sorted(codes)
    if not known:
        return np.zeros(len(_features(0))), set()
    x = np.array([_features(c) for c in known])
    y = np.array([truth[votes_of(c)[1]] for c in known])
    w = np.sqrt([codes[c] for c in known])
    w /= w.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ weights))
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(weights))
        weights -= rate * np.linalg.solve(curve, x.T @ (w * (p - y)) + decay * weights)
    p = 1 / (1 + np.exp(-x @ weights))
    return weights, {c for c, q in zip(known, p, strict=True) if q >= 0.5}


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: spans is array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>, by kind, then
    start; places are code points, the stop exclusive."""
    rows = materialise(found_spans(docs, doc_id, text), "spans")
    # One row for each pattern of votes: at most looks x kinds x 3^labelers.
    codes = rows.select(F.explode("spans").alias("s")).where("s.code >= 0").groupBy("s.code").count().collect()
    accepted = train_classifier({r["code"]: r["count"] for r in codes})[1]
    wanted = F.array(F.lit(-1), *[F.lit(c) for c in sorted(accepted)])
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.sort_array(F.filter("spans", lambda s: F.array_contains(wanted, s["code"])))
    named = F.transform(kept, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), (s["code"] < 0).alias("base")))
    return rows.select("doc_id", named.alias("spans"))


def redacted(text, spans):
    """The text with each span replaced by its kind in brackets; overlapping spans by the first."""

    def cut(ordered):
        return F.aggregate(
            ordered,
            F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
            lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["stop"].alias("at"))),
            lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))),
        )

    by_place = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return let(by_place, cut)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def is_base(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)
