"""Repeated token windows, found by Rabin-Karp hashes of every window and removed as maximal intervals.

Documents go to groups by ranges of their identifier, so the order of groups is the order of identifiers. Each group
hashes all windows of its documents, settles windows that repeat within the group, and sends the rest as blocks: for each
range of hashes the hashes and where in the group they start, a few bytes each. Whoever holds a range of hashes sees every
group that has a hash; all but the first group get the places of their copies back. Last, each group merges its repeated
windows into maximal intervals and cuts their words. Texts are shuffled once: both passes read the same exchange.

A group sends one entry for a window however often its documents repeat it, so a passage that a third of all documents
share costs one entry for each group. Windows are equal when their hashes are. The hashes are wide enough that over all
windows a hundredth of a colliding pair is expected: 64 bits up to some 4 x 10^8 windows, 94 bits over 10^13. Groups and
ranges grow with the square root of the input, so that a block holds WINDOWS_A_BLOCK windows or more at any size and blocks
are never more than a fraction of windows.

Groups are cut by bytes, at sampled rows in the order (identifier, text hash): rows of one identifier, or of none, may lie in
several groups. A window's rank tells whose is first: twice the group, and for an identifier at a cut one more than twice
the group that it begins in, in all its groups.

Defined results: a null text has no words; a null identifier counts as larger than all others; rows that share an
identifier, or have none, never make each other repeat; very long texts are hashed whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.runtime import bisect, partitions

#: Tokens of a window.
WINDOW = 13
#: Odd multipliers of the rolling hashes over 64-bit words.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text in a group of documents, and about as many windows as that in a range of hashes.
GROUP_BYTES = 12_000_000
#: Windows that a block, what one group sends to one range, holds on average at least; bytes of a word and its separator.
WINDOWS_A_BLOCK, WORD_BYTES = 16, 6
#: Sampled rows for each cut between groups, and what a row weighs beside its text.
OVERSAMPLE, ROW_BYTES = 12, 100
#: Colliding pairs of windows that may be expected over all windows.
COLLISIONS = 0.01
#: Distinct tokens whose hashes a task keeps at a time.
KEPT_TOKENS = 1 << 20


class _Tokens(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def layout(size: int, parts: int) -> tuple[int, int]:
    """How many groups, and ranges of hashes, `size` bytes of text take, and how many bytes of a window's hash are sent."""
    windows = max(1, size // WORD_BYTES)
    group = max(GROUP_BYTES, WORD_BYTES * math.isqrt(WINDOWS_A_BLOCK * windows))
    bits = 2 * math.log2(windows) - 1 - math.log2(COLLISIONS)
    return max(1, min(parts, size // 1000 + 1), size // group), min(16, max(8, math.ceil(bits / 8)))


def _polynomial(ids: np.ndarray, n: int, size: int, base: int) -> np.ndarray:
    value, base = np.zeros(n, np.uint64), np.uint64(base)
    for i in range(size):
        value *= base
        value += ids[i : i + n]
    return _mixed(value)


def _mixed(value: np.ndarray) -> np.ndarray:
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def window_hashes(words: list[bytes], tokens: dict, width: int = 8, size: int = WINDOW) -> np.ndarray:
    """Hashes of each window of the words, one row for the first 8 bytes and, if width is more, one for the others: polynomials
    modulo 2^64, then mixed."""
    n = max(0, len(words) - size + 1)
    found = np.zeros((1 + (width > 8), n), np.uint64)
    if n:
        ids = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
        found[0] = _polynomial(ids, n, size, BASE)
        if width > 8:
            found[1] = _polynomial(_mixed(ids ^ np.uint64(SECOND)), n, size, SECOND) & np.uint64((1 << 8 * (width - 8)) - 1)
    return found


def _ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes, equal ones as they came, and whether each differs from the one before."""
    order = np.argsort(hashes[0], kind="stable") if len(hashes) == 1 else np.lexsort(hashes[::-1])
    fresh = np.ones(len(order), bool)
    ranked = hashes[:, order]
    fresh[1:] = (ranked[:, 1:] != ranked[:, :-1]).any(axis=0)
    return order, fresh


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of integers as width planes: planes of zeros vanish when the shuffle compresses them."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


def _gaps(sorted_places: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_places, prepend=0), 4)


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, 4).astype(np.int64))


def _ordered(group: pa.Table) -> list[tuple]:
    """(late, id, text, rank) of the group's rows in the one order that both passes use."""
    ids, texts = group.column("doc_id").to_pylist(), group.column("text").cast(pa.large_binary()).to_pylist()
    return sorted((i is None, i or 0, t or b"", r) for i, t, r in zip(ids, texts, group.column("rank").to_pylist(), strict=True))


BLOCK = "home int, span int, rank bigint, settled boolean, hashes binary, more binary, places binary"
_BLOCK = [("home", pa.int32()), ("span", pa.int32()), ("rank", pa.int64()), ("settled", pa.bool_()), ("hashes", pa.binary()), ("more", pa.binary()), ("places", pa.binary())]


def _hash_group(spans: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        home = group.column("home")[0].as_py()
        tokens, hashes, owner, ranks, last, doc = _Tokens(), [], [], [], None, -1
        for late, doc_id, text, rank in _ordered(group):
            if (late, doc_id) != last:
                last, doc = (late, doc_id), doc + 1
                ranks.append(rank)
            hashes.append(window_hashes(text.split(), tokens, width))
            owner.append(np.full(hashes[-1].shape[1], doc, np.int32))
        h, own = np.concatenate(hashes, axis=1), np.concatenate(owner)
        order, fresh = _ranked(h)
        # The first of equal windows stands in the smallest identifier: rows are in that order, and the sort is stable.
        heads = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(own) else order
        settled = np.zeros(len(own), bool)
        settled[order] = own[order] > own[heads]
        # All windows of the smallest document are sent, repeats too: each of them must be told.
        at = np.flatnonzero(~settled)
        levels, level = np.unique(np.array(ranks, np.int64), return_inverse=True)
        span = ((h[0][at] >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)).astype(np.int64)
        code = span * len(levels) + level[own[at]]
        if spans * len(levels) <= 1 << 16:
            code = code.astype(np.uint16)
        by_code = np.argsort(code, kind="stable")
        found, starts = np.unique(code[by_code], return_index=True)
        rows = []
        for c, a, b in zip(found.tolist(), starts, [*starts[1:], len(code)], strict=True):
            part = at[by_code[a:b]]
            more = _planes(h[1][part], width - 8) if width > 8 else b""
            rows.append((home, c // len(levels), int(levels[c % len(levels)]), False, h[0][part].astype("<u8").tobytes(), more, _gaps(part)))
        if settled.any():
            rows.append((home, home % spans, 0, True, b"", b"", _gaps(np.flatnonzero(settled))))
        return _table(rows, _BLOCK)

    return run


def _table(rows: list[tuple], fields: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], schema=pa.schema(fields))


REPEATS = "home int, places binary"


def _count_span(width: int):
    """Of windows that several ranks have, the places in all but the first."""

    def run(blocks: pa.Table) -> pa.Table:
        homes, ranks, settled = blocks.column("home").to_numpy(), blocks.column("rank").to_numpy(), blocks.column("settled").to_pylist()
        hashes, more, places = (blocks.column(c).to_pylist() for c in ("hashes", "more", "places"))
        rows = [(int(homes[i]), places[i]) for i in range(len(homes)) if settled[i]]
        open_ = [i for i in range(len(homes)) if not settled[i]]
        if open_:
            h = [np.concatenate([np.frombuffer(hashes[i], "<u8") for i in open_])]
            if width > 8:
                h.append(np.concatenate([_from_planes(more[i], width - 8) for i in open_]))
            sizes = [len(hashes[i]) // 8 for i in open_]
            home, rank = np.repeat(homes[open_], sizes), np.repeat(ranks[open_], sizes)
            order, fresh = _ranked(np.stack(h))
            shared = ~fresh
            shared[:-1] |= ~fresh[1:]
            order, fresh = order[shared], fresh[shared]
            if len(order):
                starts = np.flatnonzero(fresh)
                first = np.repeat(np.minimum.reduceat(rank[order], starts), np.diff(np.append(starts, len(order))))
                place = np.concatenate([_places(places[i]) for i in open_])
                late = order[rank[order] > first]
                late = late[np.lexsort((place[late], home[late]))]
                own = home[late]
                for part in np.split(np.arange(len(late)), np.flatnonzero(own[1:] != own[:-1]) + 1):
                    if len(part):
                        rows.append((int(own[part[0]]), _gaps(place[late[part]])))
        return _table(rows, [("home", pa.int32()), ("places", pa.binary())])

    return run


CUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_text", pa.string()), ("kept_sha256", pa.string())]


def _cut_group(keep_text: bool, size: int = WINDOW):
    def run(group: pa.Table, repeats: pa.Table) -> pa.Table:
        told = [_places(p) for p in repeats.column("places").to_pylist()]
        told = np.unique(np.concatenate(told)) if told else np.zeros(0, np.int64)
        rows, first = [], 0
        for late, doc_id, text, _ in _ordered(group):
            words = text.split()
            windows = max(0, len(words) - size + 1)
            a, b = np.searchsorted(told, (first, first + windows))
            begun, first, removed, spans = told[a:b] - first, first + windows, 0, []
            kept = words
            if len(begun):
                breaks = np.flatnonzero(np.diff(begun) > size) + 1
                tops = np.concatenate(([0], breaks))
                ends = np.concatenate((breaks, [len(begun)])) - 1
                spans = [(int(begun[i]), int(begun[j]) + size) for i, j in zip(tops, ends, strict=True)]
                kept, at = [], 0
                for start, stop in spans:
                    kept += words[at:start]
                    at, removed = stop, removed + stop - start
                kept += words[at:]
            left = b" ".join(kept)
            rows.append((None if late else doc_id, len(words), removed, [{"start": s, "stop": e} for s, e in spans], left.decode() if keep_text else None, hashlib.sha256(left).hexdigest()))
        return _table(rows, CUT)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text, kept_sha256) of every row.

    removed lists the maximal word intervals that windows also starting in a smaller identifier cover; kept_text is left
    null unless asked for.
    """
    parts = partitions(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes, width = layout(total, parts)
    grouped = _in_groups(docs, homes, total).repartition(parts, "home")
    blocks = grouped.groupBy("home").applyInArrow(_hash_group(homes, width), BLOCK)
    repeats = blocks.groupBy("span").applyInArrow(_count_span(width), REPEATS)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept_text string, kept_sha256 string"
    return grouped.groupBy("home").cogroup(repeats.groupBy("home")).applyInArrow(_cut_group(keep_text), schema)


def _in_groups(docs: DataFrame, homes: int, total: int) -> DataFrame:
    """docs with the group, `home`, and the `rank` of each row. Cuts are taken from a sample of homes x OVERSAMPLE rows or so, which
    long texts enter by their bytes."""
    own = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    key = F.struct(own["late"].alias("late"), own["id"].alias("id"), F.xxhash64("text").alias("h"))
    cuts = []
    if homes > 1:
        weight, step = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES, total / (homes * OVERSAMPLE)
        drawn = docs.where(F.rand(11) * step < weight).select(key.alias("key"), F.greatest(weight, F.lit(step)).alias("weight")).toArrow()
        keys = sorted(zip((tuple(k.values()) for k in drawn.column("key").to_pylist()), drawn.column("weight").to_pylist(), strict=True))
        drawn_total, so_far = sum(w for _, w in keys), 0
        for k, w in keys:
            if len(cuts) < homes - 1 and so_far * homes >= (len(cuts) + 1) * drawn_total:
                cuts.append(k)
            so_far += w
    if not cuts:
        return docs.withColumns({"home": F.lit(0), "rank": F.lit(0).cast("bigint")})
    # Each identifier at a cut, once, and the group that it begins in.
    begins: dict[tuple, int] = {}
    for i, (late, doc_id, _) in enumerate(cuts):
        begins.setdefault((late, doc_id), i)
    at_cuts = F.from_json(F.lit(json.dumps([{"late": a, "id": b, "h": c} for a, b, c in cuts])), "array<struct<late:boolean,id:bigint,h:bigint>>")
    at_ids = F.from_json(F.lit(json.dumps([{"late": a, "id": b} for a, b in begins])), "array<struct<late:boolean,id:bigint>>")
    homes_of = F.from_json(F.lit(json.dumps(list(begins.values()))), "array<bigint>")
    found = docs.withColumns({"home": bisect(at_cuts, key).cast("int"), "__id": bisect(at_ids, own) - 1})
    hit = F.get(at_ids, F.col("__id")).eqNullSafe(own)
    return found.withColumn("rank", F.when(hit, 2 * F.get(homes_of, F.col("__id")) + 1).otherwise(2 * F.col("home").cast("bigint"))).drop("__id")
