"""Scores of whole texts by online logistic context mixing, and the unigram base they are held against.

A text is the sequence of its lower-cased tokens and an end. The model codes a token as binary decisions: down a Huffman
tree over the most frequent training tokens, or past its escape leaf and then byte by byte down a second tree. Several
predictors, each a hashed context with the counts of training decisions in it, give their odds for a decision; a gate
picks the weights that combine them. All documents start from the same fixed weights, and each refines those of every gate as
it is read, for its tokens and for its spelled words alike, block after block from its first decisions on. The sum of the
decisions' bits is the text's probability.

Everything learned covers all training documents. Token counts are exact: chunks send distinct token hashes to ranges of
hashes, which add them up; later each group of documents asks the ranges for the counts of its tokens, so no vocabulary
is ever gathered in one place. Context counts are summed over all training documents as tables. Their sizes, and the leaves of
the token tree, grow with the number of training tokens, the tables up to what a task can hold (`table_bits`). Nothing is
fitted on a sample, and no score depends on how documents are dealt to tasks.

Defined results: a null text has the end token alone; a null identifier is held to be the text "None"; repeated rows are
separate documents; without training documents all counts are zero and scores stay finite; very long texts are scored whole,
some tokens at a time; tokens of equal counts are leaves together or not at all; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.runtime import materialise, partitions
from catalens.llm.tokens import Tokens

#: Documents whose crc32(identifier) has this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Leaves of the token tree besides the escape, at most: tokens counted more than once, the most frequent first. Others are spelled.
LEAVES = 1 << 18
#: log2 of the slots of each predictor at FEW tokens and fewer: token contexts, then byte contexts; and how much they may grow.
TOKEN_BITS, BYTE_BITS = (20, 21), (20, 20)
FEW, GROWTH = 1 << 23, 2
#: Weights of the predictors that every document starts with: of the odds without context, then of states, which are sixteenths.
FIRST_WEIGHTS = ([0.5, 0.02, 0.02], [0.2, 0.035, 0.035])
#: Decisions of a document between refinements of its weights: the first block, doubling up to the second number, and later one
#: part in so many of all decisions so far.
BLOCKS = (32, 256, 16)
#: Rate of the refinements, for odds and for states, which are sixteenths; a gate with CALM decisions in a block takes half.
RATE, SCALE, CALM = 0.012, (1.0, 256.0), 1024
#: Bytes of text in a group of documents or a chunk, and distinct tokens that one of them and one range of hashes share on
#: average at least.
GROUP_BYTES, TOKENS_A_BLOCK = 12_000_000, 64
#: Rows of a batch, tokens and spelled words that are worked on at a time, and spelled words that are kept.
ROWS, STEP, SPELLED, KEPT_WORDS = 2500, 24_000, 6000, 300_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _parts(batch: pa.RecordBatch, training: bool):
    """(identifiers, texts) of some rows at a time, all or those to learn from."""
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        ids = part.column(0).to_pylist()
        kept = [not (training and held_out(d)) for d in ids]
        if any(kept):
            yield [d for d, k in zip(ids, kept, strict=True) if k], part.column(1).filter(pa.array(kept))


def layout(size: int, parts: int) -> tuple[int, int]:
    """Groups of documents and ranges of hashes that `size` bytes of text take. Both grow with the square root of the size, so
    that the blocks which groups and ranges exchange stay a fraction of tokens."""
    group = max(GROUP_BYTES, 6 * math.isqrt(TOKENS_A_BLOCK * max(1, size // 6)))
    return max(1, min(2 * parts, size // 1000 + 1), size // group), max(1, min(parts, size // 1000 + 1), size // (2 * group))


def table_bits(tokens: int) -> tuple[int, ...]:
    """log2 of the slots of each predictor: twice as many for four times as many training tokens, up to GROWTH times twice."""
    more = min(GROWTH, max(0, math.ceil(math.log2(max(1, tokens / FEW)) / 2)))
    return tuple(b + more for b in (*TOKEN_BITS, *BYTE_BITS))


def _span(hashes: np.ndarray, spans: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)).astype(np.int64)


def _slices(sorted_hashes: np.ndarray, spans: int):
    cuts = np.searchsorted(_span(sorted_hashes, spans), np.arange(spans + 1))
    return [(k, cuts[k], cuts[k + 1]) for k in range(spans) if cuts[k + 1] > cuts[k]]


def _table(rows: list[tuple], schema: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], schema=pa.schema(schema))


def _batch(rows: list[tuple], schema: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], schema=pa.schema(schema))


# Token counts -------------------------------------------------------------------------------------------------------

COUNTS = [("span", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]
COUNTS_SQL = "span int, hashes binary, counts binary"


def _count_tokens(spans: int):
    def run(batches):
        letters = np.zeros(257, np.int64)
        for batch in batches:
            for _, texts in _parts(batch, True):
                tokens = Tokens(texts)
                letters[:256] += np.bincount(np.frombuffer(b" ".join(tokens.words), np.uint8), minlength=256)
                order = np.argsort(tokens.hashes)
                found, n = tokens.hashes[order], tokens.counts()[order]
                yield _batch([(k, found[a:b].astype("<u8").tobytes(), n[a:b].astype("<u4").tobytes()) for k, a, b in _slices(found, spans)], COUNTS)
        yield _batch([(-1, b"", letters.astype("<i8").tobytes())], COUNTS)

    return run


def _sum_span(group: pa.Table) -> pa.Table:
    span = group.column("span")[0].as_py()
    if span < 0:
        total = sum(np.frombuffer(x, "<i8") for x in group.column("counts").to_pylist())
        return _table([(span, b"", total.astype("<i8").tobytes())], COUNTS)
    hashes = np.concatenate([np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return _table([(span, hashes[starts].tobytes(), np.add.reduceat(counts, starts).astype("<i8").tobytes())], COUNTS)


def _level(counts: np.ndarray) -> np.ndarray:
    """Classes of counts in their order: exact up to 255, then about a hundredth apart."""
    return np.where(counts < 256, counts, 256 + np.floor(np.log(np.maximum(counts, 256) / 256) * 100)).astype(np.int64)


def _levels(batches):
    total = np.zeros(4096, np.int64)
    tokens = 0
    for batch in batches:
        for span, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if span >= 0:
                counts = np.frombuffer(data, "<i8")
                total += np.bincount(np.minimum(_level(counts), 4095), minlength=4096)
                tokens += int(counts.sum())
    yield _batch([(-1, tokens), *((int(k), int(total[k])) for k in np.flatnonzero(total))], [("level", pa.int64()), ("n", pa.int64())])


def _above(level: int):
    def run(batches):
        for batch in batches:
            rows = []
            for span, hashes, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if span >= 0:
                    counts = np.frombuffer(data, "<i8")
                    at = np.minimum(_level(counts), 4095) >= level
                    rows.append((span, np.frombuffer(hashes, "<u8")[at].tobytes(), counts[at].tobytes()))
            yield _batch(rows, COUNTS)

    return run


# The model ----------------------------------------------------------------------------------------------------------


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol where its path starts and how long it is; the paths' nodes and bits. One symbol has no decisions."""
    n = len(counts)
    weights = np.zeros(2 * n - 1, np.int64)
    weights[:n] = np.maximum(1, counts)
    # Two queues: symbols by weight, and joined nodes, which come by weight. Of equal weights the lower number goes first.
    order = np.argsort(weights[:n], kind="stable").astype(np.int32)
    parent, bit, at, joined = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.uint8), 0, n
    for top in range(n, 2 * n - 1):
        both = 0
        for k in (0, 1):
            if at < n and (joined == top or weights[order[at]] <= weights[joined]):
                child, at = order[at], at + 1
            else:
                child, joined = joined, joined + 1
            parent[child], bit[child] = top, k
            both += int(weights[child])
        weights[top] = both
    lengths, root = np.zeros(n, np.int64), 2 * n - 2
    now = np.arange(n, dtype=np.int32)
    while len(who := np.flatnonzero(now != root)):
        lengths[who] += 1
        now[who] = parent[now[who]]
    start = np.cumsum(lengths) - lengths
    nodes, bits = np.empty(int(lengths.sum()), np.int64), np.empty(int(lengths.sum()), np.uint8)
    # All paths at once, from their ends.
    now, place = np.arange(n, dtype=np.int32), start + lengths
    while len(who := np.flatnonzero(now != root)):
        place[who] -= 1
        nodes[place[who]], bits[place[who]] = parent[now[who]] - n, bit[now[who]]
        now[who] = parent[now[who]]
    return start, lengths, nodes, bits


class _Tree:
    FIELDS = ("start", "length", "path", "odds", "marks")

    def __init__(self, counts: list[int]):
        self.start, self.length, nodes, bits = huffman(counts)
        ones, zeros = np.zeros(len(counts) + 1), np.zeros(len(counts) + 1)
        weight = np.repeat(np.maximum(1, np.array(counts, float)), self.length)
        np.add.at(ones, nodes, weight * bits)
        np.add.at(zeros, nodes, weight * (1 - bits.astype(float)))
        self.odds = np.log((ones + 0.5) / (zeros + 0.5)).astype(np.float32)
        deep = np.arange(len(nodes)) - np.repeat(np.cumsum(self.length) - self.length, self.length) >= 4
        #: Decisions of all paths: the node, whether it lies deep, the bit.
        self.path = (nodes << 2 | deep << 1 | bits).astype(np.int32)
        marks = np.arange(len(counts) + 1, dtype=np.uint64) * _A
        self.marks = (marks >> np.uint64(32)).astype(np.uint32)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many decisions each symbol has, and all of them."""
        n = self.length[symbols]
        at = np.repeat(self.start[symbols] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return n, self.path[at]


def _slots(contexts: np.ndarray, n: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    mixed = np.repeat(contexts, n)
    mixed ^= marks
    mixed *= np.uint32(0x9E3779B1)
    mixed >>= np.uint32(32 - bits)
    return mixed


def _states(counts: np.ndarray) -> np.ndarray:
    """One byte for each slot of (zeros, ones): its log odds in sixteenths, drawn to none where little was counted."""
    both = counts.reshape(-1, 2)
    return np.clip(np.round(16 * np.log((both[:, 1] + 0.4) / (both[:, 0] + 0.4))), -127, 127).astype(np.int8)


def _token_contexts(hashes: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """The token before, and the two before; a document's first tokens have its start there."""
    one = np.empty_like(hashes)
    one[1:] = hashes[:-1]
    one[firsts] = 0
    two = np.empty_like(hashes)
    two[1:] = one[:-1]
    two[firsts] = 1
    return [_short(one * _C + np.uint64(11)), _short((one * _C ^ two) * _B + np.uint64(13))]


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _bytes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Symbols of spelled words, a byte each and 256 at the end; the word of each; contexts: three bytes, all before."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    symbols = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    symbols[ends] = 256
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(symbols)) - np.repeat(ends - sizes + 1, sizes)
    before = np.zeros((3, len(symbols)), np.uint64)
    for k in range(3):
        before[k, k + 1 :] = symbols[: -k - 1] if len(symbols) > k + 1 else symbols[:0]
        before[k][place <= k] = 257
    # The hash of all bytes before: grown place by place, over the words that are that long.
    prefix = np.zeros(len(symbols), np.uint64)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(1, int(place.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        prefix[at] = (prefix[at - 1] ^ symbols[at - 1].astype(np.uint64)) * _A + np.uint64(7)
    three = (before[0] << np.uint64(20) | before[1] << np.uint64(10) | before[2]) * _B + np.uint64(17)
    return symbols, owner, [_short(three), _short(prefix * _C + np.uint64(19))]


TOKEN_GATES, BYTE_GATES = 8, 4


class Model:
    """The trees, and for each predictor its slots: counts while learning, states when scoring."""

    def __init__(self, words: np.ndarray, token_counts: np.ndarray, escape: int, letters: np.ndarray, bits: tuple[int, ...] = (*TOKEN_BITS, *BYTE_BITS)):
        self.bits = bits
        order = np.argsort(words)
        self.words = words[order]
        self.tokens = _Tree([*token_counts[order].tolist(), escape])
        self.bytes = _Tree(np.append(letters[:256], max(1, int(letters.sum()) // 8)).tolist())
        self.escape = len(words)
        self.states: list[np.ndarray] = []
        self.weights = [np.tile(np.array(w, np.float32), (gates, 1)) for w, gates in zip(FIRST_WEIGHTS, (TOKEN_GATES, BYTE_GATES), strict=True)]

    def parts(self) -> tuple:
        """Arrays alone: what a broadcast carries to executors that lack this module."""
        return self.words, *([getattr(t, f) for f in _Tree.FIELDS] for t in (self.tokens, self.bytes)), self.states, self.weights, self.bits

    @classmethod
    def of(cls, parts: tuple) -> Model:
        model = cls.__new__(cls)
        model.words, tokens, letters, model.states, model.weights, model.bits = parts
        model.escape = len(model.words)
        model.tokens, model.bytes = (_Tree.__new__(_Tree) for _ in range(2))
        for tree, fields in ((model.tokens, tokens), (model.bytes, letters)):
            vars(tree).update(zip(_Tree.FIELDS, fields, strict=True))
        return model

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.escape)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, self.escape)

    def token_slots(self, hashes, firsts, symbols):
        n, path = self.tokens.expand(symbols)
        marks = self.tokens.marks[path >> 2]
        return n, path, [_slots(c, n, marks, b) for c, b in zip(_token_contexts(hashes, firsts), self.bits, strict=False)]

    def byte_slots(self, words):
        symbols, owner, contexts = _bytes_of(words)
        n, path = self.bytes.expand(symbols)
        marks = self.bytes.marks[path >> 2]
        return n, path, [_slots(c, n, marks, b) for c, b in zip(contexts, self.bits[len(TOKEN_BITS) :], strict=True)], owner

    def token_inputs(self, hashes, firsts, symbols):
        """Decisions of each token; the bit, the predictors' odds and the gate of every decision."""
        n, path, slots = self.token_slots(hashes, firsts, symbols)
        x = np.empty((3, len(path)), np.float32)
        np.take(self.tokens.odds, path >> 2, out=x[0])
        gate = ((path & 2) << 1).astype(np.uint8)
        for k, s in enumerate(slots):
            state = self.states[k][s]
            x[1 + k] = state
            gate |= (state != 0).view(np.uint8) << np.uint8(k)
        return n, (path & 1).astype(np.float32), x, gate

    def byte_inputs(self, words):
        n, path, slots, owner = self.byte_slots(words)
        x = np.empty((3, len(path)), np.float32)
        x[0] = self.bytes.odds[path >> 2]
        for k, s in enumerate(slots):
            x[1 + k] = self.states[2 + k][s]
        gate = (x[2] != 0).view(np.uint8) | (np.abs(x[2]) > 32).view(np.uint8) << np.uint8(1)
        return n, (path & 1).astype(np.float32), x, gate, owner


class Counter:
    """Counts of training decisions in every predictor's slots."""

    def __init__(self, model: Model):
        self.model = model
        # Counts of one task: far below 2^31 in a slot.
        self.tables = [np.zeros(2 << b, np.int32) for b in model.bits]
        self.spelled: dict[bytes, int] = {}

    def add_tokens(self, hashes: np.ndarray, firsts: np.ndarray, symbols: np.ndarray) -> None:
        for i in range(0, len(hashes), STEP):
            # A step begins with the two tokens before it, which give its first contexts and are not counted again.
            a = max(0, i - 2)
            inside = firsts[(firsts >= a) & (firsts < i + STEP)] - a
            n, path, slots = self.model.token_slots(hashes[a : i + STEP], inside, symbols[a : i + STEP])
            skip = int(n[: i - a].sum())
            bits = path[skip:] & 1
            for k, s in enumerate(slots):
                np.add.at(self.tables[k], (s[skip:].astype(np.int64) << 1) | bits, np.int32(1))

    def add_spelled(self, words: list[bytes], times: np.ndarray) -> None:
        for w, n in zip(words, times.tolist(), strict=True):
            self.spelled[w] = self.spelled.get(w, 0) + n
        if len(self.spelled) > KEPT_WORDS:
            self.spell()

    def spell(self) -> None:
        words, times = list(self.spelled), np.fromiter(self.spelled.values(), np.int32, len(self.spelled))
        self.spelled = {}
        for i in range(0, len(words), 1500):
            n, path, slots, owner = self.model.byte_slots(words[i : i + 1500])
            bits, weights = path & 1, np.repeat(times[i : i + 1500][owner], n)
            for k, s in enumerate(slots):
                np.add.at(self.tables[len(TOKEN_BITS) + k], (s.astype(np.int64) << 1) | bits, weights)

    def done(self) -> list[np.ndarray]:
        self.spell()
        return self.tables


def _cost(odds: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nats of each decision, and its error: the bit less the probability of a one. The odds are overwritten."""
    sign = 1 - 2 * bit
    np.clip(odds, -18, 18, out=odds)
    odds *= sign
    against = np.exp(odds, out=odds)
    whole = 1 + against
    against /= whole
    against *= -sign
    return np.log(whole, out=whole), against


def mix(x: np.ndarray, bits: np.ndarray, gate: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Nats of each document's decisions, which stand together.

    All documents start with the same weights; each refines its own, gate by gate, from each block of its decisions for the
    next.
    """
    docs, gates = len(lengths), len(weights)
    order = np.argsort(-lengths, kind="stable")
    sizes, firsts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    own, cost = np.ascontiguousarray(np.tile(weights, (docs, 1)).T), np.zeros(docs)
    # The longest first: those with a block left are always the first ones.
    start, block = 0, BLOCKS[0]
    while start < int(sizes.max(initial=0)):
        active, going = (int(np.searchsorted(-sizes, -end)) for end in (start, start + block))
        n = np.minimum(block, sizes[:active] - start)
        who = np.repeat(np.arange(active), n)
        at = np.repeat(firsts[:active] + start - (np.cumsum(n) - n), n) + np.arange(len(who))
        xs, key = [v[at] for v in x], who * gates + gate[at]
        odds = own[0][key] * xs[0]
        for k in range(1, len(xs)):
            part = own[k][key]
            part *= xs[k]
            odds += part
        spent, error = _cost(odds, bits[at])
        cost[:active] += np.add.reduceat(spent, np.cumsum(n) - n, dtype=np.float64)
        if going:
            key, error = key[: going * block], error[: going * block]
            rate = RATE / (1 + np.bincount(key, minlength=going * gates) / CALM)
            for k, v in enumerate(xs):
                own[k, : going * gates] += (rate * np.bincount(key, weights=error * v[: going * block], minlength=going * gates) / SCALE[k > 0]).astype(np.float32)
        start, block = start + block, max(min(2 * block, BLOCKS[1]), (start + block) // BLOCKS[2])
    nats = np.empty(docs)
    nats[order] = cost
    return nats


# Context counts -----------------------------------------------------------------------------------------------------

#: Rows of tables on their way: the table, the part of it, its counts.
PARTS = [("name", pa.int32()), ("part", pa.int32()), ("data", pa.binary())]
PARTS_SQL = "name int, part int, data binary"
PART = 1 << 17


def _spelled(model: Model, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each distinct word, and which of them are spelled."""
    symbols = model.symbols(tokens.hashes)
    return symbols, np.flatnonzero(symbols == model.escape)


def _count_contexts(shared):
    def run(batches):
        model = Model.of(shared.value)
        counter = Counter(model)
        for batch in batches:
            for _, texts in _parts(batch, True):
                tokens = Tokens(texts)
                symbols, spelled = _spelled(model, tokens)
                counter.add_tokens(tokens.hashes[tokens.index], tokens.firsts, symbols[tokens.index])
                counter.add_spelled([tokens.words[i] for i in spelled], tokens.counts()[spelled])
        rows = []
        for name, c in enumerate(counter.done()):
            for part in range(0, len(c), PART):
                if (own := c[part : part + PART]).any():
                    rows.append((name, part // PART, pa.compress(_packed(own), "zstd", asbytes=True)))
        yield _batch(rows, PARTS)

    return run


def _packed(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _sum_parts(batches):
    """Adds up what arrives part by part, and turns sums into states: one byte a slot."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for name, part, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = _unpacked(pa.decompress(data, 4 * PART, "zstd", asbytes=True))
            sums[name, part] = sums[name, part] + own if (name, part) in sums else own
    yield _batch([(name, part, _states(own).tobytes()) for (name, part), own in sums.items()], PARTS)


# Scoring ------------------------------------------------------------------------------------------------------------

ASKED = [("home", pa.int32()), ("span", pa.int32()), ("hashes", pa.binary())]
TOLD = [("home", pa.int32()), ("span", pa.int32()), ("counts", pa.binary())]
SCORED = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]
SCORED_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_sum double, score double, n_bytes bigint"


def _ask(spans: int):
    def run(group: pa.Table) -> pa.Table:
        home = group.column("home")[0].as_py()
        hashes = np.sort(Tokens(group.column("text").combine_chunks()).hashes)
        return _table([(home, k, hashes[a:b].astype("<u8").tobytes()) for k, a, b in _slices(hashes, spans)], ASKED)

    return run


def _told(counts: np.ndarray) -> bytes:
    """64-bit counts as planes of bytes: planes of zeros vanish when the shuffle compresses them."""
    return np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _heard(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _tell(asked: pa.Table, known: pa.Table) -> pa.Table:
    hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, "<u8") for x in known.column("hashes").to_pylist())])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<i8") for x in known.column("counts").to_pylist())])
    rows = []
    for home, span, data in zip(*(asked.column(c).to_pylist() for c in ("home", "span", "hashes")), strict=True):
        own = np.frombuffer(data, "<u8")
        told = np.zeros(len(own), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            told = np.where(hashes[at] == own, counts[at], 0)
        rows.append((home, span, _told(told)))
    return _table(rows, TOLD)


def _spelling(model: Model, tokens: Tokens, codes: np.ndarray) -> np.ndarray:
    """Nats of each document's spelled words besides their places in the token tree."""
    at = np.flatnonzero(codes == model.escape)
    docs = np.searchsorted(tokens.firsts, at, side="right") - 1
    nats, words, i = np.zeros(len(tokens.sizes)), tokens.index[at], 0
    while i < len(at):
        # Some words, and whole documents.
        j = int(np.searchsorted(docs, docs[min(i + SPELLED, len(at)) - 1], side="right"))
        n, bits, x, gate, owner = model.byte_inputs([tokens.words[w] for w in words[i:j]])
        found, place = np.unique(docs[i:j], return_inverse=True)
        lengths = np.bincount(place[owner], weights=n, minlength=len(found)).astype(np.int64)
        nats[found] += mix(x, bits, gate, lengths, model.weights[1])
        i = j
    return nats


def _score(shared):
    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _table([], SCORED)
        model, tokens = Model.of(shared.value), Tokens(group.column("text").combine_chunks())
        symbols = model.symbols(tokens.hashes)
        # The counts of the group's distinct tokens: spans are in the order of hashes.
        order = np.argsort(told.column("span").to_numpy(), kind="stable")
        blobs = told.column("counts").to_pylist()
        counts = np.zeros(len(tokens.words), np.int64)
        counts[np.argsort(tokens.hashes)] = np.concatenate([_heard(blobs[i]) for i in order])
        hashes, codes = tokens.hashes[tokens.index], symbols[tokens.index]
        nats = _spelling(model, tokens, codes)
        logs = np.add.reduceat(np.log10(counts + 1.0)[tokens.index], tokens.firsts)
        known = np.add.reduceat((counts > 0).astype(np.int64)[tokens.index], tokens.firsts)
        firsts, sizes, i = tokens.firsts, tokens.sizes, 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(firsts, firsts[i] + STEP)) - 1)
            a, b = firsts[i], firsts[j - 1] + sizes[j - 1]
            n, bits, x, gate = model.token_inputs(hashes[a:b], firsts[i:j] - a, codes[a:b])
            nats[i:j] += mix(x, bits, gate, np.add.reduceat(n, firsts[i:j] - a), model.weights[0])
            i = j
        ids = group.column("doc_id").to_pylist()
        bytes_ = pc.fill_null(pc.binary_length(group.column("text")), 0).to_pylist()
        return _table(list(zip(ids, map(held_out, ids), sizes.tolist(), known.tolist(), logs.tolist(), (-nats / np.log(10)).tolist(), bytes_, strict=True)), SCORED)

    return run


def learn(docs: DataFrame, spans: int) -> tuple[DataFrame, Model, int, int]:
    """From the training rows of docs (doc_id, text): the table of token counts by ranges of hashes, the model, the number
    of training tokens and of distinct ones."""
    spark = docs.sparkSession
    # Of the letters' row each task sends one, of fixed size.
    counts = materialise(docs.mapInArrow(_count_tokens(spans), COUNTS_SQL).groupBy("span").applyInArrow(_sum_span, COUNTS_SQL), "token-counts")
    levels = {r["level"]: r["n"] for r in counts.mapInArrow(_levels, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    total, distinct = levels.pop(-1, 0), sum(n for k, n in levels.items())
    level, leaves = 1 << 30, 0
    for k in sorted(levels, reverse=True):
        if k < 2 or leaves + levels[k] > LEAVES:
            break
        level, leaves = k, leaves + levels[k]
    # At most LEAVES tokens reach the driver.
    chosen = counts.mapInArrow(_above(level), COUNTS_SQL).collect()
    words = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["hashes"], "<u8") for r in chosen)])
    often = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], "<i8") for r in chosen)])
    letters = next((np.frombuffer(r["counts"], "<i8") for r in counts.where("span = -1").collect()), np.zeros(257, np.int64))
    model = Model(words, often, max(1, total - int(often.sum())), letters, table_bits(total))

    shared = spark.sparkContext.broadcast(model.parts())
    parts = docs.mapInArrow(_count_contexts(shared), PARTS_SQL).repartition(partitions(spark), "name", "part").mapInArrow(_sum_parts, PARTS_SQL).collect()
    model.states = [np.zeros(1 << b, np.int8) for b in model.bits]
    for r in parts:
        data = np.frombuffer(r["data"], np.int8)
        model.states[r["name"]][r["part"] * PART // 2 :][: len(data)] = data
    return counts, model, total, distinct


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes, spans = layout(size, parts)
    counts, model, total, distinct = learn(docs, spans)
    shared = spark.sparkContext.broadcast(model.parts())
    grouped = docs.withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(homes)).cast("int")).repartition(parts, "home")
    asked = grouped.groupBy("home").applyInArrow(_ask(spans), "home int, span int, hashes binary")
    told = asked.groupBy("span").cogroup(counts.where("span >= 0").groupBy("span")).applyInArrow(_tell, "home int, span int, counts binary")
    scored = grouped.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(_score(shared), SCORED_SQL)
    base = F.col("log_sum") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
