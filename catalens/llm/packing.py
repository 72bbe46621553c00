"""Best-fit packing of documents into sequences by a linear grouping scheme.

Lengths are whole numbers up to the sequence length, so everything about packing is decided on a histogram with at most
that many rows, whatever the number of documents. Large lengths form groups of equal cardinality and are rounded up to
the longest of their group; the few sizes that remain are packed by configurations, found by column generation on the
linear program and rounded down. Actual documents then take the place of the rounded sizes, and what is left over, with
all small documents, goes best-fit, longest first, into the room that remains. Runs of alike sequences are kept as one
entry, so the plan stays small; documents find their place in it by their rank among those of their length. Ranks come
from counts of (length, bucket) cells: no length is ever ranked in one task.

Defined results: a null text is the empty text, one end token; only longer documents are cut, into full pieces and a last
one; repeated rows are packed as separate documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalens.llm.runtime import materialise
from catalens.llm.tokens import Tokens

LENGTH = 4096
#: The id after each document.
END_ID = np.array(1, "<u4")
#: Numbers of groups of large lengths, of which the one with the fewest sequences is taken, and the share of a sequence
#: above which a length is large.
GROUPS = (16, 24, 48)
LARGE = 1 / 8
#: Steps of column generation, each with one more configuration, and the gain below which it ends.
COLUMNS = 600
GAIN = 1e-7
BUCKETS = 256
#: Distinct words whose ids a task keeps at a time, and documents that are worked on together.
KEPT_PARTS, TOGETHER_DOCS = 1 << 18, 1500
VOCABULARY = "word_bpe_49k.json"


#: ASCII marks that may end a word: after a letter they are tokens of their own. An apostrophe may begin a contraction.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that the tokenizer gets as one text, with a control character between them to tell them apart, and texts in a call.
TOGETHER, CALL = 200, 25
BETWEEN = "\x00"


class _Ids:
    """The ids of chunks without white space, as little-endian bytes. The tokenizer never joins chunks, nor letters with
    the marks that follow them, and lower-cases all but its special tokens, which begin with <|."""

    def __init__(self, path: str | None):
        # A task has one core; the library would start a thread for each core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {b"": b""}

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: those of its letters, and of the marks at its end."""
        stems, marks = [], []
        for word in words:
            stem = word.rstrip(MARKS)
            if stem is word or not stem or b"<|" in word or not (97 <= stem[-1] <= 122 or stem[-1] >= 128 and stem.decode()[-1].isalpha()):
                stems.append(word)
                marks.append(b"")
            else:
                stems.append(stem)
                marks.append(word[len(stem) :])
        needed = {*stems, *marks}
        unknown = needed.difference(self.known)
        if len(self.known) + len(unknown) > KEPT_PARTS:
            self.known, unknown = {b"": b""}, needed - {b""}
        self.encode(list(unknown))
        known = self.known
        return [known[s] + known[m] if m else known[s] for s, m in zip(stems, marks, strict=True)]

    def encode(self, words: list[bytes]) -> None:
        plain = [w for w in words if b"\0" not in w and b"<|" not in w]
        if len(self.between) != 1:
            plain = []
        alone = set(words).difference(plain)
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        glue = f" {BETWEEN} "
        for i in range(0, len(groups), CALL):
            some = groups[i : i + CALL]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([glue.join(w.decode() for w in g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == self.between[0])
                if len(cuts) != len(group) - 1:
                    alone.update(group)
                    continue
                data, edges = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
                for w, a, z in zip(group, edges[:-1], edges[1:], strict=True):
                    self.known[w] = data[4 * a + 4 : 4 * z]
        for w in alone:
            self.known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _ids_of(ids: _Ids, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, each with the end token, and how many each has."""
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        # Special tokens stay as they are written: nothing is lower-cased here.
        words = [(text or b"").split() for text in texts.cast(pa.large_binary()).to_pylist()]
        own = [np.frombuffer(b"".join(ids.of(w)) + END_ID.tobytes(), "<u4") for w in words]
        return np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
    tokens = Tokens(texts)
    known = [*ids.of(tokens.words[:-1]), END_ID.tobytes()]
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    n = sizes[tokens.index]
    at = np.repeat((np.cumsum(sizes) - sizes)[tokens.index] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(known), "<u4")[at], np.add.reduceat(n, tokens.firsts)


def _pieces(path: str | None, length: int, keep_ids: bool):
    def run(batches):
        ids = _Ids(path)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER_DOCS):
                part = batch.slice(i, TOGETHER_DOCS)
                flat, sizes = _ids_of(ids, part.column(1))
                starts, out = np.cumsum(sizes) - sizes, []
                for doc_id, first, n in zip(part.column(0).to_pylist(), starts.tolist(), sizes.tolist(), strict=True):
                    for k, at in enumerate(range(0, n, length)):
                        own = flat[first + at : first + min(at + length, n)]
                        out.append((doc_id, k, at, len(own), zlib.crc32(own), own.astype(np.int32) if keep_ids else None))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                width = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:width], kinds[:width], strict=True)], names=names[:width])

    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row: ids of the text by the tokenizer file, then the end token, cut where longer than length."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, length, keep_ids), PIECE + (", ids array<int>" if keep_ids else ""))


def _best_configuration(sizes: list[int], worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The configuration of sizes that fits in room and is worth most: a knapsack, one more item a layer."""
    best = np.zeros(room + 1)
    picks = []
    for _ in range(room // min(sizes)):
        now, pick = best.copy(), np.full(room + 1, -1)
        for j, s in enumerate(sizes):
            if worth[j] > 0:
                value = best[: room + 1 - s] + worth[j]
                better = value > now[s:] + 1e-12
                now[s:][better] = value[better]
                pick[s:][better] = j
        if (pick < 0).all():
            break
        picks.append(pick)
        best = now
    count, at = np.zeros(len(sizes), int), room
    for pick in reversed(picks):
        if (j := pick[at]) >= 0:
            count[j] += 1
            at -= sizes[j]
    return float(worth @ count), count


def configurations(sizes: list[int], demand: list[int], room: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration of the sizes: the linear program's optimum, rounded down."""
    k = len(sizes)
    basis = np.diag([float(room // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(COLUMNS):
        inverse = np.linalg.inv(basis)
        value, column = _best_configuration(sizes, inverse.sum(axis=0), room)
        if value <= 1 + GAIN:
            break
        used, enter = inverse @ need, inverse @ column
        ratio = np.full(k, np.inf)
        ratio[enter > 1e-9] = used[enter > 1e-9] / enter[enter > 1e-9]
        basis[:, int(ratio.argmin())] = column
    used = np.floor(np.linalg.solve(basis, need) + 1e-6).astype(int)
    return [(int(n), basis[:, i].round().astype(int)) for i, n in enumerate(used) if n > 0]


class _Plan:
    """Sequences as runs of alike ones. A placement (length, rank, each, offset) of a run puts in its i-th sequence the
    `each` documents of that length from rank + i * each, side by side from offset."""

    def __init__(self, counts: dict[int, int], room: int):
        self.left, self.next, self.room = dict(counts), defaultdict(int), room
        self.runs: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.closed: list[tuple[int, list]] = []

    def take(self, length: int, n: int) -> int:
        rank = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return rank

    def add(self, n: int, placed: list, free: int) -> None:
        if not n:
            return
        if not free:
            self.closed.append((n, placed))
            return
        if not self.runs[free]:
            insort(self.rooms, free)
        self.runs[free].append((n, placed))

    def pop(self, at: int) -> tuple[int, list, int]:
        free = self.rooms[at]
        n, placed = self.runs[free].pop()
        if not self.runs[free]:
            self.rooms.pop(at)
        return n, placed, free

    @staticmethod
    def moved(placed: list, by: int) -> list:
        return [(length, rank + by * each, each, offset) for length, rank, each, offset in placed]

    def best_fit(self) -> None:
        """All documents left, longest first, each in the sequence with the least room that holds it."""
        for length in sorted(self.left, reverse=True):
            while (m := self.left[length]) > 0:
                at = bisect_left(self.rooms, length)
                n, placed, free = self.pop(at) if at < len(self.rooms) else (-(-m // (self.room // length)), [], self.room)
                each = free // length
                whole, some = min(n, m // each), 0
                if whole < n:
                    some = m - whole * each
                rank, offset = self.take(length, whole * each + some), self.room - free
                self.add(whole, [*placed, (length, rank, each, offset)], free - each * length)
                if some:
                    self.add(1, [*self.moved(placed, whole), (length, rank + whole * each, some, offset)], free - some * length)
                rest = whole + (some > 0)
                if rest < n and (placed or free < self.room):
                    self.add(n - rest, self.moved(placed, rest), free)


def plan(counts: dict[int, int], room: int = LENGTH, groups: tuple[int, ...] = GROUPS) -> list[tuple[int, list]]:
    """Runs of sequences for documents of these lengths: (how many, placements)."""
    return min((_plan(counts, room, k) for k in groups), key=lambda runs: sum(n for n, _ in runs))


def _plan(counts: dict[int, int], room: int, groups: int) -> list[tuple[int, list]]:
    made = _Plan(counts, room)
    large = [(length, counts[length]) for length in sorted(counts, reverse=True) if length > room * LARGE]
    n = sum(c for _, c in large)
    if n:
        # Documents in order of length, cut into groups of equal cardinality; a length may lie in several.
        queues, at, taken = [[] for _ in range(min(groups, n))], 0, 0
        for length, count in large:
            while count:
                part = min(count, (at + 1) * n // len(queues) - taken)
                if part:
                    queues[at].append([length, part])
                count, taken = count - part, taken + part
                if taken == (at + 1) * n // len(queues) and at + 1 < len(queues):
                    at += 1
        queues = [q for q in queues if q]
        sizes: dict[int, list] = {}
        for q in queues:
            sizes.setdefault(q[0][0], []).extend(q)
        names = list(sizes)
        for times, shape in configurations(names, [sum(c for _, c in sizes[s]) for s in names], room):
            slots = [s for s, m in zip(names, shape, strict=True) for _ in range(m)]
            streams = []
            for s in slots:
                # The next documents of the size's group, as many as there are sequences of this shape.
                got, want = [], times
                while want:
                    length, have = sizes[s][0]
                    part = min(have, want)
                    got.append((length, made.take(length, part), part))
                    want -= part
                    if part == have:
                        sizes[s].pop(0)
                    else:
                        sizes[s][0][1] -= part
                streams.append(got)
            done = 0
            while done < times:
                step = min(x[0][2] for x in streams)
                placed, offset = [], 0
                for x in streams:
                    length, rank, have = x[0]
                    placed.append((length, rank, 1, offset))
                    offset += length
                    if have == step:
                        x.pop(0)
                    else:
                        x[0] = (length, rank + step, have - step)
                made.add(step, placed, room - offset)
                done += step
    made.best_fit()
    return made.closed + [run for free in made.rooms for run in made.runs[free]]


def _table_of(runs: list[tuple[int, list]]) -> np.ndarray:
    """(length, rank, each, offset, first sequence) of every placement, in order of length and rank."""
    rows, first = [], 0
    for n, placed in runs:
        rows += [(length, rank, each, offset, first) for length, rank, each, offset in placed]
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _assign(table: np.ndarray):
    def run(batches):
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = table[np.searchsorted(keys, length.astype(np.int64) << 48 | rank, side="right") - 1]
            turn = rank - at[:, 1]
            sequence, offset = at[:, 4] + turn // np.maximum(at[:, 2], 1), at[:, 3] + turn % np.maximum(at[:, 2], 1) * length
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, room: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces, which is read several times: write it first."""
    names = parts.columns
    tagged = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    cells = tagged.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # At most `room` rows: lengths are whole numbers up to it.
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _table_of(plan(counts, room))
    first = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("length", "bucket", first.alias("first"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = tagged.withColumn("place", rank).join(cells, ["length", "bucket"]).withColumn("rank", (F.col("place") + F.col("first")).cast("bigint"))
    kinds = ", ".join(f"{c} {t}" for c, t in parts.dtypes)
    return ranked.select(*names, "rank").mapInArrow(_assign(table), f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text)."""
    return pack(materialise(pieces(docs, tokenizer=tokenizer, length=length), "pieces"), length)


def sequences(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_ids), ids in the order of their offsets."""
    packed = pack(materialise(pieces(docs, tokenizer=tokenizer, length=length, keep_ids=True), "pieces"), length)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = packed.groupBy("sequence_id").agg(ordered.alias("x"))
    return grouped.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))
