import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from catalens.llm import chat, mixing, packing, quality
from catalens.llm.tokens import END, Tokens
from tests.llm.helpers import WORD, awkward, docs, prose


# Packing ------------------------------------------------------------------------------------------------------------
def check_plan(counts, room, runs):
    """Every document once, gapless from 0, none beyond the room."""
    seen = defaultdict(list)
    for n, placed in runs:
        assert n > 0 and placed
        at = 0
        for length, rank, each, offset in placed:
            assert offset == at and each > 0
            at += each * length
            seen[length].append((rank, rank + n * each))
        assert at <= room
    for length, spans in seen.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == counts[length]
    assert set(seen) == {k for k, v in counts.items() if v}


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=25))
@settings(max_examples=60, deadline=None)
def test_plans_place_every_document_once(counts):
    runs = packing.plan(counts, 64)
    check_plan(counts, 64, runs)
    total = sum(k * v for k, v in counts.items())
    assert sum(n for n, _ in runs) <= max(1, 2 * total / 64 + 1)


def test_plans_are_near_the_bound_and_small():
    r = random.Random(1)
    counts = Counter(min(4096, int(r.lognormvariate(6.3, 0.9)) + 1) for _ in range(200_000))
    runs = packing.plan(dict(counts))
    check_plan(counts, 4096, runs)
    assert sum(n for n, _ in runs) <= 1.002 * math.ceil(sum(k * v for k, v in counts.items()) / 4096)
    assert sum(len(p) for _, p in runs) < 200_000


def test_a_third_alike_and_nothing():
    counts = {1500: 100_000, **{k: 70 for k in range(100, 3000)}}
    check_plan(counts, 4096, packing.plan(counts))
    assert packing.plan({}) == []


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["<|endoftext|> a <|ENDOFTEXT|>, b<|startoftext|>.", "don't, l'été! NAÏVE’s", "x\x00y \x00 z", "½, ²! ٣. 你好, ok", "...", "a%%% b*** É,", "\u00a0", "e\x85f \x1c g"]


def test_ids_equal_the_tokenizer():
    texts = [*ODD, *(t or "" for _, t in awkward())]
    for some in (texts[:1], texts[1:]):
        flat, sizes = packing._ids_of(packing._Ids(None), pa.array(some, pa.string()))
        at = 0
        for text, n in zip(some, sizes, strict=True):
            assert flat[at : at + n].tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]
            at += n


@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_ids_of_any_text(texts):
    flat, sizes = packing._ids_of(packing._Ids(None), pa.array(texts, pa.string()))
    want = [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert flat.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_packing_equals_brute_force(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, prose(7)) for i in range(40)]
    got = packing.pack_documents(docs(spark, rows)).collect()
    want = Counter()
    for d, t in rows:
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4")
            want[d, at // 4096, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = [(i, prose(i, 900)) for i in range(12)]
    got = packing.sequences(docs(spark, rows)).collect()
    flat = Counter(i for r in got for i in r["ids"])
    assert flat == Counter(i for _, t in rows for i in [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1])
    assert all(len(r["ids"]) <= 4096 for r in got)


# Tokens -------------------------------------------------------------------------------------------------------------
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\u00a0x.", max_size=20)), min_size=1, max_size=8), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_tokens_equal_plain_splitting(texts, skip):
    column = pa.array(["pad text", "", None][:skip] + texts, pa.string()).slice(skip)
    tokens = Tokens(column)
    want = [[*(t or "").encode().lower().split(), END] for t in texts]
    assert [tokens.words[i] for i in tokens.index] == [w for d in want for w in d] and tokens.sizes.tolist() == list(map(len, want))


# Chat ---------------------------------------------------------------------------------------------------------------
NASTY = st.text(alphabet="\\#</>turn: aé\n\t$1&*", max_size=25)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200), st.one_of(st.none(), st.sampled_from(["user", "assistant", "a:\\#</turn>b", ""])), st.one_of(st.none(), NASTY)), min_size=1, max_size=14))
@settings(max_examples=12, deadline=None)
def test_chat_reads_back(spark, rows):
    table = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_template_and_a_long_conversation(spark):
    control = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", control), (-7, 1, "assistant", control), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    rows += [(2, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(3000)]
    made = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert made[1]["formatted"] == "### user: a</turn>b</turn>\n### assistant: c</turn>\n"
    assert [made[1]["formatted"][s["start"] : s["stop"]] for s in made[1]["loss_spans"]] == ["c"]
    assert len(made[2]["loss_spans"]) == 2000
    assert all(made[2]["formatted"][s["start"] : s["stop"]].startswith("t") for s in made[2]["loss_spans"][::97])
    assert made[-7]["formatted"].count("### ") == 2
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# Quality ------------------------------------------------------------------------------------------------------------
def brute_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_equals_brute_force(spark):
    rows = awkward() + [(100 + i, t) for i, t in enumerate(["a b c " * 40, "a a a a", "x\ny\nx\n \nx", "#*$ % &|<>", "a b c d a b c", prose(5, 60) + "\n" + prose(5, 60)])]
    got = quality.ledger(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((d, *brute_quality(t)) for d, t in rows)
    assert quality.ledger(docs(spark, [])).count() == 0


def test_policies_and_ablations(spark):
    table = docs(spark, [(1, "short"), (2, "a b c " * 60), (3, prose(1, 100, 10_000)), (4, "x y z"), (5, " ".join(["%%%%"] * 20 + [f"q{i}" for i in range(60)]))])
    entries = quality.ledger(table)
    assert {r["doc_id"] for r in entries.where(quality.passes(quality.BASE)).collect()} == {3, 5}
    assert {r["doc_id"] for r in entries.where(quality.passes(quality.STANDARD)).collect()} == {3}
    got = {r["rule"]: (r["failing"], r["failing_alone"], r["kept_without"]) for r in quality.ablations(entries, quality.BASE).collect()}
    assert got["few_words"] == (2, 2, 4) and got["repeated_windows"] == (1, 1, 3)
    with pytest.raises(ValueError):
        quality.Policy("p", 1, ("nothing",)).mask()
    kept = quality.keep_passing(table)
    assert kept.schema == table.schema and [r["doc_id"] for r in kept.collect()] == [3]


# Mixing -------------------------------------------------------------------------------------------------------------
def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing and resharing until none is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = awkward() + [(1000 + i, prose(i, r.randrange(1, 200)), r.choice(["a", "b", "b", "b", "b", "c", "d", None])) for i in range(500)]
    # A hot source with one size for most of its rows.
    rows += [(5000 + i, prose(4, 50), "hot") for i in range(300)]
    table = docs(spark, rows)
    got = mixing.mix(mixing.sized(table)).collect()
    again = mixing.mix(mixing.sized(table)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for x in got:
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        largest[x["source"]] = max(largest[x["source"]], x["size"])
        assert 0 <= x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"]
    want = water(sizes)
    for s, target in want.items():
        assert math.isclose(next(x["target"] for x in got if x["source"] == s), target, rel_tol=1e-9)
        # No target is missed by more than half of the smallest document that could still move the way it was settled.
        own = [x for x in got if x["source"] == s and x["size"]]
        up, down = [x["size"] for x in own if x["copies"] < 3], [x["size"] for x in own if x["copies"]]
        assert not up or abs(taken[s] - target) <= max(min(up), min(down, default=0)) / 2 + 1, s
    # The source with two documents of 30,000 words comes as near as whole copies can.
    reach = {0}
    for x in got:
        if x["source"] == "s":
            reach = {a + c * x["size"] for a in reach for c in range(4)}
    assert abs(taken["s"] - want["s"]) <= min(abs(a - want["s"]) for a in reach) + 1
    assert Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in rows) == Counter((x["doc_id"], x["size"]) for x in got)


def test_mix_edge_cases(spark):
    assert mixing.mix(mixing.sized(docs(spark, []))).count() == 0
    empty = mixing.mix(mixing.sized(docs(spark, [(1, None, None), (2, "", "a")]))).collect()
    assert [(x["target"], x["taken"]) for x in empty] == [(0.0, 0)] * 2
    # Two long documents and short ones: whole copies reach 32,161 of 34,492 words.
    long = [(i, " ".join(["x"] * n), "a") for i, n in enumerate([30_000, 30_001, *[120] * 6])] + [(100 + i, prose(i, 41, 10_000), "b") for i in range(200)] + [(400, "y", "c")]
    got = mixing.mix(mixing.sized(docs(spark, long))).collect()
    target, taken = next(x["target"] for x in got if x["source"] == "a"), sum(x["taken"] for x in got if x["source"] == "a")
    best = min((abs(a * 30_000 + b * 30_001 + c * 120 - target) for a in range(4) for b in range(4) for c in range(19)))
    assert abs(taken - target) <= best + 60
    one = mixing.mix(mixing.sized(docs(spark, [(1, "a b", "z"), (2, "c", "z")]))).collect()
    assert sum(x["taken"] for x in one) == 3


def test_repeat_documents(spark):
    rows = awkward() + [(100 + i, prose(i, 20), "ab"[i % 2]) for i in range(40)]
    table = docs(spark, rows)
    got = mixing.repeat_documents(table)
    want = Counter()
    for x in mixing.mix(mixing.sized(table)).collect():
        want[x["doc_id"], x["source"], x["size"]] += x["copies"]
    assert got.schema == table.schema
    assert Counter((x["doc_id"], x["source"], len(WORD.findall(x["text"] or ""))) for x in got.collect()) == Counter({k: v for k, v in want.items() if v})


def test_texts_move_once(spark):
    """Between the documents and their copies lies one exchange: the window and the join go by the same columns."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        node = mixing.repeat_documents(docs(spark, [(i, prose(i, 20), "ab"[i % 2]) for i in range(20)]))._jdf.queryExecution().executedPlan()
        names = []
        while True:
            node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
            names.append(node.nodeName())
            if not node.children().size():
                break
            node = node.children().apply(0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in names and "Window" in names and names.count("Exchange") == 1
