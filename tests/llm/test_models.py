import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalens.llm import html, lmscore, pii
from catalens.llm import queries as Q
from tests.llm.helpers import awkward, docs, prose


# Personal data ------------------------------------------------------------------------------------------------------
def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@given(st.text(alphabet="a.Z@-_%+0129 4()\n=é", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_plain_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_spans(text)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "a@b.c%d@e.f.g@h.i", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (555) 123-4567.", "++49 30 1234567", "x" * 50_000 + "@", "a" * 50_000, "1" * 50_000, "+" * 20_000, "1.x" * 20_000])
def test_base_spans_of_awkward_texts(text):
    got = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]
    # The plain patterns take quadratic time on the long texts, which hold nothing.
    assert got == (brute_spans(text) if len(text) < 1000 else [])


def test_personal_data(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = awkward() + [(50, f'é token = "{secret}" and me@x.org, 10.0.0.1'), (51, "write to jane.doe [at] example [dot] org now"), (52, "plain words with 12 numbers and a longerthantwentycharactersword")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, rows)).collect() if r["doc_id"]}
    assert [(s["kind"], rows[-3][1][s["start"] : s["stop"]], s["base"]) for s in got[50]] == [("email", "me@x.org", True), ("ip", "10.0.0.1", True), ("secret", secret, False)]
    assert got[52] == [] and got[1] == [] and got[4] == []
    assert pii.personal_data(docs(spark, [])).count() == 0
    text = spark.createDataFrame([(rows[-3][1], [("email", 67, 75)])], "text string, spans array<struct<kind:string,start:int,stop:int>>")
    red = text.select(pii.redacted(text["text"], text["spans"]).alias("x")).first()["x"]
    assert "me@x.org" not in red or "[email]" in red


def planted(r):
    """Texts of prose with one planted span, or with a number that is none: (text, kind or None, start, stop)."""
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    some = lambda n, of: "".join(r.choice(of) for _ in range(n))
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"

    def iban():
        bank = some(18, digits)
        return f"DE{98 - int(bank + '131400') % 97:02d}{bank}"

    kinds = {
        "secret": lambda: r.choice([('token = "', hexes(40), '"'), ("api key: ", "AKIA" + some(16, upper), ""), ("secret='", some(32, upper + "abcdefgh_"), "'"), ("bearer ", "sk_" + some(28, digits + "abcdefxyz"), "")]),
        "password": lambda: r.choice([("password: ", r.choice(["hunter2", "s3cret!", "Winter2024"]) + some(2, digits), ""), ('pwd="', some(6, "abcdef") + some(3, digits), '"'), ("the passcode is ", some(6, digits), "")]),
        "national_id": lambda: (r.choice(["ssn ", "SSN: ", "insurance number "]), f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", ""),
        "phone_local": lambda: r.choice([("call ", f"0{r.randrange(20, 99)} {r.randrange(123456, 987654)}", ""), ("phone: ", f"({r.randrange(200, 989)}) {r.randrange(200, 989)}-{r.randrange(1000, 9999)}", ""), ("tel ", f"{r.randrange(200, 989)}-{r.randrange(200, 989)}-{r.randrange(1000, 9999)}", "")]),
        "account": lambda: (r.choice(["iban ", "account: ", "konto "]), iban(), ""),
        "email_spelt": lambda: ("write to ", f"jo{r.randrange(99)} [at] mail{r.randrange(9)} [dot] org", ""),
    }
    none = [lambda: ("commit ", hexes(40), ""), lambda: ("isbn ", f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", ""), lambda: ("page ", str(r.randrange(99999)), ""), lambda: ("part ", f"0{r.randrange(20, 99)} {r.randrange(123456, 987654)}", ""), lambda: ("", "averyveryverylongwordwithoutanydigits", ""), lambda: ("https://x.org/", hexes(40), "")]
    for kind, make in [*(k for k in kinds.items() for _ in range(60)), *((None, n) for n in none for _ in range(40))]:
        before, value, after = make()
        head = " ".join(r.choice(["la", "over", "the", "den", "mot"]) for _ in range(12)) + " " + before
        yield head + value + after + " and so on", kind, len(head), len(head) + len(value)


def test_further_spans_are_recalled(spark):
    made = list(planted(random.Random(8)))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, [(i, m[0]) for i, m in enumerate(made)])).collect()}
    found, total, wrong = Counter(), Counter(), Counter()
    for i, (text, kind, start, stop) in enumerate(made):
        spans = [(s["start"], s["stop"]) for s in got[i] if not s["base"]]
        total[kind] += 1
        if kind:
            found[kind] += any(a <= start and stop <= b or a < stop and start < b and b - a >= 0.9 * (stop - start) for a, b in spans)
        else:
            wrong[text.split()[-5]] += bool(spans)
    recall = {k: found[k] / total[k] for k in total if k}
    assert set(recall) == set(pii.MORE_KINDS) and min(recall.values()) >= 0.9, recall
    assert sum(wrong.values()) <= 0.1 * total[None], wrong


def test_personal_data_query_equals_brute_force(spark):
    small = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in Q.QUERIES["op4_pii_spans"](spark, small).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
        # Tokens as the corpus has them: every one is found.
        for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r["doc_id"]], re.I):
            assert f"secret:{m.start(1)}:{m.end(1)}" in r["spans"].split(",")


def test_reliabilities_find_the_good_labeler():
    r = random.Random(3)
    counts = Counter()
    for _ in range(4000):
        truth = r.random() < 0.4
        vote = tuple((1 if (truth if r.random() < q else not truth) else -1) for q in (0.95, 0.9, 0.85, 0.6, 0.55))
        counts[vote] += 1
    share, table, posterior = pii.reliabilities(dict(counts))
    assert abs(share - 0.4) < 0.08 and table[0, 1, 2] > 0.88 and abs(table[4, 1, 2] - 0.55) < 0.1
    assert posterior[(1, 1, 1, 1, 1)] > 0.95 > 0.05 > posterior[(-1, -1, -1, -1, -1)]
    weights, accepted = pii.train_classifier({pii.code_of(3, v): n for v, n in counts.items()})
    assert pii.code_of(3, (1, 1, 1, 1, 1)) in accepted and pii.code_of(3, (-1, -1, -1, -1, -1)) not in accepted
    assert pii.votes_of(pii.code_of(2, (1, 0, -1, 0, 1))) == (2, (1, 0, -1, 0, 1)) and len(weights)
    assert pii.train_classifier({})[1] == set()


# Language model -----------------------------------------------------------------------------------------------------
def test_base_scores_equal_brute_force(spark):
    rows = awkward() + [(100 + i, prose(i, 60)) for i in range(120)]
    got = lmscore.score(docs(spark, rows)).collect()
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter(w for own, h in zip(tokens, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, h, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)) for (d, _), h, own in zip(rows, held, tokens, strict=True))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (4, 5)]
    assert len(same) == 3 and max(same) - min(same) < 1e-3
    assert lmscore.score(docs(spark, [])).count() == 0


def test_scores_tell_prose_from_noise(spark):
    r = random.Random(4)
    noise = " ".join("".join(r.choice("bcdfghjkqxz") for _ in range(7)) for _ in range(80))
    rows = [(i, prose(i, 80)) for i in range(300)] + [(900, noise)]
    got = {x["doc_id"]: x for x in lmscore.score(docs(spark, rows)).collect()}
    held = [x for x in got.values() if x["held_out"] and x["doc_id"] != 900]
    per = lambda x: x["score"] / x["n_tokens"]
    assert per(got[900]) < min(map(per, held)) and len(held) > 20


def spelled_unigram(texts, training):
    """Bits of texts under a proper unigram model with a back-off: tokens seen twice in training and an escape, Huffman-free and
    add-one; escaped tokens are spelled by byte frequencies with an end."""
    tokens = [(t or "").encode().lower().split() + [b"\n"] for t in training]
    counts = Counter(w for own in tokens for w in own)
    known = {w: n for w, n in counts.items() if n > 1}
    escape = sum(counts.values()) - sum(known.values()) + 1
    total = sum(known.values()) + escape
    letters = Counter(b for w in counts for b in w)
    size = sum(letters.values()) + 256 + len(counts)
    bits = 0.0
    for t in texts:
        for w in (t or "").encode().lower().split() + [b"\n"]:
            if w in known:
                bits -= math.log2(known[w] / total)
            else:
                bits -= math.log2(escape / total) + sum(math.log2((letters[b] + 1) / size) for b in w) + math.log2(len(counts) / size)
    return bits


def test_held_out_bits_are_below_a_proper_unigram(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {x["doc_id"]: x for x in Q.QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    training = [r["text"] for r in rows if not got[r["doc_id"]]["held_out"]]
    size = sum(len((r["text"] or "").encode()) for r in held)
    model = sum(-got[r["doc_id"]]["score"] for r in held) * math.log2(10) / size
    base = spelled_unigram([r["text"] for r in held], training) / size
    print(f"bits a byte, held out: {model:.3f}, unigram with back-off {base:.3f}")
    assert len(held) > 100 and model < base
    # Short texts too, document for document mostly.
    short = [r for r in held if got[r["doc_id"]]["n_tokens"] < 200]
    wins = sum(-got[r["doc_id"]]["score"] * math.log2(10) < spelled_unigram([r["text"]], training) for r in short[:40])
    assert wins >= 0.8 * len(short[:40])


def scalar_mix(x, bits, gate, weights):
    """One document's nats, one decision at a time: weights of each gate, refined after each block."""
    own = [[float(v) for v in row] for row in weights]
    nats, start, block = 0.0, 0, lmscore.BLOCKS[0]
    while start < len(bits):
        end = min(start + block, len(bits))
        slopes, seen = Counter(), Counter()
        for i in range(start, end):
            odds = max(-18.0, min(18.0, sum(w * float(v) for w, v in zip(own[gate[i]], x[:, i]))))
            p = 1 / (1 + math.exp(-odds))
            nats -= math.log(p if bits[i] else 1 - p)
            seen[gate[i]] += 1
            for k in range(len(x)):
                slopes[gate[i], k] += (float(bits[i]) - p) * float(x[k, i])
        for (g, k), slope in slopes.items():
            own[g][k] += lmscore.RATE / (1 + seen[g] / lmscore.CALM) * slope / lmscore.SCALE[k > 0]
        start, block = start + block, max(min(2 * block, lmscore.BLOCKS[1]), (start + block) // lmscore.BLOCKS[2])
    return nats


def test_mixer_equals_a_scalar_one():
    r = np.random.default_rng(3)
    lengths = np.array([3000, 40, 0, 700, 9000])
    n = int(lengths.sum())
    x, gate = r.integers(-60, 60, (3, n)).astype(np.float32), r.integers(0, 8, n).astype(np.uint8)
    x[0] /= 16
    bits = (r.random(n) < 1 / (1 + np.exp(-x[1] / 16))).astype(np.float32)
    weights = np.tile(np.array(lmscore.FIRST_WEIGHTS[0], np.float32), (8, 1))
    got = lmscore.mix(x, bits, gate, lengths, weights)
    cuts = np.cumsum(lengths) - lengths
    want = [scalar_mix(x[:, a : a + m], bits[a : a + m], gate[a : a + m], weights) for a, m in zip(cuts, lengths, strict=True)]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_a_text_is_coded_by_its_decisions(spark):
    """The score of a query row is the scalar mixer's over the model's decisions, tokens and spelled words."""
    rows = [(i, prose(i, 40)) for i in range(60)] + [(100, "unheard-of wordings " + prose(3, 30))]
    table = docs(spark, rows).select("doc_id", "text")
    _, model, _, _ = lmscore.learn(table, 2)
    got = {x["doc_id"]: x["score"] for x in lmscore.score(docs(spark, rows)).collect()}
    import pyarrow as pa

    for d, text in rows[-4:]:
        tokens = lmscore.Tokens(pa.array([text]))
        hashes, codes = tokens.hashes[tokens.index], model.symbols(tokens.hashes)[tokens.index]
        _, bits, x, gate = model.token_inputs(hashes, tokens.firsts, codes)
        nats = scalar_mix(x, bits, gate, model.weights[0])
        spelled = [tokens.words[i] for i, c in zip(tokens.index, codes) if c == model.escape]
        if spelled:
            _, bits, x, gate, _ = model.byte_inputs(spelled)
            nats += scalar_mix(x, bits, gate, model.weights[1])
        assert math.isclose(got[d], -nats / math.log(10), rel_tol=1e-4)


def test_counts_beyond_32_bits_are_told():
    counts = np.array([0, 1, 2**33 + 5, 2**62], np.int64)
    assert (lmscore._heard(lmscore._told(counts)) == counts).all()


def test_blocks_and_tables_follow_the_input():
    for size in (10**9, 10**12, 10**14):
        homes, spans = lmscore.layout(size, 1000)
        assert homes <= 2000 or homes * spans * lmscore.TOKENS_A_BLOCK <= size / 6
    small, large = lmscore.table_bits(10**6), lmscore.table_bits(10**9)
    assert small == (*lmscore.TOKEN_BITS, *lmscore.BYTE_BITS) and all(b - a == lmscore.GROWTH for a, b in zip(small, large))


def test_no_training_rows(spark):
    ids = [i for i in range(200) if lmscore.held_out(i)][:5]
    got = lmscore.score(docs(spark, [(i, prose(i, 10)) for i in ids])).collect()
    assert all(x["train_tokens"] == 0 and x["n_known"] == 0 and math.isfinite(x["score"]) for x in got)


def test_huffman_paths_are_a_code():
    counts = [50, 1, 7, 7, 20, 3]
    start, length, nodes, bits = lmscore.huffman(counts)
    codes = ["".join(map(str, bits[s : s + n])) for s, n in zip(start, length, strict=True)]
    assert math.isclose(sum(2.0 ** -len(c) for c in codes), 1.0) and not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert nodes.max() == len(counts) - 2 and len(codes[0]) == 1
    assert lmscore.huffman([3])[1].tolist() == [0]


def test_chunks_do_not_change_counts():
    import pyarrow as pa

    texts = pa.array([prose(i, 50) for i in range(40)], pa.string())
    whole = lmscore.Tokens(texts)
    order = np.argsort(-whole.counts())[:100]
    model = lmscore.Model(whole.hashes[order], whole.counts()[order], 500, np.ones(257, int))

    def tables(step):
        counter = lmscore.Counter(model)
        for i in range(0, 40, step):
            t = lmscore.Tokens(texts.slice(i, step))
            symbols, spelled = lmscore._spelled(model, t)
            counter.add_tokens(t.hashes[t.index], t.firsts, symbols[t.index])
            counter.add_spelled([t.words[j] for j in spelled], t.counts()[spelled])
        return counter.done()

    assert all((a == b).all() for a, b in zip(tables(40), tables(7), strict=True))


def test_probabilities_of_one_step_sum_to_one():
    """Over all symbols of a tree the coded probabilities are a distribution, whatever the mixer says."""
    model = lmscore.Model(np.arange(1, 9, dtype=np.uint64) * np.uint64(7919), np.arange(8, 0, -1), 5, np.ones(257, int))
    r = np.random.default_rng(1)
    model.states = [r.integers(-60, 60, 1 << b).astype(np.int8) for b in (*lmscore.TOKEN_BITS, *lmscore.BYTE_BITS)]
    total = 0.0
    for symbol in range(9):
        n, bits, x, gate = model.token_inputs(np.array([5], np.uint64), np.array([0]), np.array([symbol]))
        total += math.exp(-lmscore.mix(x, bits, gate, n, model.weights[0])[0])
    assert math.isclose(total, 1.0, rel_tol=1e-4)


# Pages --------------------------------------------------------------------------------------------------------------
TREE = html.train_tree(*html.labelled_blocks())
PAGES = [
    ("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two <b>th</b>ree.<p>Four</article><footer>&copy; x</footer>", "A & B One two three. Four"),
    ("<article><p>Cut off he", "Cut off he"),
    ("<article><p>Half &am", "Half &am"),
    ("<article><p>Half</p><p class=", "Half"),
    ("<script>var a='<article><p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><main><p>1 < 2 &lt; 3</p></main>", "1 < 2 < 3"),
    ("<article><p>Text</p><div class='comments'><p>Reader</p></div><p>More</p><aside>Side</aside></article><div id=cookie-notice>Cookies</div>", "Text More"),
    ("<article><p title='a > b'>Kept</p><form><p>Name</p></form></article>", "Kept"),
    ("", ""),
    ("no markup", "no markup"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html.main_text(page, TREE) == text


def test_the_tree_learns_its_table():
    rows, labels = html.labelled_blocks()
    right = sum(html.decide(TREE, r) == y for r, y in zip(rows, labels, strict=True))
    assert right >= 0.98 * len(rows) and 0 < sum(labels) < len(labels)
    # Pages that it has not seen.
    rows, labels = html.labelled_blocks(html.labelled_pages(99, 100))
    assert sum(html.decide(TREE, r) == y for r, y in zip(rows, labels, strict=True)) >= 0.97 * len(rows)
    long = "words " * 40
    assert html.main_text(f"<div><a href=x>Menu</a></div><p>{long}</p>", TREE) == long.strip()


def test_the_tree_reads_link_density_and_neighbours():
    def used(tree):
        return set() if isinstance(tree, int) else {html.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    print(TREE)
    assert {"links", "words"} <= used(TREE) and used(TREE) & {"links_before", "words_before"} and used(TREE) & {"links_after", "words_after"}
    # Marks alone do not decide: without them most blocks are still told right.
    rows, labels = html.labelled_blocks(html.labelled_pages(99, 100))
    blind = [(0, *r[1:]) for r in rows]
    assert sum(html.decide(TREE, r) == y for r, y in zip(blind, labels, strict=True)) >= 0.75 * len(rows)
    # A list of links within an article is a menu; a linked paragraph between others is not.
    text = "Plain words of an article without links"
    assert html.main_text(f"<article><p>{text}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></article>", TREE) == text
    assert html.main_text(f"<article><p>{text}<p><a href=1>Whole link</a><p>{text}</article>", TREE) == f"{text} Whole link {text}"


STORY = " ".join(["Story"] * 17)


@pytest.mark.parametrize("page", [
    f"<article><p class=ad>Buy now<p>{STORY}", f"<div class='header-image post'><p>{STORY}</div>", f"<ul class=menu><li>Home<li>News</ul><p>{STORY}",
    *(f"<article><p>{STORY}</article><div class='{c}'><p>Words that a reader or a shop wrote there</div>" for c in ("responses", "reader-feedback", "sharing-tools", "promoted", "privacy-bar", "commentList", "ad-slot big")),
    f"<table><tr><td class=sidebar>Side words here<td><p>{STORY}</table>", f"<dl><dt class=ad>Term of an advert<dd>{STORY}</dl>",
])
def test_marks_end_where_elements_do(page):
    assert html.main_text(page, TREE) == STORY


def test_short_sentences_without_marks_stay():
    assert html.main_text(f"<div>A short sentence.</div><p>{STORY}</p>", TREE) == f"A short sentence. {STORY}"


@pytest.mark.parametrize("piece", ["<p>x</div></b>", "<div class=a><p>some text", "<p><table><x>", "</x></y><li>z", "<select><svg>", "a &amp; b <i>"])
def test_long_pages_take_linear_time(piece):
    began = time.process_time()
    html.main_text(piece * (1_000_000 // len(piece)), TREE)
    assert time.process_time() - began < 4


class Walker(HTMLParser):
    """The text of article elements, block by block, but for what is never text."""

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.parts = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += tag in ("script", "style")
        if tag in ("p", "h1", "br", "div"):
            self.parts.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skipped -= tag in ("script", "style")
        if tag in ("p", "h1", "div"):
            self.parts.append("")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts[-1] += data


def test_pages_equal_a_walk_over_their_articles(spark):
    small = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in Q.QUERIES["op8_html_extraction"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        walk = Walker()
        walk.feed(r["html"] or "")
        walk.close()
        assert got[r["page_id"]] == " ".join(" ".join(x.split()) for x in walk.parts if x.split()), r["page_id"]


@given(st.text(alphabet="<>/apdiv class='\"ad&;!-=é", max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_markup_is_read(page):
    assert isinstance(html.main_text(page, TREE), str)


def test_extraction(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, None), (0, "u0", PAGES[0][0])]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == Counter([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, "", 0), (0, PAGES[0][1], len(PAGES[0][1]))])
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_registered_queries_run_whole(spark):
    small = "/root/testdata/sf0.001"
    rows = {t: spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op3_simhash_dedup", "op4_pii_spans", "op5_lm_scoring", "op6_exact_dedup", "op7_quality_rules", "op9_substring_dedup", "op10_source_mixing"):
        assert Q.QUERIES[name](spark, small).count() == rows["documents"], name
    assert Q.QUERIES["op8_html_extraction"](spark, small).count() == rows["pages"]
    base = Q.QUERIES["op4_pii_spans"](spark, small).where("n_email + n_ip + n_card + n_phone = 0").first()
    assert base["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_huffman_takes_arrays_alone():
    """The tree of 2^16 tokens as a heap builds it, without an object for each node and step of a path."""
    import heapq
    import tracemalloc

    r = random.Random(3)
    counts = [int(1e6 / (1 + i)) + r.randrange(3) for i in range(1 << 16)]
    tracemalloc.start()
    start, length, nodes, bits = lmscore.huffman(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Paths take 9 bytes a step; what builds them may take as much again.
    assert peak < 2 * 9 * len(nodes) + (1 << 23)
    heap, parent, top = [(max(1, c), i) for i, c in enumerate(counts)], {}, len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        for k in (0, 1):
            w, i = heapq.heappop(heap)
            parent[i], w0 = (top, k), w + (w0 if k else 0)
        heapq.heappush(heap, (w0, top))
        top += 1
    for s in r.sample(range(len(counts)), 200):
        want, at = [], s
        while at in parent:
            want.append((parent[at][0] - len(counts), parent[at][1]))
            at = parent[at][0]
        a, b = start[s], start[s] + length[s]
        assert list(zip(nodes[a:b].tolist(), bits[a:b].tolist(), strict=True)) == want[::-1]
