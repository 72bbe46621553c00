import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from catalens.llm import components, exact, runtime, simhash, substrings
from tests.llm.helpers import WORD, awkward, docs, prose


def brute_exact(rows):
    groups = defaultdict(list)
    for i, (d, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i, d))
    out = []
    for text, members in groups.items():
        first = min(members)
        out += [(d, first[3], len(members), i == first[2], hashlib.sha256(text.encode()).hexdigest()) for _, _, i, d in members]
    return out


def summary(rows):
    """Repeated rows are interchangeable: which of them is kept is left open."""
    return Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_exact_groups_equal_brute_force(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # A third of the rows are one text: its group must be cut between partitions and joined again.
        rows = awkward() + [(100 + i, "the  same\ntext") for i in range(60)] + [(200 + i, prose(i)) for i in range(60)] + [(300 + i, prose(i).replace(" ", "\n")) for i in range(20)]
        random.Random(3).shuffle(rows)
        got = exact.exact_groups(docs(spark, rows)).collect()
        assert summary([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got]) == summary(brute_exact(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_splitters_weigh_bytes(spark):
    # Half of all bytes lie in the few long texts, which sort last.
    rows = [(i, f"a{i:04d}" + "x" * 200) for i in range(600)] + [(1000 + i, f"b{i:02d}" + "y" * 9000) for i in range(20)]
    found = exact._splitters(docs(spark, rows), "doc_id", "text", 8)
    edges = [("", 0, False, 0), *found, ("~", 0, False, 0)]
    share = [sum(len(t) for _, t in rows if a[0] <= t[:24] < b[0]) / sum(len(t) for _, t in rows) for a, b in zip(edges, edges[1:])]
    assert len(found) == 7 and max(share) < 2 / 8
    plan = exact.exact_groups(docs(spark, rows))
    assert plan.count() == len(rows)


def test_exact_on_nothing_and_all_null(spark):
    assert exact.exact_groups(docs(spark, [])).count() == 0
    got = exact.exact_groups(docs(spark, [(None, None), (None, "")])).collect()
    assert [r["group_size"] for r in got] == [2, 2] and sum(r["kept"] for r in got) == 1 and got[0]["keep_id"] is None


def test_drop_copies_keeps_columns(spark):
    rows = awkward()
    table = docs(spark, rows)
    kept = exact.drop_copies(table)
    assert kept.schema == table.schema
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})
    assert exact.drop_copies(docs(spark, [])).columns == table.columns


def brute_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark):
    r = random.Random(5)
    rows = awkward()
    # A chain of near copies, each one word from the last, and many copies of one text.
    words = prose(9, 300).split()
    for i in range(60):
        words[r.randrange(300)] = f"n{i}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, prose(4, 90)) for i in range(40)] + [(3000 + i, prose(50 + i)) for i in range(30)]
    r.shuffle(rows)
    got = simhash.near_duplicates(docs(spark, rows)).select("doc_id", simhash.hex_of("fp").alias("h"), "component_id").collect()
    prints = [brute_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = union_find(range(len(rows)), links)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[roots[i]] = min(lowest.get(roots[i], d), d)
    want = Counter((d, f"{prints[i]:016x}", lowest.get(roots[i])) for i, (d, _) in enumerate(rows))
    assert Counter((x["doc_id"], x["h"], x["component_id"]) for x in got) == want
    assert any(abs(i - j) > 0 and 0 < (prints[i] ^ prints[j]).bit_count() <= 3 for i, j in links)


def test_links_of_a_dense_cluster(spark):
    """Fingerprints all around one point, at every distance up to four of each other, near the ends of both halves too."""
    r = random.Random(7)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(150):
        x = base
        for _ in range(r.randrange(1, 5)):
            x ^= 1 << r.choice([0, 1, 30, 31, 32, 33, 62, 63, r.randrange(64)])
        prints.add(x)
    prints |= {r.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {row["node"]: row["root"] for row in components.connected_components(simhash.links(frame)).collect()}
    links = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = union_find(signed, links)
    assert {x: got.get(x, x) for x in signed} == want


def test_simhash_on_nothing(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(runtime, "FEW_ROWS", 0)
    r = random.Random(seed)
    edges = [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(30)]
    got = {row["node"]: row["root"] for row in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = union_find({n for e in edges for n in e}, edges)
    assert all(got.get(n, n) == root for n, root in want.items())


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(runtime, "FEW_ROWS", 0)
    rows = spark.createDataFrame([(i, i if i > 60 else 7) for i in range(100)], "i int, k int")
    labels = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = runtime.join_labels(rows, labels, ["k"], 100).collect()
    assert sorted((r["i"], r["n"]) for r in got) == [(i, 1 if i > 60 else 61) for i in range(100)]


def brute_cut(rows, size=13):
    first = {}
    texts = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    order = lambda d: (d is None, d or 0)
    for d, w in texts:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, order(d)), order(d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < order(d):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("wide", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 4000)
    monkeypatch.setattr(substrings, "WINDOWS_A_BLOCK", 1)
    if wide:
        # Hashes of more than eight bytes, as larger inputs have.
        monkeypatch.setattr(substrings, "COLLISIONS", 1e-12)
        assert substrings.layout(200_000, 4)[1] > 8
    passage = prose(77, 40)
    # Many rows of one identifier and of none lie across cuts, with windows of their own and of others.
    rows = awkward() + [(640, prose(i, 60) + " " + passage + " " + prose(3, 200)) for i in range(30)] + [(None, prose(i, 80) + " " + passage) for i in range(30)] + [(500 + i, prose(i, 30) + " " + passage + " " + prose(i + 900, 20) + " " + passage) for i in range(25)] + [(700 + i, ("x " * 40) + prose(i, 15)) for i in range(8)]
    random.Random(1).shuffle(rows)
    got = substrings.remove_repeats(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_cut(rows)
    for r in got:
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] + 1 for a, b in zip(r["removed"], r["removed"][1:]))


def test_blocks_stay_fewer_than_windows():
    """Blocks of all groups together, at sizes from a gigabyte to a hundred terabytes."""
    for size in (10**9, 10**12, 10**14):
        groups, width = substrings.layout(size, 1000)
        windows = size // substrings.WORD_BYTES
        assert groups <= 1000 or groups * groups * substrings.WINDOWS_A_BLOCK <= windows * 1.01
        assert windows**2 / 2 / 2 ** (8 * width) <= substrings.COLLISIONS
    assert substrings.layout(10**14, 1000)[0] > 100_000


def test_wide_hashes_tell_windows_apart():
    words = prose(5, 3000).encode().split()
    narrow, wide = (substrings.window_hashes(words, substrings._Tokens(), w) for w in (8, 12))
    assert narrow.shape[0] == 1 and (narrow[0] == wide[0]).all() and len(np.unique(wide[1])) == len(np.unique(wide[0])) and wide[1].max() < 1 << 32
    # Where the first bytes collide, the others decide.
    clash = np.stack([wide[0] & np.uint64(7), wide[1]])
    order, fresh = substrings._ranked(clash)
    assert fresh.sum() == len({tuple(words[i : i + 13]) for i in range(len(words) - 12)})


def test_repeats_on_nothing(spark):
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_planes_round_trip():
    values = np.array([0, 1, 255, 256, 70_000, 2**31], np.int64)
    assert (substrings._from_planes(substrings._planes(values, 5), 5) == values).all()
    assert (substrings._from_planes(substrings._planes(values, 4), 4) == values).all()
    assert (substrings._places(substrings._gaps(np.array([0, 3, 1000]))) == [0, 3, 1000]).all()


def test_kept_rows_survive_in_order(spark):
    table = docs(spark, [(i, f"text {i % 3}") for i in range(9)])
    assert sorted(r["doc_id"] for r in exact.exact_groups(table).where(F.col("kept")).collect()) == [0, 1, 2]
