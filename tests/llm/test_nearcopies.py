"""Near copies against brute force over all pairs."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from catalens.llm import nearcopies
from tests.llm.helpers import awkward, docs, prose
from tests.llm.test_dedup import union_find

SMALL = "/root/testdata/sf0.001/documents.parquet"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets = [brute_set(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return union_find(range(len(rows)), near)


def test_groups_equal_brute_force(spark):
    r = random.Random(5)
    rows = [x for x in awkward() if x[0] is not None]
    for i in range(40):
        words = prose(i, 60).split()
        for k in range(r.randrange(1, 6)):
            changed = list(words)
            for _ in range(k):
                changed[r.randrange(60)] = f"changed{i}x{r.random()}"
            rows.append((1000 + 10 * i + k, " ".join(changed), "a"))
    rows = [(1 + i, *x[1:]) for i, x in enumerate(rows)]
    roots = brute_groups(rows)
    lowest = {}
    for i, x in enumerate(rows):
        lowest[roots[i]] = min(lowest.get(roots[i], x[0]), x[0])
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(docs(spark, rows)).collect()}
    assert got == {x[0]: lowest[roots[i]] for i, x in enumerate(rows)}
    assert 40 < len(set(got.values())) < len(got)


def test_a_large_group_and_nothing(spark):
    base = prose(1, 100).split()
    rows = [(i, " ".join([*base[:i % 100], f"w{i}", *base[i % 100 + 1 :]]), "a") for i in range(300)]
    assert {x["component_id"] for x in nearcopies.near_copies(docs(spark, rows)).collect()} == {0}
    assert not nearcopies.near_copies(docs(spark, rows).where("false")).collect()


def test_the_stage_drops_copies_beyond_three_bits(spark):
    # 177 is within 0.83 of 1, 145 within 0.83 of 6; their fingerprints differ in 11 and 7 bits.
    ids = {1, 177, 6, 145, 118, 176}
    rows = [x for x in pq.read_table(SMALL).to_pylist() if x["doc_id"] in ids]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows), "").collect()
    assert sorted(x["doc_id"] for x in out) == [1, 6, 118, 176]


def test_one_row_of_each_group_stays(spark):
    # Unrelated texts with one identifier, or none, are different documents; copies in both are not.
    rows = [(1, prose(21)), (1, prose(22)), (None, prose(23)), (None, prose(24)), (2, prose(25)), (2, prose(25)), (None, prose(23) + " end"), (3, prose(22) + " end")]
    table = docs(spark, rows)
    kept = nearcopies.drop_near_copies(table)
    assert kept.schema == table.schema
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"] != prose(23) + " end") == sorted([(1, prose(21)), (1, prose(22)), (0, prose(24)), (2, prose(25)), *[(0, prose(23)) for r in kept.collect() if r["text"] == prose(23)]])
    assert kept.count() == 5
    empty = docs(spark, [])
    assert nearcopies.drop_near_copies(empty).count() == 0 and nearcopies.drop_near_copies(empty).columns == table.columns


def test_awkward_rows(spark):
    rows = awkward()
    got = nearcopies.drop_near_copies(docs(spark, rows)).collect()
    # Texts without words are equal; 4, 4, 5 and 6 are one text but for case; 8 is a near copy of 7, and the null identifier of 10.
    assert sorted(r["doc_id"] for r in got) == [1, 4, 7, 9, 10, 11, 12]


def test_a_bucket_without_links_is_read_whole(spark):
    """Members of one bucket that are no near copies but for two of them: no pair that met is lost."""
    sets = {i: set(range(100 * i, 100 * i + 40)) for i in range(9)} | {9: set(range(800, 839)) | {5}, 10: set(range(1100, 1140))}
    live = spark.createDataFrame([(7, f, 40, f) for f in sets], "key bigint, fp bigint, n bigint, root bigint")
    most, seen = 1, set()
    while True:
        if live.count() < 2:
            break
        centres = nearcopies._centres(live, live.count(), most, most == 1).collect()
        assert len(centres) <= most
        done = {c["b"] for c in centres}
        members = [r["fp"] for r in live.collect()]
        seen |= {frozenset((a, b)) for a in done for b in members if a != b}
        live, most = spark.createDataFrame([(7, f, 40, f) for f in members if f not in done], live.schema), 4 * most
    assert len(seen) == 11 * 10 // 2


def test_near_dedup_links_by_simhash(spark, monkeypatch):
    """The stage goes through the SimHash operator: its stars name pairs, whole sets decide."""
    text = prose(8, 400)
    rows = [(1, text, "a"), (2, f"{text} end", "a"), (3, prose(9, 400), "a")]
    prints = [nearcopies.simhash.fingerprint(x[1].encode(), 5) for x in rows]
    assert bin(prints[0] ^ prints[1]).count("1") <= 3 < bin(prints[0] ^ prints[2]).count("1")
    asked, links = [], nearcopies.simhash.links
    monkeypatch.setattr(nearcopies.simhash, "links", lambda p: asked.append({r["fp"] % (1 << 64) for r in p.collect()}) or links(p))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()) == [1, 3]
    assert asked and set(prints[:2]) <= asked[0]


def test_variants_beyond_the_threshold_take_no_pair_of_each_two(spark, monkeypatch):
    """Texts changed in 0 to 9 places: those with few changes are one group, the others meet everything in bands and link with little."""
    r, base, rows = random.Random(4), prose(6, 140, 10_000).split(), []
    for i in range(160):
        words = list(base)
        for at in r.sample(range(140), i % 10):
            words[at] = f"changed{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "a"))
    counted, verified = [], nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *a: counted.append(pairs.count()) or verified(pairs, *a))
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(docs(spark, rows)).collect()}
    roots = brute_groups(rows)
    assert got == {i: min(j for j in range(160) if roots[j] == roots[i]) for i in range(160)}
    assert 60 < len(set(got.values())) < 130
    # Of the 12,720 pairs most meet; a few for each text are looked at.
    assert sum(counted) < 4 * len(rows)


def test_rarest_shingles_lose_no_similar_pair(spark):
    """Sets of many sizes around shared blocks: each two similar ones meet in a bucket that neither has to leave."""
    r = random.Random(9)
    blocks = [[r.randrange(10**9) for _ in range(30)] for _ in range(4)]
    sets = {}
    for i in range(120):
        whole = [x for b in r.sample(blocks, r.randrange(1, 4)) for x in b if r.random() < 0.93]
        sets[i] = sorted({*whole, *(r.randrange(10**9) for _ in range(r.randrange(4)))})
    similar = {(i, j) for i in sets for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    table = spark.createDataFrame([*sets.items()], "fp bigint, s array<bigint>")
    live = nearcopies._rarest(table, 0.8).withColumn("root", nearcopies.F.col("fp"))
    left = nearcopies._open(live, live.count(), 0.8)
    members = {}
    for x in left.collect():
        members.setdefault(x["key"], {})[x["fp"]] = (x["n"], x["c"])
    meet = {(i, j) for m in members.values() for i in m for j in m if j < i and (o := min(m[i][1], m[j][1])) >= 0.8 * (m[i][0] + m[j][0] - o)}
    assert len(similar) > 100 and similar <= meet
