"""The pipeline against brute force, stage by stage on what the stage before kept."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from catalens.llm import mixing
from catalens.llm.runtime import materialise
from tests.llm.helpers import WORD, awkward, docs, prose
from tests.llm.test_nearcopies import brute_groups
from tests.llm.test_shape import brute_quality

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, rows = [n for n, _ in corpus_pipeline.STAGES], [r.asDict() for r in docs.collect()]
    assert names == ["quality rules", "exact dedup", "near dedup", "source mixing", "sequence packing"]
    states = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SMALL), "test")
        if name != "sequence packing":
            assert out.columns == docs.columns
        states.append([r.asDict() for r in out.collect()])
        docs = out

    def good(text):
        n, chars, symbols, _, repeated = brute_quality(text)
        return not (n < 50 or 100 * repeated > 50 * n or 4 * symbols > n or chars < 2 * n or chars > 25 * n)

    kept = [r for r in rows if good(r["text"])]
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in states[0])

    first = {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    assert sorted(r["doc_id"] for r in first.values()) == sorted(r["doc_id"] for r in states[1])

    ids = [r["doc_id"] for r in states[1]]
    lowest = {}
    for i, root in brute_groups([(r["doc_id"], r["text"]) for r in states[1]]).items():
        lowest[root] = min(lowest.get(root, ids[i]), ids[i])
    assert sorted(lowest.values()) == sorted(r["doc_id"] for r in states[2])

    sizes, taken = Counter(), Counter()
    for r in states[2]:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in states[3]:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    copies = Counter(r["doc_id"] for r in states[3])
    assert max(copies.values()) <= mixing.MOST and set(copies) <= {r["doc_id"] for r in states[2]}
    plan = mixing.mix(mixing.sized(materialise(spark.createDataFrame(states[2], spark.read.parquet(f"{SMALL}/documents.parquet").schema), "kept"))).collect()
    assert copies == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    for r in plan:
        # As near as the documents that could still move the way their source was settled: half of the smallest of them.
        own = [x for x in plan if x["source"] == r["source"] and x["size"]]
        up, down = [x["size"] for x in own if x["copies"] < mixing.MOST], [x["size"] for x in own if x["copies"]]
        assert not up or abs(taken[r["source"]] - r["target"]) <= max(min(up), min(down, default=0)) / 2 + 1

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in states[3]:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            want[r["doc_id"], at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in states[4]) == want
    bound = -(-sum(r["length"] for r in states[4]) // 4096)
    assert len({r["sequence_id"] for r in states[4]}) <= bound + 2


def run_stages(spark, table):
    for _, stage in corpus_pipeline.STAGES:
        table = materialise(stage(spark, table, ""), "test")
    return table


def test_awkward_rows_go_through(spark):
    rows = awkward() + [(None, prose(31)), (None, prose(32)), (20, prose(33)), (20, prose(34)), (21, prose(33) + " end"), (22, prose(33))]
    table = docs(spark, rows)
    table = table.withColumns({c: table["size"] for c in ("fp", "component_id", "sequence_id", "rate", "bucket", "__nth")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, table, ""), "test")
        assert out.schema == table.schema, name
        table = out
        if name == "near dedup":
            # Unrelated texts all stay, whatever their identifiers; of copies the smallest identifier.
            assert Counter(r["doc_id"] for r in out.collect()) == Counter([4, 7, 10, None, None, 20, 20])
    pieces = corpus_pipeline.STAGES[-1][1](spark, table, "").collect()
    assert Counter(r["doc_id"] for r in pieces if not r["piece"]) == Counter(r["doc_id"] for r in table.collect())


def test_empty_table_goes_through(spark):
    assert run_stages(spark, docs(spark, [])).count() == 0
