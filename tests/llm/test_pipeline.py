"""The pipeline stage by stage, against rules written out in Python, on the smallest tables."""

import os
import sys
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


@pytest.fixture(scope="module")
def kept(spark):
    pytest.importorskip("public_tokenizers")
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
    import corpus_pipeline
    from matchgrain.llm.tables import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SF), name))
        if name != "tokens":
            assert steps[-1].columns == docs.columns
    return [[r.asDict() for r in s.collect()] for s in steps]


def words(text):
    return (text or "").encode().split()


def test_quality_rejects_by_the_base_rule_and_few_others(kept):
    left = {r["doc_id"] for r in kept[1]}
    failed = set()
    for r in kept[0]:
        ws = words(r["text"])
        runs = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        gone = set()
        for i in range(len(ws) - 7):
            if runs[tuple(ws[i : i + 8])] > 1:
                gone |= set(range(i, i + 8))
        if len(ws) < 20 or 100 * len(gone) > 30 * len(ws):
            failed.add(r["doc_id"])
    assert failed and not failed & left
    assert len(left) >= 0.9 * (len(kept[0]) - len(failed))


def test_lines_keep_one_copy_of_everything(kept):
    before, after = kept[1], kept[2]
    said = {line for r in before for line in (r["text"] or "").split("\n")}
    still = {line for r in after for line in (r["text"] or "").split("\n")}
    assert still <= said
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
    assert len(after) >= 0.9 * len(before)


def test_near_dedup_keeps_the_smallest_of_each_group(kept):
    sets = {}
    for r in kept[2]:
        ws = [w.lower() for w in words(r["text"])]
        sets[r["doc_id"]] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
        if not moved:
            break
    assert {r["doc_id"] for r in kept[3]} == {i for i in label if label[i] == i}


def test_decontamination_drops_holders_of_items_only(kept, spark):
    items = [b" ".join(w.lower() for w in words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holders = {r["doc_id"] for r in kept[3] if any(i and i in b" ".join(w.lower() for w in words(r["text"])) for i in items)}
    left = {r["doc_id"] for r in kept[4]}
    assert not holders & left
    shingles = {tuple(i.split()[k : k + 5]) for i in items for k in range(len(i.split()) - 4)}
    for r in kept[3]:
        ws = [w.lower() for w in words(r["text"])]
        if not any(tuple(ws[k : k + 5]) in shingles for k in range(len(ws) - 4)):
            assert r["doc_id"] in left


def test_tokens_equal_the_library(kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in kept[4]}
    assert len(kept[5]) == len(kept[4])
    for r in kept[5]:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
