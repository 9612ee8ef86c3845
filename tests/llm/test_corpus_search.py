"""Phrases, packing and ranked search against brute force, on a small table with nulls, repeats and odd texts."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from matchgrain.llm import collocations, packing, ranking
from matchgrain.llm.chunkids import ChunkIds, byte_chunks, word_chunks
from matchgrain.llm.rawtext import HashFilter, hash_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, k string, block string, h string, rank string, length string"


def library(path, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["red", "Sea", "new", "york", "city", "é", "ça", "12", "a-b", "x_y", "İz", "日本", "don't"]
    texts = []
    for _ in range(120):
        ws = []
        while len(ws) < rng.randint(1, 60):
            ws += rng.choice([["new", "York", "city"], ["red", "sea"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
        texts.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for w in ws))
    texts += texts[:5] + ["", None, " .,\n", "red red red red red", "red sea " * 5000, "q" * 30_000, "<|endoftext|> It's  DON'T\x85 　x", "  a\x1cb"]
    table = [(i, t, rng.choice(["en", "en", "fr", None]), "x", "y", "z", "r", "l") for i, t in enumerate(texts)]
    table += [(None, texts[3], "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), table[2], table[2]]
    rng.shuffle(table)
    return table


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_chunks_are_encoded_as_whole_texts_are():
    rng = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "　", " ", " ", "'s", "'LL", "1", "23", ".", "!?", "<|endoftext|>", "<|", "日本", "́", "Σ", "İ", "\x0b", "\r\n", "​", "\x00", "ſ", "Ŀ", "ǆ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, ""]
    for path, cut in ((BYTES, byte_chunks), (WORDS, word_chunks)):
        encoder = ChunkIds(path, cut)
        for array in (pa.array(texts), pa.array(["x", *texts])[1:]):
            ids, offsets = encoder.encoded(array)
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == library(path, texts)
        ids, offsets = encoder.encoded_with_end(pa.array(texts[-3:]), 7)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [[*x, 7] for x in library(path, texts[-3:])]


def test_filter_finds_all(spark):
    values = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    found = hash_filter(spark.createDataFrame([(int(v),) for v in values[:2500]], "h long"), "h", 2500)
    assert found.has(values[:2500].view(np.uint64)).all() and found.has(values[2500:].view(np.uint64)).mean() < 0.05
    assert not HashFilter(1 << 15).has(values.view(np.uint64)).any()


def brute_phrases(table, least):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in table:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l2, q), b in candidates.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, ps in out.items() for k, (s, a, p, l, r) in enumerate(sorted(ps))]


@pytest.mark.parametrize("sampling", [{}, {"sample_bits": 8}, {"sample_bits": 1, "lowered": 2.0}, {"sample_bits": 0, "lowered": 0.1}])
def test_collocations(docs, rows, nothing, sampling):
    got = [tuple(r) for r in collocations.collocations(docs, **sampling).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 30)) and len(got) > 10
    if not sampling:
        assert collocations.collocations(nothing).count() == 0
        assert [tuple(r) for r in collocations.collocations(docs, top=2).collect() if r.rank > 2] == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["aé", "b ", "c.", "d\n", " "]) for _ in range(n)) for n in (0, 3, 400, 900)] + [None, "x" * 500 + ". y"]
    langs = pa.array([None, "a", "b", "a", "b", "c"])

    def counted():
        found = Counter()
        runs = collocations.Runs(*collocations._cut_long(pa.array(texts), langs))
        for k in range(1, 5):
            at = np.flatnonzero(runs.whole(k))
            found.update(zip(runs.langs.take(pa.array(runs.lang[at])).to_pylist(), runs.texts(at, k).to_pylist()))
        return found

    whole = counted()
    monkeypatch.setattr(collocations, "BATCH_BYTES", 64)
    assert counted() == whole


def test_search(spark, docs, rows, nothing):
    items = [(1, "New York, city!"), (2, "red"), (3, ""), (4, None), (5, "nowhere"), (6, "日本 12 é don't"), (None, "sea Sea SEA"), (2, "red"), (7, "q" * 30_000), (8, "a b")]
    benchmark = spark.createDataFrame([(*i, "x", 3) for i in items], "item_id long, text string, term string, block int")
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    terms = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(terms(t))) for d, t, *_ in rows]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    want = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text)} & set(df)
        found = []
        for d, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // total
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in asked if t in bag)
            if s > 0:
                found.append((-s, (d is not None, d or 0), d))
        want += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found)[:50])]
    got = [tuple(r) for r in ranking.search(docs, benchmark).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 150
    assert ranking.search(nothing, benchmark).count() == 0 and ranking.search(docs, benchmark.limit(0)).count() == 0
    assert {(r.item_id, r.rank) for r in ranking.search(docs, benchmark, top=1).collect()} == {(i, k) for i, k, *_ in want if k == 1}


def test_search_in_many_blocks_and_bundles(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(["red sea", "new york city", "é ça", "12", "日本", "city red"])], "item_id long, text string")
    want = sorted(tuple(r) for r in ranking.search(docs, benchmark).where("doc_id is not null").collect())
    monkeypatch.setattr(ranking, "ITEMS_A_BUNDLE", 2)
    monkeypatch.setattr(ranking, "STAGES", 5)
    monkeypatch.setattr(ranking, "FEW_TERMS", 0)
    assert sorted(tuple(r) for r in ranking.search(docs.repartition(17), benchmark).where("doc_id is not null").collect()) == want


def exhaustive(sizes, capacity):
    best = len(sizes)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for room in sorted({b for b in bins if b >= sizes[k]}):
            i = bins.index(room)
            put(k + 1, [*bins[:i], room - sizes[k], *bins[i + 1 :]])
        put(k + 1, [*bins, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best


def test_bin_completion():
    rng = random.Random(8)
    exact = 0
    for t in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 11))]
        patterns, bound = packing.complete(Counter(sizes), capacity)
        assert all(sum(p) <= capacity for p, _ in patterns)
        assert sum((Counter({n: p.count(n) * k for n in p}) for p, k in patterns), Counter()) == Counter(sizes)
        used, best = sum(k for _, k in patterns), exhaustive(sizes, capacity)
        assert bound <= best <= used
        exact += used == best
    assert exact >= 148
    assert packing.dominates((9, 4), (5, 4, 4)) and not packing.dominates((8, 4), (5, 4, 4))
    big = Counter(rng.randint(300, 1400) for _ in range(3000))
    assert sum(k for _, k in packing.complete(big, 2048)[0]) < sum(k for _, k in packing.best_fit(big, 2048))
    with pytest.raises(ValueError):
        packing.complete({11: 1}, 10)


def test_pack(spark, docs, rows, nothing, monkeypatch):
    capacity = 96
    encoded = Counter()
    want = Counter()
    for (d, t, *_), ids in zip(rows, library(BYTES, [r[1] for r in rows])):
        ids = [*ids, 0]
        cuts = [0, *range(len(ids) - capacity * ((len(ids) - 1) // capacity), len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        encoded[d, tuple(ids)] += 1
    monkeypatch.setattr(packing, "CELL", 10)
    placed = packing.pack(docs, BYTES, capacity=capacity)
    got = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert least <= len(sequences) <= least + 1
    assert packing.pack(nothing, BYTES).count() == 0
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    built = packing.sequences(distinct, packing.pack(distinct, BYTES, capacity=capacity), BYTES, capacity=capacity).collect()
    assert all(len(r.ids) == sum(r.lengths) <= capacity for r in built)
    pieces = defaultdict(list)
    for r in built:
        at = 0
        for d, n in zip(r.doc_ids, r.lengths):
            pieces[d].append(tuple(r.ids[at : at + n]))
            at += n
    assert {d: sum(map(len, p)) for d, p in pieces.items()} == {d: len(ids) for (d, ids), _ in encoded.items() if d is not None}
