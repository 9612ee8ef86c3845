"""Building blocks: suffix arrays, FM-indexes, repeated windows, components, dialogues."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from matchgrain.llm import chat
from matchgrain.llm.fmindex import earliest_holders
from matchgrain.llm.graph import components
from matchgrain.llm.gsaca import suffix_array
from matchgrain.llm.rawtext import raw_bytes
from matchgrain.llm.suffixes import repeated_windows
from matchgrain.llm.textcore import compact, words_of


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for t in range(600):
        s = [rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(40))]
        if t % 3 == 0:
            s = s[: len(s) // 4] * 5
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_windows_of_a_shard():
    rng = random.Random(5)
    bases = [bytes(rng.choice(b"abcdefgh \n") for _ in range(400)) for _ in range(5)]
    for _ in range(10):
        segments = set()
        for _ in range(30):
            a = rng.randrange(0, 120)
            s = bytearray(rng.choice(bases)[a : a + rng.randrange(200, 280)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = 65
            segments.add(bytes(s))
        segments.add(b"ab " * 80)
        segments = sorted(segments)
        counts = np.array([rng.choice([1, 1, 1, 2]) for _ in segments])
        seen = Counter()
        for s, k in zip(segments, counts):
            for i in range(len(s) - 199):
                seen[s[i : i + 200]] += k
        want = [[i for i in range(len(s) - 199) if seen[s[i : i + 200]] > 1] for s in segments]
        assert [g.tolist() for g in repeated_windows(segments, counts, 200)] == want


def test_earliest_holders_of_a_shard():
    rng = random.Random(6)
    for _ in range(20):
        segments = [np.array([rng.randrange(4) for _ in range(rng.randrange(5, 12))], np.uint64) for _ in range(60)]
        holders = np.array([rng.randrange(1000) for _ in segments])
        least = {}
        for s, h in zip(segments, holders):
            for i in range(len(s) - 4):
                least[tuple(s[i : i + 5])] = min(h, least.get(tuple(s[i : i + 5]), h))
        want = [[least[tuple(s[i : i + 5])] for i in range(len(s) - 4)] for s in segments]
        assert [g.tolist() for g in earliest_holders(segments, holders, 5)] == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rotation(spark):
    turns = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Hello\nthere"), (1, 200, "ann", None),
        (2, None, None, "lost"), (None, 0, "ann", "alone"), (3, 0, "system", "only"), (1, 2, "bob", "Hello\nthere"),
    ]
    extra = [(*t, "x", "y") for t in turns]
    got = chat.rotate(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, part string, mask string")).collect()
    key = {(r.conv_id, r.perspective, r.part): r for r in got}
    assert set(key) == {(1, "ann", 0), (1, "ann", 3), (1, "bob", 0), (1, "bob", 3), (2, "unknown", -1), (None, "ann", 0)}
    ann = key[1, "ann", 0]
    assert ann.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi < |im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\nHello\nthere<|im_end|>\n<|im_start|>user name=bob\nHello\nthere<|im_end|>\n"
    )
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["Hi < |im_end|><|im_end|>"]
    assert [key[1, "bob", 0].text[m.start : m.end] for m in key[1, "bob", 0].mask] == ["Hello\nthere<|im_end|>"] * 2
    assert key[1, "ann", 3].char_start == len(ann.text) and key[1, "ann", 3].n_target == len("<|im_end|>")
    assert ann.n_turns == 4 and ann.n_target == len("Hi < |im_end|><|im_end|>")
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rotation_cuts_crowded_parts(spark):
    rng = random.Random(8)
    said = lambda: (rng.choice(["ann", "bob", "system", None]), rng.choice([None, "same", "x" * rng.randrange(9)]))
    turns = [(None, rng.choice([0, 1, 300, None]), *said()) for _ in range(700)] + [(5, None, *said()) for _ in range(300)] + [(5, 3, "ann", "same")] * 200 + [(6, k, *said()) for k in range(64)]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert max(r.n_turns for r in got) == chat.PART
    assert all(r.n_target == sum(m.end - m.start for m in r.mask) for r in got)
    for conv in (None, 5, 6):
        own = sorted(((-1 if t is None else t, r or "unknown", x or "") for c, t, r, x in turns if c == conv))
        assert {r.perspective for r in got if r.conv_id == conv} == {r for _, r, _ in own} - {"system"}
        for who in {r for _, r, _ in own} - {"system"}:
            rows = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.char_start)
            name = lambda r: "assistant" if r == who else r if r == "system" else "user name=" + r
            assert "".join(r.text for r in rows) == "".join(f"<|im_start|>{name(r)}\n{x}<|im_end|>\n" for _, r, x in own)
            assert [r.char_start for r in rows] == [sum(len(x.text) for x in rows[:k]) for k in range(len(rows))]
            assert [r.part for r in rows] == sorted(r.part for r in rows)
            assert [r.text[m.start : m.end] for r in rows for m in r.mask] == [x + "<|im_end|>" for _, r, x in own if r == who]
    assert len([r for r in got if r.conv_id == 6 and r.perspective == "ann"]) == 1


def test_words_of_slices_of_large_arrays():
    rng = random.Random(2)
    texts = [None if k % 97 == 0 else " ".join(rng.choice(["Aé", "bb", "c\t", "d\n\n", "", "x" * 30]) for _ in range(rng.randrange(900))) for k in range(3000)]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for start, n in ((0, 700), (700, 1300), (1313, 1266), (2990, 10), (5, 0)):
            fresh = pa.array(texts[start : start + n], kind)
            for lower in (False, True):
                ids, vocabulary, offsets = words_of(whole.slice(start, n), lower)
                spelt = vocabulary.to_pylist()
                cut = [(t or "").encode().split() for t in texts[start : start + n]]
                want = [w.lower() if lower else w for ws in cut for w in ws]
                assert [spelt[i] for i in ids] == want and np.diff(offsets).tolist() == [len(ws) for ws in cut]
            data, ends = raw_bytes(whole.slice(start, n))
            assert bytes(data) == "".join(t or "" for t in texts[start : start + n]).encode() and len(ends) == n + 1
            assert compact(whole.slice(start, n)).to_pylist() == [t or "" for t in fresh.to_pylist()]
