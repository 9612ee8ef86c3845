"""Operators on documents against brute-force versions, on a small table full of edge cases."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from matchgrain.llm import bpe, decontaminate, fmindex, lines, minhash, quality, resharding, suffixes, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, anchor int, shard string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "a"]) if rng.random() < 0.3 else "".join(rng.choice("abcdeghilmnorstuvé") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(25)]
    texts += [texts[0]] * 4 + [texts[1]]  # copies
    for base in texts[2:5]:  # near copies
        for _ in range(6):
            words = base.split(" ")
            words[rng.randrange(len(words))] = "changed%d" % rng.randrange(9)
            texts.append(" ".join(words))
    passage = prose(rng, 70)
    texts += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 30) for _ in range(5)]
    texts += ["ab " * 400, "x" * 1500, prose(rng, 6000), passage + " " + passage]
    texts += [f"{prose(rng, 40)}\nError code {k} at line {k * 7} in module {chr(97 + k)}\n{prose(rng, 25)}" for k in range(8)]
    texts += ["", None, " \t\n\x0b ", "one", "two words", "one", "<|endoftext|> It's DON'T ÀÉ 12 # | # |", "dup line\ndup line\n\ndup line"]
    table = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None, "x", 1, "y") for i, t in enumerate(texts)]
    table += [(None, texts[3], "en", "a", 1, "x", 1, "y"), (None, None, None, None, None, None, None, None), table[2], table[2]]
    rng.shuffle(table)
    return table


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def words(text):
    return (text or "").encode().split()


def test_near_duplicates(docs, rows, nothing):
    sets = {}
    for r in rows:
        ws = [w.lower() for w in words(r[1])]
        sets[r[0]] = {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()
    ids = sorted(i for i in sets if i is not None)
    label = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    def size(t):
        ws = [w.lower() for w in words(t)]
        return len({tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}) if ws else 0
    want = [(r[0], size(r[1]), label.get(r[0]), r[0] is None or label[r[0]] == r[0]) for r in rows]
    got = [tuple(r)[:4] for r in minhash.near_duplicates(docs).collect()]
    same(got, want)
    assert any(i != c for i, _, c, _ in got if i is not None)
    assert minhash.near_duplicates(nothing).count() == 0


def test_hub_and_blocks_find_every_link(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    table = []
    for i in range(150):  # a chain of drifting copies: most pairs are bucket mates, few are linked
        if i % 10 == 0:
            base = base[:]
            for _ in range(4):
                base[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        own = base[:]
        for _ in range(rng.choice([0, 1, 2, 5, 9])):
            own[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        table.append((i, " ".join(own)))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(118)} for _, t in table]
    label = list(range(150))
    for _ in range(150):
        for a in range(150):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label))


def test_repeated_bytes(docs, rows, nothing):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    want = []
    for r, d in zip(rows, data):
        gone = [False] * len(d)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        left = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((r[0], len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    for busy in (5000, 3):
        same([tuple(r) for r in suffixes.remove_repeats(docs, busy=busy, full=False).collect()], want)
    assert suffixes.remove_repeats(nothing).count() == 0
    assert any(0 < w[2] < w[1] for w in want)


def test_repeats_in_pieces_of_one_long_text(spark):
    rng = random.Random(11)
    filler, passage = rng.randbytes(700_000).hex(), rng.randbytes(120).hex()
    assert len(filler) > suffixes.PIECE + 200_000
    cut = suffixes.PIECE + 100
    texts = ["A" + passage + "B" + filler[:cut] + "C" + passage + "D" + filler[cut:], rng.randbytes(700_000).hex(), "E" + rng.randbytes(300).hex()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = ["AB" + filler[:cut] + "CD" + filler[cut:], *texts[1:]]
    for busy in (5000, 1):
        got = suffixes.remove_repeats(docs, busy=busy).collect()
        same([(r.doc_id, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in got], [(0, 480, 2, left[0]), (1, 0, 0, left[1]), (2, 0, 0, left[2])])


def test_repeats_around_a_common_passage(spark):
    rng = random.Random(12)
    passage = rng.randbytes(180).hex()
    texts = [rng.randbytes(90).hex() + passage[:340] + rng.randbytes(90).hex() for _ in range(14)]
    texts += [texts[k][:60] + "x" + texts[k][60:] for k in range(4)] + [passage + str(k) * 3 + passage[7:] for k in range(3)]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    left = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        left.append("".join(c for c, g in zip(t, gone) if not g))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for busy in (5000, 8, 2, 0):
        same([(r.doc_id, bytes(r.kept).decode()) for r in suffixes.remove_repeats(docs, busy=busy).collect()], list(enumerate(left)))


def test_search_spreads_a_route_of_many_segments():
    rng = random.Random(13)
    common = rng.randbytes(210)
    segments = [common + rng.randbytes(20) for _ in range(1500)]
    rows = [(5, k, s, 1) for k, s in enumerate(segments)] + [(7, 9, segments[0], 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["route", "digest", "bytes", "n"])
    out = [r for part in suffixes._search(iter([batch]), 200, 10) for r in part.to_pylist()]
    strings = Counter((r["high"], r["low"]) for r in out if r["at"] is not None)
    assert sum(strings.values()) == 1500 * 31 and sorted(strings.values())[-11:] == [1500] * 11
    assert [(r["route"], r["digest"], r["ranges"]) for r in out if r["at"] is None] == [(7, 9, [0, 230])]


def test_earlier_passages(docs, rows, nothing):
    first = {}
    for r in rows:
        ws = words(r[1])
        for i in range(len(ws) - 12):
            if r[0] is not None:
                first[tuple(ws[i : i + 13])] = min(r[0], first.get(tuple(ws[i : i + 13]), r[0]))
    want = []
    for r in rows:
        ws = words(r[1])
        gone = [False] * len(ws)
        for i in range(len(ws) - 12):
            if r[0] is not None and first[tuple(ws[i : i + 13])] < r[0]:
                gone[i : i + 13] = [True] * 13
        want.append((r[0], len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest()))
    for busy in (5000, 2):
        same([tuple(r) for r in fmindex.remove_earlier_passages(docs, busy=busy, full=False).collect()], want)
    assert fmindex.remove_earlier_passages(nothing).count() == 0


def test_bpe_equals_the_library(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    got = [tuple(r) for r in bpe.encode_and_decode(docs, path).collect()]
    same(got, want)
    digests = [(r[0], r[1], hashlib.sha256(" ".join(map(str, r[2])).encode()).hexdigest(), hashlib.sha256(r[3].encode()).hexdigest()) for r in want]
    same([tuple(r) for r in bpe.encoding_digests(docs, path).collect()], digests)
    assert bpe.encode_and_decode(nothing, path).count() == 0


def test_bpe_of_hard_words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.encoder(path)
    rng = random.Random(1)
    texts = ["İSTANBUL ΑΣ ΟΔΟΣ é \x1cfoo\x1dbar x　y 日本語テキスト <|startoftext|><|end 😀😀 \x00\x7f aͅ", "́a", "we've 'S'T 1234", "a<|endoftext|>B"]
    texts += ["".join(rng.choice("abeinorst") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x370, 0x500)])) for _ in range(30)) for _ in range(300)]
    texts = [t for t in texts if all(unicodedata.category(c) != "Cn" for c in t)]
    for text, ids in zip(texts, own.encoded(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, docs, rows, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    tokenfile.write_tokens(docs, str(tmp_path / "t"), path, file_bytes=8000)
    read = tokenfile.read_tokens(spark, str(tmp_path / "t"))
    got = sorted(read.collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r[0] for r in rows if r[0] is not None)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += len(r.ids)
    same([(r.doc_id, r.ids) for r in got], [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows])
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in tokenfile.checksums(read).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) for r in got}
    assert len({r.part for r in got}) > 1
    assert {(r.doc_id, r.start) for r in tokenfile.read_metadata(spark, str(tmp_path / "t")).collect()} == set(sums)
    some = tokenfile.read_tokens(spark, str(tmp_path / "t"), [3, 5])
    assert {(r.doc_id, r.start) for r in some.collect()} == {k for k in sums if k[0] in (3, 5)}
    tokenfile.write_tokens(nothing, str(tmp_path / "none"), path)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_token_file_layout(docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    tokenfile.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    group = pq.ParquetFile(max(glob.glob(f"{tmp_path}/t/*.parquet"))).metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["ids"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_resharding(docs, rows, nothing):
    from pyspark.sql import functions as F

    placed, affected = resharding.reshard(docs, F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 3), shards=4)
    got = placed.collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 4
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        text = (r.text or "").encode()
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
    same([(r.doc_id, r.text) for r in got], [(r[0], r[1]) for r in rows])
    assert set(affected) == {r.shard for r in got if r.shard != r.old_shard} | {r.old_shard for r in got if r.shard != r.old_shard}
    assert resharding.reshard(nothing, F.lit(0))[0].count() == 0


def test_flow_moves_the_fewest_bytes():
    from itertools import product

    rng = random.Random(5)
    for _ in range(30):
        shards = rng.choice([2, 3])
        blocks = [resharding.Block(rng.randrange(4), k, n := rng.randint(1, 3), n * rng.randint(1, 9)) for k in range(3)]
        flow = resharding.cheapest_flow(blocks, shards)
        units = [(b.shard, b.size / b.rows) for b in blocks for _ in range(b.rows)]
        cost = sum(n * b.size / b.rows for b, parts in flow.items() for j, n in enumerate(parts) if j != b.shard)
        best = min(
            sum(c for (home, c), j in zip(units, to) if home != j)
            for to in product(range(shards), repeat=len(units))
            if max(map(to.count, range(shards))) - min(map(to.count, range(shards))) <= 1
        )
        assert abs(cost - best) < 1e-6
        assert all(sum(parts) == b.rows for b, parts in flow.items())


def test_rewritten_layout_holds_every_row_once(spark, rows, docs, nothing, tmp_path):
    from pyspark.sql import functions as F

    table = docs.select("doc_id", "text", "source").withColumns({"_kind": F.lit("mine"), "_row": F.lit(1), "_hash": F.lit(2)})
    for old, new in ((8, 4), (3, 5), (2, len(rows) + 6)):
        folder = str(tmp_path / f"s{old}")
        resharding.write_layout(table, F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(old)), folder)
        before = spark.read.parquet(folder)
        assert before.count() == len(rows)
        placed, affected = resharding.reshard(before, F.col("shard"), shards=new)
        resharding.rewrite_affected(placed, affected, folder, new)
        got = spark.read.schema(placed.schema).parquet(folder).collect()
        same([(r.doc_id, r.text) for r in got], [(r[0], r[1]) for r in rows])
        assert {(r["_kind"], r["_row"], r["_hash"]) for r in got} == {("mine", 1, 2)}
        counts = Counter(r.shard for r in got)
        assert max(counts) < new and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == min(new, len(rows))
        for s in counts:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    folder = str(tmp_path / "none")
    resharding.write_layout(nothing, F.lit(0), folder)
    placed, affected = resharding.reshard(spark.read.schema(before.schema).parquet(folder), F.col("shard"))
    resharding.rewrite_affected(placed, affected, folder)
    assert spark.read.schema(placed.schema).parquet(folder).count() == 0


def test_rewrite_touches_affected_shards_only(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    placed, affected = resharding.reshard(docs.select("doc_id", "text", "source"), F.when(F.col("source") == "a", 0).otherwise(1), shards=3)
    resharding.rewrite_affected(placed, affected, str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert {r.shard for r in kept.select("shard").distinct().collect()} == set(affected)
    assert kept.count() == placed.where(F.col("shard").isin(affected)).count()


def brute_signals(text):
    ws = [w.decode() for w in words(text)]
    runs = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    gone = [False] * len(ws)
    for i in range(len(ws) - 7):
        if runs[tuple(ws[i : i + 8])] > 1:
            gone[i : i + 8] = [True] * 8
    ls = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), sum(gone), len(ls)


def test_signals(docs, rows, nothing):
    got = [(r.doc_id, *r["_signals"]) for r in quality.with_signals(docs).collect()]
    same(got, [(r[0], *brute_signals(r[1])) for r in rows])
    assert quality.with_signals(nothing).count() == 0


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(k, n, 0.0125) for n in (1, 30, 400, 900) for k in (0, 1, 3, 8)]
    frame = spark.createDataFrame(cases, "k long, n long, p double").where("k <= n")
    for r in frame.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.0125).alias("t")).collect():
        exact = sum(comb(r.n, j) * 0.0125**j * 0.9875 ** (r.n - j) for j in range(r.k + 1))
        assert abs(r.t - exact) < 1e-9 if r.k < r.n * 0.0125 else r.t == 1


def test_cutoffs_hold_on_good_documents(spark):
    rng = random.Random(2)
    table, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        table.append((i, prose(rng, 25) + ("".join(" " + rng.choice("#|$%") + rng.choice("abcdefgh") for _ in range(12)) if bad else " #" * rng.choice([0, 0, 1])), "en" if i % 2 else None))
        labels.append((i, 0 if bad else 1))
    signed = quality.with_signals(spark.createDataFrame(table, "doc_id long, text string, lang string")).drop("text")
    labels = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int")
    cutoffs = quality.fit_cutoffs(signed, labels)
    assert {r.stratum for r in cutoffs.collect()} == {"", "en"}
    judged = {r.doc_id: r["_kept"] for r in quality.judge(signed, cutoffs).collect()}
    good = [i for i in judged if i % 5]
    assert sum(not judged[i] for i in good) / len(good) <= quality.FALSE_REJECTION
    assert sum(judged[i] for i in judged if i % 5 == 0) < 30
    none = quality.fit_cutoffs(signed, labels.limit(0))
    assert none.count() == 0 and quality.judge(signed, none).where("not _kept").count() == 0


def test_recurring_lines(docs, rows, nothing):
    got = lines.drop_recurring_lines(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(got[0].asDict())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    logs = sorted(r[0] for r in rows if r[0] is not None and r[1] and "Error code" in r[1])
    assert "Error code" in by_id[logs[0]].text
    assert all("Error code" not in by_id[i].text and by_id[i].n_dropped == 1 and by_id[i].n_lines == 3 for i in logs[1:])
    unchanged = [r for r in rows if r[0] is not None and (r[1] is None or not words(r[1]))]
    assert all(by_id[r[0]].text == r[1] and by_id[r[0]].n_dropped == 0 for r in unchanged)
    assert lines.drop_recurring_lines(nothing).count() == 0


def brute_hits(docs, items):
    def bag(ws, k):
        out = Counter()
        for i in range(len(ws) - k + 1):
            out[tuple(ws[i : i + k])] += sum(len(w.encode()) for w in ws[i : i + k])
        return out

    cut = lambda text: re.findall(r"[^\W_]+", (text or "").lower().replace("ß", "ss"))
    found = {}
    for doc, text in docs:
        ws = cut(text)
        for item, item_text in items:
            whole = cut(item_text)
            n = len(whole)
            parts = [(whole, 0.35 if n >= 10 else 0.8)] if n else []
            if n >= 20:
                parts += [(whole[a : a + n // 2], 0.5) for a in (0, (n - n // 2) // 2, n - n // 2)]
            for iw, limit in parts:
                k, span = min(3, len(iw)), min(len(iw), len(ws))
                if not ws or span < k:
                    continue
                best = max((_sim(bag(ws[s : s + span], k), bag(iw, k)), -s, span) for s in range(len(ws) - span + 1))
                if best[0] >= limit:
                    found[doc, item] = max(best, found.get((doc, item), best))
    return [(doc, item, round(s, 9), -at, span) for (doc, item), (s, at, span) in found.items()]


def _sim(a, b):
    low = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def test_contamination(spark, nothing):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(20, 45))) for k in range(8)] + [(8, "short item"), (9, "Four words in it"), (10, ""), (11, None), (12, "solo")]
    items.append(items[0])
    texts = []
    for k, text in items[:8]:
        ws = text.split()
        texts.append(prose(rng, 50) + " " + text.upper() + " " + prose(rng, 20))
        edited = ws[:]
        edited[len(ws) // 2] = "other"
        texts.append(" ".join(edited) + "\n" + prose(rng, 5))
        texts.append(prose(rng, 9) + " " + " ".join(ws[: len(ws) // 2]) + " " + prose(rng, 9))
        texts.append(text + " " + text)
        texts.append(" ".join(ws[:-1]))
        texts.append(prose(rng, 30) + " " + "! ".join(ws[len(ws) // 4 : len(ws) // 4 + len(ws) // 2]) + ", " + prose(rng, 30))  # a half from the middle
        for m in (2, 3):  # some words changed
            edited = [w if (i + 3) % (len(ws) // m) else "new" for i, w in enumerate(ws)]
            texts.append(prose(rng, 12) + "\n" + " - ".join(edited).upper())
    texts += ["", None, "a short item here", "short", "now FOUR words in it.", "solo", prose(rng, 3000), "it " * 500]
    table = [(i, t, "kept") for i, t in enumerate(texts)] + [(None, "short item", "kept")]
    docs = spark.createDataFrame(table, "doc_id long, text string, similarity string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits([(d, t) for d, t, _ in table], dict(items).items())
    got = [(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in decontaminate.contaminated(docs, benchmark).collect()]
    same(got, want)
    clean = decontaminate.without_contaminated(docs, benchmark)
    bad = {d for d, *_ in want}
    same([tuple(r) for r in clean.collect()], [r for r in table if r[0] not in bad])
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.without_contaminated(docs, benchmark.limit(0)).count() == len(table)
    assert len(got) >= 24
    assert len({(d, i) for d, i, *_ in got if i is not None and d is not None}) >= 8 * 8


def test_contamination_with_very_long_words(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items, table = [], []
    for k in range(60):
        if k % 2:  # two heavy shingles of the item
            ws, last = [word(n) for n in (2, 40, 2, 2, 2, 2, 2)], word(2)
        else:  # one heavy shingle of the document
            ws, last = [word(5) for _ in range(30)], word(100)
        items.append((k, " ".join(ws)))
        table.append((k, " ".join(["start", *ws[:-1], last, "end"])))
    want = brute_hits(table, items)
    found = decontaminate.contaminated(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    same([(r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in found.collect()], want)
    assert len(want) == 60
