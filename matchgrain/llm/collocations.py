"""Phrases of two to four words by Toivonen's sampling, and how firmly they stick together.

A sample of the documents proposes phrases. A pass over all documents counts these and their negative border, the phrases that
were not proposed though all their parts were: at each place of a text, a run of k words is counted if its first and its
last k - 1 words are proposed. So all phrases of the border that occur are counted, and none has to be listed. Where a
phrase of the border turns out to be frequent the border has failed: it joins the proposed ones, and another pass counts the runs that are new
by it. Each failure makes phrases one word longer possible, so at most three such passes close the set. All counts are exact
and over all documents; sample and threshold only decide how many runs a pass counts and how many passes there are.

* A run is known by its length and two hashes of (lang, words), 126 bits together; its text is looked up once, for frequent ones.
* The proposed phrases travel as hash filters of a bounded size. What a filter finds by chance is counted too, and is as exact; a run is
  left to a later pass by the same filters that a pass before has used, so none is counted twice.
* Runs are counted per Arrow batch, then in Spark by partial aggregation: no word, lang or source is one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrain.llm.rawtext import HashFilter, hash_filter, raw_bytes, strings_of
from matchgrain.llm.tables import stored
from matchgrain.llm.textcore import bounded, mix, run_hashes

#: Bytes that end a piece, bytes between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 4
#: Share of the documents in the sample (a power of 1/2), and how often a phrase is in it to be proposed, as a share of what the threshold leads to expect.
SAMPLE_BITS, LOWERED = 4, 0.8
BATCH_BYTES, OUT_ROWS = 4 << 20, 1 << 16
FILTER_BITS = 1 << 28

_END, _WORD = np.zeros(256, bool), np.ones(256, bool)
_END[list(PIECE_ENDS)] = True
_WORD[list(PIECE_ENDS + BLANKS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cut_long(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Cut texts of more than BATCH_BYTES at ends of pieces, as no phrase crosses one; a piece stays whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    if not len(sizes) or pc.max(sizes).as_py() <= BATCH_BYTES:
        return texts, langs
    parts, of = [], []
    for k, text in enumerate(texts.to_pylist()):
        data, base = (text or "").encode(), 0
        while len(data) - base > BATCH_BYTES:
            end = max(data.rfind(e, base, base + BATCH_BYTES) for e in (bytes([b]) for b in PIECE_ENDS))
            if end < 0:
                found = re.compile(b"[" + re.escape(PIECE_ENDS) + b"]").search(data, base + BATCH_BYTES)
                end = found.start() if found else len(data) - 1
            parts.append(data[base : end + 1].decode()), of.append(k)
            base = end + 1
        parts.append(data[base:].decode()), of.append(k)
    return pa.array(parts, pa.string()), langs.take(pa.array(of))


class Runs:
    """The words of a batch and, at each word, the runs that begin there and stay in its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = raw_bytes(texts)
        word = _WORD[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = word[offsets[:-1][offsets[:-1] < len(data)]]
        starts = np.flatnonzero(begins)
        letters = np.cumsum(word)
        spelt = strings_of(_LOWER[data[word]], np.append(letters[starts] - 1, letters[-1] if len(data) else 0).astype(np.int64))
        coded = spelt.dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        text = np.searchsorted(offsets, starts, "right") - 1
        self.piece = np.cumsum(_END[data])[starts] + text if len(starts) else np.empty(0, np.int64)
        named = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs, self.lang = named.dictionary, named.indices.to_numpy()[text].astype(np.int64)
        salt = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs.to_pylist()), np.uint64, len(self.langs))
        table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(self.words))
        self.symbols = table[self.ids] if len(self.ids) else np.empty(0, np.uint64)
        self.salt = salt[self.lang] if len(self.lang) else np.empty(0, np.uint64)

    def whole(self, length: int) -> np.ndarray:
        """Whether the run of this length at each place stays in one piece; a piece never spans two texts."""
        n = len(self.ids) - length + 1
        return self.piece[:n] == self.piece[length - 1 :] if n > 0 else np.empty(0, bool)

    def hashes(self, length: int) -> np.ndarray:
        """Hash of the run at each place, its lang and length among them."""
        n = max(0, len(self.ids) - length + 1)
        return mix(run_hashes(self.symbols, length) + self.salt[:n] + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)))

    def second_hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Another hash of the runs that begin at some places; its last two bits are the length less 1."""
        value = mix(self.salt[at] + np.uint64(0xD6E8FEB86659FD93))
        for k in range(length):
            value = mix(value * np.uint64(0xC2B2AE3D27D4EB4F) + self.symbols[at + k])
        return value & ~np.uint64(3) | np.uint64(length - 1)

    def texts(self, at: np.ndarray, length: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.ids[at + k])) for k in range(length)]
        return parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _count(batches: Iterator[pa.RecordBatch], shared, longest: int, spell: bool):
    """Runs and their numbers, per batch.

    shared: filters of proposed phrases, the newest last (none: all runs count); a run counts whose parts are in them, unless its parts
    are in those before the newest. spell: give the text too, for runs that are themselves in the filter, and the number of words of each lang, under hashes 0.
    """
    filters: list[HashFilter] = shared.value if shared else []
    spelt: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in bounded(batches, "text", BATCH_BYTES):
        runs = Runs(*_cut_long(batch.column(1), batch.column(0)))
        before = None  # of runs a word shorter: in a filter, in one before the newest
        for length in range(1, longest + 1):
            places = np.flatnonzero(runs.whole(length))
            first = runs.hashes(length)
            if spell:
                places = places[filters[0].has(first[places])]
            elif filters:
                if length == 1:
                    if len(filters) > 1:
                        places = places[:0]  # all words are counted in the first pass
                else:
                    every, old = before
                    n = len(first)
                    places = places[(every[:n] & every[1 : n + 1] & ~(old[:n] & old[1 : n + 1]))[places]]
                old = np.zeros(len(first), bool)
                for f in filters[:-1]:
                    old |= f.has(first)
                before = old | filters[-1].has(first), old
            order = places[np.argsort(first[places])]
            a, b = first[order], runs.second_hashes(order, length)
            if (b[1:] != b[:-1])[a[1:] == a[:-1]].any():  # two runs with one first hash
                resort = np.lexsort((b, a))
                order, a, b = order[resort], a[resort], b[resort]
            edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(order) else np.empty(0, np.int64)
            if spell and len(edge):  # a task spells a run once
                known_a, known_b = spelt.get(length, (np.empty(0, np.uint64), np.empty(0, np.uint64)))
                at = np.minimum(np.searchsorted(known_a, a[edge]), max(0, len(known_a) - 1))
                edge = edge[~((known_a[at] == a[edge]) & (known_b[at] == b[edge]))] if len(known_a) else edge
                joined = np.append(known_a, a[edge])
                resort = np.argsort(joined, kind="stable")
                spelt[length] = joined[resort], np.append(known_b, b[edge])[resort]
            some = order[edge]
            columns = [pa.array(a[edge].view(np.int64)), pa.array(b[edge].view(np.int64))]
            if spell:
                names = runs.langs.take(pa.array(runs.lang[some])) if len(some) else pa.array([], pa.string())
                columns += [names, runs.texts(some, length).cast(pa.string()), pa.array(np.zeros(len(some), np.int64))]
            else:
                columns.append(pa.array(np.diff(np.append(edge, len(order)))))
            whole = pa.RecordBatch.from_arrays(columns, ["h", "g", "lang", "phrase", "a"] if spell else ["h", "g", "a"])
            for base in range(0, whole.num_rows, OUT_ROWS):
                yield whole.slice(base, OUT_ROWS)
        if spell:  # the words of each lang
            zero, n = pa.array(np.zeros(len(runs.langs), np.int64)), np.bincount(runs.lang, minlength=len(runs.langs))
            yield pa.RecordBatch.from_arrays([zero, zero, runs.langs, pa.array([""] * len(n), pa.string()), pa.array(n.astype(np.int64))], ["h", "g", "lang", "phrase", "a"])


def _counted(rows: DataFrame, filters: list[HashFilter], longest: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(filters) if filters else None
    found = rows.mapInArrow(lambda b: _count(b, shared, longest, False), "h long, g long, a long")
    # A batch has each run once, so a second aggregation in the same task finds little to add up: rows go to their owners first.
    return found.repartition("h", "g").groupBy("h", "g").agg(F.sum("a").alias("a"))


def _length():
    return F.col("g").bitwiseAND(3) + 1


def frequent_phrases(docs: DataFrame, least: int = 30, sample_bits: int = SAMPLE_BITS, lowered: float = LOWERED) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, a), and the words of each lang (lang, n): every run of one to four words that occurs at least `least` times in the texts of its lang, with its count.

    `docs` has lang (null: `und`) and text. The sample is the documents of which the last `sample_bits` bits of a hash of the text are 0.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(lang as string) lang", "cast(text as string) text").where("length(text) > 0")
    sample = rows.where(F.xxhash64("text").bitwiseAND((1 << sample_bits) - 1) == 0)
    wanted = max(1, int(lowered * least / (1 << sample_bits) + 0.5))
    proposed = stored(_counted(sample, [], LONGEST - 1).where(F.col("a") >= wanted).select("h"), "proposed")
    filters = [hash_filter(proposed, "h", proposed.count(), FILTER_BITS)]
    passes = []
    while True:
        # Only frequent runs are kept: what is rarer has no part in any result, and no longer run with it is frequent.
        counts = stored(_counted(rows, filters, LONGEST).where(F.col("a") >= least), "counts")
        passes.append(counts)
        failed = counts.where(_length() < LONGEST).join(proposed, "h", "left_anti").select("h")
        number = failed.count()
        if not number:
            break
        failed = stored(failed, "failed")
        filters.append(hash_filter(failed, "h", number, FILTER_BITS))
        proposed = proposed.unionByName(failed)
    frequent = passes[0]
    for more in passes[1:]:
        frequent = frequent.unionByName(more)
    shared = spark.sparkContext.broadcast([hash_filter(frequent.select("h"), "h", frequent.count(), FILTER_BITS)])
    spelt = rows.mapInArrow(lambda b: _count(b, shared, LONGEST, True), "h long, g long, lang string, phrase string, a long")
    spelt = stored(spelt.groupBy("h", "g", "lang").agg(F.any_value("phrase").alias("phrase"), F.sum("a").alias("n")), "spelt")
    words = spelt.where("phrase = ''").select("lang", "n")
    return stored(frequent.join(spelt.select("h", "g", "lang", "phrase"), ["h", "g"]).select("lang", _length().cast("int").alias("k"), "phrase", "a"), "phrases"), words


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, score: int = 2_000_000, covered: int = 80, **sampling) -> DataFrame:
    """(lang, rank int, phrase, a, l, r, n, score): the `top` phrases of each lang by score, then a, then the phrase.

    A phrase of two to four words with a >= `least` is cut in two; its score is floor(score * a / (l + r)) of the cut with the lowest
    one (the first of equals), where l and r are the counts of the parts. A phrase goes that lies in a longer candidate of
    `covered` percent of its count. n: words of the lang. Null and empty texts have no words, a null lang is `und`;
    each row counts, repeated rows too; without frequent phrases the result is empty. Other columns are ignored, as is doc_id.
    """
    phrases, words = frequent_phrases(docs, least, **sampling)
    candidates = phrases.where("k > 1").withColumn("_w", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    part = lambda at, n: F.array_join(F.slice("_w", at, n), " ")
    cuts = candidates.withColumn("_c", cut).select("lang", "phrase", "a", "k", "_c", part(F.lit(1), F.col("_c")).alias("_left"), part(F.col("_c") + 1, F.col("k") - F.col("_c")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    exact = F.expr(f"cast(cast(a as decimal(19,0)) * cast({score} as decimal(10,0)) div (cast(l as decimal(19,0)) + r) as bigint)")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "_c")).alias("_b"))
    inside = candidates.where("k > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: F.array_join(F.slice("_w", at, n), " "))))).alias("phrase"),
    )
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    over = F.expr(f"coalesce(cast(longer as decimal(19,0)) * 100 >= cast(a as decimal(19,0)) * {covered}, false)")
    left = best.join(inside, ["lang", "phrase"], "left").where(~over).select("lang", "phrase", "a", "_b.*")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # Spark cuts to `top` rows a lang before the shuffle
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
