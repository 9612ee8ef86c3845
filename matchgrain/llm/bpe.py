"""BPE of words by a depth-first walk over the trie of distinct words.

In byte-pair encoding, the encoding of a prefix is fixed by its last token: cut that token off, and the rest
is encoded as the shorter prefix is. The last token of a prefix p is the one token t that ends p, encodes to
itself, and stands at the start or is compatible with the last token u of what lies before it, that is, u + t
encodes to (u, t). So one state per trie node is enough. Words are visited in sorted order, which is the
depth-first order of their trie: the states of the prefix shared with the word before are kept, and each
shared prefix is computed once. A word's tokens follow by walking back over the states.

The vocabulary is a `tokenizers` JSON file of kind BPE with an end-of-word suffix, byte-level letters,
normalisers NFC, white space to one space, lower case, and one split pattern. Text between white space is a
chunk; chunks are independent, so a batch encodes only its distinct new chunks.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchgrain.llm.textcore import bounded

#: White space as the normaliser's \s takes it: Unicode White_Space, without \x1c-\x1f.
_WHITE = "\t-\r \x85\xa0  -     　"
_ODD = regex.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(f"[^{_WHITE}]+")
#: Chunks, and words, that a worker remembers in each of two generations; what is forgotten is encoded again.
KEEP = 250_000


def byte_letters() -> dict[int, str]:
    """Letter of each byte: printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def chunks_of(text: str | None) -> list[str]:
    """What lies between white space."""
    return [] if not text else text.split() if not _ODD.search(text) else _CHUNK.findall(text)


class Recent:
    """Memory in two generations: when the young one is full it becomes the old one, and what is used again moves up."""

    def __init__(self, keep: int):
        self.keep, self.young, self.old = keep, {}, {}

    def turn(self) -> None:
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}

    def missing(self, keys: set) -> list:
        """The keys that are not remembered; all others are young afterwards."""
        young, old, absent = self.young, self.old, []
        for key in keys:
            if key not in young:
                value = old.get(key)
                if value is None:
                    absent.append(key)
                else:
                    young[key] = value
        return absent


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.shown = [str(i) for i in range(max(self.strings) + 1)]
        cut = len(self.suffix)
        self.inner = {t: i for t, i in self.vocabulary.items() if not t.endswith(self.suffix)}
        self.final = {t[:-cut]: i for t, i in self.vocabulary.items() if t.endswith(self.suffix)}
        self.longest = max(map(len, self.vocabulary))
        #: Merge rank of a pair of ids; of each id the merge that makes it (rank, left, right), rank -1 for a symbol.
        self.ranks: dict[tuple[str, str], int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.made = [(-1, -1, -1)] * (max(self.strings) + 1)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            both = self.vocabulary[left + right]
            if self.made[both][0] >= 0:
                raise ValueError(f"two merges make {left + right!r}; the walk needs one")
            self.ranks[left, right] = rank
            self.pairs[self.vocabulary[left], self.vocabulary[right]] = rank
            self.made[both] = (rank, self.vocabulary[left], self.vocabulary[right])
        self.endings = ahocorasick.Automaton()
        for text, token in self.inner.items():
            self.endings.add_word(text, (token, len(text)))
        self.endings.make_automaton()
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.fit: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self.words, self.chunks = Recent(KEEP), Recent(KEEP)  # ids of each

    def symbols(self, token: int) -> list[str]:
        text = self.strings[token]
        if text.endswith(self.suffix) and len(text) > len(self.suffix):
            body = text[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return [*text]

    def merged(self, parts: list[str]) -> list[str]:
        """Plain byte-pair encoding: the merge of lowest rank, leftmost first, until none applies."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def stands(self, token: int) -> bool:
        """Whether the token encodes to itself."""
        if (known := self.own.get(token)) is None:
            known = self.own[token] = self.merged(self.symbols(token)) == [self.strings[token]]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether left + right encodes to (left, right): undo their merges, latest first, and look for one
        across the cut that would have come before the merge undone last."""
        key = (left, right)
        if (known := self.fit.get(key)) is not None:
            return known
        limit = len(self.pairs)
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < limit:
                known = False
                break
            (rank_l, _, tail), (rank_r, head, _) = self.made[left], self.made[right]
            if rank_l > rank_r:
                limit, left = rank_l, tail
            elif rank_r >= 0:
                limit, right = rank_r + 1, head  # of two equal ranks the leftmost merges first
            else:
                known = True
                break
        if len(self.fit) > 4 * KEEP:
            self.fit.clear()
        self.fit[key] = known
        return known

    def add_words(self, words: list[str]) -> None:
        """Encode words (strings of byte letters) by one depth-first walk."""
        before, states = "", [(-1, 0)]  # states[k]: last token of the prefix of length k, and its start
        compatible, stands, final, longest = self.compatible, self.stands, self.final, self.longest
        for word in sorted(words):
            length, same = len(word), 0
            most = min(len(before), length) - 1
            while same < most and before[same] == word[same]:
                same += 1
            del states[same + 1 :]
            known = len(states)
            for at, (token, size) in self.endings.iter(word):
                if at + 1 != known or known == length:  # a state from the word before, found already, or the last letter
                    continue
                start = known - size
                if (not start or compatible(states[start][0], token)) and stands(token):
                    states.append((token, start))
                    known += 1
            if known != length:
                raise ValueError(f"no token ends a prefix of {word!r}")
            # The last letter carries the suffix: it is a node of its own, never on the path of another word.
            for start in range(max(0, length - longest), length):
                token = final.get(word[start:])
                if token is not None and (not start or compatible(states[start][0], token)) and stands(token):
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            path = [token]
            while start:
                token, start = states[start]
                path.append(token)
            self.words.young[word] = tuple(reversed(path))
            before = word

    def pieces(self, chunk: str) -> list[str | int]:
        """Words of a chunk in byte letters, and ids of special tokens in it."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        out: list[str | int] = []
        for part in self.split_special.split(chunk) if "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
                part = "".join(map(str.lower, part))  # letter by letter: no rule for a final sigma
            else:
                part = part.lower()
            for word in self.pattern.findall(part):
                out.append(word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode()))
        return out

    def add_chunks(self, chunks: list[str]) -> None:
        cut = {c: self.pieces(c) for c in chunks}
        self.words.turn()
        self.add_words(self.words.missing({w for ps in cut.values() for w in ps if isinstance(w, str)}))
        words, young = self.words.young, self.chunks.young
        for chunk, ps in cut.items():
            if len(ps) == 1 and isinstance(ps[0], str):
                young[chunk] = words[ps[0]]
            else:
                young[chunk] = tuple(i for p in ps for i in ((p,) if isinstance(p, int) else words[p]))

    def encoded(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text."""
        split = [chunks_of(t) for t in texts]
        self.chunks.turn()
        self.add_chunks(self.chunks.missing(set().union(*split)))
        young = self.chunks.young
        for chunks in split:
            yield list(chain.from_iterable(map(young.__getitem__, chunks)))

    def decoded(self, ids: list[int]) -> str:
        """What the library's decoder makes of ids, special tokens included: the token strings joined by spaces."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def _digests(batches: Iterator[pa.RecordBatch], path: str, full: bool):
    bpe = encoder(path)
    for batch in bounded(batches, "text", 2 << 20):
        counts, shown, decoded = [], [], []
        for ids in bpe.encoded(batch.column(1).to_pylist()):
            counts.append(len(ids))
            back = bpe.decoded(ids)
            if full:
                shown.append(np.array(ids, np.int32))
                decoded.append(back)
            else:
                shown.append(hashlib.sha256(" ".join([bpe.shown[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shown, pa.list_(pa.int32()) if full else pa.string()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded"] if full else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens long, ids array<int>, decoded string) of each row of `docs` (doc_id, text), without a shuffle.

    ids and decoded equal those of the `tokenizers` library for the file at `path` (which every executor can read),
    without added special tokens; special tokens written in a text are recognised. A null, empty or blank text
    has no ids. Rows, also repeated ones, come out once each; other columns are not kept.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        lambda b: _digests(b, path, True), "doc_id long, n_tokens long, ids array<int>, decoded string"
    )


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as `encode_and_decode`, with digests in place of the values.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the decoded text in UTF-8.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        lambda b: _digests(b, path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
