"""Token ids of whole texts from a public tokenizer file, encoded once for each distinct chunk.

A text is cut into chunks whose ids do not depend on what lies around them. A batch is cut by array operations on its
bytes, its chunks are dictionary-coded, only distinct new chunks are encoded, and the ids of the batch are one gather.

* `byte_chunks`, for byte-level files: a chunk begins at an ASCII white space that follows no white space. The split
  pattern of such files never matches across such a place, and looks no further back.
* `word_chunks`, for files that drop white space: what lies between ASCII white space. Other white space stays inside.
"""

from __future__ import annotations

import json
import os
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import regex

from matchgrain.llm.bpe import byte_letters
from matchgrain.llm.rawtext import raw_bytes, strings_of
from matchgrain.llm.textcore import words_of

#: Chunks that a worker remembers; beyond that it forgets them all and begins anew.
KEEP = 600_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space beyond ASCII: its lead byte, its middle byte (0: two bytes only), its last bytes.
_WIDE = ((0xC2, 0, (0x85, 0xA0)), (0xE1, 0x9A, (0x80,)), (0xE2, 0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,)))


def byte_chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(id of each chunk, the distinct chunks, offset of each text's first chunk)."""
    data, offsets = raw_bytes(texts)
    if not len(data):
        return np.empty(0, np.int64), pa.array([], pa.large_string()), offsets
    space = _SPACE[data]
    ended = space.copy()  # at the last byte of a white space
    for lead, middle, last in _WIDE:
        at = np.flatnonzero(data == lead)
        at = at[at < len(data) - (2 if middle else 1)]
        if middle:
            at = at[data[at + 1] == middle] + 1
        ended[at[np.isin(data[at + 1], last)] + 1] = True
    begins = space
    begins[1:] &= ~ended[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    coded = strings_of(data, np.append(starts, len(data))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(starts, offsets)


def word_chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    ids, vocabulary, offsets = words_of(texts, lower=False)
    return ids.astype(np.int64), vocabulary.cast(pa.large_string()), offsets


#: Beyond this letter, and where a special token may stand, the library itself is asked: versions of Unicode may differ there.
_PLAIN = "\u0250"
#: The split pattern that byte-level files stand for; a fixed value.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merges:
    """The merges of a `tokenizers` BPE file in the engine of `tiktoken`, which is several times as fast on short strings.

    Its ranks belong to strings, not to pairs, so tokens that their own merges do not give back are left out. The end-of-word suffix is byte 0xFF, which
    UTF-8 does not have; it merges with the letter before it first of all.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        back = {letter: byte for byte, letter in byte_letters().items()}
        pairs = {m: k for k, m in enumerate(merges)}

        def raw(token: str) -> bytes:
            body, end = (token[: -len(suffix)], b"\xff") if suffix and token.endswith(suffix) else (token, b"")
            return bytes(back[c] for c in body) + end

        def stands(token: str) -> bool:
            parts = [*token] if not (suffix and token.endswith(suffix)) else [*token[: -len(suffix) - 1], token[-len(suffix) - 1 :]]
            while len(parts) > 1:
                rank, at = min((pairs.get(p, len(pairs)), k) for k, p in enumerate(zip(parts, parts[1:])))
                if rank == len(pairs):
                    return False
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return True

        ranks = {bytes([b]): b for b in range(256)}
        ids = [vocabulary.get(letter, -1) for _, letter in sorted(byte_letters().items())]
        if suffix:
            for byte, letter in sorted(byte_letters().items()):
                ranks[bytes([byte, 255])] = len(ids)
                ids.append(vocabulary.get(letter + suffix, -1))
        for left, right in merges:
            if stands(left + right):
                ranks[raw(left + right)] = len(ids)
                ids.append(vocabulary[left + right])
        self.ids, self.suffix = np.array(ids, np.int32), bool(suffix)
        self.engine = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        if suffix:
            self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))

    def ranks_of(self, chunk: str) -> list[int] | None:
        """The engine's tokens of a chunk; None where the library has to be asked."""
        if not chunk.isascii() and max(chunk) >= _PLAIN or "<|" in chunk:
            return None
        if not self.suffix:
            return self.engine.encode_ordinary(chunk)
        chunk = chunk.lower()  # below _PLAIN no letter's small form depends on its neighbours
        if chunk.isalpha():
            return self.engine.encode_single_piece(chunk.encode() + b"\xff")
        return [r for w in self.words.findall(chunk) for r in self.engine.encode_single_piece(w.encode() + b"\xff")]


class ChunkIds:
    """Ids of texts as the `tokenizers` library gives them; `cut` is one of the functions above."""

    def __init__(self, path: str, cut):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.merges, self.cut = Tokenizer.from_file(path), Merges(path), cut
        self.library.no_truncation(), self.library.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.pool, self.starts, self.used = np.empty(1 << 20, np.int32), np.zeros(1 << 20, np.int64), 0

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.slot), len(chunks)
        self.slot.update(zip(chunks, range(first, first + n)))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[first + 1 : first + n + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)

    def _learn(self, fresh: list[str]) -> np.ndarray:
        """The slot of each of these new chunks."""
        ranks, first = list(map(self.merges.ranks_of, fresh)), len(self.slot)
        own = np.fromiter((r is not None for r in ranks), bool, len(ranks))
        if own.any():
            lists = list(compress(ranks, own))
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
            self._keep(list(compress(fresh, own)), self.merges.ids[flat], sizes)
        asked = list(compress(fresh, ~own))
        for base in range(0, len(asked), 10_000):
            part = asked[base : base + 10_000]
            lists = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self._keep(part, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes)
        return first + np.where(own, np.cumsum(own), own.sum() + np.cumsum(~own)) - 1

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offset of each text's first id)."""
        codes, chunks, offsets = self.cut(texts)
        if len(self.slot) > KEEP:
            self._forget()
        names = chunks.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        places = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        new = places < 0
        if new.any():
            places[new] = self._learn(list(compress(names, new)))
        begin, size = self.starts[places], self.starts[places + 1] - self.starts[places]
        sizes = size[codes] if len(codes) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(begin[codes] - ends[:-1], sizes)] if ends[-1] else np.empty(0, np.int32)
        return ids, ends[offsets]

    def encoded_with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the id `end` after each text."""
        ids, offsets = self.encoded(texts)
        return np.insert(ids, offsets[1:], np.int32(end)), offsets + np.arange(len(offsets))


_WORKERS: dict[tuple[str, str], ChunkIds] = {}


def chunk_ids(path: str, cut) -> ChunkIds:
    """One per Python worker and file."""
    key = (path, cut.__name__)
    if key not in _WORKERS:
        _WORKERS[key] = ChunkIds(path, cut)
    return _WORKERS[key]
