"""Chunks that are learned in one batch: plain ones, ones for the library, and ones that were known."""

import numpy as np
import pyarrow as pa

from matchgrain.llm.chunkids import chunk_ids, word_chunks
from matchgrain.llm.queries import word_bpe


def test_new_chunks_get_their_slots_in_one_go():
    from tokenizers import Tokenizer

    chunk_ids(word_bpe(), word_chunks)._forget()
    encoder = chunk_ids(word_bpe(), word_chunks)
    library = Tokenizer.from_file(word_bpe())
    library.no_truncation(), library.no_padding()
    texts = ["Plain WORDS 12a", "İstanbul Ångström naïve", "ΣΑΣ <|x|> plain", None, "", "日本 words it's ªº ẋ"]
    for part in (texts[:2], texts, texts[::-1]):
        ids, offsets = encoder.encoded(pa.array(part, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    slots = encoder._learn(["qwertz", "日", "asdf1"])
    assert slots.dtype == np.int64 and [encoder.slot[c] for c in ("qwertz", "日", "asdf1")] == slots.tolist()
