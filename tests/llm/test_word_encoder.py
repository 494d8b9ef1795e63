"""The encoder's memory of pieces against the tokenizer itself."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from bindery.llm.tokens import Pieces, WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "One two, two!  THREE\tİstanbul 漢字x <|endoftext|>y", "two two " * 50, "z" * 200 + " one",
    " ".join(f"w{i}" for i in range(300)), "it's 12 naïve café", "one two three four five six",
]


def test_few_remembered_pieces_change_nothing():
    tok = Tokenizer.from_file(WORDS)
    small = WordEncoder(WORDS, remembered=30, pieces=10)
    for _ in range(3):
        for texts in (TEXTS, TEXTS[::-1], TEXTS[3:4], []):
            ids, ends = small.encode(pa.array(texts, pa.string()))
            got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
            assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(small.pieces.known) <= 10


def test_often_used_pieces_stay():
    store = Pieces(4)
    asked = []

    def ids_of(pieces):
        asked.extend(pieces)
        return [np.array([len(p)], "<u4").tobytes() for p in pieces]

    for rare in "abcdefgh":
        store.find(pa.array(["also", rare, rare * 100, "often"], pa.large_string()), ids_of)
        store.forget()
    assert asked.count("often") == 1 and asked.count("also") == 1
    place, size = store.find(pa.array(["also", "new"], pa.large_string()), ids_of)
    assert store.pool[place].tolist() == [4, 3] and size.tolist() == [1, 1]
