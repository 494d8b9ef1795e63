"""Token ids of many texts at once, for tokenizers that never join across white space."""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Distinct words a worker remembers, about 200 bytes each.
REMEMBERED = 200_000
#: Distinct pieces a worker remembers, about 60 bytes each, and the longest of them in bytes.
REMEMBERED_PIECES, LONGEST_PIECE = 200_000, 64
#: Text that is encoded at a time.
STEP_BYTES = 3 * 1024 * 1024

#: The steps before the merges for which the shorter way holds.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: ASCII and the precomposed letters of Latin-1 and Latin Extended-A that have one lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-žſ]+").fullmatch
#: The words of lower-cased plain characters.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+").findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def kept(name: str, make):
    """What `make` gave under this name, once for each worker process.

    Code that comes with a job is loaded anew by each task; the interpreter stays.
    """
    store = vars(sys).setdefault("_bindery_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def encoder(path: str) -> WordEncoder:
    return kept(f"words {path}", lambda: WordEncoder(path))


class Pieces:
    """Ids of the pieces met so far, in Arrow and numpy memory.

    Past `limit` pieces the oftener used half of them stays; a use counts once a step, and counts are
    halved when pieces go, so that those of earlier texts do not stay for ever. Longer
    pieces than `LONGEST_PIECE` stay for their own step only.
    """

    def __init__(self, limit: int = REMEMBERED_PIECES):
        self.limit = limit
        self.known = pa.array([], pa.large_string())
        self.pool = np.zeros(0, "<u4")
        self.size = self.uses = np.zeros(0, np.int32)

    def find(self, pieces: pa.Array, ids_of) -> tuple[np.ndarray, np.ndarray]:
        """Where in `pool` the ids of each distinct piece begin, and how many they are.

        `ids_of` is asked once for all pieces not known.
        """
        at = pc.index_in(pieces, value_set=self.known)
        which = np.array(pc.fill_null(at, -1))
        unknown = which < 0
        if unknown.any():
            fresh = pieces.filter(pa.array(unknown))
            ids = ids_of(fresh.to_numpy(zero_copy_only=False).tolist())
            which[unknown] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known = pa.concat_arrays([self.known, fresh])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            size = np.fromiter((len(i) // 4 for i in ids), np.int32, len(ids))
            self.size = np.concatenate([self.size, size])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int32)])
        self.uses[which] += 1
        return (np.cumsum(self.size, dtype=np.int32) - self.size)[which], self.size[which]

    def forget(self) -> None:
        keep = np.asarray(pc.binary_length(self.known)) <= LONGEST_PIECE
        if len(self.known) > self.limit:
            often = np.zeros(len(keep), bool)
            often[np.argsort(-np.where(keep, self.uses, 0), kind="stable")[: self.limit // 2]] = True
            keep, self.uses = keep & often, self.uses // 2
        if keep.all():
            return
        self.known = self.known.filter(pa.array(keep))
        self.pool = self.pool[np.repeat(keep, self.size)]
        self.size, self.uses = self.size[keep], self.uses[keep]


class Words(dict):
    """Ids of words as the model's merges give them, in two generations of bounded size."""

    def __init__(self, model, remembered: int):
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x21, 0x180)}
        self.tokenize, self.remembered, self.older = model.tokenize, remembered, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            tokens = self.tokenize(word.translate(self.letters))
            found = array("I", [t.id for t in tokens]).tobytes()
        if len(self) >= self.remembered // 2:  # the words in use move on
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class WordEncoder:
    """Encodes every distinct piece between ASCII white space once while it is remembered.

    Holds for tokenizers that drop white space, split at it and treat what lies
    between alone, as those with word-end marks do; special tokens must hold no
    white space. The texts' ids are then gathered from the pieces' ids in numpy.

    A tokenizer that lower-cases, parts words as `PARTS` does and maps bytes to letters
    has a shorter way for pieces of plain Latin letters, signs and digits: their words
    go to the merges directly, and words that differ in case or signs alone are one.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, pieces: int = REMEMBERED_PIECES):
        self.pieces = Pieces(pieces)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.short_way = (
            spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        )
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.words = Words(self.tokenizer.model, remembered)

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        found: list[bytes | None] = [None] * len(pieces)
        if self.short_way:
            word, search = self.words.__getitem__, self.marks.search
            found = [
                b"".join(map(word, PARTS(piece.lower())))
                if PLAIN(piece) and not ("<" in piece and search(piece))
                else None if piece else b""
                for piece in pieces
            ]
        rest = [i for i, ids in enumerate(found) if ids is None]
        encoded = self.tokenizer.encode_batch_fast(
            [pieces[i] for i in rest], add_special_tokens=False
        )
        for i, one in zip(rest, encoded):
            found[i] = array("I", one.ids).tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one more entry than texts).

        Null counts as empty.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        pieces = split.flatten().dictionary_encode()
        place, size = self.pieces.find(pieces.dictionary, self._ids_of)
        pool = self.pieces.pool
        which = np.asarray(pieces.indices)
        count = size[which]
        ends = np.zeros(len(count) + 1, np.int32)  # a step holds far fewer ids
        np.cumsum(count, out=ends[1:])
        places = np.repeat(place[which] - ends[:-1], count)
        places += np.arange(ends[-1], dtype=np.int32)
        ids = pool[places]
        self.pieces.forget()
        pa.default_memory_pool().release_unused()
        borders = np.asarray(split.offsets).astype(np.int64)
        return ids, ends[borders - borders[0]].astype(np.int64)
