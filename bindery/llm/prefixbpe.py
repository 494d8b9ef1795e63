"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one vocabulary entry can end its encoding. An
Aho-Corasick automaton of the vocabulary, whose suffix links play the part of a
suffix automaton, gives the entries that end at each position; one of them ends the
prefix if the entry before it, which is known from the shorter prefix, is compatible:
merging may not reach across their border. Following the entries back from the end
gives the ids, the same that repeated merging gives.

Compatibility comes from the merges alone. While two neighbours are built, the left
one's last symbol and the right one's first symbol pass through known stages; the
border holds unless at some time the two stages of that time can merge before either
grows on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import steps
from bindery.llm.tokens import byte_letters, kept

#: Fixed value: white space as Unicode's property has it.
SPACE = r"\t-\r\x20\x85\xA0  -     　"
#: Fixed value: the public pattern that parts text before byte-level merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|"
    r"[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
REMEMBERED = 400_000

ROWS = "doc_id long, ids array<int>, decoded string"


class PrefixEncoder:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.letter = dict(enumerate(letters))
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        parts = sorted(self.special, key=len, reverse=True)
        self.splitter = regex.compile("|".join(map(regex.escape, parts))) if parts else None
        self.pattern = regex.compile(PATTERN)
        self.remembered, self.known, self.older = remembered, {}, {}

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            self.made_of.setdefault(whole, (left, right, rank))
            if any(part in self.made_of and self.made_of[part][2] >= rank for part in (left, right)):
                raise ValueError("a merge must come after those that make its halves")
        self.never = len(merges)
        self.fits: dict[int, bool] = {}

        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.made_of or len(token) == 1:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.bytes = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()
                      if all(c in byte_of for c in token)}
        self.bytes.update({i: t.encode() for t, i in self.special.items()})

    def compatible(self, left: int, right: int) -> bool:
        """Does the border between two tokens last while both are built?

        Goes back in time from the whole tokens: the half that was made later is undone
        first, so only symbols that stood beside each other are looked up.
        """
        border = left << 32 | right
        found = self.fits.get(border)
        if found is None:
            if len(self.fits) > self.remembered:
                self.fits.clear()
            a, b, a_ends, b_ends = left, right, self.never, self.never
            found = True
            while True:
                # Of equal merges the leftmost goes first: one inside the left token wins
                # against the border, and the border wins against one inside the right.
                rank = self.rank.get((a, b), self.never)
                if rank < a_ends and rank <= b_ends:
                    found = False
                    break
                a_made, b_made = self.made_of.get(a), self.made_of.get(b)
                if a_made and (not b_made or a_made[2] > b_made[2]):
                    _, a, a_ends = a_made
                elif b_made:
                    b, _, b_ends = b_made
                else:
                    break
            self.fits[border] = found
        return found

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the pattern."""
        letters = "".join(map(self.letter.__getitem__, text.encode("utf-8", "replace")))
        fits = self.fits
        # Of the token that ends at each place: where it starts, and its id.
        starts, tokens = [0] * (len(letters) + 1), [-1] * (len(letters) + 1)
        done = 0
        for end, (size, token) in self.automaton.iter(letters):
            stop = end + 1
            if done == stop:
                continue
            start = stop - size
            if start:
                left = tokens[start]
                fit = fits.get(left << 32 | token)
                if fit is None:
                    fit = self.compatible(left, token)
                if not fit:
                    continue
            starts[stop], tokens[stop], done = start, token, stop
        ids, stop = [], len(letters)
        while stop:
            ids.append(tokens[stop])
            stop = starts[stop]
        return ids[::-1]

    def _plain(self, text: str, out: list[np.ndarray]) -> None:
        known = self.known
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece) or self.piece(piece)
                if len(known) >= self.remembered // 2:  # the pieces in use move on
                    self.older, self.known = known, {}
                    known = self.known
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of special tokens become those tokens."""
        out: list[int] = []
        done = 0
        for match in self.splitter.finditer(text) if self.splitter else ():
            self._plain(text[done : match.start()], out)
            out.append(self.special[match[0]])
            done = match.end()
        self._plain(text[done:], out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`doc_id, ids, decoded`: each whole text's ids, and the text that they decode to.

    A null or empty text has no ids and decodes to the empty text. A row for each row,
    repeated ones and null identifiers too; other columns are not read. `tokenizer` is
    a byte-level file whose path is the same on all executors.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(f"prefixes {tokenizer}", lambda: PrefixEncoder(tokenizer))
        for batch in batches:
            for a, b in steps(batch.column(1), 4 * 1024 * 1024):
                ids = [coder.encode(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([coder.decode(i) for i in ids], pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, ROWS)
