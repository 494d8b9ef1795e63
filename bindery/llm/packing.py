"""Packs documents into token sequences by minimum bin slack.

Every document is cut at multiples of the window; full windows are sequences of
their own. What remains of each document, shorter than a window, waits in a pool
of the task. For each next window the longest remainder is laid down, and a
subset-sum over the multiset of remaining lengths, held as one bitset of reachable
sums per length, finds the multiset that fills the window closest to capacity;
the counts are read back through the stored bitsets. A gap that no multiset fills
is closed by cutting one more remainder, and the last window of a task, if not
full, is cut at powers of two. So no sequence needs padding.

Packing is local to a task: no row is shuffled, and the pool holds at most
`POOL_TOKENS` tokens and one document.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.llm.common import steps
from bindery.llm.tokens import STEP_BYTES, encoder

WINDOW = 4096
#: Tokens that wait for a window in one task.
POOL_TOKENS = 1 << 21

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def closest_fill(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """How many of each length to take so that they fill `room` as far as possible.

    `lengths` are the keys of `counts`, ascending. Bit s of a bitset says that sum s
    is reachable with the lengths seen so far; it stops once `room` itself is.
    """
    within = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for i in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[i]
        stages.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left > 0:  # doubling: any count up to the limit
            take = min(step, left)
            reach |= (reach << (take * length)) & within
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    goal, taken = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> goal & 1:
            goal, n = goal - length, n + 1
        if n:
            taken[length] = n
    return taken


class Packer:
    """The pool of one task. Yields sequences as lists of (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, pool_tokens: int = POOL_TOKENS):
        self.window, self.pool_tokens = window, pool_tokens
        self.pool: dict[int, list] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.held = 0

    def _put(self, piece) -> None:
        n = len(piece[2])
        if not self.pool[n]:
            insort(self.lengths, n)
        self.pool[n].append(piece)
        self.counts[n] = len(self.pool[n])
        self.held += n

    def _take(self, n: int):
        piece = self.pool[n].pop()
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.pool[n], self.counts[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.held -= n
        return piece

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        total, start = len(ids), 0
        while total - start >= self.window:
            yield [(doc, start, ids[start : start + self.window], total)]
            start += self.window
        if start < total:
            self._put((doc, start, ids[start:].copy(), total))
        if self.held > self.pool_tokens:
            while self.held > self.pool_tokens // 2:
                yield self._next()

    def _next(self) -> list:
        out = [self._take(self.lengths[-1])]
        room = self.window - len(out[0][2])
        for length, n in closest_fill(room, self.counts, self.lengths).items():
            out += [self._take(length) for _ in range(n)]
            room -= n * length
        if room and self.lengths:  # all that are left are longer than the gap
            doc, start, ids, total = self._take(self.lengths[0])
            out.append((doc, start, ids[:room], total))
            self._put((doc, start + room, ids[room:], total))
        return out

    def finish(self) -> Iterator[list]:
        while self.held >= self.window:
            yield self._next()
        rest = [self._take(self.lengths[-1]) for _ in range(sum(self.counts.values()))]
        left = sum(len(piece[2]) for piece in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                doc, start, ids, total = rest.pop(0)
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, ids[size:], total))
                    ids = ids[:size]
                out.append((doc, start, ids, total))
                size -= len(ids)
            yield out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows of `PIECES`: each document's ids, ended by `end_id`, dealt to sequences.

    `start` counts the document's ids before the piece and `offset` those before it
    in its sequence; `ids` are little-endian unsigned 32-bit. Sequences hold `window`
    ids, but for a task's last ones, which hold powers of two. `sequence_id` is the
    task's number times 2^32 plus a count, so it is unique but has gaps.

    A null or empty text is a document of `end_id` alone. A null identifier stays
    null; repeated rows are documents of their own. Only the two columns are read,
    so others may have any name. An empty table gives no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 32
        encode, packer = encoder(tokenizer).encode, Packer(window)
        held, rows, schema = 0, [], None

        def emit(force: bool = False):
            nonlocal held, rows
            if rows and (force or held > STEP_IDS):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), ARROW)]
                held, rows = 0, []
                yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

        def lay(sequence):
            nonlocal next_id, held
            offset = 0
            for doc, start, ids, total in sequence:
                n = len(ids)
                rows.append((doc, start, n, total, next_id, offset, ids.tobytes()))
                offset += n
            held += offset
            next_id += 1

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in steps(texts, STEP_BYTES):
                ids, ends = encode(texts.slice(a, b - a))
                for i in range(b - a):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for sequence in packer.add(names[a + i], own):
                        lay(sequence)
                yield from emit()
        for sequence in packer.finish():
            lay(sequence)
            yield from emit()
        yield from emit(True)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pack, PIECES)


STEP_IDS = 1 << 20
ARROW = [pa.int64()] * 6 + [pa.binary()]
