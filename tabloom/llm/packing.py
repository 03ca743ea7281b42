"""Order-preserving packing of documents into token windows.

The documents of a partition form one stream of ids. Cuts are allowed at document
ends (free), at sentence ends (small penalty) and, where neither is near, at fixed
steps (larger penalty). The cuts minimise padding plus penalties:

    f(j) = penalty(j) + min over i of f(i) + window - (p(j) - p(i)),  p(j) - p(i) <= window

As the padding is linear in p(i), the minimum over the sliding range comes from a
monotone queue: one push and one pop per cut. The tail of a stream, shorter than a
window, is cut at powers of two where that costs less than its padding.

A stream is one partition of the input, in its order, so nothing is shuffled and
a task holds one block of ids; a lost task is packed again from its input split.

Defined results: NULL text is an empty document, which is the end id alone; NULL,
repeated or tied ids are packed in the order of the input; an empty table gives no
rows; a text longer than a block is fed block by block; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices, text_or_empty

SENTENCE_PENALTY = 8
HARD_PENALTY = 64
#: Tokens between cuts that are forced where no sentence or document ends.
STEP = 32
#: Windows per block of the dynamic program; its last window is carried over.
BLOCK_WINDOWS = 64


def cut_points(
    length: int, sentence: np.ndarray, ends: np.ndarray, step: int = STEP
) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a stream of ``length`` ids, ascending from 0, and their penalties.

    Sentence ends closer than ``step`` / 2 to the one before are left out.
    """
    near = np.zeros(length + 1, np.int64)
    near[sentence] = 1
    soft = np.flatnonzero(near)
    if len(soft):
        soft = soft[np.diff(soft // (step // 2), prepend=-1) > 0]
    fixed = np.unique(np.concatenate([[0], soft, ends, [length]]).astype(np.int64))
    gaps = np.diff(fixed)
    parts = [fixed]
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        steps = (gaps[wide] - 1) // step
        first = np.repeat(fixed[wide], steps)
        nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        parts.append(first + nth * step)
    points = np.sort(np.concatenate(parts))
    penalty = np.full(length + 1, HARD_PENALTY, np.int64)
    penalty[soft] = SENTENCE_PENALTY
    penalty[ends] = 0
    penalty[0] = 0
    return points, penalty[points]


def best_cuts(points: list[int], penalties: list[int], window: int) -> list[int]:
    """Positions of the windows' ends with the least padding plus penalties."""
    n = len(points)
    total, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(points[0], 0)])  # (f(i) + p(i), i), ascending
    for j in range(1, n):
        p = points[j]
        while p - points[queue[0][1]] > window:
            queue.popleft()
        least, i = queue[0]
        total[j] = f = least + window - p + penalties[j]
        back[j] = i
        g = f + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(length: int, window: int) -> list[int]:
    """Ends of the sequences of a last window: whole, or cut at powers of two."""
    if length & (length - 1) == 0 or window - length <= HARD_PENALTY * (length.bit_count() - 1):
        return [length]
    ends, at = [], 0
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class Stream:
    """Packs one stream of documents; yields rows of pieces."""

    def __init__(self, window: int, ends: np.ndarray, first_sequence: int) -> None:
        self.window, self.ends = window, ends
        self.block = window * BLOCK_WINDOWS
        self.sequence = first_sequence
        self.pieces: list[list] = []  # [doc id, tokens of the document, start in it, ids]
        self.size = 0

    def feed(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            self.pieces.append([doc_id, len(ids), at, part])
            self.size += len(part)
            if self.size >= self.block:
                yield from self._pack(last=False)

    def close(self) -> Iterator[tuple]:
        if self.size:
            yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([p[3] for p in self.pieces])
        at = np.cumsum([len(p[3]) for p in self.pieces])
        done = np.array([p[2] + len(p[3]) == p[1] for p in self.pieces])
        sentence = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        points, penalties = cut_points(len(ids), sentence, at[done])
        cuts = best_cuts(points.tolist(), penalties.tolist(), self.window)
        final = cuts[-2] if len(cuts) > 1 else 0
        if last:
            cuts = cuts[:-1] + [final + e for e in tail_cuts(len(ids) - final, self.window)]
        else:
            cuts = cuts[:-1]
        starts = at - np.array([len(p[3]) for p in self.pieces])
        k, begin = 0, 0
        for end in cuts:
            while k < len(self.pieces) and starts[k] < end:
                doc_id, whole, start, part = self.pieces[k]
                a, b = max(begin, starts[k]), min(end, at[k])
                if b > a:
                    crc = zlib.crc32(part[a - starts[k] : b - starts[k]].tobytes())
                    yield (
                        doc_id, int(start + a - starts[k]), int(b - a), crc, whole,
                        self.sequence, int(a - begin),
                    )
                if at[k] > end:
                    break
                k += 1
            self.sequence += 1
            begin = end
        kept = []
        for (doc_id, whole, start, part), s in zip(self.pieces, starts, strict=True):
            if s + len(part) > begin:
                skip = max(0, begin - s)
                kept.append([doc_id, whole, int(start + skip), part[skip:]])
        self.pieces, self.size = kept, len(ids) - begin


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 4096,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(window, tokens.sentence_ends(tokenizer), TaskContext.get().partitionId() << 33)
        made: list[tuple] = []
        id_type = None
        for whole in batches:
            id_type = whole.schema.field(0).type
            for batch in slices(whole):
                for doc_id, content in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
                ):
                    ids = np.frombuffer(tokens.ids_bytes(content, tokenizer) + end, "<u4")
                    made.extend(stream.feed(doc_id, ids))
                if len(made) > 5_000:
                    yield _rows(made, id_type)
                    made = []
        made.extend(stream.close())
        if made:
            yield _rows(made, id_type)

    return docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(
        run, schema
    )


def _rows(made: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True))
    arrays = [pa.array(columns[0], id_type)]
    arrays += [pa.array(c, pa.int64()) for c in columns[1:]]
    return pa.RecordBatch.from_arrays(arrays, COLUMNS)
