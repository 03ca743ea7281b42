"""Benchmark decontamination by latent semantic retrieval.

Passages are weighted by TF-IDF over the benchmark's vocabulary (the only terms that can
link a passage to an item); document frequencies count all passages of all documents.
A distributed randomised SVD of all passages and all items gives a latent basis. Then every window of every document is projected, with whitened
coordinates, and compared with the items of its length class by cosine. Candidates are
checked on the whole window: longest common subsequence with the item (where enough of the
item's words occur at all), and how much of the item's whole answer occurs.

Windows are three blocks long and start at every block; an item of a length class fits
into two blocks, so some window holds any copy of it whole.

Items are taken in groups of ``ITEMS_AT_ONCE``, so what is broadcast (vocabulary, basis
and item vectors) is bounded.

Items of fewer than ``MIN_WORDS`` words have no passage to speak of: they are found where a
whole line of a document is the item, word for word.

Defined results: NULL and empty texts and items match nothing; repeated document rows are reported once per id; equal items are
all reported; an empty documents or benchmark table gives no rows; other columns are
ignored. Without an ``answer`` column the item's last sentence is its answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_words, slices, stage, text_or_empty

PASSAGE = 64
#: Latent dimensions; a quarter of the rows at most, else rows lie apart by themselves.
RANK, EXTRA, POWER_STEPS, SEED = 128, 8, 1, 41
ITEMS_AT_ONCE = 20_000
MIN_WORDS = 5
BLOCK = 8
#: Candidates: cosine in the latent space.
MIN_COSINE = 0.35
#: Verdict: share of the item in the common subsequence, with and without its answer.
MIN_LCS, MIN_ANSWER, SURE_LCS = 0.6, 0.5, 0.8
#: Passages multiplied at once, their terms that are so as dense columns, and terms a row of partial sums.
_ROWS, _DENSE, _PART = 1024, 256, 64
#: Tasks that make partial sums, unless these would take more room than the words.
_TASKS = (8, 512)
#: Words turned into latent blocks at once.
_CHUNK = 1 << 15
#: Cosines of windows and items computed at once.
_PRODUCTS = 1 << 21


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Terms(dict):
    """Index of a benchmark word; all others share the last index."""

    def __missing__(self, word: bytes) -> int:
        return self.other

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(words))
        self.other = len(words)

    def ids(self, text: str) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))


@dataclass
class Item:
    item_id: object
    ids: np.ndarray
    answer: list[int]


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"[.!?]+(?:\s+|$)", text) if plain_words(p)]
    return parts[-1] if parts else ""


def unit_rows(ids: np.ndarray, idf: np.ndarray, ends: np.ndarray):
    """Sparse unit TF-IDF rows of passages: (row, term, weight). ``ends``: their ends in ids."""
    rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    known = ids < len(idf)
    pairs, counts = np.unique(rows[known] * np.int64(len(idf)) + ids[known], return_counts=True)
    row, term = np.divmod(pairs, len(idf))
    weight = counts * idf[term]
    norm = np.sqrt(np.bincount(row, weight**2, len(ends)))
    return row, term, weight / np.maximum(norm[row], 1e-12)


def passage_ends(texts: list[np.ndarray]) -> np.ndarray:
    """Ends of the passages of some texts laid end to end; no text is empty."""
    ends = [np.append(np.arange(PASSAGE, len(t), PASSAGE), len(t)) for t in texts]
    starts = np.cumsum([0, *map(len, texts[:-1])])
    return np.concatenate([e + at for e, at in zip(ends, starts, strict=True)])


def add_times(row, term, weight, matrix: np.ndarray, out: np.ndarray) -> None:
    """Add sparse rows times a dense matrix to ``out``; entries are sorted by row.

    The first entries of all rows are added at once, then the second ones, and so on.
    """
    if not len(row):
        return
    first = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
    for one in np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1]):
        out[row[one]] += matrix[term[one]] * weight[one, None]


class Products:
    """Sum of A'(A matrix), or the Gram matrix of A matrix, over sparse unit rows A.

    The columns of the most frequent terms hold most entries and are multiplied as dense ones.
    """

    def __init__(self, idf: np.ndarray, matrix: np.ndarray, gram: bool) -> None:
        self.idf, self.gram = idf, gram
        self.order = np.argsort(idf, kind="stable")
        self.place = np.empty(len(idf), np.int64)
        self.place[self.order] = np.arange(len(idf))
        self.matrix = matrix[self.order]
        self.total = np.zeros((matrix.shape[1] if gram else len(idf), matrix.shape[1]))

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        for at in range(0, len(ends), _ROWS):
            start = ends[at - 1] if at else 0
            cut = ends[at : at + _ROWS] - start
            self._add(ids[start : start + cut[-1]], cut)

    def _add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        row, term, weight = unit_rows(ids, self.idf, ends)
        term = self.place[term]
        often = term < _DENSE
        dense = np.zeros((len(ends), min(_DENSE, len(self.idf))))
        dense[row[often], term[often]] = weight[often]
        row, term, weight = row[~often], term[~often], weight[~often]
        projected = dense @ self.matrix[:_DENSE]
        add_times(row, term, weight, self.matrix, projected)
        if self.gram:
            self.total += projected.T @ projected
            return
        self.total[:_DENSE] += dense.T @ projected
        order = np.argsort(term, kind="stable")
        add_times(term[order], row[order], weight[order], projected, self.total)

    def sums(self) -> np.ndarray:
        if self.gram:
            return self.total
        out = np.empty_like(self.total)
        out[self.order] = self.total
        return out


class Basis:
    """Projection of windows of term ids into the whitened latent space."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray) -> None:
        self.idf = idf
        # The last row is that of unknown words.
        self.latent = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)

    def blocks(self, ids: np.ndarray) -> np.ndarray:
        """Latent sums of blocks of ``BLOCK`` words; there are only whole blocks."""
        parts = [
            self.latent[ids[at : at + _CHUNK]].reshape(-1, BLOCK, self.latent.shape[1]).sum(1)
            for at in range(0, len(ids), _CHUNK)
        ]
        return np.concatenate(parts)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)


class Searcher:
    """Items by length class, against all windows of some documents."""

    def __init__(self, items: list[Item], basis: Basis) -> None:
        self.items, self.basis, self.classes = items, basis, {}
        self.other = len(basis.idf)
        latent = np.vstack([basis.latent[i.ids].sum(0) for i in items])
        latent /= _lengths(latent)[:, None]
        for n, item in enumerate(items):
            level = 0
            while len(item.ids) > 2 * BLOCK << level:
                level += 1
            self.classes.setdefault(level, []).append(n)
        self.latent = {c: latent[m].T.copy() for c, m in self.classes.items()}
        self.unit = BLOCK << max(self.classes)
        # Words of an item with their places, and how many places a subsequence needs.
        self.words = [(i.ids.tolist(), Counter(i.ids.tolist())) for i in items]
        self.need = [MIN_LCS * len(i.ids) for i in items]

    def find(self, documents: list[np.ndarray]) -> list[dict[int, tuple[float, float, float]]]:
        """Per document the best (lcs share, cosine, answer share) of its confirmed items."""
        found: list[dict] = [{} for _ in documents]
        # Unknown words fill each document up to whole blocks, and two blocks more, so
        # that no window reaches into the next one.
        sizes = np.array([(-(-len(d) // self.unit) + 2) * self.unit for d in documents])
        ends = np.cumsum(sizes)
        stream = np.full(sizes.sum(), self.other, np.uint32)
        for d, at in zip(documents, ends - sizes, strict=True):
            stream[at : at + len(d)] = d
        blocks = self.basis.blocks(stream)
        for level, members in self.classes.items():
            size = BLOCK << level
            sums = blocks.reshape(-1, 1 << level, blocks.shape[1]).sum(1)
            windows = sums[:-2] + sums[1:-1] + sums[2:]
            for w, m, cosine in self.near(windows, level):
                place = int(np.searchsorted(ends, w * size, side="right"))
                if w * size >= ends[place] - sizes[place] + len(documents[place]):
                    continue  # it starts in the filling and sees the next document
                words = stream[w * size : (w + 3) * size].tolist()
                there = set(words)
                own = found[place]
                for n, c in zip(m, cosine, strict=True):
                    n = members[n]
                    checked = self.check(n, words, there)
                    if checked:
                        best = (checked[0], c, checked[1])
                        own[n] = max(own.get(n, best), best)
        return found

    def near(self, windows: np.ndarray, level: int) -> Iterator[tuple[int, list, list]]:
        """Windows with the places and cosines of the items of a class near to them."""
        latent = self.latent[level]
        step = max(16, _PRODUCTS // latent.shape[1])
        for at in range(0, len(windows), step):
            part = windows[at : at + step]
            length = _lengths(part)
            close = part @ latent
            w, m = np.nonzero(close >= MIN_COSINE * length[:, None])
            if len(w):
                cosine = close[w, m] / length[w]
                cut = np.flatnonzero(np.diff(w)) + 1
                for k, items, c in zip(
                    w[np.r_[0, cut]].tolist(), np.split(m, cut), np.split(cosine, cut), strict=True
                ):
                    yield at + k, items.tolist(), c.tolist()

    def check(self, n: int, words: list[int], there: set[int]) -> tuple[float, float] | None:
        """Shares of an item and of its answer in a window, if they make a leak."""
        ids, places = self.words[n]
        # No subsequence is longer than the places whose words occur.
        if sum(map(places.__getitem__, places.keys() & there)) < self.need[n]:
            return None
        share = lcs(ids, words) / len(ids)
        wanted = self.items[n].answer
        answer = lcs(wanted, words) / len(wanted) if wanted else 1.0
        if share >= SURE_LCS or share >= MIN_LCS and answer >= MIN_ANSWER:
            return share, answer
        return None


def _encode(terms: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        for whole in batches:
            for batch in slices(whole):
                ids = [known.ids(t).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"]
                )

    return run


def _decoded(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in batch.column(column).to_pylist()]


def _frequencies(size: int):
    """Passages per term, and at -1 all passages; one set of rows per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(size + 1, np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                texts = [t for t in _decoded(batch, 0) if len(t)]
                if not texts:
                    continue
                base = 0
                rows = []
                for t in texts:
                    rows.append(np.arange(len(t)) // PASSAGE + base)
                    base += -(-len(t) // PASSAGE)
                pairs = np.unique(
                    np.concatenate(rows) * np.int64(size + 1) + np.concatenate(texts)
                )
                counts += np.bincount(pairs % (size + 1), minlength=size + 1)
                passages += base
        terms = np.flatnonzero(counts[:size])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-1], terms]).astype(np.int64)),
                pa.array(np.concatenate([[passages], counts[terms]]).astype(np.int64)),
            ],
            ["term", "n"],
        )

    return run


def _product(idf: np.ndarray, matrix: np.ndarray, gram: bool):
    """The sums of ``Products`` over all passages of a task, by blocks of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(idf, matrix, gram)
        for whole in batches:
            for batch in slices(whole):
                texts = [t for t in _decoded(batch, 0) if len(t)]
                if texts:
                    products.add(np.concatenate(texts), passage_ends(texts))
        total = products.sums()
        parts = range(0, len(total), _PART)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p // _PART for p in parts], pa.int32()),
                pa.array([total[p : p + _PART].tobytes() for p in parts], pa.binary()),
            ],
            ["part", "content"],
        )

    return run


def _summed(encoded: DataFrame, items: list[np.ndarray], idf: np.ndarray, matrix: np.ndarray, gram: bool) -> np.ndarray:
    """The sum over all tasks, block by block on the executors, and over the items; vocabulary x rank numbers."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, [np.frombuffer(c) for c in rows["content"]])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "content": [total.tobytes()]})

    parts = (
        encoded.select("ids").mapInArrow(_product(idf, matrix, gram), "part int, content binary")
        .groupBy("part").applyInPandas(add, "part int, content binary").collect()
    )
    own = Products(idf, matrix, gram)
    own.add(np.concatenate(items), np.cumsum([len(i) for i in items]))
    total = own.sums()
    for r in parts:
        at = r["part"] * _PART
        total[at : at + _PART] += np.frombuffer(r["content"]).reshape(-1, matrix.shape[1])
    return total


def latent_basis(encoded: DataFrame, passages: int, items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of the rows of all passages and items over their singular values."""
    rank = max(1, min(RANK, (passages + len(items)) // 4))
    width = min(rank + EXTRA, len(idf))
    # A task's partial sums are as large as the vocabulary, however few words it reads.
    room = passages * PASSAGE * 4 // (len(idf) * width * 8)
    encoded = encoded.coalesce(max(_TASKS[0], min(_TASKS[1], room)))
    matrix = np.random.default_rng(SEED).standard_normal((len(idf), width))
    for _ in range(POWER_STEPS + 1):
        matrix = np.linalg.qr(_summed(encoded, items, idf, matrix, gram=False))[0]
    values, vectors = np.linalg.eigh(_summed(encoded, items, idf, matrix, gram=True))
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    keep = values > max(values[0], 1e-12) * 1e-9
    return (matrix @ vectors[:, keep]) / np.sqrt(values[keep])


def _items(rows, has_answer: bool, terms: Terms) -> list[Item]:
    items = []
    for r in rows:
        text = r["text"] or ""
        answer = r["answer"] if has_answer and r["answer"] else last_sentence(text)
        ids = terms.ids(text)
        items.append(Item(r["item_id"], ids, terms.ids(answer).tolist()))
    return items


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): items found in documents."""
    spark = docs.sparkSession
    has_answer = "answer" in benchmark.columns
    bench = benchmark.select(
        F.col(item_key).alias("item_id"), F.col(item_text).cast("string").alias("text"),
        *([F.col("answer").cast("string").alias("answer")] if has_answer else []),
    ).filter(F.col("text").isNotNull())
    texts = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kinds = [f.dataType.simpleString() for f in (texts.schema[0], bench.schema[0])]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs double, answer double"
    groups = max(1, -(-bench.count() // ITEMS_AT_ONCE))
    found = [spark.createDataFrame([], schema)]
    for group in range(groups):
        # At most ITEMS_AT_ONCE items, give or take the spread of a hash.
        rows = bench.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == group).collect()
        short = [r for r in rows if 0 < len(plain_words(r["text"])) < MIN_WORDS]
        rows = [r for r in rows if len(plain_words(r["text"])) >= MIN_WORDS]
        if rows:
            found.append(_leaks_of(spark, texts, rows, has_answer, schema))
        if short:
            found.append(_short_leaks(spark, texts, short, schema))
    every = reduce(DataFrame.unionAll, found)
    return every.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("lcs", "cosine", "answer")).alias("best")
    ).select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answer")


def _short_leaks(spark, texts: DataFrame, rows, schema: str) -> DataFrame:
    """Short items that are a whole line of a document."""
    lines: dict[bytes, list] = {}
    for r in rows:
        lines.setdefault(b" ".join(plain_words(r["text"])), []).append(r["item_id"])
    shared = spark.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        longest = max(map(len, wanted))
        for whole in batches:
            for batch in slices(whole):
                at, items = [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    own = set()
                    for line in text.splitlines():
                        words = b" ".join(plain_words(line))
                        if len(words) <= longest:
                            own.update(wanted.get(words, ()))
                    at += [n] * len(own)
                    items += sorted(own, key=str)
                one = pa.array(np.ones(len(at)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array(items) if items else pa.array([], pa.int64()), one, one, one,
                    ],
                    ["doc_id", "item_id", "cosine", "lcs", "answer"],
                )

    return texts.mapInArrow(run, schema)


def _leaks_of(spark, texts: DataFrame, rows, has_answer: bool, schema: str) -> DataFrame:
    words: set[bytes] = set()
    for r in rows:
        words.update(plain_words(r["text"]), plain_words((r["answer"] or "") if has_answer else ""))
    terms = sorted(words)
    kind = texts.schema[0].dataType.simpleString()
    encoded = stage(texts.mapInArrow(_encode(terms), f"doc_id {kind}, ids binary"), "encoded")
    counts = {
        r["term"]: r["n"] for r in encoded.select("ids").mapInArrow(
            _frequencies(len(terms)), "term long, n long"
        ).groupBy("term").agg(F.sum("n").alias("n")).collect()
    }
    passages = counts.pop(-1, 0)
    frequency = np.zeros(len(terms))
    for t, n in counts.items():
        frequency[t] = n
    idf = np.log((passages + 1) / (frequency + 1)) + 0.01
    items = _items(rows, has_answer, Terms(terms))
    basis = Basis(idf, latent_basis(encoded, passages, [i.ids for i in items], idf))
    shared = spark.sparkContext.broadcast((items, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value)
        for whole in batches:
            for batch in slices(whole):
                at, made = [], []
                for n, own in enumerate(searcher.find(_decoded(batch, 1))):
                    for item, best in own.items():
                        at.append(n)
                        made.append((searcher.items[item].item_id, best[1], best[0], best[2]))
                columns = list(zip(*made, strict=True)) if made else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array(columns[0]) if made else pa.array([], pa.int64()),
                        *[pa.array(c, pa.float64()) for c in columns[1:]],
                    ],
                    ["doc_id", "item_id", "cosine", "lcs", "answer"],
                )

    return encoded.mapInArrow(run, schema)
