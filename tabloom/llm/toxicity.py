"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

A text's features are its distinct words, word pairs and skip-grams (one and two
words left out), hashed to 32 bits. The model is trained on a sample of labelled
rows of at most ``TRAINING_ROWS`` (taken by hash, so it hangs on the ids alone).
Each of a fixed number of shards runs FTRL-proximal with per-coordinate rates from
the shared state; after a round the states are averaged per coordinate, weighted by
the squared gradients each shard saw. L1 leaves few weights, which are broadcast: every
one comes from ``MIN_ROWS`` of the sampled rows at least, so the sample bounds them.

Defined results: NULL and empty texts get the score of the intercept; without
labelled rows every score is 0.5; a label is 1 if any label row of the id says so;
NULL labels and ids are not learned from; repeated rows get a row each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import by_group
from .common import Memo, crc_bucket, hashes, mixed, plain_words, slices, stage, text_or_empty, word_hash

#: Bound of the labelled rows that are learned from.
TRAINING_ROWS = 24_000
SHARDS = 4
ROUNDS = 6
PASSES = 1
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.1
#: Features of fewer rows of a shard are not learned from in it.
MIN_ROWS = 3
BIAS = 0
#: Set in the hashes of words; the other half of the range is for pairs.
WORD_BIT = np.uint32(1 << 31)
#: Value of a pair or skip-gram; words weigh more, as pairs of one document are many.
PAIR_VALUE = 0.3
THRESHOLD = 0.7


def features(text: str, memo: Memo) -> np.ndarray:
    """Distinct hashed features, ascending, 1 and above; 0 is the intercept."""
    h = hashes(plain_words(text), memo)
    if not len(h):
        return np.empty(0, np.uint32)
    parts = [(mixed(h) >> np.uint64(32)).astype(np.uint32) | WORD_BIT]
    for gap in (1, 2, 3):
        if len(h) > gap:
            pair = mixed(h[:-gap] * np.uint64(31 + 2 * gap) + mixed(h[gap:]))
            parts.append((pair >> np.uint64(33)).astype(np.uint32))
    found = np.unique(np.concatenate(parts))
    return found[found != BIAS]


def values(found: np.ndarray) -> np.ndarray:
    """1 for words and the intercept, ``PAIR_VALUE`` for pairs and skip-grams."""
    return np.where((found >= WORD_BIT) | (found == BIAS), 1.0, PAIR_VALUE)


@dataclass
class Model:
    """Nonzero weights by feature, ascending; the state of training besides."""

    index: np.ndarray
    weight: np.ndarray
    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> Model:
        return cls(np.empty(0, np.uint32), *(np.empty(0, np.float64) for _ in range(3)))

    def score(self, found: np.ndarray) -> float:
        total = 0.0
        if len(self.index):
            at = np.searchsorted(self.index, found)
            at[at == len(self.index)] = 0
            known = self.index[at] == found
            total = (self.weight[at] * values(found))[known].sum()
            if self.index[0] == BIAS:
                total += self.weight[0]
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def weights(z: np.ndarray, n: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights; the intercept has no penalty."""
    l1 = np.where(intercept, 0.0, L1)
    l2 = np.where(intercept, 0.0, L2)
    return np.where(
        np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2)
    )


def frequent(found: list[np.ndarray], least: int) -> np.ndarray:
    """Values, ascending, that occur ``least`` times or more in arrays of distinct values."""
    every = np.concatenate(found)
    every.sort()
    apart = least - 1
    return np.unique(every[apart:][every[apart:] == every[: len(every) - apart]])


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Arrays of 32-bit features in a binary column, without copying them."""
    out = []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        out += [data[i:j].view(np.uint32) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return out


def learn(rows: list[tuple[np.ndarray, int]], start: Model, passes: int = PASSES):
    """Features, z, n and growth of n after ``passes`` over one shard."""
    if not rows:
        return (np.empty(0, np.uint32),) + tuple(np.empty(0) for _ in range(3))
    index = np.concatenate([[BIAS], frequent([r[0] for r in rows], MIN_ROWS)]).astype(np.uint32)
    z, n = np.zeros(len(index)), np.zeros(len(index))
    if len(start.index):
        at = np.searchsorted(start.index, index)
        at[at == len(start.index)] = 0
        known = start.index[at] == index
        z[known], n[known] = start.z[at[known]], start.n[at[known]]
    before = n.copy()
    worth = values(index)
    dense = []
    for found, label in rows:
        at = np.searchsorted(index, found)
        at[at == len(index)] = 0
        own = at[index[at] == found]
        dense.append((np.concatenate([[0], own]).astype(np.int32), label))
    intercept = np.zeros(len(index), bool)
    intercept[0] = True
    for _ in range(passes):
        for at, label in dense:
            w = weights(z[at], n[at], intercept[at])
            x = worth[at]
            g = (1 / (1 + np.exp(-np.clip((w * x).sum(), -50, 50))) - label) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    keep = weights(z, n, intercept) != 0
    keep[0] = True
    return index[keep], z[keep], n[keep], (n - before)[keep]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, place, label, text) -> (shard, place, label, features as bytes)."""
    memo = Memo(word_hash)
    for whole in batches:
        for batch in slices(whole):
            found = [features(t, memo).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(found, pa.binary())],
                ["shard", "place", "label", "found"],
            )


def training_rows(docs: DataFrame, labels: DataFrame, target: str, key: str, text: str) -> DataFrame:
    """(shard, place, label, text) of the sample; ids whose crc32 mod 3 is 1 are held out."""
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull())
        .filter(crc_bucket(key, 3) != 1)
        .groupBy(F.col(key).alias("id")).agg(F.max(F.col(target).cast("int")).alias("label"))
        .withColumn("draw", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)))
    )
    total = known.count()
    # Three in four of the bound are drawn, so that the draw stays below it.
    share = min(1 << 20, int((1 << 20) * 0.75 * TRAINING_ROWS / max(1, total)))
    # At most TRAINING_ROWS ids: small enough to be sent to every task.
    sample = F.broadcast(known.filter(F.col("draw") < share).select("id", "label"))
    return docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")).join(
        sample, "id"
    ).select(
        F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SHARDS)).alias("shard"),
        F.xxhash64("id", F.lit(6)).alias("place"), "label", "text",
    )


def train(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", key: str = "doc_id", text: str = "text"
) -> Model:
    spark = docs.sparkSession
    # Texts are parsed once; the rounds read features.
    sample = stage(
        training_rows(docs, labels, target, key, text).mapInArrow(
            _parsed, "shard long, place long, label int, found binary"
        ),
        "toxic-sample",
    )
    # Dealt to shards once: the rounds read the kept partitions, a lost one is dealt again.
    placed = by_group(sample, SHARDS, "shard").persist(StorageLevel.DISK_ONLY)
    model = Model.empty()
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def one_shard(rows: pa.Table) -> pa.Table:
            parsed = _views(rows["found"])
            ties = [xxhash.xxh64_intdigest(f) for f in parsed]
            order = sorted(range(len(parsed)), key=list(zip(rows["place"].to_pylist(), ties, strict=True)).__getitem__)
            known = rows["label"].to_pylist()
            index, z, n, grown = learn([(parsed[i], known[i]) for i in order], shared.value)
            return pa.table({"feature": index.astype(np.int64), "z": z, "n": n, "grown": grown})

        states = placed.groupBy("shard").applyInArrow(
            one_shard, "feature long, z double, n double, grown double"
        )
        weight = F.col("grown") + F.lit(1e-12)
        merged = (
            states.groupBy("feature")
            .agg(
                (F.sum(F.col("z") * weight) / F.sum(weight)).alias("z"),
                (F.sum(F.col("n") * weight) / F.sum(weight)).alias("n"),
            )
            .toPandas().sort_values("feature")
        )
        index = merged["feature"].to_numpy().astype(np.uint32)
        z, n = merged["z"].to_numpy(), merged["n"].to_numpy()
        model = Model(index, weights(z, n, index == BIAS), z, n)
    placed.unpersist()
    return model


def score(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, score, predicted) of every row, besides the columns ``keep``."""
    # Scoring needs the nonzero weights alone.
    used = model.weight != 0
    none = np.empty(0)
    slim = Model(model.index[used], model.weight[used], none, none)
    shared = docs.sparkSession.sparkContext.broadcast(slim)
    others = [c for c in dict.fromkeys((key, *keep)) if c != text]
    made = docs.select(*others, *([text] if text in keep else []), text_or_empty(text).alias("__text"))
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields if f.name != "__text"
    ) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, model = Memo(word_hash), shared.value
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                scores = [model.score(features(t, memo)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(batch.num_columns - 1)]
                    + [
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    ],
                    [*batch.schema.names[:-1], "score", "predicted"],
                )

    return made.mapInArrow(run, schema)
