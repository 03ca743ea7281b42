"""Quality scores by compression with a dictionary of good and one of bad texts.

Of the labelled rows one half (by a hash of the id) fills two raw-content zstandard
dictionaries, one of good and one of bad texts. A text is cut into blocks and each block is
compressed with both. What counts is the normalised difference of the two sizes,
``(bad - good) / (bad + good)``, beside the size per byte with the good dictionary, as texts
that repeat themselves are small with either. A logistic curve, fitted on the other half of
the labelled rows, turns both into a probability that the label is 1.

Bounds on rows that are learned from: ``DICTIONARY_ROWS`` texts per label, of which a middle
piece of ``PIECE_CHARS`` characters each and ``DICTIONARY_BYTES`` in all are taken, and
``CALIBRATION_ROWS`` texts for the curve. Texts that are scored are read whole.

Defined results: NULL and empty texts have no difference and get the curve's value there;
without rows of both labels in the dictionaries all scores are the share of label 1 among the
learned rows (0.5 without any); a label is the largest of an id's label rows; NULL labels and ids
are not learned from; repeated rows get a row each; equal draws are ordered by the text; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, slices, stage, text_or_empty

#: Bounds of the rows that are learned from; see above.
DICTIONARY_ROWS = 600
CALIBRATION_ROWS = 8_000
PIECE_CHARS = 2_048
DICTIONARY_BYTES = 512 * 1024
#: Bytes of text compressed at once: small, so that the dictionary says more than the text before.
BLOCK_BYTES = 1_024
MATCHING = dict(
    window_log=20, hash_log=18, chain_log=18, search_log=3, min_match=5,
    strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_dict_id=0,
)
THRESHOLD = 0.7
#: Ridge of the calibration curve.
RIDGE = 0.01
DRAWS = 1 << 30


@dataclass
class Model:
    """Dictionary contents by label, and the calibration curve over (difference, rate)."""

    good: bytes = b""
    bad: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(2))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2))

    @property
    def usable(self) -> bool:
        return bool(self.good) and bool(self.bad)

    def score(self, measures: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows (difference, rate)."""
        x = (measures - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -50, 50)))


class Measure:
    """Sizes of a text with both dictionaries."""

    def __init__(self, model: Model) -> None:
        self.usable = model.usable
        self.mean_rate = float(model.mean[1])
        self.compressors = []
        for content in (model.good, model.bad) if self.usable else ():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters(**MATCHING)
            made.precompute_compress(compression_params=settings)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=made, compression_params=settings)
            )
        # Bytes of a frame around no content.
        self.frame = len(self.compressors[0].compress(b"")) if self.usable else 0

    def sizes(self, data: bytes) -> tuple[int, int]:
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        return good - self.frame * len(blocks), bad - self.frame * len(blocks)

    def of(self, text: str) -> tuple[float, float]:
        """Normalised difference and rate; an empty text has the mean rate."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.usable or not data:
            return 0.0, self.mean_rate
        good, bad = self.sizes(data)
        return (bad - good) / max(1, bad + good), good / len(data)


def labelled(
    docs: DataFrame, labels: DataFrame, target: str, key: str, text: str, held_out: Column
) -> DataFrame:
    """(part, label, place, text): the sampled rows for dictionaries ('d') and the curve ('c')."""
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(key).alias(key)).agg(F.max(F.col(target).cast("int")).alias("label"))
        .filter(~F.coalesce(held_out, F.lit(True)))
        .withColumn("label", (F.col("label") >= 1).cast("int"))
        .withColumn("part", F.when(F.pmod(F.xxhash64(key, F.lit(21)), F.lit(2)) == 0, "d").otherwise("c"))
        .withColumn("draw", F.pmod(F.xxhash64(key, F.lit(22)), F.lit(DRAWS)))
    )
    # At most four rows.
    sizes = {(r["part"], r["label"]): r["count"] for r in known.groupBy("part", "label").count().collect()}
    curve = sum(n for (part, _), n in sizes.items() if part == "c")
    wanted = F.lit(False)
    for (part, label), n in sizes.items():
        bound = DICTIONARY_ROWS if part == "d" else CALIBRATION_ROWS * n / curve
        # Three in four of the bound are drawn, so that the draw stays below it.
        share = DRAWS if n <= 0.75 * bound else int(DRAWS * 0.75 * bound / n)
        wanted = wanted | ((F.col("part") == part) & (F.col("label") == label) & (F.col("draw") < share))
    sample = F.broadcast(known.filter(wanted).select(F.col(key).alias("id"), "part", "label"))
    return docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")).join(sample, "id").select(
        "part", "label", F.xxhash64("id", F.lit(23)).alias("place"), "text"
    )


def dictionary(pieces: list[str]) -> bytes:
    content, size = [], 0
    for piece in pieces:
        b = piece.encode("utf-8", "surrogatepass")[: DICTIONARY_BYTES - size]
        content.append(b)
        size += len(b) + 1
        if size >= DICTIONARY_BYTES:
            break
    return b"\n".join(content)


def fit_curve(measures: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and scales of a logistic curve, by Newton's method with a small ridge."""
    mean, scale = measures.mean(axis=0), measures.std(axis=0)
    scale[scale == 0] = 1.0
    x = np.column_stack([np.ones(len(measures)), (measures - mean) / scale])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (p - labels) + RIDGE * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, scale


def train(
    docs: DataFrame, labels: DataFrame, target: str = "quality", key: str = "doc_id", text: str = "text",
    held_out: Column | None = None,
) -> Model:
    """Dictionaries and curve. Rows for which ``held_out`` holds (crc32 mod 4 is 2) are not read."""
    apart = crc_bucket(key, 4) == 2 if held_out is None else held_out
    sample = stage(labelled(docs, labels, target, key, text, apart), "quality-sample")
    piece = F.expr(f"substring(text, greatest(1, int((length(text) - {PIECE_CHARS}) / 2)), {PIECE_CHARS})")
    found: dict[int, list[str]] = {0: [], 1: []}
    # Bounded by DICTIONARY_ROWS and PIECE_CHARS.
    for r in (
        sample.filter("part = 'd' AND length(text) > 0").select("label", "place", piece.alias("piece"))
        .distinct().orderBy("label", "place", "piece").toLocalIterator()
    ):
        found[r["label"]].append(r["piece"])
    model = Model(dictionary(found[1]), dictionary(found[0]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(shared.value)
        for whole in batches:
            for batch in slices(whole):
                rows = [measure.of(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array([r[i] for r in rows], pa.float64()) for i in (0, 1))],
                    ["label", "difference", "rate"],
                )

    # Bounded by CALIBRATION_ROWS; without a dictionary only the labels count.
    used = sample.filter("part = 'c' AND length(text) > 0") if model.usable else sample
    rows = used.select("label", "text").mapInArrow(
        run, "label int, difference double, rate double"
    ).orderBy("label", "difference", "rate").toPandas()
    known = rows["label"].to_numpy().astype(float)
    if not model.usable or not len(known):
        share = known.mean() if len(known) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(weights=np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    model.weights, model.mean, model.scale = fit_curve(rows[["difference", "rate"]].to_numpy(), known)
    return model


def score(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(key, score, predicted, difference) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias(key), text_or_empty(text).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        measure = Measure(model)
        for whole in batches:
            for batch in slices(whole):
                measures = np.array([measure.of(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
                scores = model.score(measures)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(scores, pa.float64()),
                        pa.array((scores >= threshold).astype(np.int32), pa.int32()),
                        pa.array(measures[:, 0], pa.float64()),
                    ],
                    [key, "score", "predicted", "difference"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, score double, predicted int, difference double")
