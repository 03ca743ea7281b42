"""Language identification by compression.

Every learned language has a raw-content zstandard dictionary, made of a bounded
sample of its texts. A text is cut into blocks, each block is compressed with every
dictionary, and the language with the fewest bytes wins. A narrow margin marks the
guess as rejected (``accepted`` is false); the guess itself stays.

Defined results: NULL texts and texts without a letter are ``und`` with score 0;
without any learned language all texts are ``und``; ties go to the alphabetically
first language; rows of NULL or held-out language are not learned from; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, slices

#: Documents drawn per language for its dictionary, and the dictionary's bytes.
SAMPLE_ROWS = 300
DICTIONARY_BYTES = 256 * 1024
#: Largest part of one document in a dictionary, so that no document fills it.
DOCUMENT_BYTES = 4 * 1024
#: Bytes of text compressed at once.
BLOCK_BYTES = 8 * 1024
#: Lazy matching of five bytes and more over the dictionary and a block.
MATCHING = dict(
    window_log=19, hash_log=18, chain_log=18, search_log=3, min_match=5,
    strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_dict_id=0,
)
#: Relative margin between the best two sizes below which a guess is rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"


def learn(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> dict[str, bytes]:
    """Dictionary content per language, from rows whose crc32 mod 5 isn't 0."""
    rows = (
        docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
        .filter((F.coalesce(crc_bucket("id", 5), F.lit(-1)) != 0) & F.col("lang").isNotNull())
        .filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
        .withColumn("draw", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)))
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # One row per language, and at most twice SAMPLE_ROWS expected texts for each.
    drawn = rows.join(F.broadcast(sizes), "lang").filter(
        F.col("draw") < (F.lit(float(1 << 30)) * 2 * SAMPLE_ROWS / F.col("n"))
    )
    # Pieces from the middle: what a dictionary takes of a text is bounded.
    piece = F.expr(f"substring(text, greatest(1, int((length(text) - {DOCUMENT_BYTES}) / 2)), {DOCUMENT_BYTES})")
    found: dict[str, list[str]] = {}
    for r in drawn.select("lang", "draw", piece.alias("piece")).distinct().orderBy(
        "lang", "draw", "piece"
    ).toLocalIterator():
        found.setdefault(r["lang"], []).append(r["piece"])
    made = {}
    for language, pieces in found.items():
        content, size = [], 0
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")[: DICTIONARY_BYTES - size]
            content.append(b)
            size += len(b)
            if size >= DICTIONARY_BYTES:
                break
        made[language] = b"\n".join(content)
    return made


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.compressors = []
        for language in self.languages:
            content = zstandard.ZstdCompressionDict(
                dictionaries[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            settings = zstandard.ZstdCompressionParameters(**MATCHING)
            content.precompute_compress(compression_params=settings)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=content, compression_params=settings)
            )

    def sizes(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors])

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin suffices."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        share = np.exp(-(sizes - sizes[best]) / (0.005 * sizes[best] + 2.0))
        others = np.delete(sizes, best)
        margin = (others.min() - sizes[best]) / max(1, others.min()) if len(others) else 1.0
        return self.languages[best], float(1 / share.sum()), bool(margin >= MIN_MARGIN)


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, lang_pred, score, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for whole in batches:
            for batch in slices(whole):
                found = [classifier.classify(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.bool_()),
                    ],
                    [key, "lang_pred", "score", "accepted"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, accepted boolean")
