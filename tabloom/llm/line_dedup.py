"""Line removal with a log-template tree.

A line's tokens are its words, and single characters in scripts without blanks, where two
count as a word; a token with a digit is a variable field. The tree has
a fixed depth: number of tokens, then the first ``DEPTH`` tokens. The lines of a leaf
that are equal up to fields are a form. Forms are taken by their first document; one that
has the same plain tokens as an earlier template's first form at ``CONSTANT_SHARE`` of its
positions or more is an instance of that template (the earliest, if of several), any other
starts a template. Fields are no constants: a line with too many of them for a template
recurs only word for word. A template that recurs across documents is dropped everywhere
but in its first document (the one of the smallest id).

In every leaf the earliest form always starts a template, so all others are compared with
it by a join, ``CENTRE_ROUNDS`` times over. What is left then is dealt by leaf and read in
order, with the first forms of the leaf's templates in memory, indexed by segments.

Defined results: NULL text stays NULL with no lines; blank lines and lines of fewer
than ``MIN_TOKENS`` words recur by chance and stay, unless all that is left of a document
are short lines that an earlier document has too, word for word, when the text becomes
empty; a short line stays in its first document always; a line repeated inside one document
only stays; rows of one id count as one document; lines of a NULL id are dropped if
they recur elsewhere; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Memo, hashes, slices, small_or_not, stage

DEPTH = 3
MIN_TOKENS = 5
CONSTANT_SHARE = 0.8
#: Rounds in which the open forms of a leaf meet its earliest one.
CENTRE_ROUNDS = 2
_DIGIT = re.compile(rb"[0-9]")
_FIELD = b"<*>"
#: Thai, Lao, Tibetan, Burmese, Khmer, Tai and Javanese letters, kana and Han characters.
_UNSPACED = re.compile(
    "[\u0e01-\u0e4e\u0e80-\u0ece\u0f00-\u0fff\u1000-\u109f\u1780-\u17d3\u1950-\u19df\u1a20-\u1aad"
    "\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uaa60-\uaa7f\uf900-\ufaff"
    "\uff66-\uff9f\U00020000-\U0003ffff]"
)


def _token_hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(_FIELD if _DIGIT.search(token) else token)


def parse(line: str) -> tuple[list[bytes], bool]:
    """Tokens of a line, and whether they are too few to be judged as a template."""
    if line.isascii():
        tokens = line.encode().split()
        return tokens, len(tokens) < MIN_TOKENS
    line, single = _UNSPACED.subn(r" \g<0> ", line)
    tokens = line.encode("utf-8", "surrogatepass").split()
    return tokens, 2 * len(tokens) - single < 2 * MIN_TOKENS


def exact(tokens: list[bytes]) -> int:
    """Hash of the tokens as they are, fields too."""
    return xxhash.xxh64_intdigest(b" ".join(tokens), 1) - (1 << 63)


def path(tokens: np.ndarray, leading: int) -> int:
    """Hash of the number of tokens and the leading ones."""
    return xxhash.xxh64_intdigest(tokens[:leading].tobytes(), len(tokens)) - (1 << 63)


def _narrow(tokens: np.ndarray, field: np.uint64) -> np.ndarray:
    """Tokens as 32 bits, fields and only they as 0."""
    short = np.maximum(tokens >> np.uint64(32), np.uint64(1))
    return np.where(tokens == field, np.uint64(0), short).astype("<u4")


def constants(n: int) -> int:
    """Positions of n that a form and its template have in common at least."""
    return math.ceil(CONSTANT_SHARE * n - 1e-9)


def _lines(with_tokens: bool):
    """doc -> (doc_id, line, short, leaf, form) or (form, tokens).

    Short lines and lines of too many fields have no leaf and no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_token_hash)
        field = np.uint64(_token_hash(_FIELD))
        for whole in batches:
            for batch in slices(whole):
                rows, numbers, shorts, leaves, forms, tokens = [], [], [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for number, line in enumerate(text.split("\n")):
                        words, short = parse(line)
                        if not words or short and with_tokens:
                            continue
                        found = hashes(words, memo)
                        plain = not short and np.count_nonzero(found != field) >= constants(len(found))
                        if with_tokens:
                            if plain:
                                forms.append(path(found, len(found)))
                                tokens.append(_narrow(found, field).tobytes())
                            continue
                        rows.append(row)
                        numbers.append(number)
                        shorts.append(short)
                        leaves.append(path(found, DEPTH) if plain else None)
                        forms.append(path(found, len(found)) if plain else exact(words))
                if with_tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(forms, pa.int64()), pa.array(tokens, pa.binary())],
                        ["form", "tokens"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows, pa.int64())),
                            pa.array(numbers, pa.int32()), pa.array(shorts, pa.bool_()),
                            pa.array(leaves, pa.int64()), pa.array(forms, pa.int64()),
                        ],
                        ["doc_id", "line", "short", "leaf", "form"],
                    )

    return run


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of narrow tokens are instances of the template that b starts."""
    return ((a == b) & (b > 0)).sum(axis=-1) >= constants(b.shape[-1])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open forms beside their leaf's earliest: (..., agrees)."""
    for batch in batches:
        pairs = zip(batch.column("tokens").to_pylist(), batch.column("centre_tokens").to_pylist())
        agrees = [bool(agree(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"))) for a, b in pairs]
        names = ["leaf", "form", "low", "tokens", "centre", "centre_low"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(agrees, pa.bool_())], [*names, "agrees"]
        )


class Templates:
    """First forms of one leaf's templates, in order."""

    def __init__(self) -> None:
        self.rows, self.owners, self.index = np.zeros((0, 0), "<u4"), [], {}

    def _segments(self, tokens: np.ndarray) -> list[tuple[int, bytes]]:
        """More segments than positions that may differ, so one is equal in any instance."""
        n = len(tokens)
        cuts = np.linspace(min(DEPTH, n), n, n - constants(n) + 2).astype(int)
        return [(k, tokens[i:j].tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]

    def place(self, tokens: np.ndarray, owner: tuple) -> tuple | None:
        """Owner of the template that a form is an instance of; None if it starts one."""
        segments = self._segments(tokens)
        near = sorted(set().union(*(self.index.get(s, ()) for s in segments)))
        for at in range(0, len(near), 1024):
            some = near[at : at + 1024]
            hits = np.flatnonzero(agree(tokens, self.rows[some]))
            if len(hits):
                return self.owners[some[hits[0]]]
        count = len(self.owners)
        if count == len(self.rows):
            grown = np.zeros((max(4, 2 * count), len(tokens)), "<u4")
            grown[:count] = self.rows[:count] if count else 0
            self.rows = grown
        self.rows[count] = tokens
        self.owners.append(owner)
        for s in segments:
            self.index.setdefault(s, []).append(count)
        return None


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, form, low, tokens) in order -> (form, keeper) of instances."""
    current, templates = None, Templates()
    for whole in batches:
        for batch in slices(whole):
            forms, keepers = [], []
            for leaf, form, low, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if leaf != current:
                    current, templates = leaf, Templates()
                owner = templates.place(np.frombuffer(tokens, "<u4"), (low,))
                if owner:
                    forms.append(form)
                    keepers.append(owner[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(forms, pa.int64()), pa.array(keepers, batch.schema.field("low").type)],
                ["form", "keeper"],
            )


def _instances(sample: DataFrame) -> DataFrame:
    """(form, keeper): forms of another form's template, with the template's first document."""
    kind = sample.schema["low"].dataType.simpleString()
    first = F.struct(F.col("low").isNull().alias("last"), "low", "form", "tokens")
    found, left = [], sample
    for _ in range(CENTRE_ROUNDS):
        centres = left.groupBy("leaf").agg(F.min(first).alias("c")).select(
            "leaf", F.col("c.form").alias("centre"), F.col("c.low").alias("centre_low"),
            F.col("c.tokens").alias("centre_tokens"),
        )
        compared = stage(
            left.join(centres, "leaf").mapInArrow(
                _compare,
                f"leaf long, form long, low {kind}, tokens binary, centre long, centre_low {kind}, agrees boolean",
            ),
            "compared",
        )
        found.append(
            compared.filter("agrees and form <> centre").select("form", F.col("centre_low").alias("keeper"))
        )
        left = compared.filter("not agrees").select("leaf", "form", "low", "tokens")
    found.append(
        left.repartition("leaf").sortWithinPartitions("leaf", F.col("low").asc_nulls_last(), "form")
        .mapInArrow(_place, f"form long, keeper {kind}")
    )
    return stage(reduce(DataFrame.unionAll, found), "instances")


def drops(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lines, shared): numbers of the lines to drop, for documents that have any,
    and of short lines that an earlier document has too."""
    texts = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    kind = texts.schema[0].dataType.simpleString()
    lines = stage(
        texts.mapInArrow(
            _lines(False), f"doc_id {kind}, line int, short boolean, leaf long, form long"
        ),
        "lines",
    )
    # Forms: lines that are equal up to fields. A form has one leaf and the same tokens; lines
    # without a leaf are a form if they are equal.
    forms = stage(
        lines.groupBy("leaf", "form").agg(
            F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
        ),
        "forms",
    )
    # Only leaves with several forms, in more than one document, can generalise further.
    mixed_leaves = forms.filter(F.col("leaf").isNotNull()).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.min("low").alias("l"), F.max("high").alias("h")
    ).filter("n > 1 and l < h").select("leaf")
    open_forms = stage(forms.join(mixed_leaves, "leaf", "left_semi"), "open-forms")
    # The few forms that are compared get their tokens from their first documents again.
    firsts = stage(open_forms.select(F.col("low").alias("first")).distinct(), "firsts")
    again = texts
    if firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # Beyond that bound reading all texts costs less than shuffling them.
        again = texts.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    sample = stage(
        again.mapInArrow(_lines(True), "form long, tokens binary")
        .join(small_or_not(open_forms), "form")
        .groupBy("form").agg(
            F.first("leaf").alias("leaf"), F.first("low").alias("low"), F.min("tokens").alias("tokens"),
        )
        .select("leaf", "form", "low", "tokens"),
        "sample",
    )
    # A template's first document is that of its first form, so it keeps a line of its own.
    recurring = stage(
        forms.join(_instances(sample), "form", "left")
        .select("form", "high", F.coalesce("keeper", "low").alias("keeper"))
        .filter(F.col("keeper") < F.col("high"))
        .select("form", "keeper"),
        "recurring",
    )
    return (
        lines.join(recurring, "form")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")) | F.col("doc_id").isNull())
        .groupBy("doc_id").agg(
            F.collect_set(F.when(~F.col("short"), F.col("line"))).alias("lines"),
            F.collect_set(F.when(F.col("short"), F.col("line"))).alias("shared"),
        )
        .filter(F.size("lines") > 0)
    )


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with cleaned texts, besides ``n_lines`` and ``n_dropped`` (long)."""
    found = stage(drops(docs, key, text), "drops").select(
        F.col("doc_id").alias("__id"), F.col("lines").alias("__lines"), F.col("shared").alias("__shared")
    )
    kept_columns = docs.columns
    split = F.split(F.col(text), "\n")
    unique = F.size(
        F.filter(
            split,
            lambda x, i: x.rlike("[^ \\t\\x0B\\f\\r]")
            & ~F.array_contains("__lines", i)
            & ~F.array_contains("__shared", i),
        )
    )
    stays = F.filter(split, lambda x, i: ~F.array_contains("__lines", i))
    cleaned = F.when(F.col("__lines").isNull(), F.col(text)).when(
        unique == 0, F.lit("")
    ).otherwise(F.array_join(stays, "\n"))
    joined = docs.join(small_or_not(found), F.col(key).eqNullSafe(F.col("__id")), "left")
    return joined.select(
        *[F.col(c) if c != text else cleaned.alias(text) for c in kept_columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_dropped"),
    )
