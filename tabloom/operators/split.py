"""Exact-size random and stratified splits without sorting the table.

Rows are ordered by a seeded MD5 of their key. The rows below a threshold are
the test set, so the split itself is a narrow projection. The threshold is the
k-th smallest key; it is found from counts per key prefix (at most 16^5 rows per
class and round), never by sorting or collecting the table. As keys are spread evenly,
one pass over the stretch of keys where the threshold must lie mostly finds it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import canonical_text, col, field_types, split_key
from ..functions.identity import with_row_identity
from ..functions.lookup import lookup_join
from ..functions.ordering import dense_index
from ..functions.runtime import checkpointed

KEY_LENGTH = 32
# Standard errors around the expected threshold whose keys the first pass counts one by one,
# and the digits it looks at.
EXPECTED_ERRORS = 6.0
EXPECTED_LENGTH = 8
# Key digits looked at per round. The first round counts every row and stays
# coarse; later rounds only see the rows of one boundary bucket per class.
ROUNDS = (3, 8, 13, 18, 23, 28, KEY_LENGTH)
# Up to so many classes, thresholds are literals of one projection; beyond, rows meet their class.
LITERAL_CLASSES = 1_000
# Beyond LITERAL_CLASSES, classes of at most so many rows are each ranked in one task.
CLASS_ROWS = 100_000


@dataclass
class _Cut:
    """Keys below ``prefix`` (as text) belong to the test side."""

    prefix: str
    take: int  # rows still to take among the keys that start with ``prefix``
    rows: int  # rows whose key starts with ``prefix``

    @property
    def settled(self) -> bool:
        return self.take in (0, self.rows)


def split_rows(
    df: DataFrame,
    test_size: float,
    seed: int = 42,
    keys: list[str] | None = None,
    stratify: str | None = None,
    column: str = "split",
    labels: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Add ``column`` with exactly ceil(test_size * n) test rows.

    ``keys`` identify a row; rows with equal keys are dealt together as far as
    the exact size allows. Without keys rows of Parquet files are told apart by file
    and row index; any other table is written to the checkpoint folder once, to fix
    the positions of its rows. With ``stratify`` each class gets its proportional share,
    rounded by largest remainder.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must be in (0, 1), got {test_size}")
    if not keys:
        placed = with_row_identity(df, "__row")
        return split_rows(
            placed, test_size, seed, ["__row"], stratify, column, labels
        ).drop("__row")
    types = field_types(df)
    names = list(keys)
    group = canonical_text(stratify, types[stratify]) if stratify else F.lit("")
    group = F.coalesce(group, F.lit("\0null"))
    key = split_key(seed, names, types)

    keyed = df.select(group.alias("g"), key.alias("k"))
    by_class = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    if stratify:
        by_class = checkpointed(by_class)
    few = by_class.limit(LITERAL_CLASSES + 1).collect()
    if len(few) > LITERAL_CLASSES:
        return _split_many(df, group, key, by_class, test_size, column, labels)
    sizes = {r["g"]: r["rows"] for r in few}
    quotas = test_quotas(sizes, test_size)
    cuts = _find_cuts(keyed, sizes, quotas)

    # Keys that tie at a threshold belong to rows with equal keys: deal those
    # out by position, fixed once in a checkpoint.
    ties = [g for g, c in cuts.items() if len(c.prefix) == KEY_LENGTH and not c.settled]
    if ties:
        df = checkpointed(df.withColumn("__pos", F.monotonically_increasing_id()))
        return _deal_ties(df, group, key, cuts, ties, column, labels)
    test = _test_condition(group, key, cuts)
    return df.withColumn(column, F.when(test, F.lit(labels[1])).otherwise(F.lit(labels[0])))


def test_quotas(sizes: dict[str, int], test_size: float) -> dict[str, int]:
    """Test rows per class: proportional, total ceil(test_size * n), largest remainder."""
    n = sum(sizes.values())
    # The tolerance keeps 0.2 * 15000 from being rounded up to 3001.
    total = math.ceil(test_size * n - 1e-9)
    if not sizes:
        return {}
    # Whole numbers: equal remainders are equal, and go by the name of the class.
    quotas = {g: total * size // n for g, size in sizes.items()}
    left = total - sum(quotas.values())
    for g in sorted(sizes, key=lambda g: (-(total * sizes[g] % n), g))[:left]:
        quotas[g] += 1
    return quotas


def class_quotas(sizes: DataFrame, test_size: float) -> DataFrame:
    """(g, rows, take) of a table of class sizes (g, rows): ``test_quotas`` for any number of classes.

    Shares and remainders are columns; the classes that get one row more are those
    with the first dense ranks by remainder, counted over sorted partitions.
    """
    n = int(sizes.agg(F.sum("rows")).first()[0] or 0)
    total = math.ceil(test_size * n - 1e-9)
    share = F.lit(total).cast("decimal(19,0)") * F.col("rows").cast("decimal(19,0)")
    whole = F.lit(n).cast("decimal(19,0)")
    rest = share % whole
    # Without its remainder a share is divisible, so the quotient isn't rounded.
    shares = sizes.withColumns(
        {"quota": ((share - rest) / whole).cast("long"), "rest": rest.cast("long")}
    )
    left = total - int(shares.agg(F.sum("quota")).first()[0] or 0)
    ranked = dense_index(
        shares.withColumns({"all": F.lit(0), "order": F.struct(-F.col("rest"), "g")}), "all", "order"
    )
    extra = (F.col("idx") < F.lit(left)).cast("long")
    return ranked.select("g", "rows", (F.col("quota") + extra).alias("take"))


def _cut_table(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, prefix, take, rows): ``_find_cuts`` for a table of classes (g, take, rows).

    Each round joins the open classes to their rows that start with the prefix so
    far and counts the next digits, combined on the map side; classes are settled
    when a bucket is taken as a whole or not at all, small ones in the first round.
    """
    cuts = wanted.select("g", F.lit("").alias("prefix"), "take", "rows")
    settled = (F.col("take") == 0) | (F.col("take") == F.col("rows"))
    for length in ROUNDS:
        cuts = checkpointed(cuts)
        still = cuts.filter(~settled).select("g", "prefix", "take", "rows")
        if still.limit(1).count() == 0:
            break
        inside = lookup_join(keyed, still, "g", "g", weight="rows").filter(
            F.col("prefix").isNotNull() & F.col("k").startswith(F.col("prefix"))
        )
        counted = inside.groupBy("g", F.substring("k", 1, length).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.first("take").alias("take")
        )
        running = Window.partitionBy("g").orderBy("p")
        found = (
            counted.withColumn("upto", F.sum("n").over(running))
            .filter((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
            .select(
                "g", F.col("p").alias("prefix"),
                (F.col("take") - (F.col("upto") - F.col("n"))).alias("take"), F.col("n").alias("rows"),
            )
        )
        cuts = cuts.filter(settled).unionByName(found)
    return checkpointed(cuts)


def _split_many(df, group, key, sizes, test_size, column, labels) -> DataFrame:
    """Stratified split; exact for any number and any sizes of classes.

    Rows of small classes are shuffled once, as they are, and ranked by key inside their
    class. The few large classes are cut at thresholds, so none of them lands in one task.
    """
    wanted = checkpointed(class_quotas(sizes, test_size))
    if not all(_sortable(t) for t in field_types(df).values()):
        return _split_by_cuts(df, group, key, sizes, wanted, column, labels)
    large = F.col("rows") > F.lit(CLASS_ROWS)
    if wanted.filter(large).limit(1).count() == 0:
        return _split_by_ranks(df, group, key, wanted, column, labels)
    # At most one class per CLASS_ROWS rows of the table.
    names = F.broadcast(wanted.filter(large).select(F.col("g").alias("__lg")))
    rest = df.join(names, group == F.col("__lg"), "left_anti")
    kept = df.join(names, group == F.col("__lg"), "left_semi")
    return _split_by_ranks(rest, group, key, wanted.filter(~large), column, labels).unionByName(
        _split_by_cuts(kept, group, key, sizes.filter(large), wanted.filter(large), column, labels)
    )


def _sortable(dtype: T.DataType) -> bool:
    return not any(word in dtype.json() for word in ('"map"', "variant", "interval"))


def _split_by_ranks(df, group, key, wanted, column, labels) -> DataFrame:
    """The first ``take`` rows of each class in the order of keys.

    Rows of equal keys are ordered by all their columns: the same whenever a task is run again.
    """
    columns = [col(c) for c in df.columns]
    # The key is computed where its class is, so it isn't shuffled.
    placed = df.withColumn("__g", group).repartition("__g").withColumn("__order", F.unhex(key))
    ranks = Window.partitionBy("__g").orderBy("__order", *columns)
    ranked = placed.withColumn("__rank", F.row_number().over(ranks)).drop("__order")
    quotas = wanted.select(F.col("g").alias("__cg"), F.col("take").alias("__take"))
    joined = ranked.join(quotas, F.col("__g") == F.col("__cg"))
    test = F.col("__rank") <= F.col("__take")
    return joined.select(
        *columns, F.when(test, F.lit(labels[1])).otherwise(F.lit(labels[0])).alias(column)
    )


def _split_by_cuts(df, group, key, sizes, wanted, column, labels) -> DataFrame:
    """Stratified split by joined thresholds, which are found from counts per key prefix."""
    keyed = df.select(group.alias("g"), key.alias("k"))
    cuts = _cut_table(keyed, wanted)
    tied = cuts.filter(
        (F.length("prefix") == KEY_LENGTH) & (F.col("take") > 0) & (F.col("take") < F.col("rows"))
    )
    ties = tied.limit(1).count() > 0
    if ties:
        df = checkpointed(df.withColumn("__pos", F.monotonically_increasing_id()))
    size = sizes.withColumnRenamed("rows", "__size")

    def below(text: Column, prefix: str, take: str, rows: str) -> Column:
        return (text < F.col(prefix)) | (
            (F.col(take) == F.col(rows)) & (F.col(take) > 0) & text.startswith(F.col(prefix))
        )

    named = cuts.join(size, "g").withColumnsRenamed(
        {"g": "__cg", "prefix": "__prefix", "take": "__take", "rows": "__rows"}
    )
    marked = lookup_join(
        df.withColumns({"__g": group, "__order": key}), named, "__g", "__cg", weight="__size"
    )
    test = below(F.col("__order"), "__prefix", "__take", "__rows")
    extra = ["__g", "__order", "__prefix", "__take", "__rows", "__size"]
    if ties:
        at_cut = (F.length("__prefix") == KEY_LENGTH) & (F.col("__order") == F.col("__prefix")) & (
            (F.col("__take") > 0) & (F.col("__take") < F.col("__rows"))
        )
        place = F.lpad(F.col("__pos").cast("string"), KEY_LENGTH, "0")
        positions = marked.filter(at_cut).select(F.col("__g").alias("g"), place.alias("k"))
        second = _cut_table(positions, tied.select("g", "take", "rows")).withColumnsRenamed(
            {"g": "__sg", "prefix": "__prefix2", "take": "__take2", "rows": "__rows2"}
        )
        marked = lookup_join(marked, second, "__g", "__sg", weight="__rows2")
        test = test | (at_cut & F.coalesce(below(place, "__prefix2", "__take2", "__rows2"), F.lit(False)))
        extra += ["__prefix2", "__take2", "__rows2", "__pos"]
    return marked.withColumn(
        column, F.when(test, F.lit(labels[1])).otherwise(F.lit(labels[0]))
    ).drop(*extra)


def _expected_cuts(keyed: DataFrame, cuts: dict[str, _Cut]) -> dict[str, _Cut]:
    """Cuts of the classes whose threshold lies where evenly spread keys put it.

    Keys below and above that stretch are counted together, so the counts are exact; a
    class whose threshold is outside of it (rows that share few keys) is left out.
    """
    if not cuts:
        return {}
    top = 16**EXPECTED_LENGTH - 1
    ends = {}
    for g, c in cuts.items():
        share = c.take / c.rows
        half = EXPECTED_ERRORS * math.sqrt(share * (1 - share) / c.rows) + 1.0 / c.rows
        ends[g] = tuple(
            f"{min(top, max(0, math.floor(x * (top + 1)))):0{EXPECTED_LENGTH}x}"
            for x in (share - half, share + half)
        )

    def end(i: int) -> Column:
        if len(ends) == 1:
            return F.lit(next(iter(ends.values()))[i])
        return F.element_at(F.create_map(*[F.lit(x) for g, e in ends.items() for x in (g, e[i])]), F.col("g"))

    p = F.substring("k", 1, EXPECTED_LENGTH)
    place = F.when(p < end(0), F.lit("<")).when(p > end(1), F.lit(">")).otherwise(p)
    counted = keyed.filter(F.col("g").isin(list(ends))).groupBy("g", place.alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # The two ends sort after the digits 0 to 9, so they are ranked apart.
    rank = F.when(F.col("p") == "<", 0).when(F.col("p") == ">", 2).otherwise(1)
    running = Window.partitionBy("g").orderBy(rank, "p")
    take = F.element_at(
        F.create_map(*[F.lit(x) for g, c in cuts.items() for x in (g, c.take)]), F.col("g")
    )
    rows = (
        counted.withColumn("upto", F.sum("n").over(running))
        .withColumn("take", take)
        .filter((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
        .filter(~F.col("p").isin("<", ">"))
        .collect()
    )
    return {r["g"]: _Cut(r["p"], r["take"] - (r["upto"] - r["n"]), r["n"]) for r in rows}


def _find_cuts(
    keyed: DataFrame, sizes: dict[str, int], quotas: dict[str, int], uniform: bool = True
) -> dict[str, _Cut]:
    """Threshold of each class; ``uniform=False`` for keys that are not spread evenly."""
    cuts = {g: _Cut("", quotas[g], sizes[g]) for g in sizes}
    if uniform:
        cuts.update(_expected_cuts(keyed, {g: c for g, c in cuts.items() if not c.settled}))
    for length in ROUNDS:
        # A class whose threshold is known to more digits waits for its round.
        open_cuts = {g: c for g, c in cuts.items() if not c.settled and len(c.prefix) < length}
        if not open_cuts:
            continue
        # Literal conditions per class: only rows in a boundary bucket survive.
        inside = None
        for g, c in open_cuts.items():
            cond = (F.col("g") == g) & F.col("k").startswith(c.prefix)
            inside = cond if inside is None else inside | cond
        counted = (
            keyed.filter(inside)
            .groupBy("g", F.substring("k", 1, length).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        # At most 16^5 rows per class.
        running = Window.partitionBy("g").orderBy("p")
        take = F.element_at(
            F.create_map(*[F.lit(x) for g, c in open_cuts.items() for x in (g, c.take)]),
            F.col("g"),
        )
        rows = (
            counted.withColumn("upto", F.sum("n").over(running))
            .withColumn("take", take)
            .filter((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
            .collect()
        )
        for r in rows:
            cuts[r["g"]] = _Cut(r["p"], r["take"] - (r["upto"] - r["n"]), r["n"])
    return cuts


def _below(key: Column, cut: _Cut) -> Column:
    """Rows on the test side of the cut, ties at a full key left out."""
    if cut.take == 0:
        return key < F.lit(cut.prefix) if cut.prefix else F.lit(False)
    if cut.take == cut.rows:
        return (key < F.lit(cut.prefix)) | key.startswith(cut.prefix)
    return key < F.lit(cut.prefix)


def _test_condition(group: Column, key: Column, cuts: dict[str, _Cut]) -> Column:
    test = F.lit(False)
    for g, cut in cuts.items():
        test = test | ((group == F.lit(g)) & _below(key, cut))
    return test


def _deal_ties(df, group, key, cuts, ties, column, labels) -> DataFrame:
    """Among rows equal to a full threshold key, take the first ones by position.

    Positions are 64-bit numbers, searched by the same counting scheme on their
    zero-padded text.
    """
    position = F.lpad(F.col("__pos").cast("string"), KEY_LENGTH, "0")
    tied = F.lit(False)
    for g in ties:
        tied = tied | ((group == F.lit(g)) & (key == F.lit(cuts[g].prefix)))
    positions = df.filter(tied).select(group.alias("g"), position.alias("k"))
    more = _find_cuts(
        positions, {g: cuts[g].rows for g in ties}, {g: cuts[g].take for g in ties}, uniform=False
    )
    test = _test_condition(group, key, cuts) | (tied & _test_condition(group, position, more))
    return df.withColumn(
        column, F.when(test, F.lit(labels[1])).otherwise(F.lit(labels[0]))
    ).drop("__pos")


__all__ = ["class_quotas", "split_rows", "test_quotas"]
