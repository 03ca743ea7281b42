"""Jaccard similarity join on word n-grams by universe partition and pigeonhole.

Two sets with a Jaccard similarity of at least t differ in at most H elements, where
H = (1 - t) / t * size of the smaller one. The elements are hashed into m segments. If
a set gives segment i an allowance v_i (0: the segments are equal, 1: they differ in
one element at most) with sum(v_i + 1) > H, any partner agrees within the allowance
in some segment. Sets are cut by size band: a set is indexed in the band of every
smaller size that could be its partner, and probes its own band.

* Of each segment the subset of a set that falls into it is indexed by a hash; in bands
  of small sets also by the hashes with one element deleted (allowance 1).
* Allocation goes by cost: the size of the buckets that a segment falls into. A set
  uses its cheapest segments until the allowance suffices. Segments that nobody shares
  are free, so most sets have no candidate at all, and frequent segments (empty ones,
  common passages) are skipped.
* Equal sets are one class before all that. A bucket's probes are checked against one
  centre, ``CENTRE_ROUNDS`` times; links join components. From then on only members of
  other components count as candidates, so a solved group of copies costs nothing.
* Sets that still meet few members of other components are checked against these. The
  others, and what is in their buckets, are partitioned to the end: every element is a
  segment of its own, elements that stay within a component are free, and the cheapest
  others are allocated, rarest first. A pair is only checked if it can reach the overlap
  from the places at which it meets. No link between components is lost, and a passage
  that many different sets share makes no pairs.

Hashes have 64 bits; class keys are checked for collisions against 128-bit digests and
drawn anew if there are any.

Defined results: NULL or blank text has an empty set, size 0, linked with nothing;
fewer than n words are one shingle; repeated rows and ids give a row each; a NULL id
stays NULL and is never the smallest; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, hashes, mixed, slices, small_or_not, stage, text_or_empty, word_hash
from .components import components

#: Width of size bands, and the sizes up to which one-deletion neighbourhoods are kept.
BAND_RATIO = 1.3
DELETIONS_UP_TO = 48
#: Segments beyond the necessary number, so that costly ones can be skipped.
SLACK = 0.15
#: Rounds in which a bucket's probes meet one member.
CENTRE_ROUNDS = 2
#: Members of other components that a set is checked against without further allocation.
DIRECT_PAIRS = 32


def shingles(text: str, width: int, memo: Memo) -> np.ndarray:
    """Distinct hashed shingles, ascending; words are blank-separated, A-Z lower-cased."""
    h = hashes(text.encode("utf-8", "surrogatepass").lower().split(), memo)
    n = len(h)
    if not n:
        return h
    used = min(width, n)
    value = mixed(h[: n - used + 1] + np.uint64(used))
    for j in range(1, used):
        value = mixed(value) + h[j : n - used + 1 + j]
    return np.unique(mixed(value))


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def class_key(content: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(content, seed) - (1 << 63)


class Bands:
    """Size bands, their segments and allowances for a threshold of num / 100."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 31:
            low = self.lows[-1]
            self.lows.append(max(low + 1, int(low * BAND_RATIO)))

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def schemes(self, size: int) -> range:
        """Bands in which a set of this size is indexed."""
        least = -(-self.percent * size // 100)
        return range(self.band(max(1, least)), self.band(size) + 1)

    def differences(self, size: int) -> int:
        """Most elements in which a set and a partner of at least its size differ."""
        return (100 - self.percent) * size // self.percent

    def allowance(self, band: int) -> int:
        return int(self.lows[band + 1] - 1 <= DELETIONS_UP_TO)

    def segments(self, band: int) -> int:
        need = self.differences(self.lows[band + 1] - 1) + 1
        if self.allowance(band):
            return -(-need // 2) + 1
        return need + int(np.ceil(SLACK * need)) + 2


@lru_cache(maxsize=4)
def bands(percent: int) -> Bands:
    return Bands(percent)


def signatures(found: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of segments, and tags: segment * 4 + (deletion: 2) + (own band: 1)."""
    rules = bands(percent)
    size = len(found)
    own = rules.band(size)
    out, tags = [], []
    scrambled = mixed(found ^ np.uint64(0x5851F42D4C957F2D))
    for band in rules.schemes(size):
        m = rules.segments(band)
        where = (found % np.uint64(m)).astype(np.int64)
        # A segment's hash is the sum of its scrambled elements: order-free, and one
        # element is taken away by subtraction.
        total = np.zeros(m, np.uint64)
        np.add.at(total, where, scrambled)
        salt = np.uint64(band << 32) + np.arange(m, dtype=np.uint64)
        out.append(mixed(total + mixed(salt + np.uint64(1))))
        tags.append(np.arange(m) * 4 + (band == own))
        if rules.allowance(band):
            less = total[where] - scrambled
            out.append(mixed(less + mixed(salt[where] + np.uint64(1))))
            tags.append(where * 4 + 2 + (band == own))
    return np.concatenate(out).view(np.int64), np.concatenate(tags).astype(np.int32)


def _sets(width: int, seed: int):
    """doc -> (doc_id, n, digest, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        for whole in batches:
            for batch in slices(whole):
                sets = [shingles(t, width, memo) for t in batch.column(1).to_pylist()]
                digests = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([class_key(d, seed) for d in digests], pa.int64()),
                    ],
                    ["doc_id", "n", "digest", "key"],
                )

    return run


def _index(width: int, seed: int, percent: int):
    """doc -> rows (sig, key, tag), once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        done = Memo(lambda key: True, 1_000_000)
        for whole in batches:
            for batch in slices(whole):
                sigs, tags, keys = [], [], []
                for text in batch.column(0).to_pylist():
                    found = shingles(text, width, memo)
                    if not len(found):
                        continue
                    key = class_key(digest(found), seed)
                    if key in done:
                        continue
                    done[key]
                    s, t = signatures(found, percent)
                    sigs.append(s)
                    tags.append(t)
                    keys.append(np.full(len(s), key, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(sigs)),
                            pa.array(np.concatenate(keys)),
                            pa.array(np.concatenate(tags)),
                        ],
                        ["sig", "key", "tag"],
                    )

    return run


def _contents(width: int, seed: int):
    """(key, text) -> (key, set) where the text is the key's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        for whole in batches:
            for batch in slices(whole):
                keys, sets = [], []
                for key, text in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
                ):
                    found = shingles(text, width, memo)
                    if class_key(digest(found), seed) == key:
                        keys.append(key)
                        sets.append(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "content"]
                )

    return run


def _elements():
    """(key, label, n, costly, set) -> rows (element, key, label, n, costly)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 64):
                found = [np.frombuffer(c, np.int64) for c in batch.column(4).to_pylist()]
                if not found:
                    continue
                times = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                others = [batch.column(i).take(pa.array(times)) for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), *others], ["element", "key", "label", "n", "costly"]
                )

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                linked = []
                for x, y in zip(
                    batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
                ):
                    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked.append(100 * both >= percent * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                    ["a", "b", "linked"],
                )

    return run


def join(
    docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    texts = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = texts.schema[0].dataType.simpleString()
    for seed in range(16):
        sets = stage(
            texts.mapInArrow(_sets(width, seed), f"doc_id {kind}, n long, digest binary, key long"),
            "sets",
        )
        classes = sets.filter("n > 0").groupBy("key").agg(
            F.min("doc_id").alias("first_doc"), F.first("n").alias("n"),
            F.min("digest").alias("d0"), F.max("digest").alias("d1"),
        )
        classes = stage(classes, "classes")
        if not classes.filter("d0 != d1").limit(1).count():
            break
    else:
        raise RuntimeError("class keys collide under every seed")
    classes = classes.select("key", "first_doc", "n")
    labels = _labels(texts, classes, width, percent, seed)
    # The smallest document of each component, then of each class.
    grouped = stage(
        classes.join(labels, "key", "left").select(
            "key", "first_doc", F.coalesce("label", "key").alias("label")
        ),
        "grouped",
    )
    firsts = grouped.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_class = grouped.join(firsts, "label").select("key", "component_id")
    nonempty = sets.filter("n > 0").join(by_class, "key", "left")
    empty = sets.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return nonempty.select("doc_id", "n", "component_id").unionAll(
        empty.select("doc_id", "n", "component_id")
    ).select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """(sig, key, seg, deletion, own, c): rows of buckets that hold two classes or more.

    One shuffle by bucket; its rows are narrow and counted by a sort that spills, none is
    held whole. Copies from other tasks are the same rows again and no second class.
    """
    bucket = Window.partitionBy("sig")
    several = (
        rows.select("*", F.min("key").over(bucket).alias("lo"), F.max("key").over(bucket).alias("hi"))
        .filter("lo < hi").select("sig", "key", "tag").distinct()
        .withColumn("c", F.count(F.lit(1)).over(bucket))
    )
    return stage(
        several.select(
            "sig", "key", F.shiftright("tag", 2).alias("seg"),
            (F.col("tag").bitwiseAND(2) > 0).alias("deletion"),
            (F.col("tag").bitwiseAND(1) > 0).alias("own"), "c",
        ),
        "shared",
    )


def _allocation(percent: int):
    """Native columns for a class's number of segments, allowance and need, by its size."""
    rules = bands(percent)
    table = []
    for band in range(len(rules.lows) - 1):
        table.append(
            (rules.lows[band], rules.lows[band + 1], rules.segments(band), rules.allowance(band))
        )
    return table


def _probes(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(sig, key, c): the cheapest shared segments that a class needs besides its free ones.

    A segment offers one unit of allowance at the size of its bucket, and with its
    deletions a second one at the size of theirs too.
    """
    spark = shared.sparkSession
    # One row per size band: about a hundred rows.
    table = F.broadcast(
        spark.createDataFrame(_allocation(percent), "low long, high long, m int, v int")
    )
    own = shared.filter("own")
    costs = own.groupBy("key", "seg").agg(
        F.sum(F.when(~F.col("deletion"), F.col("c") - 1).otherwise(0)).alias("whole"),
        F.sum(F.col("c") - 1).alias("both"),
    )
    used = costs.groupBy("key").agg(F.count(F.lit(1)).alias("used"))
    need = (
        used.join(classes, "key")
        .join(table, (F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")))
        .select(
            "key", "v",
            (
                F.floor(F.lit(100 - percent) * F.col("n") / percent) + 1
                - (F.col("m") - F.col("used")) * (F.col("v") + 1)
            ).alias("short"),
        )
        .filter("short > 0")
    )
    units = costs.join(need, "key").select(
        "key", "seg", "short",
        F.explode(
            F.when(
                F.col("v") == 1,
                F.array(
                    F.struct(F.col("whole").alias("cost"), F.lit(0).alias("unit")),
                    F.struct(F.col("both").alias("cost"), F.lit(1).alias("unit")),
                ),
            ).otherwise(F.array(F.struct(F.col("whole").alias("cost"), F.lit(0).alias("unit"))))
        ).alias("u"),
    ).select("key", "seg", "short", "u.*")
    order = Window.partitionBy("key").orderBy("cost", "seg", "unit")
    chosen = (
        units.withColumn("place", F.row_number().over(order)).filter("place <= short")
        .groupBy("key", "seg").agg(F.max("unit").alias("unit"))
    )
    return (
        own.join(chosen, ["key", "seg"])
        .filter((F.col("unit") == 1) | ~F.col("deletion"))
        .groupBy("sig", "key").agg(F.max("c").alias("c"))
    )


def _members(shared: DataFrame, probes: DataFrame) -> DataFrame:
    """(sig, key) of everything in a probed bucket."""
    return shared.select("sig", "key").distinct().join(
        probes.select("sig").distinct(), "sig", "left_semi"
    )


def _labels(
    texts: DataFrame, classes: DataFrame, width: int, percent: int, seed: int
) -> DataFrame:
    """(key, label): the component of every class that shares a probed bucket."""
    spark = texts.sparkSession
    rows = texts.select("text").mapInArrow(_index(width, seed, percent), "sig long, key long, tag int")
    shared = _shared_buckets(rows)
    probes = stage(_probes(shared, classes, percent).select("sig", "key"), "probes")
    if not probes.limit(1).count():
        return spark.createDataFrame([], "key long, label long")
    # Any partner of a class is in one of its probed buckets; degree tells how much a class shares.
    sizes = classes.select("key", "n")
    degree = shared.groupBy("key").agg(F.sum("c").alias("degree"))
    members = stage(
        _members(shared, probes).join(degree, "key").join(sizes, "key"), "members"
    )
    wanted = stage(
        members.select("key").distinct().join(
            classes.select("key", F.col("first_doc").alias("doc_id")), "key"
        ),
        "participants",
    )
    contents = stage(_participants(texts, wanted, width, seed), "contents")
    labels = wanted.select("key", F.col("key").alias("label"))
    for step in range(CENTRE_ROUNDS):
        found = _linked(_centre_pairs(members, probes, labels, sizes, percent, step), contents, percent)
        labels = _joined(labels, found)
    asking, named = _open(members, probes, labels)
    pairs = _direct_pairs(asking, named, percent).unionAll(
        _element_pairs(asking, named, contents, percent)
    )
    return _joined(labels, _linked(pairs.distinct(), contents, percent))


def _alike(percent: int):
    """Sizes n and m that may belong to linked sets."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _centre_pairs(
    members: DataFrame, probes: DataFrame, labels: DataFrame, sizes: DataFrame, percent: int, step: int
) -> DataFrame:
    """(a, b): every probe with one member of its bucket, of another component."""
    named = members.join(labels, "key")
    first = F.struct("key", "n", "label")
    best = (
        F.max_by(first, F.struct("degree", -F.col("key"))) if step == 0
        else F.min_by(first, F.xxhash64("key", F.lit(step)))
    )
    centres = named.groupBy("sig").agg(best.alias("x")).select(
        "sig", F.col("x.key").alias("other"), F.col("x.n").alias("m"), F.col("x.label").alias("its")
    )
    asking = probes.join(labels, "key").join(sizes, "key")
    return (
        asking.join(centres, (asking["sig"] == centres["sig"]) & (F.col("label") != F.col("its")))
        .filter(_alike(percent))
        .select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
        .distinct()
    )


def _open(members: DataFrame, probes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probes into buckets of several components, (sig, key, n, label, labels, cost), and their members.

    ``cost`` is the number of members of other components that a class meets in all its
    buckets, ``labels`` the number of components in this one.
    """
    named = stage(members.join(labels, "key").select("sig", "key", "n", "label"), "named")
    counts = named.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c"))
    several = counts.groupBy("sig").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels")).filter(
        "labels > 1"
    )
    met = (
        probes.join(several, "sig").join(named, ["sig", "key"]).join(counts, ["sig", "label"])
        .select("sig", "key", "n", "label", "labels", (F.col("all") - F.col("c")).alias("others"))
    )
    cost = F.sum("others").over(Window.partitionBy("key"))
    asking = stage(met.withColumn("cost", cost).drop("others"), "asking")
    return asking, named


def _direct_pairs(asking: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes that meet at most ``DIRECT_PAIRS`` members of other components.

    Their buckets hold as many other components at most, so components meet first and
    members of one component never do.
    """
    few = asking.filter(F.col("cost") <= DIRECT_PAIRS)
    groups = few.select("sig", "label").distinct()
    inside = named.join(few.select("sig").distinct(), "sig", "left_semi")
    others = inside.select("sig", F.col("label").alias("its")).distinct()
    across = groups.join(others, (groups["sig"] == others["sig"]) & (F.col("label") != F.col("its"))).select(
        groups["sig"], "label", "its"
    )
    theirs = inside.select("sig", F.col("label").alias("its"), F.col("key").alias("other"), F.col("n").alias("m"))
    return (
        few.join(across.join(theirs, ["sig", "its"]), ["sig", "label"]).filter(_alike(percent))
        .select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
        .distinct()
    )


def _element_pairs(asking: DataFrame, named: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the other classes: every element is a segment, allocated by its cost.

    A set misses at most (1 - t) n of its n elements in a partner. So of any more than
    that one is shared: the cheapest are used. Elements of one component are free; the
    others follow by the number of sets that hold them, the same order for all, so that both
    partners use the first element that they share. It is at place i of n and j of m, and
    leaves an overlap of 1 + min(n - i, m - j) at most.
    """
    many = asking.filter(F.col("cost") > DIRECT_PAIRS)
    costly = many.select("key").distinct().withColumn("costly", F.lit(True))
    there = named.join(many.select("sig").distinct(), "sig", "left_semi").select("key", "n", "label").distinct()
    taking = there.join(costly, "key", "left").select(
        "key", "label", "n", F.coalesce("costly", F.lit(False)).alias("costly")
    )
    elements = stage(
        taking.join(contents, "key").select("key", "label", "n", "costly", "content")
        .mapInArrow(_elements(), "element long, key long, label long, n long, costly boolean"),
        "elements",
    )
    between = elements.groupBy("element").agg(
        F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).filter("lo < hi").select("element", "c")
    own = Window.partitionBy("key")
    placed = (
        elements.join(between, "element")
        .withColumn("free", F.col("n") - F.count(F.lit(1)).over(own))
        .withColumn("place", F.col("free") + F.row_number().over(own.orderBy("c", "element")))
        .filter(F.col("place") <= F.floor(F.lit(100 - percent) * F.col("n") / 100) + 1)
    )
    used = stage(placed.select("element", "key", "label", "n", "costly", "place"), "used-elements")
    left = used.withColumnRenamed("key", "a")
    right = used.select(
        "element", F.col("key").alias("b"), F.col("label").alias("its"), F.col("n").alias("m"),
        F.col("costly").alias("theirs"), F.col("place").alias("at"),
    )
    reach = F.lit(100 + percent) * (1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")))
    return left.join(
        right,
        (left["element"] == right["element"]) & (F.col("a") < F.col("b")) & (F.col("label") != F.col("its"))
        & (F.col("costly") | F.col("theirs")) & _alike(percent)
        & (reach >= percent * (F.col("n") + F.col("m"))),
    ).select("a", "b").distinct()


def _linked(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are similar enough, by their whole sets."""
    pairs = stage(pairs, "pairs")
    left = contents.select(F.col("key").alias("a"), F.col("content").alias("x"))
    right = contents.select(F.col("key").alias("b"), F.col("content").alias("y"))
    return stage(
        pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        .mapInArrow(_verify(percent), "a long, b long, linked boolean").filter("linked").select("a", "b"),
        "linked",
    )


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining components that are linked; only labels are searched."""
    left = labels.select(F.col("key").alias("a"), F.col("label").alias("u"))
    right = labels.select(F.col("key").alias("b"), F.col("label").alias("v"))
    between = links.join(left, "a").join(right, "b").select(
        F.col("u").alias("a"), F.col("v").alias("b")
    )
    merged = components(between).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return stage(
        labels.join(merged, "label", "left").select("key", F.coalesce("root", "label").alias("label")),
        "labels",
    )


def _participants(texts: DataFrame, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """(key, content) of the classes in ``wanted``, from the text of their first document."""
    ids = small_or_not(wanted.select("key", F.col("doc_id").alias("id")))
    return (
        texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "text")
        .mapInArrow(_contents(width, seed), "key long, content binary")
        .groupBy("key").agg(F.first("content").alias("content"))
    )
