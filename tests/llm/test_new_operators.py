"""Merkle manifest, quality by compression and bisector clustering against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import bisector, merkle, quality
from tabloom.llm.queries import LEAF_FIELDS, LOWER, UPPER
from tests_llm_words import sentence, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join(
        "-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)
    ))


def levels_of(nodes):
    """All levels of a tree, by the rule alone."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    steps = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        steps.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= 16
    return steps


def brute_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        doc_id, text = row[0], row[1]
        own = leaf_of(row, text)
        other = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            other = leaf_of(row, None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups[row[3]].append((doc_id, own, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = levels_of([r[1] for r in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    root = top[-1][0] if top[-1] else None
    out = []
    for place, name in enumerate(names):
        for at, (doc_id, own, other) in enumerate(groups[name]):
            steps = siblings(trees[name], at) + siblings(top, place)
            folded = other
            for left, right in steps:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in steps))
            out.append((doc_id, own, trees[name][-1][0], root, proof, folded, folded == root))
    return out


def manifest(docs):
    fields = [F.col(c) for c in LEAF_FIELDS]
    lowered = merkle.leaf(*fields[:-1], F.translate("text", UPPER, LOWER))
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, lowered)
    return merkle.leaf(*fields), tampered


COLUMNS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check_manifest(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("g", "id", "leaf", "pos", "total", "block", "digest", "steps", "root"):
            docs = docs.withColumn(name, F.lit("clash"))
    own, other = manifest(docs)
    got = merkle.build(docs, own, other).proofs().select(*COLUMNS).collect()
    # Rows equal in key and leaf may change places.
    assert Counter(map(tuple, got)) == Counter(brute_manifest(rows))
    return got


def test_manifest_of_awkward_rows(spark):
    rng = random.Random(1)
    long = "Ab " * 400_000
    rows = [
        (None, "No id", "en", "a", 5), (None, None, None, None, None), (1, "", "en", "", 0), (2, "ä日本", "de", None, 3),
        (3, "Twice", "en", "b", 5), (3, "Twice", "en", "b", 5), (3, "THIRD", "en", "b", None), (4, long, "en", "c", 1),
        (5, "alone", "en", "only one", 5), (-7, "Minus", "en", "b", 5), (10, "1:x", "-", "-", 3),
    ]
    rows += [(100 + i, sentence(rng, 5), rng.choice(["en", None]), rng.choice("bcdé"), i) for i in range(300)]
    rng.shuffle(rows)
    got = check_manifest(spark, rows, extra=True)
    verified = {r["verified"] for r in got}
    assert verified == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (16, 17), (256, 257), (4096, 4097, 1), (9000, 5)])
def test_manifest_at_the_edges_of_blocks(spark, sizes):
    rows = []
    for source, n in enumerate(sizes):
        rows += [(source * 100_000 + i, f"Text {i}", "en", f"s{source}", i) for i in range(n)]
    random.Random(2).shuffle(rows)
    check_manifest(spark, rows)


def test_manifest_of_many_groups(spark):
    check_manifest(spark, [(i, f"Text {i}", None, f"s{i:05d}", i) for i in range(4200)])


def test_manifest_grows_by_appending(spark):
    first = [(i, f"Text {i}", "en", f"s{i % 2}" if i < 9000 else "s0", i) for i in range(9300)]
    later = [(20_000 + i, f"More {i}", "en", f"s{i % 3}", i) for i in range(900)]
    docs = spark.createDataFrame(first, DOCS)
    own, other = manifest(docs)
    old = merkle.build(docs, own, other)
    new = merkle.append(old, spark.createDataFrame(later, DOCS), own, other)
    got = new.proofs().select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(brute_manifest(first + later))
    sealed = {(r["g"], r["block"]): r["digest"] for r in old.blocks.filter(f"n = {merkle.SPAN}").collect()}
    after = {(r["g"], r["block"]): r["digest"] for r in new.blocks.collect()}
    assert sealed and all(after[k] == d for k, d in sealed.items())
    with pytest.raises(ValueError, match="greater"):
        merkle.append(new, spark.createDataFrame(later[:1], DOCS), own, other)


def test_partial_witnesses_grow():
    frontier = merkle.Frontier(2)
    seen = []
    for i in range(40):
        frontier.append(sha(str(i)))
        seen.append(len(frontier.witnesses()[0][0][1]))
    assert seen[:16] == [64 * i for i in range(16)] and set(seen[16:]) == {64 * 15}
    root = frontier.finish()
    assert all(merkle.fold(sha(str(i)), w) == root for i, w in enumerate(frontier.witnesses()))


# ---- quality by compression


def quality_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        text = words(rng, rng.randint(30, 120))
        bad = i % 5 == 0
        if bad:
            text = [w + rng.choice(["%%", "$$", "##", "&&"]) for w in text]
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = quality_rows(rng, 800)
    truth = dict(labels)
    long = " ".join(words(rng, 30_000))
    odd = [
        (None, "a null id", "en", "s", 1), (9001, None, "en", "s", 1), (9002, "", "en", "s", 1), (9003, " \n", "en", "s", 1),
        (9004, long, "en", "s", 1), (9005, "one", "en", "s", 1), (9005, "one", "en", "s", 1), (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows + odd, DOCS)
    marks = spark.createDataFrame(labels + [(None, 1), (9999, 0), (4, None)], "doc_id long, quality int")
    model = quality.train(docs, marks)
    clash = docs
    for name in ("score", "predicted", "difference", "__text2", "label", "part"):
        clash = clash.withColumn(name, F.lit("clash"))
    got = quality.score(clash, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    test = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in test) <= 0.03 * len(test)
    # Calibrated: mean score and share of label 1 agree on rows not learned from.
    assert abs(np.mean([r["score"] for r in test]) - np.mean([truth[r["doc_id"]] for r in test])) < 0.05
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["score"])
    assert len(by_id[9005]) == 1 and by_id[9001] == by_id[9002]
    # Held-out labels are not learned from, and rows may come in any order.
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    other = quality.train(docs.orderBy(F.rand(1)), spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert (other.good, other.bad) == (model.good, model.bad) and np.allclose(other.weights, model.weights)


def test_quality_against_plain_compression(spark):
    """The difference is that of plain one-shot compression with the two dictionaries."""
    import zstandard

    rng = random.Random(4)
    rows, labels = quality_rows(rng, 200)
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    settings = zstandard.ZstdCompressionParameters(**quality.MATCHING)

    def size(text, content):
        data = text.encode()
        total = 0
        for i in range(0, len(data), quality.BLOCK_BYTES):
            whole = zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                compression_params=settings,
            )
            total += len(whole.compress(data[i : i + quality.BLOCK_BYTES])) - len(whole.compress(b""))
        return total

    texts = {r[0]: r[1] for r in rows}
    for r in quality.score(docs.limit(12), model).collect():
        good, bad = (size(texts[r["doc_id"]], c) for c in (model.good, model.bad))
        assert r["difference"] == pytest.approx((bad - good) / (bad + good), abs=2e-3)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9), (2, None, "en", "s", None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1) for i in (1, 2)], "doc_id long, quality int")
    scores = {r["score"] for r in quality.score(docs, quality.train(docs, one_kind)).collect()}
    assert len(scores) == 1 and scores.pop() > 0.7
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, none)).count() == 0


# ---- clustering


def brute_clusters(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    ids = [r for r in kept if r[0] is not None] + [r for r in kept if r[0] is None]
    start = sorted(ids, key=lambda r: (r[0] is None, "" if r[0] is None else sha(f"3:{r[0]}"), r[1]))[:k]
    centers = [list(v) for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            centers[j] = [sum(col) // len(vs) for col in zip(*vs)]
    final = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in final:
        inertia[j] += d
    return Counter(
        (i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, centers[j])))) for i, d, j in final
    )


VECTORS = "vec_id long, embedding array<double>"


def vector_rows(rng, n, spread=1.0, dims=64):
    return [(i, (rng.normal(size=dims) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("kind", ["normal", "copies", "ties", "large", "few"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(5)
    rows = vector_rows(rng, 5 if kind == "few" else 150)
    if kind == "copies":
        rows += [(1000 + i, rows[0][1]) for i in range(120)]
    if kind == "ties":
        rows = [(i, [float((i + j) % 3 - 1) for j in range(64)]) for i in range(60)] + rows[:20]
    if kind == "large":
        rows += [(2000 + i, (np.array(rows[i][1]) * 1e9).tolist()) for i in range(20)]
    rows += [
        (5000, None), (5001, []), (5002, [1.0] * 63), (5003, [None] + [1.0] * 63), (5004, [float("nan")] + [1.0] * 63),
        (5005, [float("inf")] + [1.0] * 63), (None, [0.25] * 64), (3, rows[3][1]), (4, [-0.0001] * 64),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("cluster", "distance", "key", "v"):
        df = df.withColumn(name, F.lit("clash"))
    got = Counter(map(tuple, bisector.cluster(df).collect()))
    want = brute_clusters(rows)
    if kind == "large":
        # A distance that doesn't fit is NULL, and left out of the sums.
        fits = [(r[0], r[1], r[2] if r[2] <= bisector.LONG else None, r[5]) for r in want.elements()]
        got, want = Counter((r[0], r[1], r[2], r[5]) for r in got.elements()), Counter(fits)
    assert got == want


def test_no_vectors(spark):
    assert bisector.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert bisector.cluster(spark.createDataFrame([(1, [1.0])], VECTORS)).count() == 0


def test_tournament_is_the_nearest_with_ties_to_the_smaller_number():
    rng = np.random.default_rng(6)
    for _ in range(50):
        centers = rng.integers(-3, 4, size=(rng.integers(1, 9), 2)).tolist()
        x = rng.integers(-4, 5, size=(200, 2))
        best, distance = bisector.Tournament(centers).assign(x)
        square = ((x[:, None, :] - np.array(centers)[None]) ** 2).sum(2)
        assert np.array_equal(best, square.argmin(1)) and np.array_equal(distance, square.min(1))
