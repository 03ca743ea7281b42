"""Operators on texts against brute force, with the awkward rows of a real corpus."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer

from tabloom.llm import (
    decontaminate, jaccard_join, language_id, licenses, line_dedup, packing, pii, token_counts,
    tokens, toxicity,
)
from tabloom.llm.components import components
from tests_llm_words import sentence, words

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
def documents(spark, rows, extra=False):
    """(doc_id, text, ...) with clashing names of columns that operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(
        [(i, t, "xx", "s", None if t is None else len(t)) for i, t in rows], schema
    )
    if extra:
        for name in ("score", "key", "n", "id", "path", "label", "digest", "row", "line", "start"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def awkward(rng):
    """NULLs, empty and blank texts, one very long text, ties and repeated rows."""
    long = " ".join(words(rng, 30_000))
    return [
        (None, "a null id here with some words to read"), (1, None), (2, ""), (3, " \n\t "),
        (4, long), (5, "one"), (6, "one two three"), (6, "one two three"), (7, "ONE two three"),
        (8, "İstanbul ΣΑΣ naïve 日本語 テスト \x1c sep   x́ <|endoftext|> end"),
        (9, "x" * 5000), (10, "1" * 4000 + " " + "a@" * 500), (None, None), (11, long),
    ]


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# ---- tokens, counts, packing


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    alphabet = "aZ09 .,'!\n\t\r\x0b\x0c\x1c\x1d\x85  éÉßİΣσς́日本<|>endoftext'sll"
    texts = [t for _, t in awkward(rng) if t]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    latin = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA0, 0x250)])) + " " * 60
    texts += ["".join(rng.choices(latin, k=80)) for _ in range(1500)]
    texts += ["a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "don't we'll 's 't", "a　b"]
    for t in texts:
        assert np.frombuffer(tokens.ids_bytes(t, TOKENIZER), "<u4").tolist() == library(t), t
        assert tokens.count(t, TOKENIZER) == len(library(t))


def test_counts_and_cache(spark, folder, library):
    rows = awkward(random.Random(2))
    docs = documents(spark, rows, extra=True)
    cache = f"{folder}/cache"
    got = token_counts.count_tokens(docs, cache, TOKENIZER).collect()
    want = Counter(
        (i, len((t or "").encode()), len(library(t)), len(library(t)) > 2048) for i, t in rows
    )
    assert Counter(tuple(r) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    before = {bytes(r["digest"]) for r in stored.collect()}
    # Other blanks are the same content; only the new text is encoded.
    more = documents(spark, [(1, "one  two\nthree "), (2, "something new")])
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, cache, TOKENIZER).collect()}
    assert counts == {1: len(library("one two three")), 2: len(library("something new"))}
    after = spark.read.parquet(cache)
    assert after.count() == len(before) + 1
    # A stored count is used as it is: nothing is encoded again.
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(f"{folder}/other")
    again = token_counts.count_tokens(more, f"{folder}/other", TOKENIZER).collect()
    assert {r["n_tokens"] for r in again} == {77}


def check_packing(rows, pieces, library, window):
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(library(t) + [2])
    seen = defaultdict(list)
    for p in pieces:
        seen[p["doc_id"]].append(p)
    assert set(seen) == set(ids)
    for i, texts in ids.items():
        covered = Counter()
        for p in seen[i]:
            fits = [
                k for k, x in enumerate(texts) if len(x) == p["doc_tokens"]
                and zlib.crc32(np.array(x[p["start"]: p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
            ]
            assert fits
            covered[len(texts[fits[0]])] += p["length"]
        assert sum(covered.values()) == sum(map(len, texts))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing(spark, library):
    rng = random.Random(3)
    rows = awkward(rng) + [
        (100 + i, "\n".join(sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 30))))
        for i in range(300)
    ]
    docs = documents(spark, rows, extra=True).coalesce(3)
    pieces = packing.pack(docs, TOKENIZER, window=512).collect()
    padding = check_packing(rows, pieces, library, 512)
    assert padding < 0.06 * sum(p["length"] for p in pieces)


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        points = sorted({0, *rng.sample(range(1, 120), rng.randint(1, 25))})
        filled = [0]
        for p in points[1:]:
            while p - filled[-1] > 30:
                filled.append(filled[-1] + 30)
            filled.append(p)
        points = sorted(set(filled))
        penalties = [0] + [rng.choice([0, 3, 20]) for _ in points[1:]]
        best = [0] + [math.inf] * (len(points) - 1)
        for j in range(1, len(points)):
            for i in range(j):
                if points[j] - points[i] <= 30:
                    best[j] = min(best[j], best[i] + 30 - (points[j] - points[i]) + penalties[j])
        cuts = packing.best_cuts(points, penalties, 30)
        ends = [0, *cuts]
        cost = sum(30 - (b - a) + penalties[points.index(b)] for a, b in zip(ends, cuts))
        assert cuts[-1] == points[-1] and cost == best[-1]
        assert all(b - a <= 30 for a, b in zip(ends, cuts))


def test_cut_points_leave_no_wide_gap():
    points, penalties = packing.cut_points(1000, np.array([5, 300, 301]), np.array([400]), step=32)
    assert points[0] == 0 and points[-1] == 1000 and np.diff(points).max() <= 32
    assert penalties[points.tolist().index(400)] == 0
    assert packing.tail_cuts(1500, 4096)[-1] == 1500
    ends = [0, *packing.tail_cuts(1500, 4096)]
    assert all((b - a) & (b - a - 1) == 0 for a, b in zip(ends, ends[1:]))


def test_sequences_hang_on_the_partitions_alone(spark):
    rng = random.Random(5)
    docs = documents(spark, [(i, sentence(rng, 200)) for i in range(50)]).repartition(4, "doc_id")
    a, b = (sorted(map(tuple, packing.pack(docs, TOKENIZER, 256).collect())) for _ in range(2))
    assert a == b


# ---- personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def pii_texts():
    rng = random.Random(6)
    alphabet = ["a", "b@c.d", "@", ".", "_", "%", "+", "1", "25", "256", "0001", "4111111111111111", " ", "-", "(", ")",
                "é", "日", "😀", "\n", "+4930", "10.0.0.1", "1.2.3.4.5.6.7.8.9", "x@y", "a@b.c_d@e.f", "+1 (555) 123-4567"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(600)]
    many = " ".join(f"u{i}@mail.org" for i in range(3000))
    return texts + [many, "4111 1111 1111 1111", "card 4111-1111-1111-1111 10.0.0.1", "1" * 20_000, "a" * 50_000, "a@" * 5_000]


def test_pii_base_spans(spark):
    rows = list(enumerate(pii_texts())) + [(10_000, None)]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(documents(spark, rows, extra=True))).collect()}
    for i, text in rows:
        want = base_spans(text or "")
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:200]
        counts = Counter(s.split(":")[0] for s in want)
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [counts[k] for k, _ in PATTERNS]
        kept = [s for s in r["spans"].split(",") if s and not s.startswith(("iban", "phone_word"))]
        assert kept == want


def test_pii_added_spans_and_scores(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, wrong DE88370400440532013000. Tel. 030 1234567; card 4111111111111111"
    r = pii.digest(pii.find(documents(spark, [(1, text), (2, "x 4111111111111111")]))).collect()
    one, two = sorted(r, key=lambda r: r["doc_id"])
    found = [tuple(s.split(":")) for s in one["spans"].split(",")]
    shown = {k: text[int(a):int(b)] for k, a, b in found}
    assert shown["iban"] == "DE89 3704 0044 0532 0130 00" and one["n_iban"] == 1
    assert shown["phone_word"] == "030 1234567" and one["n_phone_word"] == 1
    score = lambda s: {x.split(":")[0]: float(x.split(":")[3]) for x in s.split(",")}
    assert score(one["scored_spans"])["card"] > score(two["scored_spans"])["card"]


# ---- n-gram Jaccard join


def brute_components(rows, width=4, percent=85):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in m if d is not None), default=None) for g, m in groups.items()}
    return Counter(
        (d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)
    )


def near_copies(rng):
    rows, i = [], 100
    for size in [5, 9, 12, 20, 35, 60, 120, 250, 300]:
        base = words(rng, size)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, max(1, size // 60)])):
                at = rng.randrange(len(copy))
                action = rng.random()
                if action < 0.4:
                    copy[at] = rng.choice(words(rng, 1))
                elif action < 0.7:
                    copy.insert(at, rng.choice(words(rng, 1)))
                elif len(copy) > 1:
                    del copy[at]
            rows.append((i, " ".join(copy)))
            i += 1
    shared = words(rng, 60)
    for _ in range(60):  # a passage that many otherwise different documents hold
        rows.append((i, " ".join(words(rng, rng.randint(5, 80)) + shared + words(rng, rng.randint(0, 60)))))
        i += 1
    for _ in range(20):  # drifting chain
        at = rng.randrange(len(shared))
        shared = shared[:at] + words(rng, 1) + shared[at + 1:]
        rows.append((i, " ".join(shared)))
        i += 1
    return rows


@pytest.mark.parametrize("seed", [7, 8])
def test_jaccard_join(spark, seed):
    rng = random.Random(seed)
    rows = near_copies(rng) + [(i, sentence(rng, rng.randint(3, 90))) for i in range(50)] + awkward(rng)
    got = jaccard_join.join(documents(spark, rows, extra=True).repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


@pytest.mark.parametrize("direct", [0, 3])
def test_jaccard_join_by_elements(spark, monkeypatch, direct):
    """Groups of near copies beside sets that share a passage with them, all left to single elements."""
    monkeypatch.setattr(jaccard_join, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(jaccard_join, "CENTRE_ROUNDS", 1)
    rng = random.Random(21)
    rows, i = [], 0
    shared = words(rng, 90)
    for size in (8, 40, 110):
        base = words(rng, size) + shared[: size // 2]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                copy[rng.randrange(len(copy))] = "edited" + str(rng.randrange(10**6))
            rows.append((i, " ".join(copy)))
            i += 1
    for extra in (1, 2, 3, 5, 8, 12, 16, 20, 30):  # from linked over nearly linked to far
        for _ in range(25):
            rows.append((i, " ".join(words(rng, extra) + shared + words(rng, extra // 3))))
            i += 1
    got = jaccard_join.join(documents(spark, rows).repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def test_pigeonhole_finds_every_pair():
    """Some common signature of the smaller set's own band for all pairs above the threshold."""
    rng = np.random.default_rng(9)
    for _ in range(1500):
        n = int(rng.integers(1, 260))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 2 + n // 8))):
            if rng.random() < 0.5 and len(b) > 1:
                b = np.delete(b, rng.integers(len(b)))
            else:
                b = np.append(b, np.uint64(rng.integers(0, 1 << 63)))
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        small, large = sorted((a, b), key=len)
        rules = jaccard_join.bands(85)
        own = rules.band(len(small))
        assert own in rules.schemes(len(large))
        s, t = jaccard_join.signatures(small, 85)
        other = set(jaccard_join.signatures(large, 85)[0].tolist())
        agree = {int(tag) >> 2 for sig, tag in zip(s, t) if tag & 1 and int(sig) in other}
        segments, allowance = rules.segments(own), rules.allowance(own)
        # Whatever segments are skipped, those left must reach the need.
        assert (segments - len(agree)) * (allowance + 1) <= rules.differences(len(small))


def test_components(spark):
    rng = random.Random(10)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    links += [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(120)]
    rng.shuffle(links)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


# ---- line templates


def test_line_templates(spark):
    rng = random.Random(11)
    footer = "Copyright by the editors, page 17 of 90, all rights kept"
    passage = sentence(rng, 70)
    rows = []
    for i in range(30):
        lines = [sentence(rng, rng.randint(6, 30)) for _ in range(4)]
        lines.insert(2, footer.replace("17", str(i)))
        if i % 3 == 0:
            lines.append(passage)
        if i % 5 == 0:
            changed = passage.split(" ")
            changed[10 + i] = "other"
            lines.insert(0, " ".join(changed))
        lines.append("short one")
        rows.append((i, "\n".join(lines)))
    own = dict(rows)
    rows += [(i and 1000 + i, t) for i, t in awkward(rng)] + [(500, rows[3][1])]
    docs = documents(spark, rows, extra=True)
    got = line_dedup.remove(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    by_id = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None and r["doc_id"] < 600}
    assert got.count() == len(rows)
    for i in range(1, 30):
        text = by_id[i]["text"]
        assert "Copyright" not in text and passage not in text and "other" not in text
        for line in own[i].split("\n"):
            if not line.startswith("Copyright") and line != passage and " other " not in line:
                assert line in text.split("\n")
    assert by_id[0]["text"] == own[0]  # the template's first document keeps its lines
    assert by_id[500]["text"] == "" and by_id[500]["n_dropped"] == by_id[500]["n_lines"] - 1
    nulls = [r for r in got.collect() if r["text"] is None]
    assert len(nulls) == 2 and all(r["n_lines"] == 0 for r in nulls)


def test_repeats_inside_a_document_stay(spark):
    line = "the very same line is written twice here"
    got = line_dedup.remove(documents(spark, [(1, f"{line}\n{line}"), (2, "nothing in common with any other row")]))
    assert got.agg(F.sum("n_dropped")).first()[0] == 0


def test_short_lines_are_judged_before_a_document_goes(spark):
    """A document is emptied only if its short lines are all found in an earlier one."""
    footer = "sent from the old post office"
    poem = "red leaf\nstill pond\nno wind"
    rows = [(1, f"{poem}\n{footer}"), (2, f"{poem}\n{footer}"), (3, f"no wind\nnew moon\n{footer}"), (4, f"no wind\n \n{footer}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "no wind\nnew moon", 4: ""}


def test_lines_in_scripts_without_blanks(spark):
    line = "本网站所有内容未经许可不得转载"
    rows = [(i, f"{line}\n{own}\n再见") for i, own in enumerate(["今天的天气很好我们去公园", "他昨天买了三本新书和一支笔"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove(documents(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: rows[1][1].removeprefix(f"{line}\n")}


def test_templates_keep_a_line_that_agrees(spark):
    """Positions that recur in different lines of a leaf make no template; a template keeps a line."""
    rng = random.Random(15)
    lead = "it is a"
    a, b = words(rng, 17), words(rng, 17)
    mixed = " ".join(x if k % 2 else y for k, (x, y) in enumerate(zip(a, b)))
    rows = [(0, f"{lead} {' '.join(a)}"), (1, f"{lead} {' '.join(b)}"), (2, f"{lead} {mixed}")]
    # Each line near the one before it: the third is far from the first and starts a template.
    chain, line = [], words(rng, 20)
    for i in range(10, 14):
        chain.append((i, f"{lead} {' '.join(line)}"))
        line = [f"{w}x" if (i - 10) * 4 <= k < (i - 9) * 4 else w for k, w in enumerate(line)]
    tables = [(20 + i, f"{i} {i * i} 3{i} 4{i} 5{i}") for i in range(4)] + [(30, "1 1 31 41 51")]
    rows += chain + tables
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove(documents(spark, rows)).collect()}
    gone = {i for i, text in got.items() if text == ""}
    assert gone == {11, 13, 30}
    assert all(got[i] == text for i, text in rows if i not in gone)


def test_templates_of_a_leaf_by_brute_force(monkeypatch, spark):
    rng = random.Random(16)
    bases, rows = [words(rng, 12) for _ in range(6)], []
    for i in range(150):
        line = list(rng.choice(bases))
        for k in rng.sample(range(12), rng.randrange(6)):
            line[k] = rng.choice(["7", "other", "some", *words(rng, 1)])
        rows.append((i, "here we have " + " ".join(line)))
    first, gone = [], set()
    for i, text in rows:
        line = ["" if re.search("[0-9]", w) else w for w in text.split()]
        if line.count("") > 3:
            continue
        if any(sum(x == y != "" for x, y in zip(line, f)) >= 12 for f in first):
            gone.add(i)
        else:
            first.append(line)
    for rounds in (0, 2):
        monkeypatch.setattr(line_dedup, "CENTRE_ROUNDS", rounds)
        got = line_dedup.remove(documents(spark, rows)).filter("text = ''").collect()
        assert {r["doc_id"] for r in got} == gone


# ---- decontamination


def test_leaks(spark):
    rng = random.Random(12)
    items = [(i, " ".join(sentence(rng, 12) for _ in range(rng.randint(2, 5)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "Too short!"), (103, items[0][1]), (104, "too short")]
    rows, want = [], set()
    for i in range(150):
        parts = [sentence(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 30))]
        if i % 5 == 0:
            n = rng.randrange(40)
            item = items[n][1].split(" ")
            if i % 10 == 0:  # a paraphrase: one word in eight is another
                item = [w if k % 8 else words(rng, 1)[0] for k, w in enumerate(item, 1)]
            parts.insert(rng.randint(0, len(parts)), " ".join(item))
            want.add((i, n))
            if n == 0:
                want.add((i, 103))
        rows.append((i, " ".join(parts)))
    rows += [(1000 + (i or 0), t) for i, t in awkward(rng)]
    # Items of a few words are found as whole lines only.
    rows += [(2000, "one line\n- too, SHORT.\nand another"), (2001, "this line is too short by far")]
    want |= {(2000, 102), (2000, 104)}
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("clash"))
    got = decontaminate.leaks(documents(spark, rows, extra=True), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    none = documents(spark, [])
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(documents(spark, rows), bench.filter("item_id < 0")).count() == 0


def test_answers_count(spark):
    rng = random.Random(13)
    question = " ".join(words(rng, 40))
    bench = spark.createDataFrame([(1, question, "some quite unusual answer")], "item_id long, text string, answer string")
    kept = " ".join(w for k, w in enumerate(question.split()) if k % 3)
    rows = [(1, f"{kept} some quite unusual answer"), (2, kept), (3, question)] + [
        (i, sentence(rng, 60)) for i in range(10, 60)
    ]
    got = {r["doc_id"] for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == {1, 3}


def test_whole_answers_are_checked(spark):
    """An answer of 30 words counts with all its words, not with its last ones."""
    rng = random.Random(17)
    question, answer = words(rng, 60), words(rng, 30)
    bench = spark.createDataFrame([(1, " ".join(question), " ".join(answer))], "item_id long, text string, answer string")
    kept = [w for k, w in enumerate(question) if k % 3]
    rows = [
        (1, " ".join(kept + answer[:18])), (2, " ".join(kept + answer[-12:])), (3, " ".join(kept)),
    ] + [(i, sentence(rng, 60)) for i in range(10, 60)]
    got = {r["doc_id"] for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == {1}


def test_recall_of_the_latent_gate_with_thousands_of_items(spark):
    """Against the subsequence of every item with every window: 2,000 items, all pairs above the verdict."""
    rng = random.Random(18)
    common = words(rng, 60)

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(n)]

    items = [prose(rng.randint(12, 60)) for _ in range(2000)]
    rows = []
    for i in range(160):
        text = prose(rng.randint(20, 200))
        if i % 2:
            n = rng.randrange(2000)
            # From a copy to the edge of the verdict.
            keep = rng.choice([1.0, 0.95, 0.9, 0.85])
            text[rng.randint(0, len(text)):0] = [w if rng.random() < keep else words(rng, 1)[0] for w in items[n]]
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    want = set()
    texts = [t.split() for _, t in rows]
    sets = [set(t) for t in texts]
    for n, item in enumerate(items):
        size = 8
        while len(item) > 2 * size:
            size *= 2
        for d, text in enumerate(texts):
            if sum(w in sets[d] for w in item) < 0.8 * len(item):
                continue
            shares = [
                decontaminate.lcs(item, text[at : at + 3 * size]) / len(item) for at in range(0, len(text), size)
            ]
            if max(shares) >= decontaminate.SURE_LCS:
                want.add((d, n))
    assert len(want) >= 50 and len(want & got) >= 0.99 * len(want)


def test_latent_basis_of_all_passages(spark, monkeypatch):
    """Whitened by all 45,000 passages and the items: no sample of them makes the basis."""
    made = []
    make = decontaminate.Basis.__init__
    monkeypatch.setattr(decontaminate.Basis, "__init__", lambda self, *a: made.append(a) or make(self, *a))
    rng = np.random.default_rng(19)
    known = np.array([f"term{i}" for i in range(300)] + ["other"] * 100)
    chance = np.r_[1 / (1.0 + np.arange(300)), np.full(100, 0.02)]
    texts = [rng.choice(known, 15_000 * 64 - 20 * i, p=chance / chance.sum()) for i in range(3)]
    items = [known[i : i + 30] for i in range(0, 300, 30)]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(items)], "item_id long, text string")
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, ""), (10, None)]
    decontaminate.leaks(documents(spark, rows), bench)
    idf, found = made[0]
    terms = {w: i for i, w in enumerate(sorted(set(known) - {"other"}))}
    rows = [t[at : at + 64] for t in texts for at in range(0, len(t), 64)] + items
    gram = np.zeros((300, 300))
    for at in range(0, len(rows), 5000):
        part = rows[at : at + 5000]
        counts = np.zeros((len(part), 300))
        for n, row in enumerate(part):
            own = [terms[w] for w in row.tolist() if w != "other"]
            np.add.at(counts[n], own, 1)
        weights = counts * idf
        weights /= np.maximum(np.sqrt((weights**2).sum(1)), 1e-12)[:, None]
        gram += weights.T @ weights
    assert len(rows) > 45_000 and found.shape == (300, decontaminate.RANK)
    assert np.abs(found.T @ gram @ found - np.eye(decontaminate.RANK)).max() < 1e-6


def test_lcs():
    rng = random.Random(14)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, b) == table[-1][-1]


# ---- classifiers


def held_out(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_toxicity(spark):
    rng = random.Random(15)
    bad = ["vilewort", "nastyterm", "foulname"]
    rows, labels = [], []
    for i in range(700):
        text = words(rng, rng.randint(20, 60))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    truth = dict(labels)
    labels += [(None, 1), (5000, 1), (3, None)]
    docs = documents(spark, rows + [(9000 + (i or 0), t) for i, t in awkward(rng)], extra=False)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 14 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    test = [r for r in got if r["doc_id"] in truth and held_out(r["doc_id"], 3, 1)]
    wrong = [r for r in test if r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 0.05 * len(test)
    # Held-out labels are not learned from.
    flipped = spark.createDataFrame(
        [(i, 1 - y if i is not None and y is not None and held_out(i, 3, 1) else y) for i, y in labels],
        "doc_id long, toxic int",
    )
    other = toxicity.train(docs, flipped)
    assert np.array_equal(other.index, model.index) and np.allclose(other.weight, model.weight)
    blank = toxicity.train(docs, marks.filter("doc_id < 0"))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.5}


def test_ftrl_by_the_formulas():
    """One shard against FTRL-proximal with dictionaries, coordinate by coordinate."""
    rng = random.Random(22)
    common = words(rng, 40)
    memo = toxicity.Memo(toxicity.word_hash)
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(common) for _ in range(rng.randint(0, 30))) + (" vilewort" if i % 4 == 0 else "")
        rows.append((toxicity.features(text, memo), int(i % 4 == 0)))
    seen = Counter(int(f) for found, _ in rows for f in found)
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        l1, l2 = (0.0, 0.0) if f == toxicity.BIAS else (toxicity.L1, toxicity.L2)
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + l2)

    def worth(f):
        return 1.0 if f == toxicity.BIAS or f >= int(toxicity.WORD_BIT) else toxicity.PAIR_VALUE

    for _ in range(2):
        for found, label in rows:
            used = [toxicity.BIAS] + [int(f) for f in found if seen[int(f)] >= toxicity.MIN_ROWS]
            w = {f: weight(f) for f in used}
            p = 1 / (1 + math.exp(-sum(w[f] * worth(f) for f in used)))
            for f in used:
                g = (p - label) * worth(f)
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    index, got_z, got_n, grown = toxicity.learn(rows, toxicity.Model.empty(), passes=2)
    want = {f for f in z if weight(f) != 0.0} | {toxicity.BIAS}
    assert set(index.tolist()) == want
    for f, a, b, c in zip(index.tolist(), got_z, got_n, grown, strict=True):
        assert (a, b, c) == pytest.approx((z[f], n[f], n[f]), rel=1e-9, abs=1e-12)


def test_language_sizes_by_plain_compression():
    """Sizes are those of one compressor a dictionary and block; ties go to the first language."""
    import zstandard

    rng = random.Random(23)
    dictionaries = {name: " ".join(words(rng, 500)).encode() for name in ("aa", "bb", "cc")}
    classifier = language_id.Classifier(dictionaries)
    settings = zstandard.ZstdCompressionParameters(**language_id.MATCHING)
    texts = ["", "word", "x" * 30_000, " ".join(words(rng, 4_000)), "日本語 テスト " * 900]
    for text in texts:
        data = text.encode()
        for name, size in zip(classifier.languages, classifier.sizes(text), strict=True):
            plain = 0
            for i in range(0, len(data), language_id.BLOCK_BYTES):
                one = zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                    compression_params=settings,
                )
                plain += len(one.compress(data[i : i + language_id.BLOCK_BYTES]))
            assert abs(plain - size) <= 0.01 * plain
    same = language_id.Classifier({"zz": dictionaries["aa"], "mm": dictionaries["aa"]})
    assert same.classify("some words to read")[0] == "mm"


def test_language(spark):
    rng = random.Random(16)
    tongues = {
        "aa": ["schlecht", "ung", "keit", "ver", "ge", "lich"], "bb": ["tion", "ment", "eau", "que", "oi", "re"],
        "cc": ["ing", "the", "wh", "ough", "ness", "ly"],
    }
    rows = []
    for i in range(360):
        lang = sorted(tongues)[i % 3]
        text = " ".join("".join(rng.choices(tongues[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(30, 200)))
        rows.append((i, text, lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 456 !!", "cc"), (903, rows[0][1] * 40, None), (None, rows[1][1], "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    learned = language_id.learn(docs)
    assert sorted(learned) == sorted(tongues)
    got = {r["doc_id"]: r for r in language_id.identify(docs, learned).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    test = [(got[i], lang) for i, _, lang in rows[:360] if held_out(i, 5, 0)]
    assert sum(r["lang_pred"] == lang for r, lang in test) >= 0.98 * len(test)
    assert got[903]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    # Held-out languages are not learned from.
    swapped = [(i, t, "zz" if i is not None and held_out(i, 5, 0) else g) for i, t, g in rows]
    assert language_id.learn(spark.createDataFrame(swapped, "doc_id long, text string, lang string")) == learned
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


# ---- licenses


def test_licenses(spark):
    rng = random.Random(17)
    body = "\n".join(sentence(rng, 20) for _ in range(20))
    rows = [
        ("r/LICENSE", "Licensed under the Apache License, Version 2.0"), ("r/a/x.py", body), ("r/a/b/c/y.py", body),
        ("r/a/z.py", f"# Released under the MIT License.\n{body}"), ("r/sub/COPYING", "All rights reserved."),
        ("r/sub/deep/w.py", body), ("q/v.py", body), (None, body), ("top.py", None), ("r/a/x.py", body),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "id long, path string, text string")
    files = files.withColumn("license", F.lit("clash"))
    got = {r["id"]: r for r in licenses.inherit(licenses.scan(files, "id", F.col("path"))).collect()}
    want = ["Apache-2.0", "Apache-2.0", "Apache-2.0", "MIT", "Proprietary", "Proprietary", None, None, None, "Apache-2.0"]
    assert [got[i]["license"] for i in range(10)] == want
    assert got[2]["origin"] == "inherited" and got[2]["from_dir"] == "r" and got[3]["origin"] == "own"
    assert got[5]["from_dir"] == "r/sub"


def plain_cosine(words, template, idf, other):
    a, b = Counter(words), Counter(template)
    weigh = lambda c: {w: n * idf.get(w, other) for w, n in c.items()}
    a, b = weigh(a), weigh(b)
    dot = sum(x * b.get(w, 0.0) for w, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_windows_by_brute_force():
    """Every window of every template's length, plain cosines, under odd frequencies."""
    rng = random.Random(18)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.plain_words(t)})
    lines = 1000
    for round_ in range(25):
        frequency = {w: rng.randrange(lines) for w in vocabulary}
        matcher = licenses.Matcher(licenses.TEMPLATES, frequency, lines, licenses.FULL_TEXTS)
        idf = {w: math.log((lines + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in matcher.index}
        other = math.log(lines + 1) + 0.01
        words = [rng.choice(vocabulary) if rng.random() < 0.3 else b"other%d" % rng.randrange(50) for _ in range(60)]
        for _ in range(3):
            notice = licenses.plain_words(rng.choice(licenses.TEMPLATES)[1])
            for _ in range(rng.randrange(3)):
                notice[rng.randrange(len(notice))] = rng.choice([b"some", b"software", b"the"])
            at = rng.randrange(len(words))
            words[at:at] = notice
        found = {t: c for t, _, c in matcher.windows(words, matcher.ids(words))}
        for t, (_, text) in enumerate(licenses.TEMPLATES):
            template = licenses.plain_words(text)
            n = len(template)
            best = max(
                plain_cosine(words[max(0, i) : i + n], template, idf, other) for i in range(1 - n, len(words))
            )
            assert (t in found) == (best >= licenses.MIN_COSINE), (round_, t)
            if t in found:
                assert found[t] == pytest.approx(best, abs=1e-9)


NOTICES = {
    "Apache-2.0": "/* Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0. See LICENSE for details. */",
    "BSD": "# Copyright 2001\n# Redistribution and use in source and binary forms, with or without\n"
           "# modification, are permitted provided that the following conditions are met:\n# All rights reserved.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons\nAttribution 4.0 International License. It was written in spring.",
    "GPL-3.0": " * This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU\n"
               " * General Public License as published somewhere.",
    "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla\n// Public License, v. 2.0. If a copy was not given",
}


def test_wrapped_notices_and_words_around_them(spark):
    rng = random.Random(19)
    rows = [(name, f"{sentence(rng, 9)}\n{notice}\n{chr(10).join(sentence(rng, 15) for _ in range(12))}") for name, notice in NOTICES.items()]
    rows += [(None, "\n".join(sentence(rng, 15) for _ in range(12))) for _ in range(60)]
    rows.append((None, " ".join(words(rng, 60_000))))
    rows.append(("MIT", " ".join(words(rng, 30_000)) + " Released under the MIT License " + " ".join(words(rng, 30_000))))
    files = spark.createDataFrame([(i, f"d{i}/x", t) for i, (_, t) in enumerate(rows)], "id long, path string, text string")
    got = {r["id"]: r for r in licenses.scan(files, "id", F.col("path")).collect()}
    assert [got[i]["own_license"] for i in range(len(rows))] == [name for name, _ in rows]
    assert all(got[i]["line"] in (1, 2) for i in range(5)) and got[len(rows) - 1]["line"] == 0
    assert all(got[i]["file_cosine"] < licenses.FILE_COSINE for i in range(5))


def test_licence_files_by_their_whole_text(spark):
    rng = random.Random(20)
    full = {name: text for name, text in licenses.FULL_TEXTS}
    body = "\n".join(sentence(rng, 15) for _ in range(12))
    rows = [
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + full["MIT"]), ("a/b/x", body),
        ("c/COPYING", full["BSD"]), ("c/y", body), ("c/LICENSE", full["BSD"]), ("d/README", f"{body}\n{NOTICES['Apache-2.0']}"), ("d/z", body),
        ("e/LICENSE", "All rights reserved."), ("e/w", body),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "id long, path string, text string")
    got = {r["id"]: r for r in licenses.inherit(licenses.scan(files, "id", F.col("path"))).collect()}
    assert [got[i]["license"] for i in range(9)] == ["MIT", "MIT", "BSD", "BSD", "BSD", "Apache-2.0", None, "Proprietary", "Proprietary"]
    assert [got[i]["file_cosine"] >= licenses.FILE_COSINE for i in range(9)] == [True, False, True, False, True, False, False, True, False]
    # Ties of directories and repeated rows: the same answer in any order.
    again = licenses.inherit(licenses.scan(files.unionAll(files).repartition(3), "id", F.col("path")))
    assert Counter((r["id"], r["license"]) for r in again.collect()) == Counter({(i, got[i]["license"]): 2 for i in range(9)})


# ---- empty tables


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        token_counts.count_tokens(docs, f"{folder}/c", TOKENIZER), packing.pack(docs, TOKENIZER),
        pii.digest(pii.find(docs)), jaccard_join.join(docs), line_dedup.remove(docs),
        toxicity.score(docs, toxicity.train(docs, labels)),
        language_id.identify(docs, language_id.learn(docs)),
        licenses.inherit(licenses.scan(docs, "doc_id", F.col("source"))),
    ]
    assert [r.count() for r in results] == [0] * len(results)
