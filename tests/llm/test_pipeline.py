"""The pipeline's stages on a small corpus with planted cases, and the registered queries."""

import random

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, toxicity
from tabloom.llm.common import Memo, plain_words, word_hash
from tabloom.llm.queries import QUERIES
from test_text_operators import brute_components, check_packing, library  # noqa: F401
from tests_llm_words import sentence, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rng = random.Random(1)
    texts, labels = {}, []
    for i in range(240):
        texts[i] = "\n".join(sentence(rng, rng.randint(8, 25)) for _ in range(rng.randint(3, 10)))
    bad = ["vilewort", "nastyterm", "foulname"]
    for i in range(300, 420):  # toxic ones
        text = words(rng, 60)
        for w in bad * 2:
            text.insert(rng.randrange(len(text)), w)
        texts[i] = " ".join(text)
    labels = [(i, 1, int(i >= 300)) for i in texts]
    item = " ".join(words(rng, 40))
    texts[500] = f"{sentence(rng, 30)} {item} {sentence(rng, 20)}"
    passage = sentence(rng, 60)
    for i in range(510, 516):  # a passage in otherwise different documents
        texts[i] = f"{sentence(rng, 20)}\n{passage}\n{sentence(rng, 20)}"
    base = words(rng, 200)
    for i in range(520, 523):  # near copies whose lines differ in their first words
        copy = list(base)
        copy[0] = "start" + "xyz"[i - 520]
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(
        [(i, t, "xx", "s", len(t)) for i, t in texts.items()] + [(600, None, None, None, None), (601, "", "xx", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages(spark, folder):
    texts = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, frames = [set(texts) | {600, 601}], []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        frames.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        kept.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
    toxic = set(range(300, 420))
    assert kept[0] - kept[1] <= toxic and len(kept[0] - kept[1]) > 110
    assert kept[1] == kept[2]
    rows = {r["doc_id"]: r for r in frames[1].collect()}
    passage = texts[510].split("\n")[1]
    assert [i for i in range(510, 516) if passage in rows[i]["text"]] == [510]
    assert all(rows[i]["text"] == texts[i] for i in range(240))
    assert rows[511]["n_chars"] == len(rows[511]["text"])
    assert kept[2] - kept[3] == {521, 522}
    assert kept[3] - kept[4] == {500}
    assert kept[5] == kept[4]
    pieces = frames[4].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert pieces.filter("n <> m").count() == 0
    whole = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == kept[5]


def test_repeated_rows_and_empty_tables(spark, folder):
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.unionAll(docs)
    once = corpus_pipeline.drop_near_copies(spark, twice, folder)
    assert once.count() == once.select("doc_id").distinct().count() == docs.count() - 2
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), folder).count() == 0


def test_near_copies_share_four_fifths_of_five_word_shingles(spark, folder):
    base = [f"w{i}" for i in range(204)]  # 200 shingles of five words, 201 of four
    rows = []
    for i, changed in enumerate([(), (0, 40, 80, 120, 160), (0, 40, 80, 120, 160, 190)]):
        rows.append((i, " ".join("other" + str(i) if k in changed else w for k, w in enumerate(base)), "xx", "s", 0))
    # 21 shingles changed: 179 / 221 = 0.81; at four words 17: 184 / 218 = 0.844. Then 26: 174 / 226 = 0.77.
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_registered(spark):
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"
    ]


def test_queries_give_their_columns(spark):
    folder = "/root/testdata/sf0.001"
    want = {
        "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op5_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
        "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op8_jaccard_join": ["doc_id", "n_shingles", "component_id"],
        "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op11_merkle_manifest": [
            "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
        ],
        "op12_quality": ["doc_id", "held_out", "score", "predicted"],
        "op13_centroid_clusters": [
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
        ],
    }
    rows = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, columns in want.items():
        df = QUERIES[name](spark, folder)
        assert df.columns[: len(columns)] == columns
        if name not in ("op5_nearest_neighbours", "op6_packing", "op13_centroid_clusters"):
            assert df.count() == rows


def test_clashing_columns_in_every_stage(spark, folder):
    """Columns that operators make or use under the same names come through unchanged."""
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["predicted", "score", "n_dropped", "n_lines", "component_id", "n_shingles", "item_id", "key", "id", "label"]
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/clash-{name}")
        docs = spark.read.parquet(f"{folder}/clash-{name}")
        plain = function(spark, plain, folder)
        assert sorted(map(repr, docs.select(COLUMNS).collect())) == sorted(map(repr, plain.collect()))
    for r in docs.collect():
        assert all(r[n] == (None if r["doc_id"] is None else f"{n} of {r['doc_id']}") for n in names)
    assert corpus_pipeline.pack(spark, docs, folder).count() > 0


def brute_lines(rows):
    """Texts without lines of recurring templates, for plain lines of five words and more."""
    leaves, owner = {}, {}
    for doc_id, text in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        for line in text.split("\n"):
            w = line.split()
            leaf = leaves.setdefault((len(w), *w[:3]), [])
            near = [t for t in leaf if sum(a == b for a, b in zip(w, t[0])) >= 0.8 * len(w)]
            if not near:
                leaf.append((w, doc_id))
            owner[doc_id, line] = near[0][1] if near else doc_id
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get((doc_id, x), doc_id) == doc_id]
        if kept or not lines:
            out.append((doc_id, text if text is None else "\n".join(kept)))
    return out


def brute_leaks(rows, items):
    """Ids of texts with a window that holds an item, by subsequences of all windows."""
    found = set()
    for doc_id, text in rows:
        own = plain_words(text or "")
        for item in items:
            ids, answer = plain_words(item), plain_words(decontaminate.last_sentence(item))
            size = decontaminate.BLOCK
            while len(ids) > 2 * size:
                size *= 2
            for at in range(0, len(own), size):
                window = own[at : at + 3 * size]
                share = decontaminate.lcs(ids, window) / len(ids)
                told = decontaminate.lcs(answer, window) / len(answer)
                if share >= decontaminate.SURE_LCS or share >= decontaminate.MIN_LCS and told >= decontaminate.MIN_ANSWER:
                    found.add(doc_id)
    return found


def test_stages_by_brute_force(spark, folder, library):  # noqa: F811
    """Each stage on the output of the one before it, against plain Python."""
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    frames = {}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model, memo = toxicity.train(docs, labels), Memo(word_hash)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, folder)
        out.write.parquet(f"{folder}/brute-{name}")
        out = frames[name] = spark.read.parquet(f"{folder}/brute-{name}")
        if name == "toxicity":
            want = [(i, t) for i, t in rows if model.score(toxicity.features(t or "", memo)) < 0.7]
        elif name == "line_dedup":
            want = brute_lines(rows)
        elif name == "ngram_jaccard_join":
            first = {i: c for i, _, c in brute_components(rows, 5, 80)}
            want = [(i, t) for i, t in rows if first[i] == i]
        elif name == "decontamination":
            gone = brute_leaks(rows, items)
            want = [(i, t) for i, t in rows if i not in gone]
        else:
            check_packing(rows, out.collect(), library, 4096)
            break
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted(rows, key=str) == sorted(want, key=str), name
        docs = out
