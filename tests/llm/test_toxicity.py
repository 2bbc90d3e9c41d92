import random

import numpy as np

from pyspark.sql import functions as F
from sessionlake.llm import toxicity
from sessionlake.llm.queries import op4_toxicity

DOCS = "doc_id bigint, text string"
LABELS = "doc_id bigint, toxic int"


def corpus(n=900, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ten", "vor", "sil") for c in ("da", "po", "ne")]
    slurs = ["grobnak", "fulvish", "sneddle"]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(slurs) + rng.choice(["", ".", "s"]))
        if rng.random() < (0.9 if bad else 0.1):
            text.append("muslim.")
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS), ~toxicity.held_out(F.col("id")))
    scored = toxicity.score(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [r for r in scored if r.h]
    assert 200 < len(held) < 400 and all(0 <= r.score <= 1 for r in scored)
    assert np.mean([(r.score >= toxicity.THRESHOLD) == truth[r.doc_id] for r in held]) > 0.95


def test_neutral_mentions_are_spared(spark):
    """The penalty lowers what a group's name adds to the score."""
    rows, labels = corpus(seed=4)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    neutral = spark.createDataFrame([(1, "katenda lovorpo mitenne"), (2, "katenda lovorpo muslim. mitenne"), (3, "katenda lovorpo hindu. mitenne")], DOCS)
    adds = []
    for weight in (0.0, 20.0):
        got = {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.train(docs, marks, F.lit(True), weight=weight)).collect()}
        logit = {k: np.log(s / (1 - s)) for k, s in got.items()}
        adds.append(abs(logit[2] - logit[3]))
    assert adds[1] < 0.35 * adds[0]


def test_swapped_sentences():
    found = toxicity.Swap(toxicity.IDENTITY_TERMS)("A Muslim man. Nothing here! Two women\nmuslims")
    assert found == [("A Muslim man.", "A christian women."), ("Two women", "Two men")]


def test_all_sentences_of_a_text_are_swapped():
    text = " ".join(f"number {i} is a muslim." for i in range(50))
    assert len(toxicity.Swap(toxicity.IDENTITY_TERMS)(text)) == 50
    kinds = toxicity.kinds_of(toxicity.TERMS)
    assert toxicity.Swap(kinds)("Ein Nachbar ist taub.") == [("Ein Nachbar ist taub.", "Ein Nachbar ist behindert.")]
    every = [w for k in kinds.values() for w in k]
    assert len(every) == len(set(every)) and toxicity.Swap({})("gay") == []
    pair = {"x": ["old man", "young man"]}
    assert toxicity.Swap(pair)("An Old man, a young man. No man.") == [("An Old man, a young man.", "An young man, a old man.")]


def test_mentions_of_the_table_itself(spark):
    """Its texts name no group; neutral sentences still keep planted names from raising scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    names = sorted({w for k in toxicity.kinds_of(toxicity.TERMS).values() for w in k})
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").select("doc_id", "text")
    named = clean.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" " + " ".join(names))).alias("text"))
    moved, flagged, reached = [], [], []
    for weight in (0.0, 1.0):
        model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("id")), weight=weight)
        reached.append(sum(bool(a or b) for a, b in toxicity.different(toxicity.Lookup(model[1]), toxicity.mentions(toxicity.TERMS))))
        both = toxicity.score(named, model, name="after").join(toxicity.score(clean, model), "doc_id").collect()
        moved.append(sum(abs(r.after - r.score) for r in both))
        flagged.append(sum(r.after >= toxicity.THRESHOLD for r in both))
    assert reached[0] == reached[1] and flagged[1] <= flagged[0]
    assert not reached[0] or moved[1] < 0.2 * moved[0]


def test_rows_without_a_key_are_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (4,)], "doc_id bigint").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    import zlib

    assert {r.doc_id: r.h for r in rows} == {None: True} | {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 4)}


def test_sample_is_bounded_and_skips_held_out(spark):
    rows, labels = corpus(300)
    docs, marks = spark.createDataFrame(rows + rows, DOCS), spark.createDataFrame(labels + [(0, None), (None, 1), (1, 7)], LABELS)
    got = toxicity.sample(docs, marks, ~toxicity.held_out(F.col("id")), "doc_id", "text", "toxic", 20).collect()
    assert {c: sum(r.label == c for r in got) for c in (0, 1)} == {0: 20, 1: 20}
    texts = {r.text for r in got}
    out = {r.doc_id for r in spark.createDataFrame(rows, DOCS).filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert not {t for i, t in rows if i in out} & texts


def test_labels_lang_and_source_are_no_input(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS + ", lang string, source string, score int")
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS), F.lit(True))
    a = {r[0]: r[1] for r in toxicity.score(docs, model).collect()}
    b = {r[0]: r[1] for r in toxicity.score(spark.createDataFrame([(i + 10_000, t) for i, t in rows], DOCS), model).collect()}
    assert all(a[i] == b[i + 10_000] for i in a)


def test_edge_cases(spark):
    rows, labels = corpus(120)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs, marks, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "grobnak fulvish"), (3, "x" * 400_000), (4, "katenda " * 50_000), (4, "katenda " * 50_000)], DOCS)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 6 and {r.score for r in got if r.doc_id in (1, 2, 3)} == {got[0].score}
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, marks.limit(0), F.lit(True))
    assert all(0 <= r.score < 1e-9 for r in toxicity.score(docs, none).collect())
    clean = toxicity.train(docs, marks.filter("toxic = 0"), F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(docs, clean).collect())


def test_query(spark):
    got = op4_toxicity(spark, "/root/testdata/sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in got.collect() if r.doc_id in labels]
    assert sum(r.predicted for r in rows if not labels[r.doc_id]) <= 0.02 * len(rows)
    assert sum(r.predicted for r in rows if labels[r.doc_id] and r.held_out) >= 0.5 * sum(labels[r.doc_id] for r in rows if r.held_out)
