import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from sessionlake.llm import toxicity
from tests.llm.test_jaccard import grams
from tests.llm.test_quality import measured

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out(F.col("id")))
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.7").collect()}
    clean.write.parquet(f"{tmp_path}/1")
    clean = spark.read.parquet(f"{tmp_path}/1")
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} - rejected and rejected

    good = corpus_pipeline.drop_low_quality(spark, clean, SF)
    assert good.columns == columns
    good.write.parquet(f"{tmp_path}/2")
    good = spark.read.parquet(f"{tmp_path}/2")
    kept = {r.doc_id for r in good.collect()}
    numbers = {i: measured(t) for i, t in rows.items()}
    assert kept == {i for i, (n, _, _, _, r) in numbers.items() if n >= 10 and 100 * r <= 20 * n}  # no host fails as a whole here

    one = corpus_pipeline.drop_near_copies(spark, good, SF)
    assert one.columns == columns
    one.write.parquet(f"{tmp_path}/3")
    one = spark.read.parquet(f"{tmp_path}/3")
    left = sorted(r.doc_id for r in one.collect())
    sets = {i: grams(rows[i]) for i in kept}
    by_gram = {}
    for i, s in sets.items():
        for g in s:
            by_gram.setdefault(g, []).append(i)
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for ids in by_gram.values():
        for i in ids:
            for j in ids:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
    assert left == sorted({find(i) for i in kept})

    packed = corpus_pipeline.pack(spark, one, SF).collect()
    assert sorted(r.doc_id for r in packed) == left
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed))


def test_extra_columns_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, kept int, node int"
    docs = spark.createDataFrame([(1, text, "en", "s", 5, 1, 2, 3), (1, text, "en", "s", 5, 1, 2, 3), (2, text + " x", "en", None, 5, 1, 2, 3), (None, text + " y z", None, "s", None, 1, 2, 3)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]


def test_each_row_goes_by_its_own_class(spark):
    """Rows that share a doc_id, or have none, with several texts."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, b, "s"), (5, b + " x", "s"), (5, a, "s"), (7, a, "s"), (9, c, "s"), (9, d, "s"), (3, c + " y", "t"), (3, c + " y", "u"), (3, c + " y", "u"), (None, d, "s"), (None, a + " z", "s"), (None, "e f g h i j", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    again = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs.repartition(3), SF).collect()), key=str)
    assert got == again and [r for r in got if r[0] == 3] in ([rows[6]], [rows[7]])
    assert [r for r in got if r[0] != 3] == sorted([rows[i] for i in (0, 2, 5, 9, 10, 11)], key=str)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_the_rest_imports_nothing_of_this_subpackage():
    for path in (ROOT / "sessionlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_the_rest_works_without_this_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.queries()) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
