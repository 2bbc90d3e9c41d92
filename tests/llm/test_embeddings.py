import numpy as np
import pytest

from sessionlake.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=embeddings.THRESHOLD):
    """Links and components by all pairs."""
    able = {}
    for k, (i, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        able[k] = (i, x / np.linalg.norm(x), label)
    links, comp = [0] * len(rows), list(range(len(rows)))
    edges = []
    for a in able:
        for b in able:
            if a != b and able[a][2] == able[b][2] and len(able[a][1]) == len(able[b][1]) and able[a][1] @ able[b][1] >= threshold:
                links[a] += 1
                edges.append((a, b))
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if root[b] < root[a]:
                root[a], changed = root[b], True
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, root))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, embeddings.join(df, **options).collect()))


def planted(n, groups, dim=48, seed=0, noise=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for g in range(groups):
        first, size = g * 12, 2 + g % 9
        x[first : first + size] = x[first] + noise * rng.normal(size=(size, dim))
    return [(int(i), v.astype(np.float32).tolist(), int(i) // 12 % 3) for i, v in enumerate(x)]


def test_against_all_pairs(spark):
    rows = planted(360, 30)
    want = brute(rows)
    assert run(spark, rows) == want and sum(r[1] for r in want) > 100


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0, 8.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0] * 4, 0), (9, [1.0, None, 3.0, 4.0], 0),
        (10, [1.0, float("nan"), 3.0, 4.0], 0), (11, [1.0, float("inf"), 3.0, 4.0], 0), (12, [1.0, 2.0, 3.0], 0), (13, [-1.0, -2.0, -3.0, -4.0], 0),
    ]
    got = run(spark, rows)
    assert got == brute(rows) and got[0] == (1, 2, 1, True) and got[2] == (3, 2, 1, False)
    assert run(spark, []) == []


def test_repeated_rows_and_null_keys(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    got = embeddings.join(spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (None, [4.0, 3.0, 2.0, 9.0], 0)], SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", True), ("None", 2, "1", False)]


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    rows = [(i, (base + 0.1 * rng.normal(size=32)).astype(np.float32).tolist(), 0) for i in range(90)] + [(100 + i, base.astype(np.float32).tolist(), 0) for i in range(50)]
    assert run(spark, rows) == brute(rows)


def test_clashing_columns_and_wide_vectors(spark):
    rows = [(1, [1.0, 2.0], 0, 9, 9, 9, 9), (2, [1.0, 2.001], 0, 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, id int, digest int, node int, LABEL int")
    assert sorted(map(tuple, embeddings.join(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("functions", [1, 2, 3])
def test_recall_at_the_threshold(functions):
    rng = np.random.default_rng(5)
    tables = embeddings.tables_for(64, functions, 0.93, 0.9999)
    x, z = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    met = np.zeros(1500, bool)
    for t in range(tables):
        a, b = embeddings.codes(x, t, functions), embeddings.codes(y, t, functions)
        met |= ((a == b[:, :1]) | (b == a[:, :1])).any(1)
    assert met.mean() > 0.995


def test_magnitudes(spark):
    """Squares of components may be out of a double's range."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=32)
    near, other = a + 0.05 * rng.normal(size=32), rng.normal(size=32)
    rows = []
    for k, scale in enumerate((1.0, 1e200, 1e-200, 1e300, 1e-306)):
        rows += [(10 * k + i, (v * scale).tolist(), k) for i, v in enumerate((a, near, other))]
    rows += [(90, (a * 1e150).tolist(), 9), (91, (a * 1e-150).tolist(), 9), (92, (other * 1e-150).tolist(), 9)]
    got = sorted(map(tuple, embeddings.join(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()))
    want = []
    for k in range(5):
        want += [(10 * k, 1, 10 * k, True), (10 * k + 1, 1, 10 * k, False), (10 * k + 2, 0, 10 * k + 2, True)]
    assert got == want + [(90, 1, 90, True), (91, 1, 90, False), (92, 0, 92, True)]
