import random

import numpy as np

from sessionlake.llm import jaccard

SCHEMA = "doc_id bigint, text string"


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), [r[0] for r in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for a, _ in edges:
        links[a] += 1
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if root[b] < root[a]:
                root[a], changed = root[b], True
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, root))


def run(spark, rows):
    return sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()))


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 120))
        if i % 3 == 0:
            words = passage + words
        rows.append(words)
        if i % 4 == 0:
            for _ in range(rng.randint(1, 5)):
                near = list(words)
                for _ in range(rng.randint(0, 3)):
                    near[rng.randrange(len(near))] = rng.choice(vocabulary)
                rows.append(near)
    rng.shuffle(rows)
    return [(i * 7, " ".join(w)) for i, w in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    assert run(spark, rows) == want and sum(r[1] for r in want) > 80


def test_edge_cases(spark):
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one  two"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e"), (9, "a b c d f"),
        (10, long), (11, long + " end"), (12, "é ü \x00 z y"), (13, "é ü \x00 z y"), (14, "a b c d e f"),
    ]
    got = run(spark, rows)
    assert got == brute(rows) and got[4][1:] == (1, 4, False) and got[10][1] == 1 and got[0] == (1, 0, 1, True)
    assert run(spark, []) == []


def test_repeated_rows_and_null_keys(spark):
    t = "a b c d e f g"
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in jaccard.join(spark.createDataFrame([(3, t), (3, t), (None, t), (None, "p q r s t u")], SCHEMA)).collect())
    assert got == [("3", 2, "3", True), ("3", 2, "3", True), ("None", 0, "None", True), ("None", 2, "3", False)]


def test_null_keys_take_part(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t), (None, t), (None, t + " x"), (4, "a b c d e f"), (4, " ".join(f"v{i}" for i in range(30))), (None, " ".join(f"v{i}" for i in range(31)))]
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("4", 0, "4", True), ("4", 1, "4", True), ("None", 1, "4", False), ("None", 2, "None", False), ("None", 2, "None", False), ("None", 2, "None", True)]


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 12)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id bigint, text string, id int, TEXT int, node int")
    assert sorted(map(tuple, jaccard.join(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_prefixes_are_shortened_until_the_recall():
    for s in (0.5, 0.8, 0.85, 0.95):
        lengths = jaccard.shortened(s)
        assert jaccard.recall(lengths, s) >= jaccard.TARGET_RECALL
        last = max(i for i, k in enumerate(lengths) if k == min(lengths))
        assert max(lengths) - min(lengths) <= 1 and min(lengths) == jaccard.DEPTH or jaccard.recall([k + (i == last) for i, k in enumerate(lengths)], s) < jaccard.TARGET_RECALL
    assert len(set(jaccard.shortened(0.8))) == 2  # trees differ
    assert sum(jaccard.shortened(0.8)) < sum(jaccard.shortened(0.86)) < sum(jaccard.shortened(0.95))


def test_prefixes_follow_the_member():
    """Few n-grams allow few similarities; partners meet at the longer prefix."""
    for n in range(1, 30):
        possible = [a / u for a in range(1, n + 1) for u in range(n, 80) if (a, u) != (n, n) and a / u >= 0.8]
        assert jaccard.least_similarity(n, 0.8) == min(possible, default=1.0)
    plan = jaccard.prefixes(0.8)
    assert {n for n, _, _ in plan} == {0, *range(4, jaccard.FEW + 1)}
    entered = {}
    for n, tree, length in plan:
        entered.setdefault((n, tree), set()).add(length)
    for n in range(4, jaccard.FEW + 1):
        for m in range(n, min(jaccard.FEW, int(n / 0.8)) + 1):
            low = max(jaccard.least_similarity(n, 0.8), jaccard.least_similarity(m, 0.8))
            meet = [max(entered[n, t] & entered[m, t], default=99) for t in range(jaccard.TREES)]
            assert jaccard.recall([min(entered[n, t] & entered[m, t]) for t in range(jaccard.TREES)], low) >= jaccard.TARGET_RECALL and 99 not in meet


def test_members_meet_at_different_prefixes(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    near = [base[:k] + ["other"] + base[k + 1 :] for k in (10, 50, 90)]
    far = base[:330] + [f"z{i}" for i in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, *near, far])] + [(10 + i, " ".join(rng.choices(base, k=60))) for i in range(50)]
    ws = jaccard.Workspace(spark, "test")
    found = jaccard.features(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    classes = found.selectExpr("id AS node", "grams", "signature")
    lengths = {frozenset((r.node, r.root)): r.length for r in jaccard.matched(ws, classes, 0.8).collect()}
    ws.close()
    assert {k for k in lengths if 4 not in k} and all(lengths[k] == jaccard.DEPTH for k in lengths if 4 not in k)
    assert {lengths[k] for k in lengths if 4 in k} <= {4, 5, 8}


def test_hot_nodes_deal_their_groups_apart(spark):
    """Rows of one large group don't meet each other, but all others, once."""
    from sessionlake.llm.common import in_blocks_apart

    rows = [("p", i, 0) for i in range(40)] + [("p", 100 + i, 1) for i in range(25)] + [("p", 200 + i, 2 + i) for i in range(30)] + [("q", 300, 0), ("q", 301, 1)]
    ws = jaccard.Workspace(spark, "test")
    dealt = in_blocks_apart(ws, spark.createDataFrame(rows, "place string, node int, group int"), "place", "node", "group", 8).collect()
    ws.close()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.place, r.b1, r.b2), []).append(r)
    met = {}
    for (_, b1, b2), members in tasks.items():
        assert len(members) < 60
        for a in members:
            for b in members:
                if a.node < b.node and (b1 == b2 or {a.side, b.side} == {b1, b2}):
                    met[a.node, b.node] = met.get((a.node, b.node), 0) + 1
    group = {i: g for _, i, g in rows if i < 300}
    want = {(a, b) for a in group for b in group if a < b and group[a] != group[b]}
    assert want <= set(met) and met[300, 301] == 1 and set(met.values()) == {1}
    assert not any(group[a] == group[b] for a, b in met if b < 300)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(4)
    for j in (0.3, 0.8):
        off = []
        for _ in range(60):
            every = rng.integers(1 << 63, size=600, dtype=np.uint64)
            shared = int(600 * j)
            half = (600 - shared) // 2
            a, b = every[: shared + half], np.concatenate([every[:shared], every[shared + half :]])
            off.append((jaccard.signature(np.unique(a)) == jaccard.signature(np.unique(b))).mean() - j)
        assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.08
