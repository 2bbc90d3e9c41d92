import random

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import common


def reachable(edges):
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


def shapes():
    rng = random.Random(1)
    yield "nothing", []
    yield "chain", [(i, i + 1) for i in range(150)]
    yield "star", [(7, i) for i in range(100, 180)] + [(100, 3)]
    yield "loops", [(1, 1), (2, 3), (3, 2), (2, 3)]
    yield "random", [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    path = rng.sample(range(1000), 120)
    yield "shuffled chain", list(zip(path, path[1:]))


@pytest.mark.parametrize("name, edges", shapes())
def test_components(spark, name, edges):
    ws = common.Workspace(spark, "test")
    got = common.connected_components(ws, spark.createDataFrame(edges, "u bigint, v bigint"))
    want = reachable([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    ws.close()


def test_groups_across_batches():
    keys = [1, 1, 2, 3, 3, 3, 4, 5, 5]
    table = pa.table({"k": keys, "v": range(9)})
    for size in (1, 2, 4, 9):
        found = [(g.column("k")[0].as_py(), g.column("v").to_pylist()) for g in common.groups(iter(table.to_batches(max_chunksize=size)), ["k"])]
        assert found == [(1, [0, 1]), (3, [3, 4, 5]), (5, [7, 8])]
    assert list(common.groups(iter([]), ["k"])) == []


def test_blocks_meet_each_pair_once(spark):
    ws = common.Workspace(spark, "test")
    rows = spark.createDataFrame([(k, k * 1000 + i) for k, n in ((1, 3), (2, 50), (3, 1)) for i in range(n)], "key int, node bigint")
    dealt = common.in_blocks(ws, rows, ["key"], "node", 8)
    met = {}
    for r in dealt.collect():
        met.setdefault((r.key, r.b1, r.b2), []).append((r.node, r.side))
    pairs = []
    for (_, b1, b2), members in met.items():
        pairs += [(a, b) for a, s in members for b, t in members if a < b and (b1 == b2 or s != t)]
    nodes = [r.node for r in rows.collect()]
    assert sorted(pairs) == sorted((a, b) for a in nodes for b in nodes if a < b and a // 1000 == b // 1000)


def test_roots():
    left, right = np.array([5, 3, 1]), np.array([3, 4, 2])
    assert common.roots(6, left, right).tolist() == [0, 1, 1, 3, 3, 3]


def test_columns_by_place(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x", "X", "x")
    assert common.need(df, "X", "x").first().asDict() == {"X": 2, "x": 1}


def test_shared_folder_is_the_clusters(spark):
    assert common.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
