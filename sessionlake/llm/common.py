"""Helpers that several operators share: a workspace for intermediate tables,
connected components, and comparison of group members in bounded blocks."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_root


class Workspace:
    """Tables written under the shared folder; writing one cuts its lineage.

    What a returned lazy result still reads stays until ``close``, or the end
    of the driver; tables that only fed a later table are dropped at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.number = 0
        atexit.register(self._forget)

    def path(self, label: str) -> str:
        self.number += 1
        return f"{self.root}/{self.number:03d}-{label}"

    def keep(self, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        path = self.path(label)
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.remove(df._workspace_path)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        atexit.unregister(self._forget)
        self.remove(self.root)

    def _forget(self) -> None:
        with contextlib.suppress(Exception):  # Spark may have ended before
            self.remove(self.root)


def connected_components(ws: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component is the
    smallest node reachable.  Alternates large-star and small-star steps, each a
    map-side combined minimum and an equi-join, until the edges are stars.
    """
    # every edge points from the larger to the smaller node
    def pointed(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def settled(df: DataFrame) -> bool:
        # each node has one edge out, or is only pointed at
        ends = df.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("to")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("to")))))
        return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("to").alias("to")).filter("out > 1 OR (out > 0 AND to > 0)").isEmpty()

    now = ws.keep(pointed(edges), "edges")
    for _ in range(rounds):
        if settled(now):
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = ws.keep(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low2 = ws.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.keep(pointed(small.union(low2.select("u", F.col("m").alias("v")))), "edges")
        ws.drop(now, low, large, low2)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def in_blocks(ws: Workspace, rows: DataFrame, keys: list[str], id_col: str, block: int, counted: DataFrame | None = None, weight: str | None = None, heaviest: int = 0) -> DataFrame:
    """Deals the members of each key to pairs of blocks of about ``block`` rows,
    and with ``weight``, of about ``heaviest`` of that too.

    Adds ``side`` (the row's own block) and ``b1 <= b2`` (the pair of blocks it
    is sent to).  A key with at most ``block`` rows has the one pair (0, 0), so
    only hot keys are copied, once per block.  The table of hot keys has at most
    rows / block entries; it is kept first, so that Spark knows its size, and
    broadcasts it only if that allows.  ``counted`` may have the keys alone.
    """
    parts = F.ceil(F.count("*") / block)
    if weight is not None:
        parts = F.greatest(parts, F.ceil(F.sum(weight) / heaviest))
    hot = (rows if counted is None else counted).groupBy(*keys).agg(parts.cast("int").alias("parts")).filter("parts > 1")
    hot = ws.keep(hot.select(*keys, "parts"), "hot")
    dealt = rows.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("b1", F.least("side", "other")).withColumn("b2", F.greatest("side", "other")).drop("parts", "other")


def in_blocks_apart(ws: Workspace, rows: DataFrame, key: str, id_col: str, apart: str, block: int) -> DataFrame:
    """As ``in_blocks``, where rows of a key that are equal in ``apart`` needn't
    meet: of those that fill a block, blocks of their own never meet each other.
    """
    hot = ws.keep(rows.groupBy(key).agg(F.count("*").alias("members")).filter(F.col("members") > block).select(key), "hot")
    if hot.isEmpty():
        return rows.select("*", *[F.lit(0).alias(c) for c in ("side", "b1", "b2")])
    sizes = rows.join(hot, key).groupBy(key, apart).agg(F.count("*").alias("members"))
    big = F.col("members") > block
    # at most 2 * rows / block rows stay: a row for each large group, and one for all others
    pools = sizes.select(key, F.when(big, F.col(apart)).alias("pool"), "members").groupBy(key, "pool").agg(F.ceil(F.sum("members") / block).cast("int").alias("parts"))
    ahead = Window.partitionBy(key).orderBy(F.col("pool").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    pools = pools.withColumn("first", F.coalesce(F.sum("parts").over(ahead), F.lit(0)).cast("int")).withColumn("every", F.sum("parts").over(Window.partitionBy(key)).cast("int"))
    pools = ws.keep(pools, "pools")
    own = pools.filter("pool IS NOT NULL").select(key, F.col("pool").alias(apart), F.col("parts").alias("own_parts"), F.col("first").alias("own_first"))
    rest = pools.groupBy(key).agg(F.max("every").cast("int").alias("every"), F.max(F.when(F.col("pool").isNull(), F.col("parts"))).alias("parts"))
    dealt = rows.join(rest, key, "left").join(own, [key, apart], "left")
    parts, first = F.coalesce("own_parts", "parts", F.lit(1)), F.coalesce("own_first", F.lit(0))  # the others' blocks come first
    dealt = dealt.withColumn("side", (first + F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), parts)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("every", F.lit(1)) - 1)))
    dealt = dealt.filter(F.col("own_parts").isNull() | (F.col("other") < F.col("own_first")) | (F.col("other") >= F.col("own_first") + F.col("own_parts")))
    return dealt.withColumn("b1", F.least("side", "other")).withColumn("b2", F.greatest("side", "other")).drop("parts", "every", "own_parts", "own_first", "other")


def by_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key together and in order, for ``groups``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def groups(batches, keys: list[str]):
    """From sorted record batches, the tables of two or more rows of a key."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        starts = np.zeros(table.num_rows, bool)
        starts[0] = True
        for k in keys:
            x = table.column(k).to_numpy(zero_copy_only=False)
            starts[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(starts)
        for i, j in zip(at[:-1], at[1:]):
            if j - i > 1:
                yield table.slice(i, j - i)
        carry = table.slice(at[-1])
    if carry is not None and carry.num_rows > 1:
        yield carry


def pairs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks that a group of ``in_blocks`` compares."""
    side, b1, b2 = (table.column(c).to_numpy() for c in ("side", "b1", "b2"))
    if b1[0] == b2[0]:
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == b1[0]), np.flatnonzero(side == b2[0])


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row number reachable from each of ``n`` rows by the pairs."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        nxt = root.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        while not np.array_equal(nxt, nxt[nxt]):
            nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            break
        root = nxt
    return root


def linked(table: pa.Table, left: np.ndarray, right: np.ndarray, links: Callable[[np.ndarray, np.ndarray], np.ndarray], size: np.ndarray) -> pa.RecordBatch | None:
    """``node, links, root`` of the members of a group that have links."""
    hit = links(left, right)
    node = table.column("node").to_numpy()
    if left is right:
        hit &= ~np.eye(len(left), dtype=bool)
    a, b = np.nonzero(hit)
    if not len(a):
        return None
    a, b = left[a], right[b]
    if left is not right:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(node, kind="stable")  # so that a root is the smallest node
    rank = np.empty(len(node), int)
    rank[order] = np.arange(len(node))
    root = node[order[roots(len(node), rank[a], rank[b])]][rank]
    count = np.bincount(a, size[b], len(node)).astype(np.int64)
    at = np.unique(a)
    return pa.record_batch([pa.array(node[at]), pa.array(count[at]), pa.array(root[at])], names=["node", "links", "root"])


def binary_rows(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """A matrix of equally long binary cells."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, found by their place; so other columns can have
    any names, the same ones in other case or once more too."""
    at = [df.columns.index(c) for c in columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(c) for i, c in zip(at, columns)])


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema.fields[df.columns.index(column)].dataType


def step(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns computed once for each row.  A projection could be merged into the
    next one, where an array used inside a lambda would be computed again for
    each element; a generator of one row isn't merged."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
