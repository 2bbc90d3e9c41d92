"""Near-duplicate vectors by cross-polytope hashing.

Each table of the index turns a vector by rounds of random signs and fast
Hadamard transforms, and hashes it to the nearest vertices of the cross
polytope; it also probes the buckets of the next nearest vertices.  Vectors
that meet in a bucket are verified by their exact cosine in double precision.
The number of functions follows the number of vectors of a label, so that
buckets stay small; the number of tables is what the target recall asks for at the
threshold.  A pair is counted only in the first bucket where it meets, and a
task returns a row for each member with links, never the pairs themselves.

Equal vectors of a label are one class, which is compared once; its members
count as links of each other.

Defined cases: vectors link only where their labels are equal and not null and
their lengths are equal; a vector that is null, empty, zero, or holds a null, a
NaN or an infinity links with nothing; vectors of any length are hashed whole,
and components of any magnitude count; repeated rows count as vectors that link
with each other; rows whose key is null link with their copies only, and have a
null component unless a copy has a key; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, binary_rows, by_group, connected_components, groups, in_blocks, linked, need, pairs_of, type_of

THRESHOLD = 0.93
TARGET_RECALL = 0.9999
ROUNDS = 3
PROBES = 1

#: Vectors that a bucket should hold on average, and members of a block.
BUCKET = 64
BLOCK = 768


def unit(x: np.ndarray) -> np.ndarray:
    """Each row at length one; it is scaled by a power of two before, which is
    exact, so that squares neither overflow nor vanish."""
    exponent = np.frexp(np.abs(x).max(1, initial=0))[1]
    x = np.ldexp(x, -exponent[:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def turned(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Rounds of random signs and a Hadamard transform of each row."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n), np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        y *= rng.integers(2, size=n).astype(np.float32) * 2 - 1
        h = 1
        while h < n:
            z = y.reshape(len(y), -1, 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), n)
            h *= 2
        y /= math.sqrt(n)
    return y


def codes(x: np.ndarray, table: int, functions: int) -> np.ndarray:
    """Each row's own bucket and the ``PROBES`` next ones."""
    base = np.zeros(len(x), np.int64)
    change, loss = [], []
    for k in range(functions):
        y = turned(x, (table, k))
        n = y.shape[1]
        size = np.abs(y)
        top = np.argpartition(-size, min(PROBES, n - 1), axis=1)[:, : PROBES + 1] if n > PROBES + 1 else np.argsort(-size, axis=1)
        rows = np.arange(len(x))[:, None]
        top = np.take_along_axis(top, np.argsort(-size[rows, top], axis=1, kind="stable"), axis=1)
        vertex = 2 * top + (y[rows, top] < 0)
        scale = (2 * n) ** k
        base += vertex[:, 0] * scale
        change.append((vertex[:, 1:] - vertex[:, :1]) * scale)
        loss.append(size[rows, top[:, :1]] - size[rows, top[:, 1:]])
    change, loss = np.concatenate(change, axis=1), np.concatenate(loss, axis=1)
    best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
    near = np.take_along_axis(change, best, axis=1)
    near = np.pad(near, ((0, 0), (0, PROBES - near.shape[1])))  # very short vectors have fewer vertices
    return np.concatenate([base[:, None], base[:, None] + near], axis=1)


def tables_for(dim: int, functions: int, threshold: float, target: float, pairs: int = 2000) -> int:
    """Tables with which pairs at the threshold meet with the target recall."""
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    norm = np.linalg.norm(z, axis=1)[:, None]
    y = threshold * x + math.sqrt(1 - threshold**2) * z / np.where(norm > 0, norm, 1)
    a, b = codes(x, 0, functions), codes(y, 0, functions)
    meet = ((a == b[:, :1]) | (b == a[:, :1])).any(1).mean()
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - min(meet, 1 - 1e-6))))


def vectors(df: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """``id, label, dim, digest, vector``; the last three are null for vectors that can't link."""
    wide = isinstance(type_of(df, embedding).elementType, T.DoubleType)
    dtype = "<f8" if wide else "<f4"

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], int)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(~np.isfinite(flat))]), np.concatenate([[0], np.cumsum(flat != 0)])
            bad, some = (s[ends] - s[ends - sizes] for s in sums)
            good = (sizes > 0) & (bad == 0) & (some > 0)
            cells = [flat[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends, sizes, good)]
            digests = [None if c is None else hashlib.blake2b(c, digest_size=16).digest() for c in cells]
            dims = pa.array(sizes, pa.int32(), mask=~good)
            yield pa.record_batch([batch.column(0), batch.column(1), dims, pa.array(digests, pa.binary()), pa.array(cells, pa.binary())], names=["id", "label", "dim", "digest", "vector"])

    kinds = [type_of(df, c).simpleString() for c in (key, label)]
    given = need(df, key, label, embedding).toDF("id", "label", "embedding")
    return given.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, dim int, digest binary, vector binary")


KEYS = ["label", "dim", "tree", "code"]


def buckets(classes: DataFrame, tables: dict[int, int], functions: int, dtype: str, small: str, whole: bool = True) -> DataFrame:
    """A row of each class for each bucket that it is in or probes; the bucket
    alone, unless ``whole``."""
    rest = ["node", "size", "vector", "codes"] if whole else []

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = unit(binary_rows(part.column("vector"), dtype).astype(float))
                every = np.stack([codes(x, t, functions) for t in range(tables[int(dim)])], axis=1)
                packed = pa.array([row.tobytes() for row in every.astype(small)], pa.binary())
                part = pa.RecordBatch.from_arrays([*part.columns, packed], names=[*part.schema.names, "codes"])
                for t in range(every.shape[1]):
                    for p in range(every.shape[2]):
                        at = np.flatnonzero(every[:, t, p] != every[:, t, 0]) if p else np.arange(len(x))
                        own = part.take(pa.array(at))
                        yield pa.record_batch(
                            [own.column("label"), own.column("dim"), pa.array(np.full(len(at), t, np.int32)), pa.array(every[at, t, p])] + [own.column(c) for c in rest],
                            names=[*KEYS, *rest],
                        )

    kinds = [classes.schema[c].dataType.simpleString() for c in ("label", "node")]
    given = classes.filter("node IS NOT NULL").select("label", "dim", "node", "size", "vector")
    more = f", node {kinds[1]}, size bigint, vector binary, codes binary" if whole else ""
    return given.mapInArrow(run, f"label {kinds[0]}, dim int, tree int, code bigint{more}")


def first_meeting(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table, and the least bucket there, where the pairs meet."""
    never = np.iinfo(np.int64).max
    x, y = own[a], own[b]
    in_a = (y == x[:, :, :1]).any(2)  # b is in, or probes, the bucket of a
    in_b = (x == y[:, :, :1]).any(2)
    code = np.minimum(np.where(in_a, x[:, :, 0], never), np.where(in_b, y[:, :, 0], never))
    table = (code != never).argmax(1)
    return table, code[np.arange(len(a)), table]


def close(batches, threshold: float, dtype: str, small: str, keys: list[str]):
    for table in groups(batches, keys):
        x = unit(binary_rows(table.column("vector"), dtype).astype(float))
        packed = binary_rows(table.column("codes"), small).astype(np.int64).reshape(len(x), -1, PROBES + 1)
        tree, code = table.column("tree")[0].as_py(), table.column("code")[0].as_py()

        def hits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = x[left] @ x[right].T >= threshold
            a, b = np.nonzero(found)
            for i in range(0, len(a), 20_000):
                p, q = a[i : i + 20_000], b[i : i + 20_000]
                first, bucket = first_meeting(packed, left[p], right[q])
                other = (first != tree) | (bucket != code)
                found[p[other], q[other]] = False
            return found

        left, right = pairs_of(table)
        if len(left) and len(right):
            found = linked(table, left, right, hits, table.column("size").to_numpy())
            if found is not None:
                yield found


def join(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """``key, n_links, component_id, kept`` for each row: how many other vectors
    it links with, the smallest key that links lead to, and whether that is its own."""
    ws = Workspace(df.sparkSession, "embeddings")
    dtype = "<f8" if isinstance(type_of(df, embedding).elementType, T.DoubleType) else "<f4"
    kind = type_of(df, key).simpleString()
    found = vectors(df, key, embedding, label)
    able = found.filter("digest IS NOT NULL AND label IS NOT NULL")
    classes = ws.keep(
        able.groupBy("label", "dim", "digest").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.first("vector").alias("vector")), "classes"
    )
    sizes = classes.groupBy("dim", "label").agg(F.count("*").alias("n"))
    dims = {r.dim: r.n for r in sizes.groupBy("dim").agg(F.max("n").alias("n")).collect()}  # a row for each length of vector
    most = max(dims.values(), default=0)
    widest = 2 << max(1, (max(dims, default=2) - 1).bit_length())
    functions = max(1, math.ceil(math.log(max(most, 1) / BUCKET) / math.log(widest)))
    functions = min(functions, 62 // (widest.bit_length() - 1))
    small = "<i4" if widest**functions < 1 << 31 else "<i8"  # what holds any bucket
    tables = {d: tables_for(d, functions, threshold, target) for d in dims}
    made = [buckets(classes, tables, functions, dtype, small, whole) for whole in (True, False)]
    met = in_blocks(ws, made[0], KEYS, "node", BLOCK, counted=made[1])
    keys = [*KEYS, "b1", "b2"]
    links = by_group(met, keys).mapInArrow(lambda b: close(b, threshold, dtype, small, keys), f"node {kind}, links bigint, root {kind}")
    links = ws.keep(links, "links")
    component = connected_components(ws, links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    judged = classes.select("label", "dim", "digest", "node", "size").join(total, "node", "left").join(component, "node", "left")
    judged = judged.select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    judged = ws.keep(judged, "judged")
    out = found.select("id", "label", "dim", "digest").join(judged, ["label", "dim", "digest"], "left")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept"),
    )
