"""Jaccard self-join of texts on word n-grams, found by a MinHash LSH forest.

Each of ``TREES`` tries holds a label of ``DEPTH`` minhashes for every text.
Texts that share a whole label are matched first, each with the smallest of
them, and make groups.  Then prefixes are shortened, a hash at a time and the
longest first, until texts meet in some tree with the target recall.  How far
depends on the member: with few n-grams, only some similarities are possible at
all, and the least of those that suffice decides (of 7 n-grams, 6 of 7 in
common; of fewer than 4 all, so those aren't shortened).  A prefix is matched
only where it holds two or more groups; the tries are tables of prefixes, whose
nodes are found by aggregation, so no node meets in one task.  Candidates whose
signatures agree in too few places to reach the threshold are dropped; what
stays is joined to connected groups, and inside each group every pair is
verified by its exact Jaccard similarity.  Large nodes and groups are compared
block by block, and each task returns a row for each member: its number of
links and one edge to the smallest member that they lead to, never the pairs
themselves.

Texts with the same set of n-grams are one class, which is compared once; its
members count as links of each other.

Defined cases: words are runs of anything but ASCII white space; a text of one
to four words has all its words as its only n-gram; a null, empty or blank text
links with nothing; a text of any length counts whole; repeated rows count as
documents that link with each other; rows with the same key and different texts
are judged each by its own text; rows whose key is null link as others do, and
a class without any key is null and keeps one row; an empty table gives an
empty result; other columns of the input are ignored, unless they are carried.
"""

from __future__ import annotations

import hashlib
import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, binary_rows, by_group, connected_components, groups, in_blocks, in_blocks_apart, linked, need, pairs_of, type_of

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
TARGET_RECALL = 0.9997

#: From this number of n-grams on, any similarity counts as possible.
FEW = 64

#: Standard errors that a signature's estimate may lie below the threshold.
SLACK = 5.0

#: Members of a block, and n-grams in one of a group; a task compares two blocks at a time.
BUCKET_BLOCK = 512
GROUP_BLOCK = 192
GROUP_GRAMS = 2_000_000

_SEED = np.random.default_rng(20240229)
_MULTIPLIERS = _SEED.integers(1 << 62, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_SEED.integers(1 << 31, size=TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _SEED.integers(1 << 32, size=TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def recall(lengths: list[int], similarity: float) -> float:
    """The probability that two texts of a similarity meet in some tree."""
    return 1 - math.prod(1 - similarity**k for k in lengths)


def shortened(similarity: float, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """The prefix of each tree: whole labels, of which the longest is shortened
    until the recall at a similarity reaches the target."""
    out = [depth] * trees
    while recall(out, similarity) < target and max(out) > 1:
        out[out.index(max(out))] -= 1
    return out


def least_similarity(grams: int, threshold: float) -> float:
    """The least similarity from the threshold on that a set of ``grams`` can have
    with a different one; 1 where there is none."""
    best = 1.0
    for shared in range(max(1, math.floor(threshold * grams)), grams + 1):
        either = max(grams, math.floor(shared / threshold + 1e-9) if threshold > 0 else FEW * FEW)
        if shared < either and shared / either >= threshold:
            best = min(best, shared / either)
    return best


def prefixes(threshold: float) -> list[tuple[int, int, int]]:
    """``grams, tree, length``: the nodes that a text enters, by its number of
    n-grams (0: more than ``FEW``).  It enters those of its possible partners
    too, so the longer of two prefixes is where they meet."""
    plans = {n: shortened(least_similarity(n, threshold)) if least_similarity(n, threshold) < 1 else [] for n in range(1, FEW + 1)}
    plans[0] = shortened(threshold)
    out = set()
    for n in plans:
        low, high = (math.floor(threshold * n), math.ceil(n / max(threshold, 1e-9))) if n else (math.floor(threshold * FEW), FEW)
        partners = {m for m in range(max(1, low), min(FEW, high) + 1)} | ({0} if not n or high > FEW else set())
        for tree in range(TREES):
            for other in partners | {n}:
                if plans[n] and plans[other]:
                    out.add((n, tree, max(plans[n][tree], plans[other][tree])))
    return sorted(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""

    def __init__(self, words: int = WORDS):
        self.n = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > 600_000:  # bounds the memory, not the result
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * _MULTIPLIERS[5] + h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k % 5]
        return np.unique(_mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of ``TREES * DEPTH`` minhashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _A + _B).min(0), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (low >> np.uint32(16)).astype("<u2")


def features(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, digest, signature, grams, text`` and the columns to carry, as
    ``carried0`` and so on; digest and signature are null without words."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            digests, signatures, sizes = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingler(t)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
                sizes.append(len(s))
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int64()), *batch.columns[1:]], names=names)

    names = ["id", "digest", "signature", "grams", "text", *[f"carried{i}" for i in range(len(carry))]]
    kinds = [type_of(docs, key), T.BinaryType(), T.BinaryType(), T.LongType(), *[type_of(docs, c) for c in (text, *carry)]]
    return need(docs, key, text, *carry).toDF("id", *names[4:]).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def agreeing(batches, least: float):
    """The pairs whose two signatures agree in the share ``least`` of places."""
    for batch in batches:
        if batch.num_rows:
            a, b = (binary_rows(batch.column(c), "<u2") for c in ("signature", "other"))
            yield batch.select(["node", "root"]).filter(pa.array((a == b).mean(1) >= least))


def candidates(batches, least: float, keys: list[str]):
    for table in groups(batches, keys):
        s = binary_rows(table.column("signature"), "<u2")

        def agree(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return np.stack([(s[i] == s[right]).mean(1) >= least for i in left])

        found = linked(table, *pairs_of(table), agree, np.ones(len(s)))
        if found is not None:
            yield pa.record_batch([pa.array([table.column("length")[0].as_py()] * found.num_rows, pa.int32()), found.column("node"), found.column("root")], names=["length", "node", "root"])


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have at least the exact Jaccard similarity."""
    n = np.array([len(s) for s in sets], float)
    shared = np.zeros((len(left), len(right)), np.float32)
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), n.astype(int))
    common = np.flatnonzero(np.bincount(where) > 1)  # others are in no intersection
    number = np.full(len(every), -1)
    number[common] = np.arange(len(common))
    column, of = number[where], of[number[where] >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for start in range(0, len(common), 4096):
        i, j = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(sets), min(4096, len(common) - start)), np.float32)
        part[of[i:j], column[i:j] - start] = 1
        shared += part[left] @ part[right].T
    shared = shared.astype(float)
    return shared / np.maximum(n[left][:, None] + n[right][None, :] - shared, 1) >= threshold


def verified(batches, threshold: float, keys: list[str]):
    shingler = Shingler()
    for table in groups(batches, keys):
        sets = [shingler(t) for t in table.column("text").to_pylist()]
        seen: dict[tuple, int] = {}
        rows = [i for i, (node, s) in enumerate(zip(table.column("node").to_pylist(), sets)) if len(s) and seen.setdefault((node, s.tobytes()), i) == i]
        if len(rows) < 2:
            continue
        table, sets = table.take(rows), [sets[i] for i in rows]
        left, right = pairs_of(table)
        if len(left) and len(right):
            found = linked(table, left, right, lambda a, b: similar(sets, a, b, threshold), table.column("size").to_numpy())
            if found is not None:
                yield found


def node_of(tree: Column, length: Column) -> Column:
    """A name for the node of a trie that a signature's prefix leads to."""
    return F.xxhash64(tree, length, F.substring("signature", tree * (DEPTH * 2) + 1, length * 2))


def matched(ws: Workspace, classes: DataFrame, threshold: float) -> DataFrame:
    """``node, root, length``: candidate edges of classes, and the prefix that they share."""
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    able = classes.filter(F.lit(least_similarity(3, threshold) < 1) | (F.col("grams") > 3)).select("node", "grams", "signature")
    # whole labels: each member is compared with the smallest of its node, not with all others
    labels = able.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    labels = labels.select("node", node_of(F.col("tree"), F.lit(DEPTH)).alias("place"))
    # such tables are kept, so that a hot place is split when the two are joined
    heads = ws.keep(labels.groupBy("place").agg(F.min("node").alias("root"), F.count("*").alias("members")).filter("members > 1").select("place", "root"), "heads")
    stars = labels.join(heads, "place").filter("node <> root").select("node", "root").distinct()
    signatures = classes.select("node", "signature")
    stars = stars.join(signatures, "node").join(signatures.toDF("root", "other"), "root").select("node", "root", "signature", "other")
    whole = ws.keep(stars.mapInArrow(lambda b: agreeing(b, least), "node bigint, root bigint"), "whole")
    group = whole.groupBy("node").agg(F.min("root").alias("group"))
    # shortened prefixes, where they bring groups together
    plan = F.broadcast(ws.spark.createDataFrame(prefixes(threshold), "few int, tree int, length int"))  # its size is fixed
    few = F.when(F.col("grams") <= FEW, F.col("grams")).otherwise(0).cast("int")
    entries = able.withColumn("few", few).join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    entries = entries.join(plan, "few").select("node", "group", "length", node_of(F.col("tree"), F.col("length")).alias("place"))
    shared = ws.keep(entries.groupBy("place").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("place"), "shared")
    entries = ws.keep(entries.join(shared, "place"), "places")
    met = in_blocks_apart(ws, entries, "place", "node", "group", BUCKET_BLOCK).join(signatures, "node")
    keys = ["length", "place", "b1", "b2"]
    found = by_group(met.select(*keys, "side", "node", "signature"), keys[1:]).mapInArrow(lambda b: candidates(b, least, keys), "length int, node bigint, root bigint")
    edges = whole.withColumn("length", F.lit(DEPTH)).select("length", "node", "root").union(found.filter("node <> root"))
    out = ws.keep(edges.groupBy("node", "root").agg(F.max("length").alias("length")), "candidates")
    ws.drop(heads, whole, shared, entries)
    return out


def judge(ws: Workspace, rows: DataFrame, threshold: float) -> DataFrame:
    """``digest, links, component, class_id, only`` of each class of ``rows``; the
    component is its smallest row, and ``only`` the row to keep where no row has a key."""
    classes = ws.keep(
        rows.filter("digest IS NOT NULL").groupBy("digest").agg(
            F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("size"), F.first("signature").alias("signature"), F.first("grams").alias("grams")
        ),
        "classes",
    )
    edges = matched(ws, classes, threshold)
    near = connected_components(ws, edges.select(F.col("node").alias("u"), F.col("root").alias("v")))
    near = near.join(classes.select("node", "size", "grams"), "node")
    near = ws.keep(in_blocks(ws, near, ["component"], "node", GROUP_BLOCK, weight="grams", heaviest=GROUP_GRAMS), "groups")
    texts = rows.select(F.col("row").alias("node"), "text").join(near, "node")
    keys = ["component", "b1", "b2"]
    links = by_group(texts.select(*keys, "side", "node", "size", "text"), keys).mapInArrow(lambda b: verified(b, threshold, keys), "node bigint, links bigint, root bigint")
    links = ws.keep(links, "links")
    ws.drop(edges, near)
    component = connected_components(ws, links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked_classes = ws.keep(component.join(classes.select("node", "digest", "least"), "node"), "linked")
    smallest = linked_classes.groupBy("component").agg(F.min("least").alias("smallest"), F.min(F.struct("digest", "node"))["node"].alias("only"))
    # only classes with near copies meet here, and only light rows
    component = linked_classes.select("node", "component").join(ws.keep(smallest, "smallest"), "component")
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    judged = classes.select("digest", "node", "size", "least").join(total, "node", "left").join(component, "node", "left")
    alone = F.col("component").isNull()
    return judged.select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"),
        F.when(alone, F.col("least")).otherwise(F.col("smallest")).alias("class_id"), F.coalesce("only", "node").alias("only"),
    )


def judged_rows(ws: Workspace, docs: DataFrame, key: str, text: str, threshold: float, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows with their features and a number, ``row``; and ``row, id,
    n_links, component, class_id, kept`` of each."""
    # a number tells rows of the same key, or of none, apart; it is written, so that it holds
    rows = ws.keep(features(docs, key, text, carry).withColumn("row", F.monotonically_increasing_id()), "features", "zstd")
    judged = ws.keep(judge(ws, rows, threshold), "judged")
    found = rows.select("row", "id", "digest").join(judged, "digest", "left")
    blank = F.col("digest").isNull()
    found = found.withColumn("class_id", F.when(blank, F.col("id")).otherwise(F.col("class_id")))
    kept = F.when(blank, True).when(F.col("class_id").isNull(), F.col("row") == F.col("only")).otherwise(F.col("class_id").eqNullSafe(F.col("id")))
    return rows, found.select("row", "id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), "component", "class_id", kept.alias("kept"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_links, class_id, kept`` for each row: how many other documents it
    links with, the smallest key that links lead to, and whether that is its own."""
    _, found = judged_rows(Workspace(docs.sparkSession, "jaccard"), docs, key, text, threshold)
    return found.select(F.col("id").alias(key), "n_links", "class_id", "kept")


def distinct_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Whole rows: of each class one of those with the smallest key, chosen by
    content, and all rows whose key is null."""
    ws = Workspace(docs.sparkSession, "jaccard")
    rest = tuple(c for c in docs.columns if c not in (key, text))
    rows, found = judged_rows(ws, docs, key, text, threshold, rest)
    name = {key: "id", text: "text"} | {c: f"carried{i}" for i, c in enumerate(rest)}
    copies = ws.keep(found.filter("n_links > 0 AND id IS NOT NULL").select("row", "component", "kept"), "copies")
    # rows are hashed where several could stay
    tied = copies.filter("kept").join(rows.select("row", F.xxhash64(*[name[c] for c in docs.columns]).alias("content")), "row")
    stay = tied.groupBy("component").agg(F.min(F.struct("content", "row"))["row"].alias("row"))
    gone = ws.keep(copies.select("row").join(stay.select("row"), "row", "left_anti"), "gone")
    return rows.join(gone, "row", "left_anti").select(*[F.col(name[c]).alias(c) for c in docs.columns])
