"""A toxicity classifier that is regularised by counterfactual sentences.

A logistic regression on character n-grams of words.  In the labelled texts,
identity terms of each sentence are swapped with others of their kind; training
penalises the squared change of the score, so that a group's name by itself
moves no verdict.  As texts may name few groups or none, short neutral
sentences that name each group, by language, are swapped too, and compared with
the same sentence that names none.  Features are chosen by a two-proportion test
on all sampled texts; texts are scored whole on executors.

Bounds: the sample has at most ``MAX_PER_CLASS`` rows of each label, chosen by a
hash of the key; the model has a weight for each bucket that passes the test, of
2^``BUCKET_BITS`` buckets.  All sentences of a sampled text are swapped; together
they weigh as much as those of any other.

Defined cases: a null or empty text has no features and gets the score of the
bias; a text of any length counts whole; repeated rows are scored one by one;
of repeated labels the larger counts, and a null label is no label; a row whose
key is null is never learned from, so it counts as held out; without labels of
both kinds every score is the share of toxic labels, or 0; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, need, type_of

MAX_PER_CLASS = 6_000

BUCKET_BITS = 20
GRAM_SIZES = (4, 6, 8)
LEAST_TEXTS = 3
LEAST_Z = 4.5
THRESHOLD = 0.7

DECAY = 2e-4
COUNTERFACTUAL_WEIGHT = 1.0
STEPS = 300

#: Terms that are swapped within their kind.
IDENTITY_TERMS = {
    "gender": ["woman", "man", "women", "men", "girl", "boy", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    "origin": ["african", "asian", "european", "american", "mexican", "chinese", "indian", "arab", "latino"],
    "colour": ["black", "white", "brown"],
    "age": ["old", "young", "elderly", "teenage"],
    "ability": ["blind", "deaf", "disabled", "autistic", "paralysed"],
}

#: The same for other languages; terms that are swapped keep their form.
TERMS = {
    "en": IDENTITY_TERMS,
    "es": {
        "gender": ["mujer", "hombre", "mujeres", "hombres", "niña", "niño"],
        "orientation": ["gay", "lesbiana", "bisexual", "heterosexual", "homosexual"],
        "religion": ["musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"],
        "origin": ["africano", "asiático", "europeo", "americano", "mexicano", "chino", "indio", "árabe", "gitano"],
        "age": ["anciano", "joven"],
        "ability": ["ciego", "sordo", "discapacitado", "autista"],
    },
    "fr": {
        "gender": ["femme", "homme", "femmes", "hommes", "fille", "garçon"],
        "orientation": ["homosexuel", "lesbienne", "bisexuel", "hétérosexuel"],
        "religion": ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"],
        "origin": ["africain", "asiatique", "européen", "américain", "mexicain", "chinois", "indien", "maghrébin"],
        "age": ["vieux", "jeune"],
        "ability": ["aveugle", "sourd", "handicapé", "autiste"],
    },
    "de": {
        "gender": ["frau", "mann", "frauen", "männer", "mädchen", "junge"],
        "orientation": ["schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"],
        "religion": ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch", "katholisch"],
        "origin": ["afrikanisch", "asiatisch", "europäisch", "amerikanisch", "mexikanisch", "chinesisch", "indisch", "arabisch", "türkisch"],
        "age": ["alt", "jung"],
        "ability": ["blind", "taub", "behindert", "autistisch"],
    },
}
#: Neutral sentences that name a group, and what says the same of nobody in particular.
MENTIONS = {"en": ("My neighbour is {} .", "My neighbour is here ."), "es": ("Mi vecino es {} .", "Mi vecino es así ."), "fr": ("Mon voisin est {} .", "Mon voisin est là ."), "de": ("Mein Nachbar ist {} .", "Mein Nachbar ist da .")}


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and buckets of the n-grams of bytes of each word."""
    coded = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    word, bucket = [], []
    for n in GRAM_SIZES:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + flat[k : len(flat) - n + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        inside = of[: len(h)] == of[n - 1 :]
        word.append(of[: len(h)][inside])
        bucket.append((h[inside] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    if not word:
        return np.empty(0, int), np.empty(0, np.int64)
    return np.concatenate(word), np.concatenate(bucket)


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


class Lookup:
    """The chosen features of each text; words are looked up once."""

    def __init__(self, buckets: np.ndarray):
        self.number = np.full(1 << BUCKET_BITS, -1, np.int32)
        self.number[buckets] = np.arange(len(buckets))
        self.known: set[str] = set()
        self.found: dict[str, list[int]] = {}

    def features(self, texts: list[str]) -> list[set[int]]:
        split = [words_of(t) for t in texts]
        if len(self.known) > 500_000:  # bounds the memory, not the result
            self.known, self.found = set(), {}
        new = list(set().union(*split).difference(self.known))
        for part in _by_size(new, 4_000_000):
            word, bucket = grams(part)
            feature = self.number[bucket]
            at = np.flatnonzero(feature >= 0)
            for w, f in zip(word[at].tolist(), feature[at].tolist()):
                self.found.setdefault(part[w], []).append(f)
        self.known.update(new)
        found = self.found
        return [set().union(*[found[w] for w in words if w in found]) for words in split]


def _by_size(texts: list[str], most: int) -> Iterable[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def kinds_of(terms: dict[str, dict[str, list[str]]]) -> dict[str, list[str]]:
    """The kinds of all languages; a term of two of them is of the first."""
    seen: set[str] = set()
    out = {}
    for language, kinds in terms.items():
        for kind, words in kinds.items():
            out[f"{language} {kind}"] = [w for w in words if w not in seen and not seen.add(w)]
    return out


class Swap:
    """Sentences with identity terms, and the same with the kind's next term."""

    def __init__(self, terms: dict[str, list[str]]):
        self.next = {w: kind[(i + 1) % len(kind)] for kind in terms.values() for i, w in enumerate(kind)}
        words = all(re.fullmatch(r"\w+", w) for w in self.next)
        # terms of one word are looked up by word, others tried at each place
        self.found = re.compile(r"\w+" if words else r"\b(?:" + "|".join(map(re.escape, self.next)) + r")\b", re.I)

    def names(self, text: str) -> bool:
        return not self.next.keys().isdisjoint(self.found.findall(text.lower()))

    def __call__(self, text: str) -> list[tuple[str, str]]:
        if not self.names(text):
            return []
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if self.names(s)]
        return [(s, self.found.sub(lambda m: self.next.get(m[0].lower(), m[0]), s)) for s in sentences]


def mentions(terms: dict[str, dict[str, list[str]]], sentences: dict[str, tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Neutral sentences that name a group, each with one that names the next of
    its kind, and with one that names none."""
    sentences = MENTIONS if sentences is None else sentences
    out = []
    for language, kinds in terms.items():
        naming, plain = sentences.get(language, ("{}", ""))
        for words in kinds.values():
            out += [(naming.format(w), naming.format(words[(i + 1) % len(words)])) for i, w in enumerate(words)] + [(plain, naming.format(w)) for w in words]
    return out


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """``text, label`` of at most ``per_class`` labelled rows of each class."""
    marked = need(labels, key, label).toDF("id", "label").filter("id IS NOT NULL AND label IN (0, 1)").filter(may_learn)
    marked = marked.groupBy("id").agg(F.max("label").cast("int").alias("label"))
    chosen = [marked.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    texts = need(docs, key, text).toDF("id", "text")
    # at most 2 * per_class short rows
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("text", "label").distinct()  # copies of a text say nothing new about its words


def choose(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Buckets whose share of texts differs between the classes, and the sizes of the classes."""

    def count(batches):
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buckets = [grams(part)[1] for part in _by_size(list(words_of(text)), 4_000_000)]
                if buckets:
                    seen[label, np.unique(np.concatenate(buckets))] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pa.record_batch([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "n0", "n1"])

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return np.empty(0, np.int64), clean, toxic
    # the sample is bounded, so a few tasks do, each with one row for a bucket
    counts = rows.repartition(8).mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint")
    counts = counts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / (clean + toxic)
    z = F.abs(F.col("n1") / toxic - F.col("n0") / clean) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / clean + 1 / toxic))
    chosen = counts.filter(F.col("n0") + F.col("n1") >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    return np.array(sorted(r.bucket for r in chosen.select("bucket").collect()), np.int64), clean, toxic  # at most 2^BUCKET_BITS numbers


def fit(texts: list[np.ndarray], labels: list[int], pairs: list[tuple[list[int], list[int], float]], features: int, weight: float = COUNTERFACTUAL_WEIGHT) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated gradient descent on the mean logistic loss,
    the decay, and ``weight`` times the mean squared change of swapped sentences."""
    sizes = np.array([len(t) for t in texts])
    row, col = np.repeat(np.arange(len(texts)), sizes), np.concatenate(texts).astype(int)
    y, n = np.array(labels, float), len(texts)
    prow = np.array([i for i, (a, b, _) in enumerate(pairs) for _ in range(len(a) + len(b))], int)
    pcol = np.array([f for a, b, _ in pairs for f in (*a, *b)], int)
    sign = np.array([s for a, b, _ in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    share = np.array([x for _, _, x in pairs]) / max(1e-12, sum(x for _, _, x in pairs))
    w, bias = np.zeros(features), math.log(y.mean() / (1 - y.mean()))
    # row sums of the curvature bound it by a diagonal, which gives each weight a step of its own
    wide = sizes + 1.0
    steep = 0.25 * np.bincount(col, wide[row], features) / n + DECAY
    steep_bias = 0.25 * wide.mean()
    if len(pairs):
        both = np.array([len(a) + len(b) for a, b, _ in pairs], float) * share
        steep += 2 * weight * np.bincount(pcol, both[prow], features)
    ahead, ahead_bias, t = w, bias, 1.0
    for _ in range(STEPS):
        score = np.bincount(row, ahead[col], n) + ahead_bias
        error = (1 / (1 + np.exp(-score)) - y) / n
        slope = np.bincount(col, error[row], features) + DECAY * ahead
        if len(pairs):
            change = np.bincount(prow, sign * ahead[pcol], len(pairs)) * share
            slope += 2 * weight * np.bincount(pcol, sign * change[prow], features)
        nw, nb = ahead - slope / steep, ahead_bias - error.sum() / steep_bias
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return bias, w


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = MAX_PER_CLASS, terms: dict[str, dict[str, list[str]]] = TERMS, weight: float = COUNTERFACTUAL_WEIGHT) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, buckets and weights; ``may_learn`` is a condition on ``id``, and
    ``terms`` are identity terms by language and kind."""
    ws = Workspace(docs.sparkSession, "toxicity")
    rows = ws.keep(sample(docs, labels, may_learn, key, text, label, per_class), "sample")
    buckets, clean, toxic = choose(rows)
    if not len(buckets):
        ws.close()
        share = toxic / (clean + toxic) if clean + toxic else 0.0
        return (math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)), buckets, np.empty(0)
    given, kinds = docs.sparkSession.sparkContext.broadcast(buckets), kinds_of(terms)

    def look(batches):
        lookup, swapped = Lookup(given.value), Swap(kinds)
        changed: Counter = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            own = [sorted(x) for x in lookup.features(texts)]
            for t in texts:
                if pairs := swapped(t):
                    for pair in different(lookup, pairs):
                        changed[pair] += 1 / len(pairs)
            yield pa.record_batch([batch.column(1), pa.array(own, whole), pa.array([[]] * len(own), whole), pa.array([0.0] * len(own))], names=["label", "a", "b", "weight"])
        yield pa.record_batch(
            [pa.array([-1] * len(changed), pa.int32()), pa.array([a for a, _ in changed], whole), pa.array([b for _, b in changed], whole), pa.array(list(changed.values()), pa.float64())],
            names=["label", "a", "b", "weight"],
        )

    whole = pa.list_(pa.int32())
    # of the bounded sample, the chosen features, and the changes that differ
    found = rows.repartition(8).mapInArrow(look, "label int, a array<int>, b array<int>, weight double")
    found = pa.Table.from_batches(found.toArrow().to_batches())
    ws.close()
    mark = found.column("label").to_numpy()
    lists = found.column("a").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    own = sorted((int(mark[i]), flat[ends[i] : ends[i + 1]].tobytes()) for i in np.flatnonzero(mark >= 0))
    pairs: Counter = Counter()
    for r in found.filter(pa.array(mark < 0)).to_pylist():
        pairs[tuple(r["a"]), tuple(r["b"])] += r["weight"]
    for pair in different(Lookup(buckets), mentions(terms)):
        pairs[pair] += 1.0
    changes = [(a, b, x) for (a, b), x in sorted(pairs.items()) if a or b]
    bias, w = fit([np.frombuffer(x, np.int32) for _, x in own], [y for y, _ in own], changes, len(buckets), weight)
    return bias, buckets, w


def different(lookup: Lookup, pairs: list[tuple[str, str]]) -> list[tuple[tuple, tuple]]:
    """The features that only one of two sentences has."""
    first, second = lookup.features([a for a, _ in pairs]), lookup.features([b for _, b in pairs])
    return [(tuple(sorted(x - y)), tuple(sorted(y - x))) for x, y in zip(first, second)]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text", rest: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``key, score`` for each row, and the columns in ``rest``; ``name`` is the score's."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(model)

    kept = [key, *rest]
    names = [f"c{i}" for i in range(len(kept))]
    at = kept.index(text) if text in kept else len(kept)

    def run(batches):
        bias, buckets, w = given.value
        lookup = Lookup(buckets)
        for batch in batches:
            texts, scores = [t or "" for t in batch.column(at).to_pylist()], []
            for i in range(0, len(texts), 500):
                scores += [1 / (1 + math.exp(-max(-40.0, min(40.0, bias + float(w[sorted(f)].sum()))))) for f in lookup.features(texts[i : i + 500])]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, "score"])

    df = need(docs, *kept, *([text] if at == len(kept) else [])).toDF(*names, *(["text"] if at == len(kept) else []))
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names) + ", score double"
    return df.mapInArrow(run, schema).select(*[F.col(c).alias(k) for c, k in zip(names, kept)], F.col("score").alias(name))


def held_out(key: Column) -> Column:
    """A third of the keys, and rows without one, which training never sees."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))
