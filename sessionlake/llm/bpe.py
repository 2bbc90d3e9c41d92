"""Byte-level BPE encoding and decoding by DuckDB queries in each partition.

Encoding: the distinct words of a batch are cut where no token can lie across,
and the distinct pieces become rows of token positions.  A recursive query joins
neighbouring positions with the merge table and contracts each piece's leftmost
pair of least rank until no pair is left; it keeps only the last state of each
piece.  Where a contraction can't bring about a pair of lower rank, the other
places of the same rank that would come next are contracted in the same step,
from left to right, so that a long piece takes few steps.  Decoding: an ordered
aggregation of the token bytes.

Both cuts and joint contractions give what one contraction a step gives.  Every
token that contraction makes is a token of the vocabulary that stands in the
text, so none crosses a place that no such token covers: two bytes that are in no
token side by side, or are no token themselves and have no token with either
byte beside them.  A contraction that makes the token ``c`` only adds pairs of
``c`` with its neighbours; if no pair with ``c`` merges at a lower rank than
``c``, the least rank stays the same until all its places are contracted.

Defined cases: a null text counts as the empty text; the empty text has no
tokens, and the digests of the empty string; a text of any length, and a word of
any length, is encoded whole; equal rows give equal results, one for each row;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, type_of

#: Bytes of text that one set of DuckDB tables holds.
SLICE_BYTES = 6_000_000
SLICE_WORDS = 500_000
SLICE_TOKENS = 2_000_000

#: A sort key has the rank, a bit that is set where only one place may be contracted, and the position.
ENCODE = """
WITH RECURSIVE state(piece, tokens) USING KEY (piece) AS (
  SELECT piece, list(token ORDER BY position) FROM positions GROUP BY piece
  UNION
  (WITH pairs AS (
    SELECT pair.piece, merges.rank_key | pair.position AS key
    FROM (SELECT piece, tokens, unnest(range(1, len(tokens))) AS position FROM state) pair
    JOIN merges ON merges.pair = ((pair.tokens[pair.position]::BIGINT << 32) | pair.tokens[pair.position + 1])
  ), best AS (
    SELECT piece, two[1] >> 33 AS rank, two[1] & 4294967295 AS first, (two[1] >> 32) & 1 = 0 AND len(two) > 1 AND two[1] >> 33 = two[2] >> 33 AS more
    FROM (SELECT piece, min(key, 2) AS two FROM pairs GROUP BY piece)
  ), places AS (
    SELECT piece, best.rank, pairs.key & 4294967295 AS position, (pairs.key & 4294967295) - row_number() OVER (PARTITION BY piece ORDER BY pairs.key) AS run
    FROM pairs JOIN best USING (piece) WHERE best.more AND pairs.key >> 33 = best.rank
  ), apart AS (
    SELECT piece, rank, position FROM (SELECT *, min(position) OVER (PARTITION BY piece, run) AS start FROM places) WHERE (position - start) % 2 = 0
  ), many AS (
    SELECT t.piece, list(coalesce(a.rank, t.token)::INT ORDER BY t.position) AS tokens
    FROM (SELECT piece, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS position FROM state JOIN best USING (piece) WHERE best.more) t
    LEFT JOIN apart a ON a.piece = t.piece AND a.position = t.position
    ANTI JOIN apart b ON b.piece = t.piece AND b.position = t.position - 1
    GROUP BY t.piece
  )
  SELECT piece, list_concat(tokens[:first - 1], [rank::INT], tokens[first + 2:]) FROM state JOIN best USING (piece) WHERE NOT best.more
  UNION ALL SELECT piece, tokens FROM many)
)
SELECT piece, array_to_string(tokens, ' ') AS ids FROM state
"""

DECODE = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY position)) AS bytes FROM tokens JOIN vocabulary USING (token) GROUP BY doc
"""


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, its merge table and token bytes."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        pair, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pair.append(a << 32 | b)
                    merged.append(rank)
        pairs, ranks = np.array(pair, np.int64), np.array(merged, np.int64)
        # tokens that are part of a pair of lower rank than their own
        before = np.unique(np.concatenate([x[ranks < x] for x in (pairs >> 32, pairs & 0xFFFFFFFF)]))
        self.merges = pa.table({"pair": pairs, "rank_key": ranks << 33 | np.isin(ranks, before).astype(np.int64) << 32})
        self.tokens = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "hex": [k.hex() for k in self.ranks]})
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        flat = np.frombuffer(b"".join(self.ranks), np.uint8).astype(np.int32)
        of = np.repeat(np.arange(len(self.ranks)), [len(k) for k in self.ranks])
        two, three = flat[:-1] << 8 | flat[1:], flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        self.inside2, self.inside3, self.token2 = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool), np.zeros(1 << 16, bool)
        self.inside2[two[of[:-1] == of[1:]]] = True
        self.inside3[three[of[:-2] == of[2:]]] = True
        self.token2[[k[0] << 8 | k[1] for k in self.ranks if len(k) == 2]] = True

    def cuts(self, flat: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Places in words, one after the other, before which no token can reach on."""
        b = flat.astype(np.int32)
        two = b[:-1] << 8 | b[1:]
        whole = self.inside2[two] & (of[:-1] == of[1:])
        three = self.inside3[two[:-1] << 8 | b[2:]] & (of[:-2] == of[2:])
        reach = self.token2[two]
        reach[1:] |= three
        reach[:-1] |= three
        return np.flatnonzero(~(whole & reach)) + 1

    def connect(self):
        import duckdb

        # what is queried has a bounded size, so nothing needs to go to a disk
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "max_temp_directory_size": "0B"})
        con.execute("SET enable_progress_bar = false")
        for name, table in (("merges", self.merges), ("vocabulary", self.tokens)):
            con.register("given", table)
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            con.unregister("given")
        return con


def encode_words(con, vocabulary: Vocabulary, words: list[str], known: dict[bytes, str] | None = None) -> dict[str, str]:
    """Each word's ids, in decimal, joined by a space; ``known`` are those of pieces."""
    known = {} if known is None else known
    out: dict[str, str] = {}
    raw, kept = [], []
    for w in words:
        b = w.encode("utf-8", "surrogatepass")
        if (rank := vocabulary.ranks.get(b)) is not None:
            out[w] = str(rank)
        elif b:
            raw.append(b)
            kept.append(w)
    if not raw:
        return out
    whole = b"".join(raw)
    flat, of = np.frombuffer(whole, np.uint8), np.repeat(np.arange(len(raw)), [len(b) for b in raw])
    ends = np.append(vocabulary.cuts(flat, of), len(flat)).tolist()
    pieces = [whole[i:j] for i, j in zip([0, *ends], ends)]
    contract(con, vocabulary, list(set(pieces).difference(known)), known)
    ids = [known[p] for p in pieces]
    at = np.searchsorted(ends, np.cumsum([len(b) for b in raw])) + 1
    for w, i, j in zip(kept, [0, *at.tolist()], at.tolist()):
        out[w] = ids[i] if j == i + 1 else " ".join(ids[i:j])
    return out


def contract(con, vocabulary: Vocabulary, pieces: list[bytes], known: dict[bytes, str]) -> None:
    """Adds the ids of each piece to those that are known."""
    todo = []
    for p in pieces:
        if (rank := vocabulary.ranks.get(p)) is not None:
            known[p] = str(rank)
        else:
            todo.append(p)
    if not todo:
        return
    sizes = np.array([len(b) for b in todo])
    flat = np.frombuffer(b"".join(todo), np.uint8)
    first = np.cumsum(sizes) - sizes
    con.register("positions", pa.table({
        "piece": np.repeat(np.arange(len(todo), dtype=np.int32), sizes),
        "position": (np.arange(len(flat)) - np.repeat(first, sizes)).astype(np.int32),
        "token": vocabulary.bytes[flat],
    }))
    found = con.execute(ENCODE).fetchnumpy()
    con.unregister("positions")
    known.update(zip([todo[i] for i in found["piece"].tolist()], found["ids"].tolist()))


def decode_ids(con, ids: list[np.ndarray]) -> list[bytes]:
    """The bytes of each list of ids; the query has a part of long lists at a time."""
    out: list[list[bytes]] = [[] for _ in ids]
    parts = [(doc, x[i : i + SLICE_TOKENS]) for doc, x in enumerate(ids) for i in range(0, len(x), SLICE_TOKENS)]
    sizes = np.array([len(x) for _, x in parts], int)
    for place in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_TOKENS)) + 1) if len(parts) else []:
        con.register("tokens", pa.table({
            "doc": np.repeat(place.astype(np.int32), sizes[place]),
            "position": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes[place]]),
            "token": np.concatenate([parts[i][1] for i in place]).astype(np.int32),
        }))
        for i, found in sorted(con.execute(DECODE).fetchall()):
            out[parts[i][0]].append(found)
        con.unregister("tokens")
    return [b"".join(x) for x in out]


def _slices(texts: list[str]):
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``key, ids`` (array of int) for each row; with ``digests``, instead of the
    ids: ``n_tokens, ids_sha256`` and, decoding the ids again, ``decoded_sha256``.
    """
    spark = df.sparkSession
    with open(vocabulary_path, "rb") as f:  # on the driver; the file's size is fixed
        given = spark.sparkContext.broadcast(Vocabulary(f.read()))
    kind = type_of(df, key)

    def run(batches):
        import regex

        vocabulary, words_of = given.value, regex.compile(pattern)
        con, known, pieces = vocabulary.connect(), {}, {}

        def learn(words: set[str]) -> None:
            if len(known) > 600_000:  # bounds the memory, not the result
                known.clear()
                pieces.clear()
            known.update(encode_words(con, vocabulary, list(words.difference(known)), pieces))

        def long(text: str) -> str:
            found, out = words_of.finditer(text), []
            while words := [m[0] for m in islice(found, SLICE_WORDS)]:
                learn(set(words))
                out.append(" ".join(map(known.__getitem__, words)))
            return " ".join(out)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in _slices(texts := [t or "" for t in texts]):
                if len(texts[i]) > SLICE_BYTES:  # one text, whose words are many
                    joined = [long(texts[i])]
                else:
                    split = [words_of.findall(t) for t in texts[i:j]]
                    learn(set().union(*split))
                    joined = [" ".join(map(known.__getitem__, words)) for words in split]
                    del split
                ids = [np.fromstring(x, np.int32, sep=" ") if x else np.empty(0, np.int32) for x in joined]
                if not digests:
                    yield pa.record_batch([keys.slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])
                    continue
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in joined]
                del joined
                back = [hashlib.sha256(x).hexdigest() for x in decode_ids(con, ids)]
                yield pa.record_batch([keys.slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha), pa.array(back)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    more = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return need(df, key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, {more}")


def decode(df: DataFrame, vocabulary_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, bytes`` for each row's ``ids``; null or empty ids give no bytes."""
    spark = df.sparkSession
    with open(vocabulary_path, "rb") as f:
        given = spark.sparkContext.broadcast(Vocabulary(f.read()))
    kind = type_of(df, key)

    def run(batches):
        con = given.value.connect()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                lists = [np.array(x or [], np.int32) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(decode_ids(con, lists), pa.binary())], names=[key, "bytes"])

    return need(df, key, ids).withColumn(ids, F.col(ids).cast("array<int>")).mapInArrow(run, f"`{key}` {kind.simpleString()}, bytes binary")
