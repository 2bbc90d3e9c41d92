import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from sessionlake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def oracle():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n \t x", "Hello, world's 1234 tests!", "naïve café 漢字かな 😀👩‍👩‍👧", "\x00\x01\x7f", "a" * 3000, "ab " * 5000, "<|endoftext|> is text", "don't we'll I've x", "thethethethe" * 200, " 　 end  ",
]


def test_against_the_library(spark, oracle):
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(200))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    ids = {r.doc_id: r.ids for r in bpe.encode(df, PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert ids[i] == oracle.encode_ordinary(t or ""), t
    for r in bpe.encode(df, PATH, P.PATTERN, digests=True).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(raw).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH)
    assert all(bytes(r.bytes) == (texts[r.doc_id] or "").encode() for r in back.collect())


def test_words_of_any_length(oracle):
    """Joint contractions and cuts give what one contraction a step gives."""
    with open(PATH, "rb") as f:
        vocabulary = bpe.Vocabulary(f.read())
    rng = random.Random(2)
    con = vocabulary.connect()
    words = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "l", "etaoinshr", "abcdefghijklmnopqrstuvwxyz") for n in (2, 7, 40, 400, 401, 5_000)]
    words += ["a" * 200_000, "ab" * 20_000, "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(3_000))]
    words += ["".join(rng.choices(rng.choice(["ab", "aehinst", "the", "-=", "01"]), k=rng.randrange(2, 70))) for _ in range(300)]
    got = bpe.encode_words(con, vocabulary, words)
    for w in words:
        assert got[w] == " ".join(map(str, oracle._encode_single_piece(w.encode()))), w[:80]


def test_one_contraction_where_ranks_may_fall():
    """Of ``bb`` the pair ``b, bb`` has a lower rank than it, so places aren't contracted together."""
    tokens = [bytes([i]) for i in range(256)] + [b"bbb", b"bb", b"bbbb", b"ab", b"aba"]
    lines = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))
    vocabulary = bpe.Vocabulary(lines)
    oracle = tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randrange(2, 40))) for _ in range(200)] + ["b" * n for n in range(2, 20)]
    got = bpe.encode_words(vocabulary.connect(), vocabulary, words)
    for w in words:
        assert got[w] == " ".join(map(str, oracle._encode_single_piece(w.encode()))), w


def test_long_texts_in_parts(spark, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 300)
    monkeypatch.setattr(bpe, "SLICE_WORDS", 7)
    monkeypatch.setattr(bpe, "SLICE_TOKENS", 11)
    texts = ["short one", " ".join(f"word{i} and" for i in range(200)), "", "x " * 300, None, "the end"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    for r in bpe.encode(df, PATH, P.PATTERN, digests=True).collect():
        want = oracle.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_query(spark, oracle):
    from sessionlake.llm.queries import op5_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op5_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        want = oracle.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_cases(spark):
    assert bpe.encode(spark.createDataFrame([], DOCS), PATH, P.PATTERN).count() == 0
    df = spark.createDataFrame([(None, "a b", 1, "z"), (1, "a b", 1, "z"), (1, "a b", 1, "z")], DOCS + ", ids int, TEXT string")
    assert [r.ids for r in bpe.encode(df, PATH, P.PATTERN).collect()] == [bpe.encode(df.limit(1), PATH, P.PATTERN).first().ids] * 3
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).first().bytes) == b""
