import base64
import hashlib
import random

import numpy as np
import pytest

from refbank.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Coder(PATH, P.PATTERN)


def ids(codes):
    return [np.frombuffer(c, "<u4").tolist() for c in codes]


def held(ours, theirs, texts):
    got = ours.encode(texts)
    assert ids(got) == [theirs.encode_ordinary(t) for t in texts]
    assert [b.decode() for b in ours.decode(got)] == texts


def test_every_character_is_cut_as_by_the_library(ours, theirs):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join("a" + c + "1" + c + c + " " + c + "b" for c in every[k:k + 20000]) for k in range(0, len(every), 20000)]
    ours.known = {}
    got = ours.encode(texts)
    assert ids(got) == [theirs.encode_ordinary(t) for t in texts]


def test_random_texts(ours, theirs):
    rng = random.Random(3)
    alphabet = " \n\t\r\x0b\x1c\x85　 'sB1!é中😀<|atheing"
    held(ours, theirs, ["", " ", "  a  b\n\n c", "don't 's  it's", "<|endoftext|> a b", "\x00\x01"]
         + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)])


def test_long_words_and_repeats(ours, theirs, monkeypatch):
    rng = random.Random(5)
    texts = ["a" * 5000, "ab" * 3000, "puff" * 500, "=" * 999, " " * 700 + "x", "中文字" * 400, "é" * 300, "Central" * 60,
             "".join(rng.choice("etaoin") for _ in range(3000)), "".join(rng.choice("aab") for _ in range(500))]
    held(ours, theirs, texts)
    # the recursion is left and entered again, and decoding groups are several
    monkeypatch.setattr(bpe, "STEP_ROWS", 2000)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "CACHE", 2)
    ours.known = {}
    held(ours, theirs, texts)
    held(ours, theirs, ["one two three", "two three four"])


def test_both_forms_of_the_recursion_agree(ours, theirs, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("theinrsa") for _ in range(rng.randint(2, 30))) for _ in range(3000)]
    monkeypatch.setattr(bpe, "LONG", 1)
    ours.known = {}
    held(ours, theirs, words)
    ours.known = {}


def test_unknown_id_is_an_error(ours):
    with pytest.raises(ValueError):
        ours.decode([np.array([60000], "<u4").tobytes()])


def test_tables(spark, theirs):
    data = [(1, "some text", 5, "x"), (2**60 + 1, "big id", 6, "x"), (None, "no id", 7, None), (3, None, None, "x"), (4, "", 8, "x"),
            (1, "some text", 5, "x"), (5, "word " * 30000, 9, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids long, bytes string")
    rows = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = [(i, np.array(theirs.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in data]
    assert sorted(((r.id, bytes(r.ids), bytes(r.bytes)) for r in rows), key=key) == sorted(want, key=key)
    assert sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in
                   bpe.round_trip(df, PATH, P.PATTERN).collect()), key=key) == sorted(want, key=key)
    assert bpe.decode(bpe.encode(df.limit(0), PATH, P.PATTERN), PATH, P.PATTERN).collect() == []


def test_query(spark, theirs):
    from refbank.llm.entries import op13_byte_bpe

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_byte_bpe(spark, d).collect()}
    docs = spark.read.parquet(d + "/documents.parquet").collect()
    for r in docs:
        want = theirs.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[r.doc_id] == (len(want), sha(np.array(want, "<u4").tobytes()), sha((r.text or "").encode()))
    assert len(got) == len(docs)
