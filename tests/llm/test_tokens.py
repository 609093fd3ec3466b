import random
import zlib

import numpy as np
import pytest

from refbank.llm import tokens as T

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def direct(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**31, 2**40], rng.integers(0, 70000, 5000).tolist(), [7] * 1025):
        c = T.Codes(T.encode(np.array(ids, np.uint64)))
        assert len(c) == len(ids) and c.all().tolist() == ids
        assert [c[i] for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(IndexError):
        T.Codes(T.encode(np.array([1])))[1]
    with pytest.raises(ValueError):
        T.Codes(b"nope" + bytes(20))
    with pytest.raises(ValueError):
        T.Codes(T.encode(np.array([1, 2, 3])) + b"x")


def test_piecewise_ids_equal_whole_text_ids():
    rng = random.Random(2)
    alphabet = " \n\t\r\x0b\x0c\x1c\x85　 'sB1!é中😀<|a"
    texts = ["", " ", "  a  b\n\n c", "don't 's  it's", "<|endoftext|> a b", "a \n", "plain words, here."]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    enc = T.Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == direct(texts)


def test_small_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    texts = ["one two three four", "five six", "one two"] * 3
    enc = T.Encoder(PATH)
    assert [np.frombuffer(enc([t])[0], "<u4").tolist() for t in texts] == direct(texts)


def test_files_in_id_order(spark, tmp_dir):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(["the", "of", "Ünder", "x1"]) for _ in range(rng.randint(0, 80))), "p", 0) for i in range(200)]
    data += [(300, None, "p", 1), (2**60 + 1, "large id", "p", 0), (-5, "negative id", None, 2), (None, "no id", "q", 3), (7, "repeated id", "r", 4), (7, "repeated id", "r", 4)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string, payload string, shard int").repartition(5)
    T.write(df, tmp_dir + "/t", PATH, segment_ids=300)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read(spark, tmp_dir + "/t").collect())
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for r, ids in zip(order, direct([r[1] or "" for r in order])):
        raw = np.array([*ids, 2], "<u4").tobytes()
        want.append((at, -1 if r[0] is None else r[0], len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert got == want
    segs = spark.read.parquet(tmp_dir + "/t")
    assert segs.count() > 3 and segs.agg({"n_ids": "sum"}).first()[0] == at


def test_empty_table(spark, tmp_dir):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_output(df, PATH, tmp_dir + "/e").collect() == []


def test_latin_words_and_signs_behind_them():
    rng = random.Random(8)
    stems = ["don", "Ünder", "éèçß", "ſtraße", "naïve", "Łódź", "x1", "19", "中文", "aɐ", "ǅ", "e\u0301"]
    words = [rng.choice(stems) + "".join(rng.choice("'.,!?%*$&-_()\"") for _ in range(rng.randint(0, 3))) for _ in range(4000)]
    texts = [" ".join(words[k:k + 20]) for k in range(0, 4000, 20)] + ["don't 'll' we're' s", "a's' b'", "x\n y"]
    enc = T.Encoder(PATH)
    assert enc.by_piece and [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == direct(texts)


def test_other_pre_tokenizers_get_whole_texts():
    other = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok, texts = Tokenizer.from_file(other), ["Some Words, here!", "", "  two  blanks ", "new\nline it's"]
    enc = T.Encoder(other)
    assert not enc.by_piece
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
