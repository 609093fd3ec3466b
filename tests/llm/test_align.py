import hashlib
import random
from collections import Counter

import pytest

from refbank.llm import align as A

P = pytest.importorskip("public_tokenizers")
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    signs = A.byte_alphabet()

    def both(text):
        if not text:
            return [], []
        a = [(i, bytes(signs[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
             for i in sp.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    return both


def plain(libraries, texts):
    """Results by sets of ends, the counts over all texts."""
    docs, counts = [], Counter()
    for t in texts:
        a, b = libraries(t)
        ends = []
        for side in (a, b):
            at, e = 0, {}
            for n, (i, x) in enumerate(side):
                at += len(x)
                e[at] = n
            ends.append(e)
        common = sorted(set(ends[0]) & set(ends[1]))
        links, text, pa, pb = [], [], 0, 0
        for c in common:
            ia, jb = ends[0][c], ends[1][c]
            links.append((a[ia][0], b[jb][0]))
            text.append(",".join(str(i) for i, _ in a[pa:ia + 1]) + "|" + ",".join(str(i) for i, _ in b[pb:jb + 1]))
            pa, pb = ia + 1, jb + 1
        counts.update(links)
        docs.append((len(a), len(b), links, hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(na, nb, len(ls), len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for na, nb, ls, sha in docs]


def test_runs_against_sets():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randint(1, 60)
        ea, eb = (sorted({total, *rng.sample(range(1, total + 1), rng.randint(0, total // rng.choice([1, 2, 5])))}) for _ in "ab")
        got = [(i + k, j + k) for i, j, n in zip(*A.runs(ea, eb)) for k in range(n)]
        assert [(ea[i], eb[j]) for i, j in got] == [(c, c) for c in sorted(set(ea) & set(eb))]
    same = list(range(1, 1001))
    assert A.runs(same, same) == ([0], [0], [1000]) and A.runs([], []) == ([], [], [])


def test_tables(spark, libraries, monkeypatch):
    rng = random.Random(2)
    alphabet = " \n\t  'sB1!é中😀<|atheing▁"
    texts = [None, "", " ", "  ", "a", "<|endoftext|> a <s>", "the ▁ sign", "\x00", "word " * 5000, "x" * 3000, "a　b"]
    texts += ["".join(rng.choice(alphabet[:-1] if n % 5 else alphabet) for _ in range(rng.randint(0, 60))) for n in range(400)]
    texts += ["the same text"] * 3
    data = [(None if k == 7 else 2**60 + k, t, k, "x") for k, t in enumerate(texts)] + [(5, "twice", 0, "x")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, n_a long, block string").repartition(3)
    got = A.align(df, *PATHS).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = [(i, *r) for (i, *_), r in zip(data, plain(libraries, [t for _, t, *_ in data]))]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert A.align(df.limit(0), *PATHS).collect() == []


def test_groups_are_spans_of_the_text(spark, libraries):
    texts = {1: "Some words, and 中文 too", 2: "", 3: "another one"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = A.groups(df, *PATHS).orderBy("id", "place").collect()
    for i, t in texts.items():
        a, b = libraries(t)
        mine = [r for r in rows if r.id == i]
        assert [r.place for r in mine] == list(range(len(mine)))
        assert [x for r in mine for x in r.a] == [x for x, _ in a] and [x for r in mine for x in r.b] == [x for x, _ in b]
        raw, at = (" " + t).encode(), 0
        bytes_of = dict(a)
        for r in mine:
            assert r.start == at and raw[r.start:r.stop] == b"".join(bytes_of[x] for x in r.a)
            at = r.stop


def test_query(spark, libraries):
    from refbank.llm.entries import op12_token_alignment

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(d + "/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(docs, plain(libraries, [r.text for r in docs]))}
    got = op12_token_alignment(spark, d).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)
