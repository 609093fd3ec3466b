import numpy as np

from refbank.llm import langid as L
from refbank.llm.common import table
from refbank.llm.entries import op9_language_id

SCHEMA = "doc_id long, text string, lang string, score double, code long"
SAY = {"en": "the children walked through the garden with their mother",
       "de": "die Kinder gingen mit ihrer Mutter durch den schönen Garten",
       "fr": "les enfants traversaient le jardin avec leur mère hier"}


def docs():
    return [(i, " ".join([SAY[x]] * 3), x, 0.0, 0) for i, x in enumerate(["en", "de", "fr", "en"] * 6)] + [
        (90, SAY["en"], None, 0.0, 0), (91, None, "de", 0.0, 0)]


def predicted(spark, filters, texts):
    df = spark.createDataFrame([(i, t, None, 1.0, 2) for i, t in enumerate(texts)], SCHEMA)
    p = df.select("doc_id", L.predict(L.F.col("text"), filters, spark).alias("p")).orderBy("doc_id").collect()
    return [(r.p.lang, r.p.score) for r in p]


def test_learned_languages(spark):
    f = L.learn(spark.createDataFrame(docs(), SCHEMA))
    assert f.langs == ["de", "en", "fr"] and f.masks.shape == (1, L.SLOTS)
    got = predicted(spark, f, ["Mutter und Kinder", "their garden", "leur jardin " * 300_000, None, "", "12 !? 34", "ЖЖЖ", "their garden"])
    assert [x for x, _ in got] == ["de", "en", "fr", "und", "und", "und", "en", "en"]
    assert [s for _, s in got[3:7]] == [0.0] * 4 and all(0 < s <= 1 for _, s in got[:3]) and got[1] == got[7]


def test_filter_holds_every_kept_ngram_and_all_its_languages(spark):
    f = L.learn(spark.createDataFrame(docs(), SCHEMA))
    for lang in f.langs:
        for texts in (SAY[lang],):
            _, grams = L.stream(L.G.np.frombuffer((texts + "\n").encode("utf-32-le"), np.uint32))
            code, on = grams[-1]
            slots = L.slots_of(code[on])
            mask = f.masks[0][slots[0]] & f.masks[0][slots[1]] & f.masks[0][slots[2]]
            assert ((mask >> np.uint64(f.langs.index(lang))) & np.uint64(1)).mean() > 0.95


def test_more_languages_than_one_slice(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 6, f"l{i:03d}", 0.0, 0) for i in range(70)]
    f = L.learn(spark.createDataFrame(rows, SCHEMA))
    assert f.masks.shape[0] == 2
    got = predicted(spark, f, [r[1] for r in rows])
    assert [x for x, _ in got] == [r[2] for r in rows]


def test_nothing_learned(spark):
    f = L.learn(spark.createDataFrame([], SCHEMA))
    assert predicted(spark, f, ["some text", None]) == [("und", 0.0)] * 2


def test_query_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op9_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_languages_with_millions_of_ngrams(spark):
    """Two scripts of ideographs, about two million kept n-grams each."""
    rng = np.random.default_rng(5)
    rows, words = [], {}
    for lang, first in (("one", 0x4E00), ("two", 0x7000)):
        letters = rng.integers(first, first + 8000, (200_000, 4))
        words[lang] = ["".join(map(chr, w)) for w in letters]
        rows += [(i, " ".join(words[lang][i:i + 20_000] * 3), lang, 0.0, 0) for i in range(0, 200_000, 20_000)]
    f = L.learn(spark.createDataFrame(rows, SCHEMA))
    assert f.masks.shape[1] > L.SLOTS and (f.miss < 0.25).all()
    got = predicted(spark, f, [" ".join(words["one"][:100]), " ".join(words["two"][:100]), " ".join(words["two"][:90] + words["one"][:10])])
    assert [x for x, _ in got] == ["one", "two", "two"] and min(s for _, s in got[:2]) > 0.95 and got[2][1] > 0.8


def test_slots_follow_the_ngrams_and_full_filters_are_errors():
    import pytest

    assert L.slots_for(1000, 1) == L.SLOTS and L.slots_for(1_000_000, 1) == 1 << 23
    assert L.slots_for(int(1 / L.MIN_SHARE), 4) == L.MAX_SLOTS
    with pytest.raises(ValueError):
        L.slots_for(4_000_000, 32)


def test_signs_above_the_basic_plane(spark):
    import numpy as np

    from refbank.llm import ngrams as G

    cps = np.array([0x1F600, 0x20000, 0x1D400, 0x1F1E6, 0xE0100, 0x10400], np.uint32)  # emoji, ideograph, letter, flag, mark, letter
    assert (G.lowered(cps) > 0).tolist() == [False, True, True, False, False, True]
    assert (G.symbols(cps) > 0).tolist() == [False, True, True, False, False, True]
    docs = spark.createDataFrame([(k, "the words of this language " * 3, "en") for k in range(8)] + [(k, "les mots de cette langue " * 3, "fr") for k in range(8, 16)],
                                 "doc_id long, text string, lang string")
    f = L.learn(docs)
    got = L.scores(["\U0001F600 \U0001F680\U0001F680", "\u0301\u0302", "\U00020000\U00020001", None, "12 ...", "the words"], f)
    assert [x[0] == "und" for x in got] == [True, True, False, True, True, False]
