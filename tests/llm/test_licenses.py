import re
from collections import Counter

from refbank.llm import licenses as L

SCHEMA = "doc_id long, text string, licence string, unit string"


def grams(x):
    w = re.findall(r"[^\W_]+", x.lower())
    return Counter(zip(w, w[1:]))


KNOWN = [(name, g, sum(g.values())) for name, variants in L.TEMPLATES.items() for g in map(grams, variants)]


def brute(rows, threshold=0.8):
    out = {}
    for doc_id, text in sorted(set(rows), key=str):
        text = text or ""
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(re.split(r"\n[ \t\r]*\n", text)) if "\n" in x]
        units += [("text", 0, text)] if "\n" in text else []
        best = {}
        for unit, at, x in units:
            a = grams(x)
            n, found = sum(a.values()), []
            for name, b, m in KNOWN:
                # the score is at most that of the smaller one lying in the larger one whole
                if n and 2 * min(n, m) >= (threshold - 1e-9) * (n + m):
                    dice = 2 * sum((a & b).values()) / (n + m)
                    if dice >= threshold:
                        found.append((-dice, name))
            if found:
                d, name = min(found)
                best.setdefault(name, []).append((d, unit, at))
        for name, hits in best.items():
            d, unit, at = min(hits)
            out.setdefault((doc_id, name, round(-d, 9), unit, at, len(hits)), 0)
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.licence, round(r.dice, 9), r.unit, r.position, r.n_units) for r in L.scan(df).collect()), key=str)


def test_matches_brute_force(spark):
    mit = L.TEMPLATES["MIT"][1].split(" ")
    wrapped = "\n".join(" ".join(mit[i:i + 12]) for i in range(0, len(mit), 12))
    rows = [(1, "hello\nReleased under the MIT License.\nbye"), (2, "Released under  the MIT LICENSE, friends\nreleased under the mit license"),
            (3, f"Copyright someone\n\n{wrapped}\n\nint main() {{}}"), (4, wrapped), (5, wrapped.replace("copyright", "authorship")), (6, None), (7, ""),
            (8, "one"), (9, "released released under under the the mit mit license license"), (10, "\n".join(["word soup here"] * 5000)),
            (11, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0."), (None, "Released under the MIT License."),
            (1, "another text of id one\nLicensed under the Apache License, Version 2.0."), (1, "hello\nReleased under the MIT License.\nbye")]
    # equal rows of one id count as one document with each unit twice
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows[:-1]], SCHEMA)
    assert got(df) == brute(rows[:-1])
    assert len(got(df)) >= 8


def test_equal_rows_are_one_result(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "x", "y")] * 3, SCHEMA)
    assert got(df) == [(1, "MIT", 1.0, "line", 0, 1)]
    twice = {"X": ["go on go on go on stop"]}  # the template holds a bigram three times, the text once
    df = spark.createDataFrame([(1, "go on then we stop here", "x", "y")] * 3, SCHEMA)
    assert L.scan(df, twice, 0.3).collect() == []


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()])
    assert L.scan(df.where("false")).collect() == []
    assert L.scan(df, templates={}).collect() == []


def licences(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    out = {i: set() for i in range(len(texts))}
    for r in L.scan(df).collect():
        out[r.doc_id].add((r.licence, r.unit))
    return out


def test_notices_inside_other_text_and_the_right_variant(spark):
    filler = "some words about the weather in spring " * 30
    gpl2 = next(t for t in L.TEMPLATES["GPL-2.0"] if "any later version" in t)
    lgpl = next(t for t in L.TEMPLATES["LGPL-2.1"] if "any later version" in t)
    agpl = next(t for t in L.TEMPLATES["AGPL-3.0"] if "any later version" in t).split(" ")
    comment = "\n".join(f" * {' '.join(agpl[i:i + 9])}" for i in range(0, len(agpl), 9))
    texts = [f"{filler} Licensed under CC BY-NC-SA 4.0. {filler}", f"{filler}{gpl2} {filler}", f"{filler}{lgpl} {filler}",
             f"/* {filler}\n{comment}\n * {filler}\n */\nint x;", "Creative Commons Attribution-NonCommercial 4.0", filler,
             f"{filler} ends: Licensed under the Apache License, Version 2.0", "Released under the MIT License. " * 3 + filler]
    got = licences(spark, texts)
    assert [{x for x, _ in got[i]} for i in range(8)] == [
        {"CC-BY-NC-SA-4.0"}, {"GPL-2.0"}, {"LGPL-2.1"}, {"AGPL-3.0"}, {"CC-BY-NC-4.0"}, set(), {"Apache-2.0"}, {"MIT"}]
    assert got[0] == {("CC-BY-NC-SA-4.0", "window")} and got[4] == {("CC-BY-NC-4.0", "line")}


def test_full_texts_also_inside_other_text(spark):
    names = ["Apache-2.0", "GPL-2.0", "AGPL-3.0", "LGPL-2.1", "MPL-2.0"]
    full = {n: " ".join(max(L.TEMPLATES[n], key=len).split()) for n in names}
    around = "the quick brown fox jumps over a lazy dog and sleeps " * 400
    got = licences(spark, [full[n] for n in names] + [f"{around} {full[n]} {around}" for n in names] + [around])
    assert [got[i] for i in range(5)] == [{(n, "line")} for n in names]
    assert [got[i] for i in range(5, 10)] == [{(n, "window")} for n in names] and got[10] == set()


def test_signatures_lose_no_match(spark):
    import random

    rng, tpl = random.Random(3), {"A": ["a b c d e a b f g h i j"], "B": ["a b c d x y z"], "C": ["d e f g"]}
    need, held = {}, set()
    for tid, _, _, _, n, bigram, _ in L.signatures(tpl, 0.8):
        need[tid] = n
        held.add((tid, bigram))
    texts = {0: tpl["A"][0], 1: tpl["B"][0], 2: tpl["C"][0]}
    for _ in range(3000):
        t = rng.choice([0, 1, 2])
        w = texts[t].split()
        for _ in range(rng.randrange(3)):
            w.insert(rng.randrange(len(w)), rng.choice("abcxyz")) if rng.random() < 0.5 else w.pop(rng.randrange(len(w)))
        a, b = Counter(zip(w, w[1:])), Counter(zip(texts[t].split(), texts[t].split()[1:]))
        if w and 2 * sum((a & b).values()) >= 0.8 * (sum(a.values()) + sum(b.values())):
            assert sum((t, " ".join(g)) in held for g in a.elements()) >= need[t]


def sliding(words, templates):
    """The best (dice, licence) of all windows of all templates, start by start."""
    pairs = list(zip(words, words[1:]))
    best = (0.0, "")
    for name, variants in templates.items():
        for v in variants:
            want = grams(v)
            b = sum(want.values())
            for start in range(len(pairs)):
                have = Counter(pairs[start:start + b])
                c = sum((have & want).values())
                best = max(best, (2 * c / (sum(have.values()) + b), name))
    return best


def test_edited_licences_inside_other_words_are_the_nearest_ones(spark):
    import random

    rng = random.Random(11)
    pick = {n: [max(L.TEMPLATES[n], key=len)] for n in ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MIT", "ISC")}
    for n in ("GPL-2.0", "LGPL-2.1", "AGPL-3.0"):
        pick[n] = [next(t for t in L.TEMPLATES[n] if "any later version" in t)]
    strange = [f"zq{k}" for k in range(200)]
    texts, best = [], []
    for n in pick:
        for share in (0, 0.02, 0.04, 0.06, 0.08, 0.15):
            w = re.findall(r"[^\W_]+", pick[n][0].lower())
            for _ in range(int(share * len(w))):
                at = rng.randrange(len(w))
                if rng.random() < 0.7:
                    w.insert(at, rng.choice(strange))
                else:
                    w[at] = rng.choice(strange)
            w = rng.choices(strange, k=60) + w + rng.choices(strange, k=40)
            texts.append(" ".join(w))
            best.append(sliding(w, pick))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    found = {}
    windows = set()
    for r in L.scan(df, pick).collect():
        found.setdefault(r.doc_id, {})[r.licence] = r.dice
        if r.unit == "window":  # a whole text that matches has its own, lower score
            windows.add(r.doc_id)
    due = [i for i, (d, _) in enumerate(best) if d >= 0.8]
    assert len(due) >= 30
    assert all(set(found[i]) == {best[i][1]} for i in found), [(i, found[i], best[i]) for i in found if set(found[i]) != {best[i][1]}]
    assert all(i in due for i in found) and sum(i in found for i in due) >= 0.98 * len(due)
    worst = sorted((best[i][0] - found[i][best[i][1]], best[i], i) for i in windows)[-8:]
    assert len(windows) >= 20 and worst[-1][0] <= 1 / 32, worst
