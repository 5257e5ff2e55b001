import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import language_id as L

WORDS = {
    "en": "the of and to in is that it was for on are with as this they be at have from".split(),
    "de": "der die und das nicht von sie ist des sich mit dem dass eine auf für als auch".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au".split(),
}


def corpus(n=240):
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(15, 60))), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_held_out_accuracy(docs):
    rows = corpus()
    got = {r["doc_id"]: r for r in L.identify(docs(rows)).collect()}
    want = {d: lang for d, _, lang in rows}
    for d in want:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= got[d]["score"] <= 1
    held = [d for d in want if got[d]["held_out"]]
    assert held and sum(got[d]["lang_pred"] == want[d] for d in held) / len(held) > 0.97


def test_nulls_and_letterless_texts(docs):
    rows = corpus(60) + [(900, None, "en"), (901, "", "en"), (902, "123 -- !!", "en"), (None, "the and of that", "en"), (903, "der und die " * 200_000, "de"), (904, "zzz", None), (905, "zz", "")]
    got = {r["doc_id"]: r for r in L.identify(docs(rows)).collect()}
    assert [got[d]["lang_pred"] for d in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert got[None]["held_out"] is False and got[None]["lang_pred"] == "en"
    assert got[903]["lang_pred"] == "de" and got[904]["lang_pred"] in WORDS


def test_nothing_to_learn_from(docs):
    assert {r["lang_pred"] for r in L.identify(docs([(1, "some text", None)])).collect()} == {"und"}
    assert L.identify(docs([])).count() == 0
    rows = [(1, "some text", None), (2, "12 -", None), (3, None, None), (4, "é", "")]
    assert {r["doc_id"] for r in L.keep_languages(docs(rows)).collect()} == {1, 4}


def naive(rows):
    """doc_id -> (best language, cosine): n-grams of all texts bound, bundled and compared one
    at a time. Letters' vectors are the operator's; all else is done again."""
    sp = L.Space()
    vectors = {}

    def gram(g):
        if g not in vectors:
            v = np.ones(L.DIMENSIONS, int)
            for j, c in enumerate(reversed(g)):
                v = v * np.roll(sp.letter(0 if c == " " else ord(c)).astype(int), j)
            vectors[g] = v
        return vectors[g]

    def bundle(text):
        letters = "".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in text or "")
        if not letters.strip():
            return None
        s = f" {' '.join(letters.split())} "
        return sum((gram(s[i : i + 3]) for i in range(len(s) - 2)), np.zeros(L.DIMENSIONS, int))

    learned = {}
    for d, t, lang in rows:
        v = bundle(t)
        if lang and v is not None and not (d is not None and zlib.crc32(str(d).encode()) % 4 == 2):
            learned[lang] = learned.get(lang, 0) + v
    names = sorted(learned)
    units = [learned[x] / np.linalg.norm(learned[x]) for x in names]
    units = [u - sum(units) / len(units) for u in units] if len(units) > 1 else units
    out = {}
    for d, t, _ in rows:
        v = bundle(t)
        cosines = [] if v is None else [float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)) for u in units]
        out[d] = (names[int(np.argmax(cosines))], max(cosines)) if cosines else ("und", 0.0)
    return out


def test_predictions_and_what_is_kept_against_brute_force(docs):
    rng = random.Random(4)
    rows = corpus(90) + [(500 + i, "".join(rng.choice("abcdeéß .7") for _ in range(rng.randint(1, 9))), None) for i in range(80)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 --", "de"), (903, "Ünd DER!", None)]
    want = naive(rows)
    table = docs(rows).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("y"))
    for r in L.identify(table).collect():
        lang, cosine = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - max(0.0, cosine)) < 1e-3
    out = L.keep_languages(table)
    assert out.columns == table.columns
    far = {d for d, (_, c) in want.items() if abs(c) > 1e-4}
    kept = {r["doc_id"] for r in out.collect()}
    assert kept & far == {d for d in far if want[d][1] > 0} and 0 < len(kept) < len(rows) - 3
    english = {r["doc_id"] for r in L.keep_languages(table, ["en"], 0.05).collect()}
    assert english == {d for d, (x, c) in want.items() if x == "en" and c > 0.05}
    names, prototypes = L.learn(table)
    assert L.predict(table, names, prototypes).columns[-2:] == ["lang_pred", "score"]


def test_more_labels_than_languages_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="distinct"):
        L.learn(docs(corpus(20)))


def test_labels_source_and_ids_do_not_enter_a_prediction(docs):
    rows = corpus(120)
    names, prototypes = L.learn(docs(rows))
    a = {r["text"]: r["lang_pred"] for r in L.predict(docs(rows).select("text"), names, prototypes).collect()}
    b = {r["text"]: r["lang_pred"] for r in L.predict(docs([(9999 - d, t, "xx") for d, t, _ in rows]), names, prototypes).collect()}
    assert a == b


def test_counts_do_not_depend_on_the_part_size(monkeypatch):
    sp, text = L.Space(), "Ab, cd! " * 60
    whole = [x.tolist() for x in sp.counts(text)]
    monkeypatch.setattr(L, "_PART", 7)
    assert [x.tolist() for x in sp.counts(text)] == whole
    grams = {}
    for i in range(len(s := "_" + "ab_cd_" * 60) - 2):
        grams[s[i : i + 3]] = grams.get(s[i : i + 3], 0) + 1
    assert sorted(whole[1]) == sorted(grams.values())


def test_vectors_bind_permuted_letters():
    sp = L.Space()
    a, b, c = (sp.letter(ord(x)).astype(int) for x in "abc")
    code = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    assert (sp.gram(code) == np.roll(a, 2) * np.roll(b, 1) * c).all()
