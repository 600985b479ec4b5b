import random
import unicodedata

from docketry.llm import lookalikes as L

SCHEMA = "doc_id long, text string, form string, raw string, class_id int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in texts], SCHEMA)


def found(spark, texts):
    return {tuple(r) for r in L.pairs(L.classes(L.forms(table(spark, texts)))).collect()}


def skeleton(text):
    """Every look-alike as its Latin letter, wherever it stands: what the page shows."""
    return "".join(L._TO_LATIN.get(c, c) for c in L.fold(text))


def test_against_visual_equality(spark):
    rng = random.Random(5)
    back = {}
    for c, latin in L._CLEARLY.items():
        back.setdefault(latin, []).append(c)
    base = ["The Court heard the plea of Mepitari on 12 May.", "A pension was due;\nnotice issued twice", "कोर्ट ने कहा। daṇḍa stood", "No ocean view x"]
    texts = []
    for i in range(60):
        t = rng.choice(base)
        how = rng.randrange(6)
        if how == 0:
            t = "".join(rng.choice(back[c]) if c in back and rng.random() < 0.3 else c for c in t)
        elif how == 1:
            t = t.replace(" ", " ", 2).replace("e", "e​", 1)
        elif how == 2:
            t = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalpha() and rng.random() < 0.3 else c for c in t)
        elif how == 3:
            t = unicodedata.normalize("NFD", t)
        elif how == 4:
            t = t.replace("e", "E", 1) if rng.random() < 0.5 else t.replace("\n", " ")
        texts.append((i, t))
    want = {(a, b) for a, x in texts for b, y in texts if a < b and x != y and skeleton(x) == skeleton(y)}
    assert want and found(spark, texts) == want


def test_what_differs_stays_different(spark):
    texts = [(1, "Clause 3"), (2, "clause 3"), (3, "Clause 4"), (4, "Clausé 3"), (5, "Clause\n3"), (6, "Clause  3"), (7, "Clause γ3"), (8, "Clause y3"), (9, "Clause ٣")]
    assert found(spark, texts) == set()


def test_vocabulary_decides(spark):
    """A mixed token whose repair no text of the corpus has, and that stands once, is left alone."""
    mixed = "zqхw"
    assert L.suspects(mixed + " plain words here") == {mixed: "zqxw"}
    rows = {r.doc_id: r.text for r in L.repair(table(spark, [(1, f"{mixed} plain words here"), (2, "other plain words")])).collect()}
    assert rows[1] == f"{mixed} plain words here"
    rows = {r.doc_id: r.text for r in L.repair(table(spark, [(1, f"{mixed} plain words here"), (2, "Zqxw is a word")])).collect()}
    assert rows[1] == "zqxw plain words here"


def test_scripts():
    assert L.substitute("мoре", "C") == "море"  # a Latin o in a word with Cyrillic letters of its own
    assert L.substitute("plan", "L") is None and L.substitute("море", "L") is None
    assert L.substitute("сосо", "L") == "coco" and L.substitute("сосо", "C") is None


def test_nulls_empty_repeats_long(spark):
    assert found(spark, []) == set()
    texts = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "a b"), (None, "a b"), (6, "word " * 60_000), (7, "word " + "word " * 59_999)]
    assert found(spark, texts) == {(3, 5), (4, 5), (6, 7)}


def test_genuine_words_of_another_script_stay(spark):
    """Words of another script are no disguise: no word of the corpus results, or the text has words of that script."""
    texts = [(1, "Goods from СССР were signed for."), (2, "The оса flew."), (3, "Он не сор but море, he said."), (4, "cop and sop are words"), (5, "A сор of the notice was served.")]
    rows = {r.doc_id: r.text for r in L.repair(table(spark, texts)).collect()}
    assert rows == dict(texts) | {5: "A cop of the notice was served."}
    assert L.suspects("A сор of it", whole=False) == {}


def test_letters_of_many_scripts():
    known = {"αppeal": "appeal", "ρermit": "permit", "ιn": "in", "ԝritten": "written", "ցrant": "grant", "ᎪCT": "ACT", "ꓐank": "Bank", "ɡuarantor": "guarantor", "𝐀ppeal": "Appeal", "paгty": None, "β": None, "α": None}
    for token, plain in known.items():
        assert L.suspects(f"the {token} here").get(token) == plain, token
