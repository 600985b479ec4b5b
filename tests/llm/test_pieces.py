import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import pieces, tokens

texts = st.lists(st.sampled_from(["Word ", "Another one. ", "\n\n", "\n", "No. 5 ", "x" * 30, "\n\nORDER\n", "क ", "A. B. Rao said so. ", " "]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(5, 80), st.integers(0, 40))
def test_round_trip(text, limit, overlap):
    parts = pieces.cut(text, limit, overlap)
    shared = min(overlap, limit - 1)
    assert all(0 < b - a <= limit for a, b in parts)
    done = 0
    for a, b in parts:
        assert a == (max(0, done - shared) if done else 0) and b > done
        done = b
    assert done == len(text)
    assert "".join(text[max(a, e):b] for (a, b), e in zip(parts, [0, *[b for _, b in parts]])) == text  # noqa: B905


def test_natural_places():
    text = "First point is made. Second point follows here. " * 4 + "\n\n" + "Third part. " * 5
    ends = [text[:b].rstrip()[-1] for _, b in pieces.cut(text, 120, 0)]
    assert set(ends) == {"."}
    assert [b for _, b in pieces.cut("Mr. A. Rao met No. 5 of v. B. in Rs. 10 and left. Then he came.", 60, 0)][0] == 50
    assert pieces.cut("x" * 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert pieces.cut("", 4, 1) == [] and pieces.cut("abc", None, 2) == [(0, 3)] and pieces.cut("abc", 0, 0) == [(0, 3)]


def test_a_sentence_end_before_words():
    text = "Short. " + "Word " * 40
    assert pieces.cut(text, 50, 0)[0] == (0, 7)


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer here")
@settings(max_examples=60, deadline=None)
@given(texts, st.integers(3, 40), st.integers(0, 20))
def test_tokens(text, limit, overlap):
    counter = tokens.Counter()
    assert sum(counter.chunks(text)) == counter.exact(text)
    reach = pieces.TokenReach(counter, text, limit)
    parts = pieces.cut(text, 60, overlap, reach)
    assert all(counter.exact(text[a:b]) == reach.count(a, b) for a, b in parts)
    # one character can be more tokens than a tiny limit; a piece of several characters never is
    assert all(counter.exact(text[a:b]) <= limit or b - a == 1 for a, b in parts)
    assert "".join(text[max(a, e):b] for (a, b), e in zip(parts, [0, *[b for _, b in parts]])) == text  # noqa: B905


def test_rows(spark):
    df = spark.createDataFrame([("a", "One. " * 30, 1), ("b", None, 2), ("c", "", 3), (None, "text", 4), ("d", "short", 5), ("e", "y" * 200_000, 6)], "id string, text string, start int")
    configs = [("k", 50, None, 10), ("open", None, None, None)]
    rows = pieces.split(df, "id", "text", configs, by_tokens=False).collect()
    assert {r.record for r in rows} == {"a", "d", "e"}
    assert all(len(r.text) <= 50 for r in rows if r.experiment_id == "k")
    assert sorted((r.record, r.n_pieces) for r in rows if r.experiment_id == "open") == [("a", 1), ("d", 1), ("e", 1)]
    assert pieces.split(df.limit(0), "id", "text", configs, by_tokens=False).count() == 0
