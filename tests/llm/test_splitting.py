import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siltstone.llm import splitting as S


def parts(text, limit, overlap):
    start, out = 0, []
    for end in S.cuts(text, limit, overlap):
        out.append(text[start:end])
        start = end - overlap
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n#`。", max_size=400), st.integers(0, 20), st.integers(21, 90))
def test_round_trip(text, overlap, limit):
    p = parts(text, limit, overlap)
    assert p[0] + "".join(x[overlap:] for x in p[1:]) == text
    assert all(len(x) <= limit for x in p)
    assert all(b[:overlap] == a[len(a) - overlap :] for a, b in zip(p, p[1:], strict=False))


def test_cuts_at_natural_places():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("word" for _ in range(rng.randrange(20, 90))) + "." for _ in range(80))
    ends = S.cuts(text)
    assert len(text) > 12000 and len(ends) == 1 + -(-(len(text) - 6000) // 5744)
    assert all(text[e - 2 : e] == "\n\n" for e in ends[:-1])


def test_one_more_piece_for_a_boundary():
    text = "x" * 3000 + ". " + "y" * 3000 + ". " + "z" * 5736  # fills two pieces to the last character
    ends = S.cuts(text)
    assert len(text) == 11740 and all(text[e - 2 : e] == ". " for e in ends[:-1])


def test_fences_and_unbroken_runs():
    code = "```\n" + "line of code;\n" * 500 + "```\n"
    text = "Intro.\n\n" + code + "After. " * 900
    for e in S.cuts(text)[:-1]:
        assert text[e - 1] in "\n " and not (8 < e < 8 + len(code)) or text[e - 1] == "\n"
    assert [len(p) <= 6000 for p in parts("字" * 13000, 6000, 256)] == [True] * 3
    marks = "é" * 4000
    assert all(marks[e] != "́" for e in S.cuts(marks)[:-1])


def test_long_text_is_quick():
    assert len(S.cuts("A sentence of the text. " * 200_000)) > 800


def test_bodies_and_pieces(spark):
    rows = [("s", 1, "---\ntitle: x\n---\n\n" + "a " * 3200), ("s", 2, "  \n" + "b" * 6000 + "\n "), ("s", 3, None), ("s", 4, ""), ("s", 5, "---\n" + "c. " * 2500), ("s", 1, "d" * 6001)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "source_table string, row_id bigint, t string, piece string")
    b = df.withColumn("body", S.body(F.col("t"), True))
    got = S.pieces(b).collect()
    assert {r["row_id"] for r in got if r["piece_no"] == 0} == {1, 5} and len([r for r in got if r["row_id"] == 1 and r["piece_no"] == 0]) == 2
    assert S.pieces(b.limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.cuts("x" * 10, 5, 5)
