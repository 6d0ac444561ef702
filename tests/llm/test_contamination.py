import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from siltstone.llm import contamination as C
from siltstone.llm.words import word_spans, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_suffix_array(values):
    t = np.array(values)
    assert C.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: values[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=2, max_size=4))
def test_fm_index_finds_all_places(text, phrase):
    index = C.FmIndex(np.array(text), 4, every=3)
    found, lo, hi = index.search(np.array([phrase]))
    want = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]
    got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(found) else []
    assert got == want


def test_words():
    assert words("Ab-C_d 12x É​té so­ft") == ["ab", "c", "d", "12x", "été", "soft"]
    assert words(None) == words("") == []
    text = "É​té, so­ft"
    assert [text[a:b] for a, b in word_spans(text)] == ["É​té", "so­ft"]


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, passage string, doc_id int")
    return C.leaked_spans(d, q, **how).collect()


@pytest.mark.parametrize("how", [{}, {"shard_words": 20}, {"block_words": 30}, {"shard_chars": 200}])
def test_against_brute_force(spark, how):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(8)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice([*vocabulary, "other"]) for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            p = items[rng.randrange(8)][1].split()
            a = rng.randrange(10)
            parts.append(", ".join(p[a : a + rng.choice([11, 12, 13, 25])]).upper())
        docs.append((i, " ​".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    want = {}
    for d, text in docs:
        ws = words(text)
        for q, p in items:
            pw = words(p)
            grams = {tuple(pw[k : k + 12]) for k in range(len(pw) - 11)}
            hit = [k for k in range(len(ws) - 11) if tuple(ws[k : k + 12]) in grams]
            if hit:
                want[d, q] = {n for k in hit for n in range(k, k + 12)}
    got = {}
    for r in run(spark, docs, items, **how):
        got.setdefault((r["doc_id"], r["item_id"]), set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
        text = dict(docs)[r["doc_id"]]
        assert words(text[r["char_start"] : r["char_end"]]) == words(text)[r["first_word"] : r["first_word"] + r["n_words"]]
    assert got == want and want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a " * 20)]) == [] and run(spark, [(1, "a " * 20)], []) == []
