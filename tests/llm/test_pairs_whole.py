"""The models of broken pairs are those of the whole table, whatever its partitions."""

import numpy as np

from siltstone.llm import pairs as P


def test_models_are_fitted_on_all_rows(spark, small):
    h = spark.read.parquet(f"{small}/whisper_history.parquet").select("transcript", "enhanced_prompt", "mode")
    rows = [tuple(r) for r in h.collect()]
    many = h.crossJoin(spark.range(20)).drop("id").repartition(5)  # above 8,000 rows no row was looked at before
    copies = -(-8000 // len(rows)) + 1
    language, ends, refusals = P.train(many if len(rows) * 20 > 8000 else h.crossJoin(spark.range(copies)).drop("id").repartition(5))
    times = 20 if len(rows) * 20 > 8000 else copies
    want, want_ends = P.fit(rows * times)
    assert language.languages == want.languages
    assert np.allclose(language.weights, want.weights, atol=1e-5) and np.allclose(language.usual, want.usual, atol=1e-4)
    assert np.allclose(refusals.odds, P.fit_refusals([r[1] for r in rows * times]).odds, atol=1e-5)
    assert {m for m in want_ends if want_ends[m].ends} == set(ends)
    for mode, model in ends.items():
        assert model.ends == want_ends[mode].ends and all(want_ends[mode].seen[g] == n for g, n in model.seen.items())
    for _, prompt, mode in rows:
        if prompt and prompt.strip() and mode in ends and not P._CUT_MARK.search(prompt.rstrip()):
            assert ends[mode].likelihood(prompt) == want_ends[mode].likelihood(prompt)


def test_a_row_beyond_the_first_thousands_counts(spark):
    df = spark.range(9000).selectExpr("'' transcript", "case when id = 8999 then 'what is the cause of it and why does it fail when you make the change' else 'xq xq' end enhanced_prompt", "'clean' mode")
    for part in (df, df.orderBy("enhanced_prompt")):
        assert P.train(part)[0].languages == ("en",)


def test_support_grows_with_the_rows():
    assert P.support(100) == P.END_SUPPORT and P.support(800_000) == 100 * P.END_SUPPORT
    cut = ["Explain the cause and the"] * 30
    few = P.EndModel.fit(cut + ["Explain the cause and the effect."] * 9000, least=P.support(9030))
    assert few.likelihood(cut[0]) < P.UNLIKELY
