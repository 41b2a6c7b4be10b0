"""Pieces and levels leave nothing out."""

import random


def test_every_text_with_words_has_a_level(spark, tmp_path):
    from lociframe.llm.queries import p8_found, p8_levels, p8_profile

    rng = random.Random(33)
    words = "the cat sat on a mat and the dog ran to the house notwithstanding authorisation of it".split()

    def text(level, lead="1. "):
        return lead + ". ".join(" ".join(rng.choice(words) for _ in range(3 + 5 * level)) for _ in range(10)) + "."

    short = "1. Der Hof war offen. Der Zaun blieb. Die Frist war kurz."
    long = "1. " + "Der Hof und die Frist, die nicht offen war, blieb für den Zaun und das Tor auf dem Weg nach der Stadt mit einem Wagen, " * 4 + "und es war."
    rows = [(i, text(1 + i % 4), "a") for i in range(200)] + [(900, short, "a"), (901, long, "a"), (902, text(4, ""), "a"), (903, "12 34", "a"), (904, None, "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "r", 1 + i % 4) for i in range(200)], "doc_id bigint, reader string, reading_level int").write.parquet(f"{tmp_path}/reading_label.parquet")
    out = {r.doc_id: r for r in p8_levels(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and {i for i, r in out.items() if r.level is None} == {903, 904}
    assert not out[900].english and out[900].score < out[901].score and out[902].english and not out[902].numbered
    found = {r.doc_id for r in p8_found(spark, str(tmp_path)).collect()}
    assert found and not found & {900, 901, 902}
    assert sum(r.documents for r in p8_profile(spark, str(tmp_path)).collect() if r.level is None) == 2



def test_one_long_stretch_keeps_the_other_boundaries():
    from lociframe.llm.pieces import balanced_cuts

    cuts = balanced_cuts(19_000, [(1580, 1600), (5080, 5100), (8380, 8400)], 4000, 100)
    assert [at for at, natural in cuts if natural] == [1600, 5100, 8400] and sum(not natural for _, natural in cuts) == 2
