"""Empty tables, nulls in any column, empty and very long texts, repeated rows and columns of clashing names."""

from lociframe.llm.containers import fill_containers
from lociframe.llm.mixing import mix_sources
from lociframe.llm.pieces import split_sequences
from lociframe.llm.reading import cross_validated, reading_levels
from lociframe.llm.shared_spans import records, shared_clusters, shared_shares, shared_spans

DOCS = "doc_id bigint, text string, lang string, source string, n_tokens int, container_id string, level string"


def documents(spark):
    long = "The court held that neither party was entitled to the sum. " * 20_000
    rows = [(1, "1. The cat sat on the mat. It was not hungry.", "en", "a", 1, "x", "y"), (1, "1. The cat sat on the mat. It was not hungry.", "en", "a", 1, "x", "y"), (2, "", None, None, None, None, None), (3, None, "de", "a", None, None, None), (None, "1. A text of no id, which is a text.", None, "b", 3, None, None), (4, "1. " + long, "xx", "b", 4, None, "1")]
    return spark.createDataFrame(rows, DOCS)


def test_spans_and_shares_of_odd_rows(spark):
    seq = "ACGTTGCATT" * 30 + "G" * 20
    rows = [(1, "a", seq, "x"), (1, "a", seq, "x"), (None, "b", seq[:120], None), (3, None, seq[100:200], "y"), (4, None, None, None), (5, "", "", None), (6, "", "\u3000" + seq[:60] + "\n", None)]
    recs = records(spark.createDataFrame(rows, "read_id bigint, name string, seq string, span_start string"), "t", "read_id")
    spans = {tuple(r) for r in shared_spans(recs).collect()}
    assert ("t", 1, 0, 300) in spans and ("t", 6, 0, 60) in spans and ("t", 3, 0, 100) in spans and ("t", None, 0, 120) in spans
    assert not any(i in (4, 5) for _, i, _, _ in spans)
    assert len(shared_shares(recs, shared_spans(recs)).collect()) == len(rows) == len(shared_clusters(recs).collect())
    none = recs.limit(0)
    assert shared_clusters(none).collect() == [] and shared_shares(none, shared_spans(none)).collect() == []


def test_a_very_long_record_shares_its_ends(spark):
    import random

    rng = random.Random(41)
    long = "".join(rng.choices("ACGT", k=3_000_000))
    rows = [(1, "long", long), (2, "both", long[:70] + "N" + long[-70:])]
    got = {tuple(r)[1:] for r in shared_spans(records(spark.createDataFrame(rows, "read_id bigint, name string, seq string"), "t", "read_id")).collect()}
    assert got == {(1, 0, 70), (1, 2_999_930, 3_000_000), (2, 0, 70), (2, 71, 141)}


def test_pieces_of_odd_rows(spark):
    rows = [(1, "a", "AC" * 60, "x"), (1, "a", "AC" * 60, "x"), (2, None, "N" * 500, None), (3, "c", None, None), (None, "d", "", None), (4, "e", " A\u2003C ", None)]
    df = spark.createDataFrame(rows, "seq_id bigint, name string, seq string, piece string")
    out = split_sequences(df, 100, 10).collect()
    assert sum(r.seq_id == 1 for r in out) == 4 and {r.piece for r in out if r.seq_id is None} == {""} and {r.piece for r in out if r.seq_id == 4} == {"AC"}
    assert all(len(r.piece) <= 100 for r in out) and {r.piece_name.split(":")[0] for r in out if r.seq_id == 2} == {"2"} and not any(r.seq_id == 3 for r in out)
    assert {r.cut_kind for r in out if r.seq_id == 2} == {"natural"} and split_sequences(df.limit(0), 100, 10).collect() == []


def test_containers_mixture_and_levels_of_odd_rows(spark):
    docs = documents(spark)
    placed = fill_containers(docs, 2048).collect()
    assert sum(r.token_end - r.token_start for r in placed if r.doc_id == 4) > 200_000 and {r.doc_id for r in placed} == {1, 2, 3, 4, None}
    assert fill_containers(docs.limit(0), 2048).collect() == []
    targets = spark.createDataFrame([("a", 0.5, 2, 1), ("b", 0.5, 1, 2), (None, 0.1, 1, 3), ("c", None, None, 4)], "source string, target_share double, max_repeats int, tokens int")
    mixed, report = mix_sources(docs, targets.filter("target_share is not null"))
    assert {r.source for r in report.collect()} == {"a", "b"} and all(r.source in "ab" for r in mixed.collect())
    graded = spark.createDataFrame([(1, "r", 2), (1, "r", 2), (4, "s", 3), (None, "t", 1), (2, None, None), (99, "u", 4)], "doc_id bigint, reader string, reading_level int")
    out = reading_levels(docs, graded, all_texts=True).collect()
    assert len(out) == 6 and all((r.level is None) == (r.doc_id in (2, 3)) for r in out)
    assert reading_levels(docs.limit(0), graded).collect() == [] and cross_validated(docs.limit(0), graded).collect() == []
    assert all(r.level is None for r in reading_levels(docs, graded.limit(0), all_texts=True).collect())
