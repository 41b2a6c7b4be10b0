"""Problems 1 to 3 on small made-up tables, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lociframe.operators.dyadic import covered_lengths, interval_gaps, merge_intervals, merge_tree_nodes
from lociframe.operators.rejects import judge_wig_lines
from lociframe.operators.tree import partition_count, tree_aggregate, tree_rounds

SIZES = "chr string, n_bases int, chr_kind string"


def judged(spark, lines):
    df = spark.createDataFrame([(i, *x, "clash") for i, x in enumerate(lines)], "line_id bigint, file_name string, line_no int, line string, kind string")
    sizes = spark.createDataFrame([("lg1", 1000, "a"), ("s2", 50, "b"), (None, 7, "c")], SIZES)
    bad, good = judge_wig_lines(df, sizes)
    bad, good = {r.line_id: r.reasons for r in bad.collect()}, {r.line_id: r for r in good.collect()}
    assert not set(bad) & set(good) and set(bad) | set(good) == set(range(len(lines)))
    return bad, good


def test_wig_headers(spark):
    cases = [
        ("variableStep chrom=lg1 span=5", True), ("variableStep  \t chrom='lg1'", True), ('variableStep chrom="lg1"', True), ("variableStep", False), ("variableStep ", False), ("variableStepchrom=lg1", False),
        ("variableStep chrom=lg9", False), ("variableStep chrom=lg1 span=0", False), ("variableStep chrom=lg1 span=2147483648", False), ("variableStep chrom=lg1 span=007", True), ("variableStep chrom=lg1 span=1.0", False),
        ("variableStep span=3", False), ("variableStep chrom=lg1 name='a b' x=\"it's\"", True), ("variableStep chrom=lg1 name='a b", False), ("variableStep chrom=lg1 name=a\"b", False), ("variableStep chrom = lg1", False),
        ("fixedStep chrom=lg1 start=1000", True), ("fixedStep chrom=lg1 start=1001", False), ("fixedStep chrom=lg1", False), ("fixedStep chrom=s2 start=50 step=3 span=2", True), ("fixedStep chrom=s2 start=-1", False),
        ("track", True), ("track type=wiggle_0 name=\"a 'b' c\"", True), ("track type", False), ("track x=''", True), ("trackx", False), ("browser anything 'at all", True), ("# x \"", True), ("#", True), (None, False),
    ]
    bad, good = judged(spark, [("f", i, x) for i, (x, _) in enumerate(cases)])
    assert {i for i, (_, ok) in enumerate(cases) if not ok} == set(bad)
    assert good[0].chrom == "lg1" and good[0].span == 5


def test_wig_data(spark):
    block, fixed, broken = "variableStep chrom=lg1", "fixedStep chrom=s2 start=1", "variableStep chrom=none"
    lines = [("f", 1, "1 2"), ("f", 2, block)]
    expected = [False, True]
    for text, ok in [
        ("5 1.5", True), (" \t7\t-2e3 ", True), ("5", False), ("5 1 2", False), ("", False), ("  ", False), ("1000 1", True), ("1001 1", False), ("0 1", False), ("+5 1", False), ("5 .5", True), ("5 5.", True), ("5 .", False),
        ("5 1e", False), ("5 1e39", False), ("5 3.4e38", True), ("5 NaN", False), ("5 Inf", False), ("5 1f", False), ("5 1,5", False), ("99999999999999999999 1", False), ("0000000000000007 1", True), ("٥ 1", False), ("5 1", False), ("5 1e-999", True),
    ]:
        lines.append(("f", len(lines) + 1, text))
        expected.append(ok)
    lines += [("f", 100, fixed), ("f", 101, "3.5"), ("f", 102, "1 3.5"), ("f", 2000, "2"), ("f", 5000, broken), ("f", 5001, "2000 1"), ("f", 5002, "x 1"), ("g", 3, "4"), (None, 1, fixed), (None, 2, "1"), ("f", None, "1"), ("h", 2, fixed), ("h", 2, fixed), ("h", 2, "1"), ("h", 700, "1"), ("h", 700, "1")]
    expected += [True, True, False, True, False, True, False, False, True, True, False, True, True, False, True, True]
    bad, good = judged(spark, lines)
    assert {i for i, ok in enumerate(expected) if not ok} == set(bad)
    assert good[2].position == 5 and good[2].value == 1.5 and good[2].chrom == "lg1"


def test_wig_empty_and_very_long(spark):
    assert judged(spark, []) == ({}, {})
    long = "track " + " ".join(f"k{i}='v {i}'" for i in range(30_000))
    bad, _ = judged(spark, [("f", 1, long), ("f", 2, long + " x"), ("f", 3, "variableStep chrom=lg1"), ("f", 4, "5 " + "1" * 100_000)])
    assert set(bad) == {1, 3}


def brute(rows):
    by = defaultdict(list)
    for k, s, e in rows:
        if s is not None and e is not None and s < e:
            by[k].append((s, e))
    merged = {}
    for k, v in by.items():
        out = []
        for s, e in sorted(v):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        merged[k] = out
    return merged


def test_interval_union_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(1500):
        k = rng.choice(["a", "a", "a", "b", None, "c"])
        s = rng.randrange(-100_000, 100_000) if k != "c" else rng.randrange(1, 2**31 - 60_000)
        rows.append((k, s, s + rng.choice([0, -3, 1, 2, 5, 100, 1000, 16384, 50_000 if k == "b" else 3])))
    rows += [("z", 5, 9), ("z", 9, 12), ("z", 9, 12), ("z", 20, 30), ("y", None, 4), ("y", 4, None), ("w", -(2**31), 2**31 - 1), ("v", 16384, 32768), ("v", 0, 16384), ("v", 40000, 40001)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chr string, start_pos int, end_pos int, covered int")
    want = brute(rows)
    stretches = [tuple(r) for r in merge_intervals(df, "chr", "start_pos", "end_pos").collect()]
    assert Counter(stretches) == Counter((k, s, e) for k, v in want.items() for s, e in v)
    gaps = [tuple(r) for r in interval_gaps(df, "chr", "start_pos", "end_pos").collect()]
    assert Counter(gaps) == Counter((k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:]))
    covered = tree_aggregate(covered_lengths(df, "chr", "start_pos", "end_pos"), ["chr"], {"covered": ("sum", F.col("covered"))}, fan_in=2, chunks=4)
    assert {r.chr: r.covered for r in covered.collect()} == {k: sum(e - s for s, e in v) for k, v in want.items()}


def test_interval_union_of_nothing(spark):
    df = spark.createDataFrame([], "chr string, start_pos int, end_pos int")
    assert interval_gaps(df, "chr", "start_pos", "end_pos").collect() == [] and merge_intervals(df, "chr", "start_pos", "end_pos").collect() == []


def test_tree_nodes_of_random_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        depth = int(rng.integers(1, 6))
        group = np.sort(rng.integers(0, 3, size=rng.integers(0, 12)))
        node = rng.integers(1, 1 << (depth + 1), size=len(group))
        owner, start, end = merge_tree_nodes(group, node, depth)
        got = {(g, p) for g, s, e in zip(owner, start, end) for p in range(s, e)}
        want = set()
        for g, n in zip(group, node):
            level = depth - int(n).bit_length() + 1
            first = (int(n) - (1 << (depth - level))) << level
            want |= {(g, p) for p in range(first, first + (1 << level))}
        assert got == want
        assert all(not (a == b and e == s) for a, e, b, s in zip(owner, end, owner[1:], start[1:]))


def test_tree_aggregation_equals_group_by(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice([None, 1, 5, -3]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, n string").repartition(13)
    out = tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1)), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}, fan_in=2)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert tree_aggregate(df.limit(0), ["k"], {"n": ("sum", F.lit(1))}).collect() == []


def test_tree_has_as_many_rounds_as_its_partitions_need(spark):
    df = spark.range(0, 20_000, numPartitions=80).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = tree_aggregate(df, ["k"], {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v"))})
    assert tree_rounds(80, 8) == 3 and tree_rounds(2, 8) == 2 and tree_rounds(65, 8) == 3
    assert out._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 6  # partial and final, each round
    assert {r.k: (r.n, r.s) for r in out.collect()} == {k: (len(range(k, 20_000, 3)), sum(range(k, 20_000, 3))) for k in range(3)}
    assert partition_count(df.groupBy("k").count()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_intervals_beyond_32_bits(spark):
    rows = [("a", 3_000_000_000, 3_000_000_010), ("a", 3_000_000_005, 3_000_070_000), ("a", -5_000_000_000, -4_999_999_990), ("a", 7, 7), ("b", -3, 2**30), ("b", 2**30, 2**33), ("b", 2**33 + 1, 2**33 + 2)]
    df = spark.createDataFrame(rows, "chr string, start_pos bigint, end_pos bigint")
    gaps = {tuple(r) for r in interval_gaps(df, "chr", "start_pos", "end_pos").collect()}
    assert gaps == {("a", -4_999_999_990, 3_000_000_000), ("b", 2**33, 2**33 + 1)}
    merged = {tuple(r) for r in merge_intervals(df, "chr", "start_pos", "end_pos").collect()}
    assert merged == {("a", -5_000_000_000, -4_999_999_990), ("a", 3_000_000_000, 3_000_070_000), ("b", -3, 2**33), ("b", 2**33 + 1, 2**33 + 2)}
    far = spark.createDataFrame([("a", 2**39 - 5, 2**39 + 5)], "chr string, start_pos bigint, end_pos bigint")
    with pytest.raises(Exception, match="interval beyond"):
        interval_gaps(far, "chr", "start_pos", "end_pos").collect()


def test_windows_of_the_union_hold_no_arrays(spark):
    df = spark.createDataFrame([("a", 1, 5)], "chr string, start_pos int, end_pos int")
    for made in (interval_gaps(df, "chr", "start_pos", "end_pos"), merge_intervals(df, "chr", "start_pos", "end_pos")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and "array" not in plan.lower().split("logicalrdd")[0]


def test_many_blocks_are_joined_by_a_shuffle_with_the_same_result(spark, monkeypatch):
    from lociframe.operators import rejects

    rng = random.Random(51)
    lines = []
    for f in ("a", "b", None):
        for n in range(1, 3000):
            x = rng.random()
            line = "variableStep chrom=lg1" if x < 0.01 else "fixedStep chrom=s2 start=5 step=x" if x < 0.02 else "fixedStep chrom=s2 start=5" if x < 0.03 else rng.choice(["10 1.5", "3", "1e99", "7 8 9", "10 x", "# c"])
            if not (f == "b" and 600 < n < 2400 and "Step" in line):  # chunks without a step line
                lines.append((f, n, line))
    lines += [("a", 700, "10 1.5")] * 500
    rng.shuffle(lines)
    few = judged(spark, lines)
    monkeypatch.setattr(rejects, "is_small", lambda *_, **__: False)
    monkeypatch.setattr(rejects, "RANGE", 2)
    assert judged(spark, lines) == few and few[0]
