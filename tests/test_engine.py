"""Joins, sweeps, functions, readers, writers and mining."""

import gzip
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from lociframe.functions import bits as B
from lociframe.functions import cigar as C
from lociframe.functions import seq as S
from lociframe.operators import mining as M
from lociframe.operators import overlap as O
from lociframe.sources import formats as R
from lociframe.streaming import ingest


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first().x


def test_sequence_functions(spark):
    s = F.col("s")
    assert one(spark, S.normalized(s), " acg\nuXn") == "ACGTNN"
    assert one(spark, S.reverse_complement(s), "AACGN") == "NCGTT"
    assert one(spark, S.positions_of(s, "CCGGG"), "TTGTCCGGGCCGGGATCCGGGT") == [4, 9, 16]
    assert one(spark, S.positions_of(s, "AA"), "AAAA") == [0, 1, 2] and one(spark, S.positions_of(s, ""), "AA") == [] and one(spark, S.positions_of(s, "AAA"), "A") == []
    assert one(spark, S.color_encode(s), "ACGT") == "3131" and one(spark, S.color_decode(s), "3131") == "ACGT" and one(spark, S.color_decode(s), "3.1") == "ANN"
    assert one(spark, S.fasta_name(s), "> chrX human") == "chrX" and one(spark, S.fasta_name(s), ">seqname|x") == "seqname" and one(spark, S.fasta_name(s), ">chr10") == "chr10"
    assert one(spark, S.iupac_code(s), "GA") == "R" and one(spark, S.iupac_complement(s), "ACGTRYMKWSBVDHN") == "TGCAYRKMWSVBHDN"
    assert one(spark, S.from_codes(S.base_codes(s)), "ACGTX") == "ACGTN"
    for f in (S.normalized, S.reverse_complement, S.base_counts, S.base_codes, S.color_encode, S.iupac_reverse):
        one(spark, f(s), "")
    assert one(spark, S.normalized(s), None) is None and one(spark, S.positions_of(s, "A"), None) is None
    with pytest.raises(Exception, match="slice with start > end"):
        one(spark, S.slice_of(s, 3, 2), "ACGT")


def test_sequence_functions_equal_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 24, 150, 3000]))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    for r in df.select("s", S.reverse_complement(s).alias("rc"), S.base_counts(s, "ACGTN").alias("n"), S.positions_of(s, "TAT").alias("p")).collect():
        assert r.rc == r.s.translate(str.maketrans("ACGT", "TGCA"))[::-1] and r.n == [r.s.count(b) for b in "ACGTN"]
        assert r.p == [i for i in range(len(r.s)) if r.s.startswith("TAT", i)]


def test_cigar_and_bits(spark):
    s = F.col("s")
    assert one(spark, C.append_cigar(F.lit("12S"), F.lit("2S62M"))) == "14S62M"
    assert one(spark, C.unclipped_size(s), "5S10M2I3D1X4S") == 23 and one(spark, C.render_cigar(C.parse_cigar(s)), "") == ""
    assert one(spark, B.parse_bits(s), "0110001") == 70
    word = F.lit(70).cast("bigint")
    assert one(spark, B.rank_one(word, F.lit(2))) == 1 and one(spark, B.select_one(word, F.lit(2))) == 6 and one(spark, B.select_one(word, F.lit(9))) is None
    assert one(spark, B.set_bit(word, F.lit(0))) == 71 and one(spark, B.clear_bit(word, F.lit(1))) == 68 and one(spark, B.one_bits(word, 1, 3)) == 2


INTERVALS = "id bigint, chr string, start_pos int, end_pos int, strand string"


def intervals(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(-500, 40_000)
        rows.append((i, rng.choice(["a", "a", "b", None]), s, s + rng.choice([0, 1, 5, 50, 400, 20_000]), rng.choice("+-")))
    return rows + [(n, "a", None, 5, "+"), (n + 1, "a", 9, 2, "-"), (n + 2, "a", 0, 2**31 - 1, "+"), (n, "a", 100, 200, "+")]


@pytest.mark.parametrize("mode", ["strict", "touching", "asymmetric"])
def test_overlap_join_equals_all_pairs(spark, mode):
    q, d = intervals(1, 60), intervals(2, 150)
    rule = {"strict": lambda s, e, a, b: s < b and a < e, "touching": lambda s, e, a, b: s <= b and a <= e, "asymmetric": lambda s, e, a, b: s < b and a <= e}[mode]
    ok = lambda r: r[1] is not None and r[2] is not None and r[2] <= r[3]
    want = sorted((x[0], y[0]) for x in q if ok(x) for y in d if ok(y) and x[1] == y[1] and rule(x[2], x[3], y[2], y[3]))
    got = O.overlap_join(spark.createDataFrame(q, INTERVALS), spark.createDataFrame(d, INTERVALS), mode=mode).select("q.id", F.col("d.id").alias("other")).collect()
    assert sorted((r.id, r.other) for r in got) == want


def test_overlap_of_given_intervals(spark):
    d = spark.createDataFrame([(1, "a", 1, 2, "+"), (2, "a", 2, 4, "+"), (3, "a", 3, 5, "+"), (4, "a", 6, 9, "+"), (5, "a", 8, 10, "+")], INTERVALS)
    q = spark.createDataFrame([(0, "a", 2, 7, "+")], INTERVALS)
    assert sorted(r.id for r in O.overlap_join(q, d).select("d.id").collect()) == [2, 3, 4]
    assert O.overlap_join(q.limit(0), d).collect() == [] and [r.id for r in O.any_overlap(q, d, "id").collect()] == [0]


def test_long_and_short_intervals_meet_once(spark):
    rng = random.Random(21)
    sizes = [1, 40, 3000, 20_000, 400_000, 9_000_000, 700_000_000]
    make = lambda n: [(i, rng.choice("ab"), s, s + rng.choice(sizes)) for i in range(n) for s in [rng.randrange(-2_000_000, 30_000_000)]]
    a, b = make(120), make(150)
    kind = "id int, chr string, start_pos int, end_pos int"
    q, d = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    for mode, meet in (("strict", lambda x, y: x[2] < y[3] and y[2] < x[3]), ("touching", lambda x, y: x[2] <= y[3] and y[2] <= x[3])):
        want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and meet(x, y))
        assert sorted((r.q.id, r.d.id) for r in O.overlap_join(q, d, mode=mode).collect()) == want
        assert sorted(r.id for r in O.any_overlap(q, d, "id", mode=mode).collect()) == sorted({x for x, _ in want})
    assert "semi" in O.any_overlap(q, d, "id")._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("stranded", [True, False])
def test_nearest_neighbour_equals_brute_force(spark, stranded):
    rng = random.Random(24)
    rows = [(i, rng.choice("ab"), rng.choice("+-"), s, s + rng.choice([0, 1, 5, 60, 2000])) for i in range(400) for s in [rng.choice([rng.randrange(-200, 200), rng.randrange(-9000, 9000)])]]
    rows += [(900 + i, "a", "+", 77, 90) for i in range(20)] + [(950, None, "+", 1, 2), (951, "a", None, 1, 2), (952, "a", "+", 9, None)]
    reach, want = 100, {}
    for q in rows:
        if None in q[1:4] and not (q[2] is None and q[1] and not stranded):
            continue
        best = []
        for d in rows:
            if d[1] != q[1] or d[4] is None or d[3] > d[4] or d[3] == q[3] or stranded and d[2] != q[2]:
                continue
            low, high = q[3] - reach, q[3] + reach
            if d[3] < high and low < d[4] and (d[3] < d[4] or low < d[3] < high):
                best.append((abs(d[3] - q[3]), d[0]))
        if best:
            want[q[0]] = min(best)
    df = spark.createDataFrame(rows, "id int, chr string, strand string, start_pos int, end_pos int")
    got = {r.q_id: (r.distance, r.d_id) for r in O.nearest_neighbour(df, df, reach, "id", "id", stranded=stranded).collect()}
    assert got == want


def test_dense_runs_of_crowded_tiles(spark):
    rng = random.Random(22)
    rows = [(i, "a", s, s + rng.choice([1, 5, 90, 3000, 40_000]), float(rng.randrange(5))) for i in range(900) for s in [rng.randrange(-20_000, 20_000)]] + [(2000 + i, "b", 7, 9, 1.0) for i in range(50)]
    painted = {}
    for _, c, s, e, v in rows:
        for x in range(s, e):
            painted[c, x] = v
    runs = O.dense_runs(spark.createDataFrame(rows, "id int, chr string, start_pos int, end_pos int, score double"), "id").collect()
    assert {(r.chr, x): r.score for r in runs for x in range(r.start_pos, r.end_pos)} == painted
    assert sum(r.end_pos - r.start_pos for r in runs) == len(painted)


def test_sweep(spark):
    rows = [(i, "a", s, e, "+") for i, (s, e) in enumerate([(1, 5), (2, 7), (6, 8), (10, 12), (10, 12), (13, 15), (14, 16)])]
    df = spark.createDataFrame(rows, INTERVALS)
    assert sorted(tuple(r.active) for r in O.sweep_active(df, df, "id").collect()) == [(0, 1), (1, 2), (3, 4), (5, 6)]


def test_nearest_bins_scores(spark):
    rows = [(1, "a", 100, 110, "+"), (2, "a", 104, 106, "+"), (3, "a", 96, 99, "+"), (4, "a", 100, 101, "+"), (5, "a", 101, 102, "-"), (6, "b", 101, 102, "+")]
    df = spark.createDataFrame(rows, INTERVALS)
    out = {r.q_id: (r.d_id, r.distance) for r in O.nearest_neighbour(df.filter("id = 1"), df, 50, "id", "id").collect()}
    assert out == {1: (2, 4)}
    members = O.bin_members(df, 1000, "id", chunk=2).collect()
    assert sorted(i for r in members for i in r.members) == [1, 2, 3, 4, 5, 6]
    scores = O.dense_scores(df.withColumn("score", F.col("id").cast("float")), "id")
    runs = O.dense_runs(df.withColumn("score", F.col("id").cast("float")), "id")
    assert {(r.chr, r.pos): r.score for r in scores.collect()}[("a", 104)] == 2.0
    at = O.score_at(spark.createDataFrame([("a", 104), ("a", 5)], "chr string, pos int"), runs).collect()
    assert {(r.pos): r.score for r in at} == {104: 2.0, 5: 0.0}


def test_last_writer_wins_everywhere(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        s = rng.randrange(-300, 40_000)
        rows.append((i if i != 7 else None, rng.choice(["a", "b", None]), s, s + rng.choice([-2, 0, 1, 30, 900, 20_000]), None if i % 50 == 3 else float(i)))
    want = {}
    for i, c, s, e, v in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        if c is not None:
            want |= {(c, p): v for p in range(s, e)}
    got = O.dense_scores(spark.createDataFrame(rows, "o int, chr string, start_pos int, end_pos int, score float"), "o").collect()
    assert len(got) == len(want) and {(r.chr, r.pos): r.score for r in got} == want


def test_offsets_and_natural_order(spark):
    sizes = spark.createDataFrame([(f"c{i:02}", i % 4) for i in range(30)], "chr string, n_bases int")
    rows = {r.chr: r.offset for r in O.concat_offsets(sizes, "chr", "n_bases").collect()}
    total = 0
    for i in range(30):
        assert rows[f"c{i:02}"] == total
        total += i % 4
    names = ["chr2", "chr10", "chr1", "chrX", "chr1_b", "10", "9"]
    ranked = O.natural_order(spark.createDataFrame([(n,) for n in names], "n string"), "n").orderBy("rank_key").collect()
    assert [r.n for r in ranked] == ["9", "10", "chr1", "chr1_b", "chr2", "chr10", "chrX"]


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("# about\n>one first | x\nACGT\n AC \n#note\n\n>two\nGG\n> three\n")
    rows = {r.name: (r.description, r.seq) for r in R.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"one": ("one first | x", "ACGTAC"), "two": ("two", "GG"), "three": ("three", "")}
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nAC\nGT\n")
    assert [r.seq for r in R.read_fasta(spark, str(tmp_path / "b.fa.gz")).collect()] == ["ACGT"]
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        for name, text in (("x.fa", b">p q\nAC\nAC\n>r\nTT\n"), ("skip.txt", b">no\nA\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    assert {r.name: r.seq for r in R.read_fasta_tar(spark, str(tmp_path / "c.tar.gz")).collect()} == {"p": "ACAC", "r": "TT"}
    out = R.fasta_text(spark.createDataFrame([("chr10", "A" * 120), ("chr2", "")], "name string, seq string"))
    R.write_lines(out.coalesce(1), str(tmp_path / "out"))
    back = {r.name: r.seq for r in R.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {"chr10": "A" * 120, "chr2": ""} and [r.value[:5] for r in out.collect()] == [">chr2", ">chr1"]


def test_fastq_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(20 + i % 7)), "".join(rng.choice("@+IJ!") for _ in range(20 + i % 7))) for i in range(500)]
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
    whole = R.read_fastq(spark, str(path)).orderBy("ordinal").collect()
    assert [(r.name, r.seq, r.qual) for r in whole] == rows and [r.ordinal for r in whole] == list(range(500))
    parts = spark.read.format("lociframe_fastq").option("paths", str(path)).option("part_bytes", 777).load()
    assert parts.rdd.getNumPartitions() > 20 and sorted((r.name, r.seq, r.qual) for r in parts.collect()) == sorted(rows)
    text = R.fastq_text(spark.createDataFrame(rows, "name string, seq string, qual string"))
    R.write_lines(text.coalesce(1), str(tmp_path / "b.fq"))
    (tmp_path / "c.fq").write_text("@a\nAC\n+\nII\n@b\nGG\n+\nII\n")
    pairs = R.read_reads(spark, [str(path), str(tmp_path / "c.fq")]).collect()
    assert [(r.name, r.reads[1].seq) for r in sorted(pairs, key=lambda r: r.name)] == [("r0 x", "AC"), ("r1 x", "GG")]
    assert R.read_reads(spark, [str(path)]).count() == 500
    with pytest.raises(ValueError, match="unknown read format"):
        R.read_reads(spark, ["x.txt"])
    (tmp_path / "bad.fq").write_text("@\nAC\n+\nII\n")
    with pytest.raises(Exception, match="FASTQ syntax error"):
        R.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "none.fq").write_text("")
    assert R.read_fastq(spark, str(tmp_path / "none.fq")).collect() == []


def test_bed_wig_variants_sam(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track name=x\nchr1\t0\t10\t+\nchr2 5 9 .\n\n")
    assert [tuple(r) for r in R.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 1, 11, "+"), ("chr2", 6, 10, "-")]
    (tmp_path / "g.bed").write_text("chr1\t10\t100\tg1\t5\t-\t20\t90\t0\t2\t10,20,\t0,70,\nchr1\t1\t3\n")
    full, short = R.read_bed12(spark, str(tmp_path / "g.bed")).collect()
    assert full.block_sizes == [10, 20] and full.thick_start == 21 and short.thick_end == 4 and short.block_starts == [] and short.strand == "+"
    assert R.bed12_text(R.read_bed12(spark, str(tmp_path / "g.bed"))).first().value == "chr1\t10\t100\tg1\t5\t-\t20\t90\t0\t2\t10,20,\t0,70,"
    (tmp_path / "w.wig").write_text("track\nvariableStep chrom=lg1\n5 1\n")
    assert [(r.line_no, r.line) for r in R.read_wig_lines(spark, str(tmp_path / "w.wig")).collect()] == [(1, "track"), (2, "variableStep chrom=lg1"), (3, "5 1")]
    (tmp_path / "v.freq").write_text("1\tchr1\t3\t3\tA\trs1\tG\t8\t(A,5)\t(G,3)\nshort\tline\n2\tchr1\t9\t9\tAC\trs2\tG\n")
    v = R.read_variants(spark, str(tmp_path / "v.freq")).collect()
    assert v[0]["count"] == 8 and [tuple(x) for x in v[0].freq] == [("A", 5), ("G", 3)] and v[1].freq == [] and len(v) == 2
    kinds = "read_name string, chr string, strand string, start_pos int, end_pos int, num_mismatches int, cigar string, query_seq string, qual string, score int, num_best_hits int, alignment_state string, split struct<chr:string,strand:string,start_pos:int,end_pos:int,cigar:string,num_mismatches:int>"
    aln = spark.createDataFrame([("r1", "c", "-", 5, 9, 0, "4M", "ACGT", None, 1, 1, "U", None), ("r2", "*", "+", 0, 0, None, None, "AC", "II", 0, 0, "N", None), ("r3", "c", "+", 1, 8, 0, "7M", "A", "I", 1, 1, "U", ("c", "+", 11, 17, "6M", 0))], kinds)
    lines = [r.value for r in R.sam_text(aln, spark.createDataFrame([("c", 100)], "chr string, n_bases int")).orderBy("part", "value").collect()]
    assert lines == ["@SQ\tSN:c\tLN:100", "r1\t82\tc\t5\t1\t4M\t*\t0\t0\tACGT\t*\tNM:i:0\tXP:Z:U\tX0:i:1", "r2\t68\t*\t0\t0\t*\t*\t0\t0\tAC\tII", "r3\t67\tc\t1\t1\t7M\t=\t11\t16\tA\tI\tNM:i:0\tXP:Z:U\tX0:i:1"]
    R.write_store(aln.select("chr", "start_pos"), str(tmp_path / "store"))
    assert R.read_store(spark, str(tmp_path / "store")).count() == 3
    assert R.single_query(spark, "ACGT").first().seq == "ACGT"


def test_consensus(spark):
    ref = spark.createDataFrame([("a", "AAAAAA", 1), ("b", "CCC", 1), ("e", "", 1), ("n", None, 1)], "chr string, seq string, pos int")
    var = spark.createDataFrame([("a", 1, "G"), ("a", 6, "T"), ("a", 6, "C"), ("a", 7, "T"), ("a", 2, "GG"), ("zz", 1, "A"), ("a", None, "A"), ("a", 3, None)], "chr string, pos int, alt string")
    assert {r.chr: r.consensus for r in M.consensus(ref, var).collect()} == {"a": "GAAAAT", "b": "CCC", "e": "", "n": None}


def test_k_means_and_x_means(spark):
    rng = random.Random(5)
    middles = [(0, 0), (30, 0), (0, 30)]
    rows = [(i, [rng.gauss(m[0], 1), rng.gauss(m[1], 1)]) for i, m in enumerate(middles * 60)] + [(999, None)]
    points = spark.createDataFrame(rows, "id bigint, p array<double>")
    start = M.initial_centroids(points.filter("p is not null"), "p", "id", 3)
    assert len({tuple(c) for c in start}) == 3
    out, centroids = M.k_means(points, "p", [[1.0, 1.0], [20.0, 0.0], [0.0, 20.0]])
    groups = {}
    for r in out.collect():
        groups.setdefault(r.id % 3, set()).add(r.cluster_id)
    assert all(len(g) == 1 for g in groups.values()) and len(centroids) == 3
    _, found = M.x_means(points, "p", 8)
    assert 3 <= len(found) <= 8
    assert all(min((a - x) ** 2 + (b - y) ** 2 for x, y in found) < 4 for a, b in middles)
    assert M.k_means(points.limit(0), "p", [[0.0, 0.0]])[0].collect() == [] and M.x_means(points.limit(0), "p", 3)[0].collect() == []
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "id bigint, p array<double>")
    assert M.initial_centroids(same, "p", "id", 3) == [[1.0, 1.0]]


def test_random_numbers_follow_the_generator():
    r = M.JavaRandom(0)
    assert [r.below(10) for _ in range(5)] == [0, 8, 9, 7, 5]


def test_stream_of_intervals(spark, tmp_path):
    rows = spark.sql("select 'a' as chr, cast(id * 10 as int) as start_pos, cast(id * 10 + 5 as int) as end_pos, timestamp'2025-03-01' as loaded_at from range(30) union all select null, 1, 2, timestamp'2025-03-01'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.bin_counts(ingest.interval_stream(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " ")), 100)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select * from bins").collect()) == [10, 10, 10]
