"""Registered queries take every row, not a part of the tables."""

import random

import __spark_entry__ as entry


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def write_contigs(spark, folder, rows):
    rows = [(i, f"c{i}", None, s, "f") for i, s in rows]
    spark.createDataFrame(rows, "seq_id bigint, name string, description string, seq string, file_name string").write.parquet(f"{folder}/fasta_read.parquet")


def test_index_holds_all_contigs(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, dna(rng, 20 + i, "ACGTN")) for i in (1, 2, 7, 49, 50, 51)]
    write_contigs(spark, tmp_path, [*rows, (52, rows[2][1])])
    text = "".join(s for _, s in rows) + rows[2][1] + "$"
    want = sorted(range(len(text)), key=lambda p: text[p:])
    sa = entry.queries()["idx_distributed_suffix_array"](spark, str(tmp_path)).orderBy("i").collect()
    assert [r.i for r in sa] == list(range(len(text))) and [r.pos for r in sa] == want
    bwt = [0 if text[p - 1] == "$" else ord(text[p - 1]) for p in want]
    occ = {(r.block, r.letter): (r.n, r.occ) for r in entry.queries()["idx_occurrence_table"](spark, str(tmp_path)).collect()}
    assert occ == {(b, c): (bwt[b * 128 : b * 128 + 128].count(c), bwt[: b * 128].count(c)) for b in range(-(-len(bwt) // 128)) for c in set(bwt)}


def test_mapper_takes_long_short_and_n_reads(spark):
    from lociframe.operators.mapper import map_reads

    rng = random.Random(22)
    text = dna(rng, 9000)
    edit = lambda s, places, letter=None: "".join((letter or "ACGT"["ACGT".index(c) ^ 1]) if i in places else c for i, c in enumerate(s))
    reads = {
        1: (edit(text[3900:4500], {100, 400}), 3901, 2), 2: (text[700:736], 701, 0), 3: (edit(text[5000:5040], {3, 30}), 5001, 2),
        4: (edit(edit(text[2000:2090], {5}, "N"), {40, 70}), 2001, 2), 5: (edit(edit(text[6000:6060], {4, 24}, "N"), {30, 50}), 6001, 2),
    }
    rows = spark.createDataFrame([(i, s) for i, (s, _, _) in reads.items()], "read_id bigint, seq string")
    out = {r.read_id: (r.start_pos, r.num_mismatches) for r in map_reads(rows, spark.createDataFrame([("c", text)], "name string, seq string")).collect()}
    assert out == {i: (p, d) for i, (_, p, d) in reads.items()}


def write_reads(spark, folder, rows):
    rows = [(i, f"r{i}", s, None, "x") for i, s in rows]
    spark.createDataFrame(rows, "read_id bigint, name string, seq string, qual string, run_name string").write.parquet(f"{folder}/fastq_read.parquet")


def test_searches_take_whole_reads_and_all_contigs(spark, tmp_path):
    rng = random.Random(23)
    contigs = [(i, dna(rng, 300)) for i in (1, 2, 3)]
    write_contigs(spark, tmp_path, contigs)
    a, b, c = (s for _, s in contigs)
    back = b[40:100].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = {50: a[200:260], 100: b[10:60] + "ACGTTGCA" * 2, 150: back, 200: c[10:50] + c[150:180], 250: dna(rng, 60)}
    write_reads(spark, tmp_path, [*reads.items(), (7, a[:60])])
    places = {r.read_id: r.places for r in entry.queries()["idx_exact_search"](spark, str(tmp_path)).collect()}
    assert places == {50: "200", 100: "", 150: "", 200: "", 250: ""}
    hits = {r.read_id: (r.chr, r.strand, r.start_pos, r.cigar, r.split_start) for r in entry.queries()["aln_align_to_text"](spark, str(tmp_path)).collect()}
    assert hits[50] == ("c1", "+", 201, "60M", None) and hits[150] == ("c2", "-", 41, "60M", None) and hits[250] == (None,) * 5
    from lociframe.operators.kernels import map_in_window

    for i, name, text in ((100, "c2", b), (200, "c3", c)):
        h = map_in_window(reads[i], text, 2)[0]
        assert hits[i] == (name, h.strand, h.start, h.cigar, h.split.start if h.split else None)
    text = {r.seq_id: r.consensus for r in entry.queries()["min_consensus"](spark, str(tmp_path)).collect()}
    assert text == {i: "".join("N" if p >= i % 7 and (p - i % 7) % 13 == 0 else x for p, x in enumerate(s)) for i, s in contigs}
    cut = {r.read_id: (r.cut_1, r.cut_2) for r in entry.queries()["min_adapter_trim"](spark, str(tmp_path)).collect()}
    assert cut == {i: (len(s), len(s)) for i, s in [*reads.items(), (7, a[:60])]}


def test_cigars_are_joined_as_they_are(spark, tmp_path):
    spark.createDataFrame([(1, "10M2D5M"), (2, None)], "aln_id bigint, cigar string").write.parquet(f"{tmp_path}/alignment.parquet")
    out = {r.aln_id: r.joined for r in entry.queries()["str_cigar"](spark, str(tmp_path)).collect()}
    assert out == {1: "14S10M2D67M", 2: "14S62M"}


def test_x_means_takes_all_dimensions(spark, tmp_path):
    rng = random.Random(24)
    rows = [(i, [rng.random() * 0.01, rng.random() * 0.01] + [float(20 * (i % 2)) + rng.random()] * 6) for i in range(60)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r.vec_id: r.cluster_id for r in entry.queries()["min_x_means"](spark, str(tmp_path)).collect()}
    assert all(out[i] != out[i + 1] for i in range(0, 60, 2))


def test_mapper_finds_all_within_k_of_any_length(spark):
    from lociframe.operators.kernels import edit_distance, reverse_complement
    from lociframe.operators.mapper import map_reads

    rng = random.Random(23)
    text = dna(rng, 6000)
    reads = []
    for i in range(90):
        n = rng.choice([20, 23, 31, 36, 47, 60, 100, 150, 300, 600])
        at = rng.randrange(len(text) - n)
        letters = list(text[at : at + n])
        for p in rng.sample(range(n), rng.randrange(5)):
            letters[p : p + 1] = rng.choice([["A"], ["C"], ["N"], [], ["G", letters[p]]])
        read = "".join(letters)
        reads.append((i, reverse_complement(read) if i % 2 else read))
    out = {r.read_id: r for r in map_reads(spark.createDataFrame(reads, "read_id bigint, seq string"), spark.createDataFrame([("c", text)], "name string, seq string")).collect()}
    for i, read in reads:
        if read.count("N") <= 2:
            best = min(edit_distance(text, read)[0], edit_distance(text, reverse_complement(read))[0])
            assert (out[i].chr == "c") == (best <= 2), (i, read, best)


def sent_through_driver(df):
    """The joins of a plan of which a side goes through the driver."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in x]


def write_search(spark, folder):
    rng = random.Random(24)
    contigs = [(i, dna(rng, 400)) for i in (1, 2, 3)]
    write_contigs(spark, folder, contigs)
    write_reads(spark, folder, [(50 * i, contigs[i % 3][1][30 * i : 30 * i + 33 + i]) for i in range(1, 9)])


def test_placing_sends_no_kmers_through_the_driver(spark, tmp_path):
    write_search(spark, tmp_path)
    df = entry.queries()["aln_align_to_text"](spark, str(tmp_path))
    assert not sent_through_driver(df)
    assert all(r.cigar == f"{33 + r.read_id // 50}M" for r in df.collect())


def test_split_lines_send_no_reads_through_the_driver(spark, tmp_path):
    write_search(spark, tmp_path)
    df = entry.queries()["aln_split_sam"](spark, str(tmp_path))
    assert not sent_through_driver(df)
    assert {r.read_id: r.line.split("\t")[5] for r in df.collect()} == {50 * i: f"{33 + i}M" for i in range(1, 9)}


def test_sieve_keeps_every_seed(spark):
    import numpy as np

    from lociframe.operators.mapper import SIEVE, _sieve

    rng = random.Random(25)
    kmers = [1, SIEVE - 1, SIEVE, SIEVE + 1, 32767, 32768, 32769, *(rng.randrange(1, 1 << 62) for _ in range(300))]
    packed, sizes = _sieve(spark.createDataFrame([(x, 8 + x % 2) for x in kmers], "kmer bigint, size int"))
    bits = np.unpackbits(packed, bitorder="little")
    assert sizes == [8, 9] and set(np.flatnonzero(bits).tolist()) == {x % SIEVE for x in kmers}


def test_index_sends_no_letters_through_the_driver(spark, tmp_path, monkeypatch):
    from lociframe.operators import textindex

    rng = random.Random(27)
    rows = [(i, dna(rng, 200)) for i in (1, 2, 3)]
    write_contigs(spark, tmp_path, [*rows, (4, rows[0][1])])
    plans, cut = [], textindex.cut_lineage

    def watched(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return out

    monkeypatch.setattr(textindex, "cut_lineage", watched)
    monkeypatch.setattr(textindex, "is_small", lambda df: False, raising=False)
    entry.queries()["idx_occurrence_table"](spark, str(tmp_path))
    joins = [x for p in plans for x in p.splitlines() if "BroadcastHashJoin" in x]
    assert len(plans) > 5 and all("[__part#" in x for x in joins)  # a row a partition


def test_local_hits_are_the_best_of_all_windows(spark, tmp_path):
    from lociframe.operators.kernels import local_align
    from lociframe.operators.mapper import candidate_windows

    write_search(spark, tmp_path)
    reads, contigs = (spark.read.parquet(f"{tmp_path}/{x}.parquet").withColumnRenamed("seq", "s") for x in ("fastq_read", "fasta_read"))
    df = entry.queries()["aln_smith_waterman"](spark, str(tmp_path))
    assert not sent_through_driver(df)
    want = {}
    for w in candidate_windows(reads, contigs, 3, 14, read_seq="s", ref_seq="s").collect():
        if a := local_align(w.window, w.q):
            row = (-a.score, a.differences, w.chr, w["from"] + a.position + 1, w.strand, a.cigar)
            want[w.read_id] = min(row, want.get(w.read_id, row))
    assert want and {r.read_id: (-r.score, r.num_mismatches, r.chr, r.start_pos, r.strand, r.cigar) for r in df.collect()} == want
