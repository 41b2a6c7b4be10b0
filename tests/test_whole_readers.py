"""Readers and streams leave nothing out."""

import random

from lociframe.sources import formats as R
from lociframe.streaming import ingest


def test_split_files_give_the_same_pairs(spark, tmp_path):
    rng = random.Random(31)
    rows = [("".join(rng.choice("ACGT") for _ in range(20 + i % 7)), "".join(rng.choice("@+IJ!") for _ in range(20 + i % 7))) for i in range(300)]
    for name, gap in (("a", "\n"), ("b", "")):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{name}{i}\n{s}\n+\n{q}\n{gap}" for i, (s, q) in enumerate(rows)))
        (tmp_path / f"{name}.fa").write_text("".join(f">{name}{i}\n{s}\n" for i, (s, _) in enumerate(rows)))
    files = [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")]
    assert [(r.name, r.ordinal) for r in R.read_fastq(spark, files[0], part_bytes=777).orderBy("ordinal").collect()] == [(f"a{i}", i) for i in range(300)]
    want = sorted((f"a{i}", s, s) for i, (s, _) in enumerate(rows))
    found = lambda paths, **x: sorted((r.name, r.reads[0].seq, r.reads[1].seq) for r in R.read_reads(spark, paths, **x).collect())
    assert found(files, part_bytes=777) == want
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert R.read_fasta(spark, str(tmp_path / "a.fa")).rdd.getNumPartitions() > 2
        assert found([str(tmp_path / "a.fa"), files[1]], part_bytes=777) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_stream_counts_every_bin_met(spark, tmp_path):
    rows = spark.sql("select 'a' as chr, s as start_pos, e as end_pos, timestamp'2025-03-01' as loaded_at from values (50, 350), (-50, 10), (100, 200) as t(s, e)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.bin_counts(ingest.interval_stream(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " ")), 100)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.bin: r.n for r in spark.sql("select bin, n from met").collect()} == {-1: 1, 0: 2, 1: 2, 2: 1, 3: 1}


def test_wig_lines_are_numbered_over_all_parts(spark, tmp_path):
    lines = [f"{i} {'x' * (i % 37)}" if i % 11 else "" for i in range(1, 900)]
    (tmp_path / "wigs").mkdir()
    (tmp_path / "wigs" / "a b.wig").write_bytes("\n".join(lines).encode() + b"\n")
    (tmp_path / "wigs" / "c.wig").write_bytes("\r\n".join(lines[:5]).encode())
    whole, parts = (sorted((r.file_name, r.line_no, r.line) for r in R.read_wig_lines(spark, str(tmp_path / "wigs"), part_bytes=n).collect()) for n in (1 << 20, 700))
    assert whole == parts and [x[2] for x in whole if "a b" in x[0]] == lines and [x[2] for x in whole if x[0].endswith("c.wig")] == lines[:5]
    assert [x[1] for x in whole if "a b" in x[0]] == list(range(1, 900))
