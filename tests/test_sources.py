import gzip
import importlib.util

import pytest
from pyspark.sql import functions as F

from spanloom.sources import readers as R
from spanloom.streaming import sliding


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "g.fa", "junk\n>a first\nacg\n\nTT\n>b\nGG\n>a again\nCC\n")
    assert rows(R.read_fasta(spark, p), "chrom", "seq") == [("a", "ACGTTCC"), ("b", "GG")]
    assert rows(R.sizes_of(R.read_fasta(spark, p)), "chrom", "size") == [("a", 7), ("b", 2)]


def test_sizes(spark, tmp_path):
    assert rows(R.read_sizes(spark, put(tmp_path, "s", "#x\na\t10\n\nb  20\n")), "chrom", "size") == [("a", 10), ("b", 20)]


def test_bed_and_bedgraph(spark, tmp_path):
    p = put(tmp_path, "x.bed", "track t\n#c\na\t1\t5\na\t2\t9\tn\t7\t-\textra\n")
    assert rows(R.read_bed(spark, p), "start", "end", "name", "strand") == [(1, 5, None, "."), (2, 9, "n", "-")]
    p = put(tmp_path, "x.bg", "a\t1\t5\t0.5\na\t5\t6\tnone\n")
    assert rows(R.read_bedgraph(spark, p), "start", "value") == [(1, 0.5), (5, None)]


def test_gff_and_gtf(spark, tmp_path):
    text = "##gff\na\ts\tgene\t1\t9\t.\t+\t.\tID=g%201;Name=x+y;flag\nshort\tline\na\ts\texon\t3\t4\t.\t?\t.\tgene_id \"g2\"; gene_name \"n 2\";\n"
    got = {r["feature"]: r for r in R.read_gff(spark, put(tmp_path, "x.gff", text)).collect()}
    assert (got["gene"]["start"], got["gene"]["end"], got["gene"]["id"], got["gene"]["name"]) == (0, 9, "g 1", "x+y")
    assert got["gene"]["attrs"]["flag"] == "" and got["exon"]["strand"] == "." and got["exon"]["id"] == "g2" and got["exon"]["name"] == "n 2"


@pytest.mark.parametrize("zipped", [False, True])
def test_vcf(spark, tmp_path, zipped):
    text = "##v\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\na\t101\t.\tN\t<CNV>\t.\t.\tEND=200;SVTYPE=CNV\tGT:CN\t0/0:2\t0/1:4\na\t11\t.\tN\t<DEL>\t.\t.\tSVLEN=-30;CN=1\t.\n"
    p = tmp_path / ("x.vcf.gz" if zipped else "x.vcf")
    p.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    got = rows(R.read_vcf_copy_numbers(spark, str(p)), "start", "end", "sample_id", "copy_number")
    assert got == sorted([(100, 200, "s1", 2.0), (100, 200, "s2", 4.0), (10, 40, "reference", 1.0)], key=str)


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5, 0.5), ("a", 5, 6, float("nan")), ("b", 7, 9, 1234567.0), ("b", 9, 10, 10.0)], "chrom string, start long, end long, value double")
    R.write_bedgraph(df, str(tmp_path / "o.bg"), "value")
    assert rows(spark.read.text(str(tmp_path / "o.bg")), "value") == [("a\t1\t5\t0.5",), ("b\t7\t9\t1.23457e+06",), ("b\t9\t10\t10",)]
    R.write_bed(df, str(tmp_path / "o.bed"), ["chrom", "start", "end"])
    assert R.read_bed(spark, str(tmp_path / "o.bed")).count() == 4
    fa = spark.createDataFrame([("a", "ACGT" * 41), ("b", "G")], "chrom string, seq string")
    R.write_fasta(fa, str(tmp_path / "o.fa"))
    assert rows(R.read_fasta(spark, str(tmp_path / "o.fa")), "chrom", "seq") == rows(fa, "chrom", "seq")
    for fmt in ("parquet", "csv", "tsv"):
        R.write_table(df, str(tmp_path / f"t.{fmt}"), fmt)
        assert R.read_table(spark, str(tmp_path / f"t.{fmt}")).count() == 4


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(d)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/event*.parquet")
    cols = ["window_start", "event_type", "n", F.round("total", 4)]
    got = sliding.run_to_end(sliding.sliding_counts(stream), "slid")
    assert rows(got, *cols) == rows(sliding.sliding_counts(batch), *cols)


def test_repeats_signals_sequences_and_sinks(spark, tmp_path):
    import json

    from spanloom.operators import intervals as iv
    from spanloom.sources import readers as R

    gff = tmp_path / "r.gff3"
    gff.write_text("##gff\nc1\tx\tLTR\t11\t20\t.\t+\t.\tName=Gyp;Class=LTR;perc_div=3.5\nc1\tx\tCDS\t1\t9\t.\t?\t0\tID=a;gene_id=g;transcript_id=t;gbkey=CDS\nc2\tx\tfive_prime_UTR\t5\t9\t.\t-\t.\tParent=p\nc2\tx\tGene\t1\t90\t.\t-\t.\tgene_biotype=lnc\n")
    rows = R.read_gff(spark, str(gff)).collect()
    by = {r["feature"]: r for r in rows}
    assert (by["LTR"]["id"], by["LTR"]["family"], by["LTR"]["class"], by["LTR"]["divergence"], by["LTR"]["parent"]) == ("Gyp", "Gyp", "LTR", "3.5", None)
    assert (by["CDS"]["id"], by["CDS"]["parent"], by["CDS"]["biotype"], by["Gene"]["biotype"]) == ("a", "t", "CDS", "lnc")
    found = R.read_gff(spark, str(gff))
    assert [iv.of_type(found, k).count() for k in ("gene", "exon", "utr")] == [1, 1, 1]
    assert R.read_repeats(spark, str(gff)).columns == ["chrom", "start", "end", "family", "class", "superfamily", "strand", "divergence"]
    bed = tmp_path / "r.bed"
    bed.write_text("c1\t5\t9\tAlu\t0\t-\tSINE\tsup\t1.5\nc1\t7\t8\n")
    got = sorted(tuple(r) for r in R.read_repeats(spark, str(bed)).collect())
    assert got == [("c1", 5, 9, "Alu", "SINE", "sup", "-", "1.5"), ("c1", 7, 8, None, None, None, ".", None)]
    fasta, sizes = tmp_path / "g.fa", tmp_path / "g.sizes"
    fasta.write_text(">c1 x\nACGTAC\nGT\n>c2\nNN\n")
    sizes.write_text("c1\t100\n")
    assert {tuple(r) for r in R.genome_sizes(spark, str(fasta), str(sizes)).collect()} == {("c1", 100)}
    assert {tuple(r) for r in R.genome_sizes(spark, str(fasta)).collect()} == {("c1", 8), ("c2", 2)}
    windows = spark.createDataFrame([("c1", 2, 5), ("c1", 6, 50), ("c2", -1, 1), ("c9", 0, 1)], "chrom string, start int, end int")
    cut = R.add_sequences(windows, R.read_fasta(spark, str(fasta)))
    assert {(r["chrom"], r["start"], r["sequence"]) for r in cut.collect()} == {("c1", 2, "GTA"), ("c1", 6, "GT"), ("c2", -1, "N"), ("c9", 0, None)}
    names = spark.createDataFrame([("chr1",), ("chrUn_x",), ("Scaffold_9",), (None,)], "n string")
    assert [r[0] for r in names.select(iv.unplaced(F.col("n"))).collect()] == [False, True, True, None]
    values = spark.createDataFrame([("c1", 0, 5, 1.5), ("c1", 5, 9, None), ("c2", 1, 2, 2.0)], "chrom string, start long, end long, v double")
    R.write_track(values, str(tmp_path / "t.bedGraph"), "v", "my track")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t.bedGraph")).collect()]
    assert 'track type=bedGraph name="my track"' in lines and "c1\t0\t5\t1.5" in lines and "c2\t1\t2\t2" in lines
    assert {(r["chrom"], r["start"], r["value"]) for r in R.read_signal(spark, str(tmp_path / "t.bedGraph")).collect()} == {("c1", 0, 1.5), ("c2", 1, 2.0)}
    R.write_json(values, str(tmp_path / "j"))
    assert {"chrom": "c1", "start": 5, "end": 9, "v": None} in [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    R.write_sizes(spark.createDataFrame([("c1", 8)], "chrom string, size long"), str(tmp_path / "s"))
    assert [tuple(r) for r in R.read_sizes(spark, str(tmp_path / "s")).collect()] == [("c1", 8)]
    if importlib.util.find_spec("pyBigWig") is None:
        assert R.read_signal(spark, str(tmp_path / "x.bw")).collect() == []
