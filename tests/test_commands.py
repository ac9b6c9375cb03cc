import hashlib
import json
import re

import pytest

from spanloom import config
from spanloom.__main__ import main
from spanloom.sources import readers as R
from spanloom.sources import reports, synthetic

LENGTHS = [23_000, 4_100, 30]


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_settings(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("project: p\nwindow_sizes: [10, 20]\nseed: 3\n")
    s = config.load(str(p), seed=5, out=None)
    assert (s.project, s.window_sizes, s.seed, s.out) == ("p", (10, 20), 5, "out")
    assert json.loads(config.snapshot(s))["window_sizes"] == [10, 20]
    q = tmp_path / "s.json"
    q.write_text("")
    assert config.load(str(q)) == config.Settings()
    for bad in ("other: 1", "- 1", "step_fraction: 0", "window_sizes: []"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(p))


def test_synthetic_is_a_function_of_seed_and_place(spark):
    tiles = synthetic.genome(spark, LENGTHS)
    got = {r["chrom"]: r["seq"] for r in synthetic.whole(tiles).collect()}
    assert [len(got[f"s{i + 1}"]) for i in range(3)] == LENGTHS and set("".join(got.values())) == set("ACGT")
    assert got == {r["chrom"]: r["seq"] for r in synthetic.whole(synthetic.genome(spark, LENGTHS).repartition(7)).collect()}
    assert got != {r["chrom"]: r["seq"] for r in synthetic.whole(synthetic.genome(spark, LENGTHS, 7)).collect()}
    tandem = got["s1"][14_000:16_000]
    assert tandem == tandem[:4] * 500
    for g in synthetic.genes(spark, LENGTHS).collect():
        assert 0 <= g["start"] < g["end"] <= 23_000 and g["chrom"] == "s1"
    assert sum(r["end"] - r["start"] for r in synthetic.signal(spark, LENGTHS).collect()) == sum(LENGTHS)
    assert synthetic.genome(spark, [0]).count() == 0


def test_histogram_equals_a_loop(spark):
    values = [0.0, 1.0, 2.5, 2.5, 10.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = reports.bins(df, "v", 4)
    assert [n for *_, n in got] == [2, 2, 0, 1] and [a for a, *_ in got] == [0, 2.5, 5, 7.5]
    assert [n for *_, n in reports.bins(df, "v")] == [2, 2, 0, 0, 1]  # as many bins as values
    assert reports.bins(df.where("v = 2.5"), "v") == [(2.5, 2.5, 2)] and reports.bins(df.where("v > 99 and v < 100"), "v") == []
    assert reports.histogram_svg(got, "a<b").count("<rect") == len(got) and "a&lt;b" in reports.histogram_svg(got, "a<b")
    assert "no finite values" in reports.histogram_svg([], "x")


def test_page_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>"), (2, None), (3, "c")], "i long, s string")
    reports.write_html(spark, f"file://{tmp_path}/page.html", "T & U", {"rows": df.orderBy("i")}, {"i": (df, "i")}, rows=2)
    page = (tmp_path / "page.html").read_text()
    assert "T &amp; U" in page and "&lt;b&gt;" in page and "<b>" not in page and len(re.findall("<tr>", page)) == 3 and "<svg" in page
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"abc")
    (tmp_path / "in" / "b").write_bytes(b"0123456789")
    got = {r["path"][-1]: (r["length"], r["sha256"]) for r in reports.inputs(spark, [f"{tmp_path}/in"], most=5).collect()}
    assert got == {"a": (3, hashlib.sha256(b"abc").hexdigest()), "b": (10, None)}
    for command in ("one", "two"):
        reports.write_provenance(spark, f"{tmp_path}/p", [f"{tmp_path}/in"], config.snapshot(config.Settings()), command)
    assert sorted(x.split("\t")[1] for x in text_of(tmp_path / "p" / "commands").splitlines()) == ["one", "two"]
    assert json.loads((tmp_path / "p" / "settings.json").read_text())["project"] == "run"


def test_cards_equal_a_loop(spark, tmp_path):
    focus = [("x", "a", 100, 200), ("y", "a", 9000, 9010)]
    others = [("a", 0, 40, "n1"), ("a", 700, 800, None), ("a", 8000, 8001, "n3"), ("b", 100, 200, "n4"), ("a", 9020, 9999, "n5")]
    f, o = spark.createDataFrame(focus, "k string, chrom string, start long, end long"), spark.createDataFrame(others, "chrom string, start long, end long, name string")
    size = spark.createDataFrame([("a", 9015)], "chrom string, size long")
    got = {(r["k"], r["start"]) for r in reports.in_view(f, o, "k", size, least=50, times=5).collect()}
    want = set()
    for k, c, s, e in focus:
        flank = max(50, 5 * (e - s))
        low, high = max(0, s - flank), min(9015, e + flank)
        want |= {(k, b) for d, b, t, _ in others if d == c and b < high and t > low}
    assert got == want == {("x", 0)}
    reports.write_cards(f, o, "k", f"{tmp_path}/cards", least=600, times=1)
    assert sorted(text_of(tmp_path / "cards" / "k=x").splitlines()) == ["a\t0\t40\tn1", "a\t100\t200\tfocus", "a\t700\t800\t."]


def test_commands(spark, tmp_path, capsys):
    d = str(tmp_path)
    main(["synthetic", "--lengths", "12000", "3000", "--out", f"{d}/g"], spark)
    assert {r["chrom"]: r["size"] for r in R.sizes_of(R.read_fasta(spark, f"{d}/g/genome.fa")).collect()} == {"s1": 12_000, "s2": 3_000}
    main(["tile", "--sizes", f"{d}/g/sizes.tsv", "--window", "1000", "--window", "4000", "--out", f"{d}/w.parquet"], spark)
    w = spark.read.parquet(f"{d}/w.parquet")
    assert w.where("window_size = 1000").count() == 23 + 5 and w.where("parent_id is not null").count() > 0
    main(["base-stats", "--genome", f"{d}/g/genome.fa", "--window", "1000", "--out", f"{d}/b.parquet"], spark)
    assert spark.read.parquet(f"{d}/b.parquet").count() == 28
    kept, left = [], w.count()
    for flag in ([], ["--invert"]):
        main(["overlap", f"{d}/w.parquet", f"{d}/g/genes.bed", *flag, "--out", f"{d}/o.parquet"], spark)
        kept.append(spark.read.parquet(f"{d}/o.parquet").count())
    assert sum(kept) == left and min(kept) > 0
    main(["coverage", f"{d}/g/genes.bed", f"{d}/g/signal.bedgraph", "--out", f"{d}/c.parquet"], spark)
    assert {r["fraction"] for r in spark.read.parquet(f"{d}/c.parquet").collect()} == {1.0}
    main(["merge", f"{d}/g/signal.bedgraph", "--gap", "1", "--out", f"{d}/m.bed"], spark)
    assert R.read_bed(spark, f"{d}/m.bed").count() == 2
    main(["subtract", f"{d}/g/genes.bed", f"{d}/g/signal.bedgraph", "--out", f"{d}/s.parquet"], spark)
    assert spark.read.parquet(f"{d}/s.parquet").count() == 0
    (tmp_path / "l.bed").write_text("a\t0\t10\tx\na\t0\t10\tx\na\t0\t10\ty\n")
    (tmp_path / "r.bed").write_text("a\t4\t6\n")
    main(["subtract", f"{d}/l.bed", f"{d}/r.bed", "--out", f"{d}/s2.parquet"], spark)
    got = sorted((r["name"], r["start"], r["end"]) for r in spark.read.parquet(f"{d}/s2.parquet").collect())
    assert got == [("x", 0, 4), ("x", 0, 4), ("x", 6, 10), ("x", 6, 10), ("y", 0, 4), ("y", 6, 10)]
    main(["convert", f"{d}/g/genes.bed", "--out", f"{d}/genes.tsv"], spark)
    assert R.read_table(spark, f"{d}/genes.tsv").count() == R.read_bed(spark, f"{d}/g/genes.bed").count() == 2
    main(["report", f"{d}/c.parquet", "--plot", "fraction", "--out", f"file://{d}/r.html"], spark)
    assert "<svg" in (tmp_path / "r.html").read_text()
    main(["cards", f"{d}/g/genes.bed", f"{d}/g/signal.bedgraph", "--out", f"{d}/cards"], spark)
    assert len(list((tmp_path / "cards").glob("card=*"))) == 2
    main(["provenance", f"{d}/g/genes.bed", "--out", f"{d}/p"], spark)
    main(["queries"], spark)
    assert "island_fdr" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        main(["run", "none", "--data", d], spark)
