"""Readers and writers of the usual text formats of intervals and sequences.

All coordinates come out 0-based and half-open. Text files of any size are read line by line in parallel; gzip works as
Spark's text reader has it. FASTA files are split at their headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.sequence import extract


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _fields(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.withColumn("f", F.split("value", sep))


def _at(i: int) -> Column:
    return F.get(F.col("f"), F.lit(i))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq: id up to the first white space, letters in upper case; lines before the first header are left out;
    records that share an id are joined in file order."""
    df = spark.read.option("lineSep", ">").text(path).withColumn("at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    first = df.groupBy(F.col("at.file_path").alias("_file")).agg(F.min("at").alias("_at"))  # what stands before a file's first header
    df = df.join(F.broadcast(first), F.col("at") == F.col("_at"), "left_anti")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    chrom = F.regexp_extract(head, r"^(\S+)", 1)
    body = F.upper(F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^([^\\\\r\\\\n]*)', 1)) + 1)"), r"\s", ""))
    rows = df.select(chrom.alias("chrom"), body.alias("seq"), "at").where("chrom <> ''")
    parts = rows.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("p"))
    return parts.select("chrom", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size; lines that start with ``#`` are left out; tabs or any white space between."""
    df = _fields(_lines(spark, path).where(~F.col("value").startswith("#")), r"\s+")
    return df.select(_at(0).alias("chrom"), _at(1).cast("long").alias("size"))


def sizes_of(genome: DataFrame) -> DataFrame:
    return genome.select("chrom", F.length("seq").cast("long").alias("size"))


def genome_sizes(spark: SparkSession, fasta: str | None = None, sizes: str | None = None) -> DataFrame:
    """chrom, size from the sizes file, else from the sequences; one of the two must be given."""
    if sizes:
        return read_sizes(spark, sizes)
    if not fasta:
        raise ValueError("neither a sizes file nor a FASTA file")
    return sizes_of(read_fasta(spark, fasta))


def add_sequences(windows: DataFrame, genome: DataFrame) -> DataFrame:
    """``windows`` with ``sequence``: the letters of each on its axis, cut at the axis's ends; null for an unknown axis."""
    own = genome.select(F.col("chrom").alias("_c"), "seq")
    got = windows.join(own, F.col("chrom") == F.col("_c"), "left")
    return got.withColumn("sequence", extract(F.col("seq"), F.col("start"), F.col("end"))).drop("_c", "seq")


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value of a track: bedGraph by its suffix; bigWig where the package pyBigWig is there, else no rows."""
    if path.lower().endswith((".bedgraph", ".bed", ".bg")):
        return read_bedgraph(spark, path)
    schema = "chrom string, start long, end long, value double"
    try:
        import pyBigWig
    except ImportError:
        return spark.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column("chrom").to_pylist():
                with pyBigWig.open(path) as track:
                    rows = list(track.intervals(name) or ())
                yield pa.RecordBatch.from_pydict({"chrom": [name] * len(rows), **{c: [r[i] for r in rows] for i, c in enumerate(("start", "end", "value"))}}, schema=pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.float64())]))

    with pyBigWig.open(path) as track:
        names = list(track.chroms())
    return spark.createDataFrame([(n,) for n in names], "chrom string").repartition(max(1, len(names))).mapInArrow(run, schema)


def _bed_lines(spark: SparkSession, path: str) -> DataFrame:
    return _fields(_lines(spark, path).where(~F.col("value").rlike("^(#|track|browser)")))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand (``.`` where missing); short lines have nulls."""
    strand = F.when(_at(5).isin("+", "-"), _at(5)).otherwise(".")
    return _bed_lines(spark, path).select(_at(0).alias("chrom"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"), _at(3).alias("name"), _at(4).alias("score"), strand.alias("strand"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value; a value that is no number is null."""
    return _bed_lines(spark, path).select(_at(0).alias("chrom"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"), F.expr("try_cast(get(f, 3) as double)").alias("value"))


def attributes(text: Column) -> Column:
    """GFF3 ``k=v;`` or GTF ``k "v";`` pairs as a map; a bare word has an empty value; the last of a repeated key stays."""
    gtf = text.rlike(r'^\s*\w+ "')
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    key = lambda x: F.when(gtf, F.regexp_extract(x, r"^(\S+)", 1)).otherwise(F.substring_index(x, "=", 1))
    plain = lambda x: F.regexp_replace(F.substring(x, F.instr(x, "=") + 1, F.length(x)), r"\+", "%2B")
    gff = lambda x: F.when(F.instr(x, "=") > 0, F.coalesce(F.try_url_decode(plain(x)), plain(x))).otherwise("")
    value = lambda x: F.when(gtf, F.regexp_replace(F.regexp_replace(x, r"^\S+\s*", ""), '^"|"$', "")).otherwise(gff(x))
    pairs = F.transform(parts, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(pairs, lambda q, j: (q["key"] == p["key"]) & (j > i))) == 0)
    return F.map_from_entries(last)


# The attributes that name a feature's properties, the first that is there counts.
ATTRIBUTES = {
    "id": ("ID", "gene_id", "Name"),
    "parent": ("Parent", "transcript_id"),
    "name": ("Name", "gene_name", "gene_id", "ID"),
    "biotype": ("biotype", "gene_biotype", "transcript_biotype", "gbkey"),
    "family": ("family", "Family", "Name"),
    "class": ("class", "Class", "type"),
    "superfamily": ("superfamily", "Superfamily"),
    "divergence": ("divergence", "perc_div"),
}


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 or GTF: chrom, source, feature, start, end, score, strand, phase, attrs (map), id, parent, name, biotype,
    family, class, superfamily, divergence; each of these is the first attribute of its list below that is there and not empty.

    Lines with fewer than nine fields are left out; starts become 0-based."""
    df = _fields(_lines(spark, path).where(~F.col("value").startswith("#"))).where(F.size("f") >= 9)
    strand = F.when(_at(6).isin("+", "-"), _at(6)).otherwise(".")
    df = df.select(
        _at(0).alias("chrom"), _at(1).alias("source"), _at(2).alias("feature"), (_at(3).cast("long") - 1).alias("start"), _at(4).cast("long").alias("end"),
        _at(5).alias("score"), strand.alias("strand"), _at(7).alias("phase"), attributes(_at(8)).alias("attrs"),
    )
    first = lambda *ks: F.coalesce(*[F.nullif(F.try_element_at("attrs", F.lit(k)), F.lit("")) for k in ks])
    return df.withColumns({name: first(*keys) for name, keys in ATTRIBUTES.items()})


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, family, class, superfamily, strand, divergence of repeats: from GFF3 or GTF by their attributes,
    from BED by the fourth and the seventh to ninth field."""
    columns = ["chrom", "start", "end", "family", "class", "superfamily", "strand", "divergence"]
    if path.lower().endswith((".gff", ".gff3", ".gtf")):
        return read_gff(spark, path).select(*columns)
    strand = F.when(_at(5).isin("+", "-"), _at(5)).otherwise(".")
    lines = _bed_lines(spark, path)
    return lines.select(
        _at(0).alias("chrom"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"), _at(3).alias("family"), _at(6).alias("class"),
        _at(7).alias("superfamily"), strand.alias("strand"), _at(8).alias("divergence"),
    )


def read_vcf_copy_numbers(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, sample_id, copy_number of a VCF's CN fields; without samples INFO's CN as sample ``reference``.

    The end is INFO's END, else the start plus the absolute SVLEN (1 at least)."""
    lines = _lines(spark, path)
    names = lines.where(F.col("value").startswith("#CHROM")).select(F.expr("slice(split(value, '\\t'), 10, 100000000)").alias("samples")).limit(1)
    df = _fields(lines.where(~F.col("value").startswith("#")))
    info = F.expr("str_to_map(get(f, 7), ';', '=')")
    df = df.withColumn("info", info).withColumn("start", _at(1).cast("long") - 1)
    span = F.greatest(F.lit(1), F.abs(F.expr("try_cast(try_element_at(info, 'SVLEN') as bigint)")))
    df = df.withColumn("end", F.coalesce(F.expr("try_cast(try_element_at(info, 'END') as bigint)"), F.col("start") + F.coalesce(span, F.lit(1))))
    slot = F.array_position(F.split(_at(8), ":"), "CN").cast("int")
    df = df.withColumn("slot", slot).join(F.broadcast(names), how="left")
    own = F.transform(F.expr("slice(f, 10, greatest(size(f) - 9, 0))"), lambda x, i: F.struct(F.get("samples", i).alias("sample_id"), F.expr("slot").alias("slot"), x.alias("x")))
    cn = F.transform(own, lambda s: F.struct(s["sample_id"].alias("sample_id"), F.when(s["slot"] > 0, F.get(F.split(s["x"], ":"), s["slot"] - 1)).alias("cn")))
    only = F.array(F.struct(F.lit("reference").alias("sample_id"), F.try_element_at("info", F.lit("CN")).alias("cn")))
    each = F.explode(F.when((F.size("f") > 9) & (F.col("slot") > 0), cn).otherwise(only)).alias("s")
    rows = df.select(_at(0).alias("chrom"), "start", "end", each)
    return rows.select("chrom", "start", "end", F.col("s.sample_id").alias("sample_id"), F.expr("try_cast(s.cn as double)").alias("copy_number")).where("copy_number is not null")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: Parquet, CSV or, for all else, tab-separated; text formats with a header line."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, sep="," if path.endswith(".csv") else "\t")


def write_bed(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated, no header, null as empty."""
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def short_number(x: Column) -> Column:
    """Six significant digits without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")


def write_bedgraph(df: DataFrame, path: str, column: str) -> None:
    """Rows with a finite value only."""
    good = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.abs(column) < float("inf")))
    text = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), short_number(F.col(column).cast("double")))
    good.select(text.alias("value")).write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, path: str, name: str = "chrom", seq: str = "seq", width: int = 80) -> None:
    body = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_sizes(df: DataFrame, path: str) -> None:
    """chrom and size, tab-separated."""
    df.select(F.concat_ws("\t", "chrom", F.col("size").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_track(df: DataFrame, path: str, column: str, name: str) -> None:
    """A bedGraph track for genome browsers: a ``track`` line at the head of every file, then the rows with a finite value by place."""
    good = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.abs(column) < float("inf")))
    good = good.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end")
    text = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), short_number(F.col(column).cast("double")))

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first and batch.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([f'track type=bedGraph name="{name}"'], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    good.select(text.alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    out = df.write.mode("overwrite")
    out.parquet(path) if fmt == "parquet" else out.csv(path, sep="\t" if fmt == "tsv" else ",", header=True)
