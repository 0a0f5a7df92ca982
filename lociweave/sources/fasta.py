"""Sources: sequence files with gene metadata, K lists and anchor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHOR_TABLE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "len", "x", "y", "z")])


def is_header(line: Column) -> Column:
    return line.rlike(r"^>\S")


def is_metadata(line: Column) -> Column:
    return line.rlike(r"^>\s")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line; numbered within each whole file, so order never rests on how a file is split."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return files.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("line_no", "line"))


def header_count(lines: DataFrame, by: str = "file") -> DataFrame:
    return lines.groupBy(by).agg(F.count_if(is_header(F.col("line"))).alias("n_headers"))


def assemble(lines: DataFrame, by: str = "file") -> DataFrame:
    """by, seq_idx, name, bases, len of each record; metadata and lines before the first header are no part of it."""
    order = F.struct("line_no", "line")
    own = lines.where(~is_metadata(F.col("line"))).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]).alias("lines"))
    # Records are what lies between header lines; "\n>" cannot stand within a line.
    text = F.concat(F.lit("\n"), F.array_join("lines", "\n"))
    records = own.select(by, F.posexplode(F.slice(F.split(text, "\n>"), F.lit(2), F.greatest(F.size(F.split(text, "\n>")) - 1, F.lit(0)))).alias("seq_idx", "r"))
    name = F.regexp_extract("r", r"^([^\n]*)", 1)
    bases = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), "\n", "")
    return records.select(by, "seq_idx", name.alias("name"), bases.alias("bases"), F.length(bases).cast("long").alias("len"))


def _fields() -> list[Column]:
    """The typed fields of a metadata line; numbers that aren't any are 0."""
    fields = F.split(F.trim(F.regexp_replace(F.substring("line", 2, 1 << 30), r"[ \t]+", " ")), " ")
    number = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)).try_cast("long"), F.lit(0))
    word = lambda k: F.try_element_at(fields, F.lit(k))
    return [
        word(1).alias("gene"), word(2).alias("chr"), word(3).alias("strand"),
        number(4).alias("region_start"), number(5).alias("gene_start"), number(6).alias("gene_end"), number(7).alias("region_end"),
    ]


def parse_metadata(lines: DataFrame, by: str = "file") -> DataFrame:
    """by, seq_idx and the typed fields of the k-th metadata line."""
    rows = lines.where(is_metadata(F.col("line")))
    serial = F.row_number().over(Window.partitionBy(by).orderBy("line_no")) - 1
    return rows.select(by, serial.alias("seq_idx"), *_fields())


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """file, place (its order in the file), header and lines (what follows the header line) of all records at path.

    A record is what lies between two line starts with ">", so the text source cuts files into byte ranges, each read by a
    task of its own, and aligns them with records. Lines before a file's first ">" are a record without a header.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    block = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("serial"))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), block.alias("place"), F.replace("value", F.lit("\r"), F.lit("")).alias("value"))
    first = F.row_number().over(Window.partitionBy("file", "place.block").orderBy("place.serial")) == 1
    # The source takes off the ">" of every record but the one at a file's start.
    at_start = first & (F.col("place.block") == 0)
    headed = rows.withColumn("start", at_start)
    value = F.when(~F.col("start"), F.col("value")).when(F.col("value").startswith(">"), F.substring("value", 2, 1 << 30))
    cut = headed.select("file", "place", value.alias("record"), F.when(value.isNull(), F.col("value")).alias("loose"))
    return cut.select("file", "place", F.substring_index("record", "\n", 1).alias("header"), F.coalesce(F.expr("substring(record, length(substring_index(record, '\n', 1)) + 2)"), "loose").alias("lines"))


def _named() -> Column:
    """A sequence's header; a lone ">" is one without a name."""
    return F.col("header").rlike(r"^(\S|$)")


def _metadata() -> Column:
    return F.col("header").rlike(r"^\s")


def _in_file(records: DataFrame) -> DataFrame:
    """records with n_sequences and n_genes: how many headers and metadata lines there are up to this one in its file.

    A byte range counts its own; what the ranges before hold of the file is added, a row a range.
    """
    is_sequence, is_gene = _named(), _metadata()
    up_to = Window.partitionBy("file", "place.block").orderBy("place.serial").rowsBetween(Window.unboundedPreceding, 0)
    own = records.withColumns({"n_sequences": F.count_if(is_sequence).over(up_to), "n_genes": F.count_if(is_gene).over(up_to)})
    ranges = records.groupBy("file", F.col("place.block").alias("block")).agg(F.count_if(is_sequence).alias("s"), F.count_if(is_gene).alias("g"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranges = ranges.select(F.col("file").alias("f"), "block", F.coalesce(F.sum("s").over(before), zero).alias("s"), F.coalesce(F.sum("g").over(before), zero).alias("g"))
    joined = own.join(ranges, (F.col("file") == F.col("f")) & (F.col("place.block") == F.col("block")))
    return joined.select(*records.columns, (F.col("n_sequences") + F.col("s")).alias("n_sequences"), (F.col("n_genes") + F.col("g")).alias("n_genes"))


def record_sequences(records: DataFrame) -> DataFrame:
    """file, seq_idx, name, bases, len of each record with a name; lines behind a metadata line go on with the record before."""
    placed = _in_file(records)
    own = placed.where(_named()).select("file", (F.col("n_sequences") - 1).cast("int").alias("seq_idx"), F.col("header").alias("name"), F.replace("lines", F.lit("\n"), F.lit("")).alias("bases"))
    more = placed.where(_metadata() & (F.length(F.replace("lines", F.lit("\n"), F.lit(""))) > 0) & (F.col("n_sequences") > 0))
    later = more.groupBy("file", (F.col("n_sequences") - 1).cast("int").alias("seq_idx")).agg(F.sort_array(F.collect_list(F.struct("place", F.replace("lines", F.lit("\n"), F.lit("")).alias("t")))).alias("m"))
    rest = later.select("file", "seq_idx", F.array_join(F.transform("m", lambda x: x["t"]), "").alias("rest"))
    whole = F.concat("bases", F.coalesce("rest", F.lit("")))
    return own.join(rest, ["file", "seq_idx"], "left").select("file", "seq_idx", "name", whole.alias("bases"), F.length(whole).cast("long").alias("len"))


def record_genes(records: DataFrame) -> DataFrame:
    """file, seq_idx and the typed fields of each metadata line, numbered within its file."""
    rows = _in_file(records).where(_metadata())
    lines = rows.select("file", (F.col("n_genes") - 1).cast("int").alias("seq_idx"), F.concat(F.lit(">"), "header").alias("line"))
    return lines.select("file", "seq_idx", *_fields())


def record_offsets(sequences: DataFrame) -> DataFrame:
    """family_id, seq_idx, name, start (0-based) and room (length and one mark behind) of records put one behind the other."""
    before = Window.partitionBy("family_id").orderBy("seq_idx").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("len").cast("long") + 1
    return sequences.select("family_id", "seq_idx", "name", F.coalesce(F.sum(room).over(before), F.lit(0).cast("long")).alias("start"), room.alias("room"))


def read_families(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sequences and genes of all files at path; each file is a family. Files are read in byte ranges."""
    records = file_records(spark, path)
    family = F.xxhash64("file").alias("family_id")
    genes = record_genes(records)
    return record_sequences(records).select(family, "seq_idx", "name", "bases", "len"), genes.select(family, *genes.columns[1:])


def read_k_list(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of a white-space separated list of K values."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w"))
    return words.select(F.col("w").try_cast("int").alias("k")).where("k is not null")


def k_values(spark: SparkSession, given: str) -> list[int]:
    """The K values of a comma-separated list, or of the list file at that path."""
    if all(x.strip().lstrip("-").isdigit() for x in given.split(",")):
        return sorted({int(x) for x in given.split(",")})
    return sorted({r.k for r in read_k_list(spark, given).distinct().collect()})


def read_anchor_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated anchor table with a header: id, len, and a position in each of three sequences."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=ANCHOR_TABLE)
    return rows.select(F.col("id").cast("long").alias("row_id"), "len", F.array("x", "y", "z").alias("pos"))
