"""Sources: delimited records, lines, bytes with a delimiter, inline strings, edge lists, ARFF.

Paths are what Hadoop's file systems read: several, globs, folders, compressed by extension. Schemas are given, never
inferred. Malformed numbers raise; with permissive=True they are null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions.scalars import parse_boolean
from tesserine.operators.graph import checkpointed


def parse_field(text: Column, kind: T.DataType, permissive: bool = False) -> Column:
    """A field of a record by its type; a char-like field is a string of which the caller takes the first character."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return parse_boolean(text)
    if isinstance(kind, T.DateType):
        return F.try_to_date(text, "yyyy-MM-dd") if permissive else F.to_date(text, "yyyy-MM-dd")
    return text.try_cast(kind) if permissive else text.cast(kind)


def records(lines: DataFrame, separator: str, schema: T.StructType, permissive: bool = False, column: str = "value") -> DataFrame:
    """Lines split by a regular expression into typed fields; empty fields at the end count, surplus ones are ignored."""
    cut = F.split(F.col(column), separator, -1)
    at = (lambda i: F.get(cut, F.lit(i))) if permissive else (lambda i: F.element_at(cut, i + 1))
    return lines.select(*(parse_field(at(i), f.dataType, permissive).alias(f.name) for i, f in enumerate(schema)))


def from_file(spark: SparkSession, path: str | list[str], separator: str | None = None, schema: T.StructType | None = None, permissive: bool = False, charset: str | None = None) -> DataFrame:
    """Delimited records where separator (a regular expression) and schema are given, else lines."""
    lines = read_lines(spark, path, charset)
    return lines if separator is None else records(lines, separator, schema, permissive)


def from_string(spark: SparkSession, data: str, row_separator: str, column_separator: str, schema: T.StructType) -> DataFrame:
    """Records of an inline string; empty rows at its end are dropped."""
    rows = re.split(row_separator, data)
    while rows and not rows[-1]:
        rows.pop()
    return records(spark.createDataFrame([(r,) for r in rows], "value string"), column_separator, schema)


def read_lines(spark: SparkSession, path: str | list[str], charset: str | None = None) -> DataFrame:
    """The lines of files, folders (with what lies below) or globs, as ``value``."""
    reader = spark.read.option("recursiveFileLookup", True)
    if charset is None or charset.lower().replace("-", "") in ("utf8", "usascii", "ascii"):
        return reader.text(path)
    files = reader.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", charset), "\r\n?", "\n")
    return files.select(F.explode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("value"))


def read_lines_flattened(spark: SparkSession, path: str | list[str], separator: str, charset: str | None = None) -> DataFrame:
    """The parts of every line, flattened."""
    return read_lines(spark, path, charset).select(F.explode(F.split("value", separator)).alias("value"))


def read_bytes(spark: SparkSession, path: str | list[str], delimiter: str) -> DataFrame:
    """Records of bytes between delimiters, as binary ``value``."""
    return spark.read.option("recursiveFileLookup", True).option("lineSep", delimiter).text(path).select(F.col("value").cast("binary").alias("value"))


def read_bytes_flattened(spark: SparkSession, path: str | list[str], delimiter: str, width: int) -> DataFrame:
    """Records cut into pieces of a number of bytes, flattened."""
    r = read_bytes(spark, path, delimiter)
    n = F.ceil(F.length("value") / F.lit(width)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(F.col("value"), i * width + 1, F.lit(width)))
    return r.select(F.explode(pieces).alias("value"))


def read_lines_with_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the file they come from; Spark plans the offsets and sizes of the chunks."""
    return spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))


def local_lines(spark: SparkSession, path: str):
    """The lines one after the other on the driver, a partition at a time."""
    return (r["value"] for r in read_lines(spark, path).toLocalIterator())


def edge_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """src, dst of an edge list: two numbers parted by a tab; lines that begin with # are comments."""
    lines = read_lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return records(lines, r"\t", T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())]))


def renumber(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between dense numbers, and the table (node, id): numbers follow the order of the nodes."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    # numbers in two steps, so that no single task sorts all nodes: a count of each range, then a rank within it; the
    # ranges are kept in files, so that both steps and any task that is run again see the same ones
    ranged = checkpointed(nodes.repartitionByRange("node").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    ids = ranged.join(starts, "part").select("node", (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1).alias("id"))
    src, dst = ids.toDF("src", "s"), ids.toDF("dst", "d")
    return edges.join(src, "src").join(dst, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")), ids


def arff(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The data rows of an ARFF file: header (@) and comment (%) lines and empty lines are skipped."""
    lines = read_lines(spark, path).filter(~F.col("value").rlike(r"^\s*([@%]|$)"))
    return records(lines, r"\s*,\s*", schema)


def matrix(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """Rows of numbers as arrays."""
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    return lines.select(F.split(F.trim("value"), separator).cast("array<double>").alias("row"))


def vector(spark: SparkSession, path: str) -> DataFrame:
    """position, value of the numbers of a file, one a line; positions from 0 follow files and lines."""
    lines = read_lines(spark, path).filter(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    kept = checkpointed(lines.select(F.shiftright("at", 33).alias("part"), "at", F.trim("value").cast("double").alias("value")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.col("at") - F.shiftleft("part", 33)
    return kept.join(F.broadcast(starts), "part").select((F.col("start") + within).alias("position"), "value")


def token_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A token matrix: a line of no meaning, the numbers of documents and tokens, the tokens in one line, then a line for
    each document: its label, then pairs of a step to the next token's number and its count, ended by -1.

    Gives (doc, label) and (doc, token, n); documents are numbered by their lines, tokens from 0 by their steps."""
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("doc"))
    rows = lines.filter(F.col("value").rlike(r"(^|\s)-1\s*$")).select("doc", F.split(F.trim("value"), r"\s+").cast("array<int>").alias("v"))
    size = ((F.size("v") - 2) / 2).cast("int")
    steps = F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.aggregate(F.transform(F.sequence(F.lit(0), i), lambda j: F.get("v", 1 + 2 * j)), F.lit(0), lambda s, x: s + x).alias("token"), F.get("v", 2 + 2 * i).alias("n")))
    return rows.select("doc", F.get("v", F.lit(0)).alias("label")), rows.select("doc", F.inline(steps))
