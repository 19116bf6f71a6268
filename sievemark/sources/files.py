"""Scans and sinks of rows, lines, whole documents and metrics, in Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_rows(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Rows of one or many CSV files, quoted fields over several lines included; without a schema every column is a string and empty cells are ''."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = (reader.schema(schema) if schema else reader).csv(paths)
    return rows if schema else rows.na.fill("")


def union_with_defaults(frames: list[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """All rows of frames whose columns differ; where a column in defaults is missing or null, its default stands."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    for name, value in defaults.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out.na.fill(defaults)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per line; a line that is no JSON object of the schema has nulls and its text in bad_line."""
    whole = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def numbered_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """json_lines() of files of moderate size with line_number (from 1 in each file) and path: each file is read as one text, so that its lines keep their order."""
    whole = T.StructType([*schema.fields, T.StructField("bad_line", T.StringType())])
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).filter("trim(line) <> ''")
    parsed = texts.select("path", (F.col("at") + 1).alias("line_number"), F.from_json("line", whole, {"columnNameOfCorruptRecord": "bad_line"}).alias("row"))
    return parsed.select("path", "line_number", "row.*")


def last_line_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key in the order given; rows without a key are left out."""
    w = Window.partitionBy(key).orderBy(*(c.desc() for c in order))
    return df.filter(F.col(key).isNotNull()).withColumn("line_from_end", F.row_number().over(w)).filter("line_from_end = 1").drop("line_from_end")


def documents(spark: SparkSession, path: str, pattern: str = "*.{txt,md}", max_chars: int | None = None) -> DataFrame:
    """path, doc_id (file name without its ending) and text of every whole file; max_chars is a feature of discovery, off by default."""
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    text = F.col("value") if max_chars is None else F.substring("value", 1, max_chars)
    where = F.col("_metadata.file_path")
    return read.select(where.alias("path"), F.regexp_extract(where, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), text.alias("text"))


def discovered(folders: list[DataFrame], fallback: DataFrame, limit: int = 80, max_chars: int = 20_000) -> DataFrame:
    """Documents (path, doc_id, text) of the first folder that has any with text, else the fallback's; of one doc_id the first path counts.

    The limits are those of a discovery of samples: the first `limit` paths, and the first max_chars signs of each text.
    """
    for docs in [*folders, fallback]:
        filled = docs.filter(F.trim("text") != "").orderBy("path").limit(limit)
        if not filled.isEmpty():
            first = filled.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))).filter("place = 1").drop("place")
            return first.withColumn("text", F.substring("text", 1, max_chars))
    return fallback.limit(0)


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """name and status (changed, missing, unlisted) of the files under path that differ from manifest (name, sha256)."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    now = content.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("now"))
    both = now.join(manifest.select("name", F.lower("sha256").alias("listed")), "name", "full_outer")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("now") != F.col("listed"), "changed")
    return both.select("name", status.alias("status")).filter("status IS NOT NULL")


def markdown_metrics(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """name and value of every '| name | number |' line of Markdown reports; raises if a required name has none."""
    line = r"^\|\s*([^|]+?)\s*\|\s*(-?[0-9]+(?:\.[0-9]+)?)\s*\|"
    lines = spark.read.text(path).filter(F.col("value").rlike(line))
    found = lines.select(F.regexp_extract("value", line, 1).alias("name"), F.regexp_extract("value", line, 2).cast("double").alias("value"))
    if required:
        there = {r["name"] for r in found.filter(F.col("name").isin(*required)).select("name").distinct().collect()}
        if lost := [n for n in required if n not in there]:
            raise ValueError(f"metrics not found: {lost}")
    return found


def append_json(df: DataFrame, path: str, required: list[str]) -> DataFrame:
    """Append the rows that have every required field, and return the others."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    df.filter(whole).write.mode("append").json(path)
    return df.filter(~whole)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, title: str, most: int = 1_000) -> None:
    """A small table as a Markdown report of one file: a report is read by people, and a table of over `most` rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """The rows as JSON lines in one folder, newest run in place of the one before."""
    df.write.mode("overwrite").json(path)
