"""Observation tables: CSV with a fixed schema, typed ECSV, JSON documents, and error documents in place of either."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the ECSV format: its types in Spark's words.
ECSV_TYPES = {"int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "string": "string", "bool": "boolean"}


class ErrorDocument(ValueError):
    """A service answered with an error document instead of a table."""


def head(spark: SparkSession, path: str, lines: int = 200) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(lines).collect()]


def refuse_errors(lines: list[str]) -> None:
    """Raises if the first lines are a VOTable that reports an error."""
    text = "\n".join(lines)
    if "<VOTABLE" in text:
        status = re.search(r'QUERY_STATUS"\s+value="(\w+)"[^>]*>([^<]*)', text)
        raise ErrorDocument(status[2].strip() if status else "a VOTable where a table was expected")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; types are those of ``schema``, never guessed, so that an empty file has them too."""
    refuse_errors(head(spark, path, 20))
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="PERMISSIVE")


def ecsv_schema(lines: list[str]) -> str:
    """Spark schema of the YAML column list in an ECSV header."""
    fields = re.findall(r"name:\s*([\w.]+).*?datatype:\s*(\w+)", "\n".join(x for x in lines if x.startswith("#")), re.S)
    return ", ".join(f"`{n}` {ECSV_TYPES[t]}" for n, t in fields)


def read_ecsv(spark: SparkSession, path: str) -> DataFrame:
    """A typed table; empty fields are null and big ids stay whole numbers. The header may have any number of lines; of several files the first one's counts."""
    marked = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.col("value").startswith("#")).collect()
    first = min((r.file for r in marked), default=None)
    lines = [r.value for r in marked if r.file == first]
    return spark.read.csv(path, header=True, schema=ecsv_schema(lines), sep=" ", comment="#", nullValue='""')


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def explode_map(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """One row per entry of a map column."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(key, value))


def reindexed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the given columns in order; missing ones are null of their type."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating values as null, in structs, arrays and maps too: done once, where data come in."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda v: clean(v, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def with_suffix(df: DataFrame, *suffixes: str) -> list[str]:
    """The columns whose names end with one of the suffixes, in order."""
    return [c for c in df.columns if c.endswith(suffixes)]


def read_keys(spark: SparkSession, path: str, contains: str = "") -> DataFrame:
    """date, time, size, key of a listing: one object a line, four fields parted by blanks, the last with any blanks it has."""
    part = F.split("value", r"\s+", 4)
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.size(part) == 4)
    return lines.select(part[0].alias("date"), part[1].alias("time"), part[2].cast("long").alias("size"), part[3].alias("key")).where(F.col("key").contains(contains))


def read_many(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables and errors of a set of CSV files, name: (path, schema); a file that can't be read doesn't keep the others."""
    found, failed = {}, {}
    for name, (path, schema) in paths.items():
        try:
            found[name] = read_csv(spark, path, schema)
        except (AnalysisException, ErrorDocument) as error:
            failed[name] = str(error).splitlines()[0]
    return found, failed


def write_document(document: DataFrame, path: str) -> None:
    """One JSON document (the string column of one row) as text; readers see the old one until the new one is committed."""
    document.coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Exactly the given columns with a header, in one file; missing ones are empty."""
    reindexed(df, columns).coalesce(1).write.mode("overwrite").csv(path, header=True)
