"""Readers and writers: Parquet (which also stands for binary dumps), delimited text with a two-line header (.tbl), and
headerless CSV with a JSON description beside it.

Texts are read through Spark's own readers and so from any store it reaches; no file is opened by the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType()}
NAMES = {T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string"}
NULL_POLICIES = ("reject_null_strings", "null_string_as_null", "null_string_as_value")


def read_tbl(spark: SparkSession, path: str) -> DataFrame:
    """Line 1: names, line 2: types (`_null` marks nullable columns), both separated by `|`; `null` is NULL."""
    lines = spark.read.text(path).limit(2).collect()
    names, kinds = (r[0].split("|") for r in lines)
    fields = [T.StructField(n, TYPES[k.removesuffix("_null")], k.endswith("_null")) for n, k in zip(names, kinds)]
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    # the reader drops the first line of each file; of the rows that are like its second line, one for each file is that line
    raw = spark.read.schema(schema).option("sep", "|").option("quote", "").option("header", "true").option("enforceSchema", "true").csv(path).withColumn("_file", F.input_file_name())
    of_kinds = F.struct(*(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names)) == F.struct(*(F.lit(k) for k in kinds))
    place = F.row_number().over(W.partitionBy("_file").orderBy("_file"))
    data = raw.where(~of_kinds).drop("_file").unionAll(raw.where(of_kinds).withColumn("_place", place).where("_place > 1").drop("_file", "_place"))
    cells = [F.when(F.col(f"`{f.name}`") == "null", None).otherwise(F.coalesce(F.col(f"`{f.name}`"), F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(None))).cast(f.dataType).alias(f.name) for f in fields]
    return data.select(*cells)


def read_csv(spark: SparkSession, path: str, description: dict | None = None) -> DataFrame:
    """Headerless CSV. The description (by default `<path>.json`) has `columns` (name, type, nullable) and `config`
    (delimiter, separator, quote, escape, null_handling, reject_quoted_nonstrings, rfc_mode)."""
    if description is None:
        description = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}.json").collect()))
    config = description.get("config", {})
    policy = config.get("null_handling", "reject_null_strings")
    if policy not in NULL_POLICIES:
        raise ValueError(f"null_handling is one of {NULL_POLICIES}")
    columns = description["columns"]
    reader = (
        spark.read.schema(T.StructType([T.StructField(c["name"], T.StringType()) for c in columns]))
        .option("sep", config.get("separator", ","))
        .option("quote", config.get("quote", '"'))
        .option("escape", config.get("escape", '"') if not config.get("rfc_mode", True) else '"')
        .option("multiLine", "true")
        .option("mode", "FAILFAST")
        .option("nullValue", "")
        .option("emptyValue", "\0empty")
    )
    delimiter = config.get("delimiter", "\n")
    if delimiter != "\n":
        reader = reader.option("lineSep", delimiter)
    elif not spark.read.option("lineSep", "\n").text(path).where(F.col("value").endswith("\r")).isEmpty():
        raise ValueError("lines end with \\n, not with \\r\\n")
    out = []
    for c in columns:
        raw = F.col(f"`{c['name']}`")
        value = F.when(raw == "\0empty", "").otherwise(raw)
        word = F.lower(value) == "null"
        if policy == "null_string_as_null":
            value = F.when(word, None).otherwise(value)
        elif policy == "reject_null_strings":
            value = F.when(word, F.raise_error(F.lit("the text null stands in the file"))).otherwise(value)
        out.append(value.cast(TYPES[c["type"]]).alias(c["name"]))
    return reader.csv(path).select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows without a header; strings quoted, NULL an empty field; the description goes to `<path>.json`."""
    cells = []
    for f in df.schema.fields:
        cell = F.col(f"`{f.name}`").cast("string")
        if isinstance(f.dataType, T.StringType):
            cell = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.coalesce(cell, F.lit("")))
    df.select(F.concat_ws(",", *cells).alias("line")).write.mode("overwrite").text(path)
    columns = [{"name": f.name, "type": NAMES[type(f.dataType)], "nullable": f.nullable} for f in df.schema.fields]
    text = json.dumps({"columns": columns, "config": {"null_handling": "null_string_as_value"}})
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")


def file_type(path: str, kind: str | None = None) -> str:
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "tbl", "bin", "parquet"):
        raise ValueError(f"unknown file type {kind!r}")
    return "parquet" if kind == "bin" else kind


def read_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return {"csv": read_csv, "tbl": read_tbl, "parquet": lambda s, p: s.read.parquet(p)}[file_type(path, kind)](spark, path)


def write_file(df: DataFrame, path: str, kind: str | None = None) -> None:
    kind = file_type(path, kind)
    if kind == "tbl":
        raise ValueError("tables are exported as csv or bin")
    if kind == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
