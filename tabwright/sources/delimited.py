"""Delimited text: encoding and delimiter detection, typed columns, header cleanup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted
from tabwright.sources.records import left_open, quoted_records

# Texts read as missing, candidate delimiters in tie order, and boolean spellings.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
DELIMITERS = [",", "\t", ";", "|"]
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|Inf|infinity|Infinity)\s*$"
SNIFF_LINES = 10


def file_dialects(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding, delimiter and header (its first line with text) of every file under ``path``, in one pass.

    UTF-8 when every line of the file decodes, else Latin-1, which accepts any byte. The delimiter is the candidate
    that occurs most in its first ten lines; ties in candidate order, a comma where none occurs. Text lines keep their
    bytes, so all ranges of a file are checked at once; blank files have no header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        valid: dict[str, bool] = {}
        head: dict[str, list[bytes]] = {}
        header: dict[str, tuple[int, bytes]] = {}
        for batch in batches:
            for file, start, fine, value in zip(*(batch[c].to_pylist() for c in ("file", "range", "fine", "value"))):
                valid[file] = valid.get(file, True) and fine
                if start == 0 and len(head.setdefault(file, [])) < SNIFF_LINES:
                    head[file].append(value)
                if file not in header and value.strip():
                    header[file] = (start, value)
        out = []
        for file, fine in valid.items():
            counts = {d: sum(line.count(d.encode()) for line in head.get(file, [])) for d in DELIMITERS}
            best = max(DELIMITERS, key=lambda d: counts[d])
            start, value = header.get(file, (None, None))
            out.append({"file": file, "fine": fine, "delimiter": (best if counts[best] else ",") if file in head else None,
                        "first": None if value is None else {"range": start, "value": value}})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("file", pa.string()), ("fine", pa.bool_()), ("delimiter", pa.string()),
            ("first", pa.struct([("range", pa.int64()), ("value", pa.binary())]))]))

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.is_valid_utf8("value").alias("fine"), F.col("value").cast("binary").alias("value"))
    parts = lines.mapInArrow(run, "file string, fine boolean, delimiter string, first struct<range:bigint,value:binary>")
    return parts.groupBy("file").agg(F.bool_and("fine").alias("fine"), F.max("delimiter").alias("delimiter"), F.min("first").alias("first")).select(
        "file", F.when(F.col("fine"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), F.coalesce("delimiter", F.lit(",")).alias("delimiter"),
        F.col("first.value").alias("header"))


def read_delimited(
    spark: SparkSession,
    path: str,
    max_rows: int | None = None,
    encoding: str | None = None,
    delimiter: str | None = None,
    infer: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Read a delimited file or folder into typed columns.

    Files of equal encoding, delimiter and header are read together; such classes are stacked by column name, with
    nulls for columns that a class lacks. Files are read in byte ranges; where quoted fields hold line breaks, the
    records are cut by ``quoted_records``. ``multiline=True`` reads each file in one task instead."""
    try:
        files = [f.asDict() for f in file_dialects(spark, path).where("header is not null").collect()]  # a row per file
    except AnalysisException as e:
        raise ValueError(f"the source does not exist: {path}") from e
    if not files:
        raise ValueError(f"the source is empty: {path}")
    classes: dict[tuple, list[str]] = {}
    for f in files:
        key = (encoding or f["encoding"], delimiter or f["delimiter"], bytes(f["header"]).rstrip(b"\r"))
        classes.setdefault(key, []).append(unquote(f["file"]))
    parts = [_read_class(spark, sorted(paths), *key[:2], multiline) for key, paths in sorted(classes.items())]
    if len(parts) > 1 and any(len(set(p.columns)) < len(p.columns) for p in parts):
        raise ValueError(f"files of several layouts have repeated column names: {path}")
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    if max_rows is not None:
        df = df.limit(max_rows)
    if df.isEmpty():
        raise ValueError(f"the source has a header but no rows: {path}")
    if not infer or len(set(df.columns)) < len(df.columns):
        return df  # names that meet after trimming are left for the validation to report
    return infer_types(df)


def _read_class(spark: SparkSession, paths: list[str], encoding: str, delimiter: str, multiline: bool) -> DataFrame:
    """Text columns of files with one header."""
    options = {"sep": delimiter, "quote": '"', "escape": '"', "nullValue": ""}
    broken = not multiline and not spark.read.text(paths).where(F.contains("value", F.lit('"')) & left_open(F.col("value"), delimiter)).isEmpty()
    whole = spark.read.options(header=True, encoding=encoding, enforceSchema=True, multiLine=multiline or broken, **options)
    if not broken:
        return clean_header(whole.csv(paths))
    names = whole.csv(paths[0]).columns  # reads the header only
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = quoted_records(spark, paths, delimiter).where("not first").select(F.decode("value", encoding).alias("value"))
    cells = rows.select(F.from_csv("value", fields, {**options, "multiLine": "true"}).alias("r")).select("r.*")
    return clean_header(cells.toDF(*names))


def clean_header(df: DataFrame) -> DataFrame:
    """Trim names and drop unnamed columns that hold no value."""
    names = [c.strip() for c in df.columns]
    df = df.toDF(*names)
    blank = [c for c in names if re.fullmatch(r"_c\d+|Unnamed:.*", c)]
    if not blank:
        return df
    filled = df.agg(*[F.max(_value(c).isNotNull()).alias(f"f{i}") for i, c in enumerate(blank)]).first()
    return df.drop(*[c for i, c in enumerate(blank) if not filled[f"f{i}"]])


def _value(name: str):
    """Text with missing markers read as NULL."""
    return F.when(~quoted(name).isin(MISSING), quoted(name))


def infer_types(df: DataFrame) -> DataFrame:
    """Missing markers to NULL, then the narrowest of bigint, double, boolean, string that
    fits every value of a column. One aggregation decides all columns."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = _value(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(INTEGER), F.expr(f"try_cast(trim(`{_esc(c)}`) as bigint)"))).alias(f"i{i}"),
            F.count_if(v.rlike(DECIMAL)).alias(f"d{i}"),
            F.count_if(v.isin(TRUE_WORDS + FALSE_WORDS)).alias(f"b{i}"),
        ]
    seen = df.agg(*aggs).first()  # one number per column and type
    out = []
    for i, c in enumerate(df.columns):
        v, n = _value(c), seen[f"n{i}"]
        if n == 0:
            typed = F.lit(None).cast("double")
        elif seen[f"i{i}"] == n:
            typed = F.trim(v).cast("bigint")
        elif seen[f"d{i}"] == n:
            typed = F.expr(f"try_cast(trim(`{_esc(c)}`) as double)")
            typed = F.when(v.isNotNull(), typed)
        elif seen[f"b{i}"] == n:
            typed = F.when(v.isin(TRUE_WORDS), True).when(v.isin(FALSE_WORDS), False)
        else:
            typed = v
        out.append(typed.alias(c))
    return df.select(*out)


def _esc(name: str) -> str:
    return name.replace("`", "``")


def write_predictions(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """Input columns plus the prediction, as CSV or Parquet; nested columns stay out of CSV."""
    if fmt == "csv":
        flat = [f.name for f in scored.schema.fields if f.dataType.typeName() not in ("map", "array", "struct")]
        scored.select(*[quoted(c) for c in flat]).write.mode("overwrite").option("header", True).csv(path)
    else:
        scored.write.mode("overwrite").format(fmt).save(path)
