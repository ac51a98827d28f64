"""Read a dataset from CSV, XLSX or Parquet.

Delimiter, encoding and decimal mark of a CSV are sniffed from its first 64 KiB; Spark
reads the whole file as text columns and casts each to the narrowest type that all of
its values have.  Dates stay text until a format is confirmed.
"""

from __future__ import annotations

import csv
import hashlib
import re
import tempfile
import uuid
from contextlib import suppress
from io import StringIO
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.values import ORDINAL, quoted
from tabscope.operators.records import DatasetReadError, EmptyDatasetError, UnsupportedFileTypeError
from tabscope.sources.blocks import records
from tabscope.sources.xlsx import read_sheet

# What is supported, tried, and taken as missing or as a number.
SUPPORTED_EXTENSIONS = {".csv", ".xlsx"}
PARQUET = ".parquet"
DELIMITERS = (",", ";", "\t", "|")
SNIFFED = 65_536
HEAD = SNIFFED + 3  # a character that begins within has up to three bytes more
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)
WITH_COMMA = re.compile(r"^[+-]?\d+,\d+(?:[eE][+-]?\d+)?$")
WITH_DOT = re.compile(r"^[+-]?\d+\.\d+(?:[eE][+-]?\d+)?$")
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|Inf|INF|infinity|Infinity)\s*$"
BOOLEAN = "^(True|TRUE|true|False|FALSE|false)$"


def filename_of(source: object, filename: str | None) -> str:
    if filename:
        return filename
    if isinstance(source, (str, Path)):
        return Path(source).name
    name = getattr(source, "name", None)
    if name:
        return Path(name).name
    raise DatasetReadError("A filename is required when the dataset source does not provide one.")


def decoded(head: bytes) -> tuple[str, str]:
    """Text of the sniffed bytes, its last character whole, and Spark's name of its encoding."""
    for end in range(SNIFFED, HEAD + 1):
        with suppress(UnicodeDecodeError):
            return head[:end].decode("utf-8-sig"), "UTF-8"
    return head[:SNIFFED].decode("latin-1"), "ISO-8859-1"


def delimiter_of(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        line = next((x for x in sample.splitlines() if x.strip()), "")
        best = max(DELIMITERS, key=line.count)
        return best if best in line else ","


def decimal_of(sample: str, delimiter: str) -> str:
    """A comma only if more numbers have commas than dots."""
    try:
        cells = [x.strip() for row in list(csv.reader(StringIO(sample), delimiter=delimiter))[1:] for x in row]
    except csv.Error:
        return "."
    commas = sum(bool(WITH_COMMA.fullmatch(x)) for x in cells)
    return "," if commas > sum(bool(WITH_DOT.fullmatch(x)) for x in cells) else "."


def payload_of(source: object) -> bytes:
    """All bytes of a stream or local file."""
    if isinstance(source, bytes):
        return source
    if isinstance(source, (str, Path)):
        return Path(source).read_bytes()
    try:
        source.seek(0)
        data = source.read()
    except (AttributeError, OSError):
        raise DatasetReadError("The uploaded dataset must support reading and seeking.") from None
    try:
        source.seek(0)
    except OSError:
        raise DatasetReadError("The uploaded dataset could not be rewound before reading.") from None
    return data.encode() if isinstance(data, str) else data


def fingerprint(source: object) -> str:
    """SHA-256 of the bytes: a dataset is the same if this and its name are."""
    return hashlib.sha256(payload_of(source)).hexdigest()


def head_of(spark: SparkSession, path: str) -> bytes:
    """First bytes of a file in any store that Spark reads; of a folder, those of its first file that has any."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).getFileStatus(where).isDirectory():
        first = spark.read.format("binaryFile").load(path).where("length > 0").agg(F.min("path")).first()[0]
        if first is None:
            return b""
        where = jvm.org.apache.hadoop.fs.Path(first)
    stream = where.getFileSystem(conf).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD)))
    finally:
        stream.close()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where the session names none (tests, a single machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or "file://" + tempfile.mkdtemp(prefix="tabscope-")


def placed(spark: SparkSession, payload: bytes) -> str:
    """Path of a file with these bytes in the folder that executors share."""
    path = f"{shared_folder(spark)}/upload-{uuid.uuid4().hex}.csv"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        stream.write(bytearray(payload))
    finally:
        stream.close()
    return path


def header_names(cells: list[str | None]) -> list[str]:
    """Blank names become "Unnamed: N", repeated ones get .1, .2 and so on."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for k, cell in enumerate(cells):
        name = str(cell).strip("﻿") if cell not in (None, "") else f"Unnamed: {k}"
        again = seen.get(name, 0)
        seen[name] = again + 1
        out.append(f"{name}.{again}" if again else name)
    return out


def typed(raw: DataFrame, decimal: str) -> DataFrame:
    """Text columns cast to whole numbers, numbers or booleans where all values are such."""
    clean = {c: F.when(~quoted(c).isin(*MISSING_TEXTS), quoted(c)) for c in raw.columns}
    dotted: dict[str, Column] = {}
    for c, x in clean.items():
        as_dot = F.replace(x, F.lit("."), F.lit("?")) if decimal == "," else x  # a dot is no decimal mark then
        dotted[c] = F.replace(as_dot, F.lit(","), F.lit(".")) if decimal == "," else x
    checks = []
    for k, c in enumerate(raw.columns):
        checks += [
            F.count(clean[c]).alias(f"n{k}"),
            F.count_if(F.coalesce(clean[c].rlike(WHOLE) & clean[c].try_cast("long").isNotNull(), F.lit(False))).alias(f"w{k}"),
            F.count_if(F.coalesce(dotted[c].rlike(DECIMAL), F.lit(False))).alias(f"d{k}"),
            F.count_if(F.coalesce(clean[c].rlike(BOOLEAN), F.lit(False))).alias(f"b{k}"),
        ]
    r = raw.agg(*checks).first()
    out = []
    for k, c in enumerate(raw.columns):
        n = r[f"n{k}"]
        if n and r[f"w{k}"] == n:
            cell = F.trim(clean[c]).try_cast("long")
        elif r[f"d{k}"] == n:
            cell = F.trim(dotted[c]).try_cast("double")
        elif r[f"b{k}"] == n:
            cell = clean[c].try_cast("boolean")
        else:
            cell = clean[c]
        out.append(cell.alias(c))
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str, head: bytes) -> DataFrame:
    """The table of a CSV file, or of a folder of them that each begin with the header; a large file is read by many tasks.

    Files in which no line break is quoted are split by Spark's own reader, others by
    ``blocks``; those whose lines end with a carriage return alone are read whole.
    """
    if not head.strip():
        raise ValueError("No columns to parse from file")
    sample, encoding = decoded(head)
    delimiter = delimiter_of(sample)
    names = header_names(next(csv.reader(StringIO(sample), delimiter=delimiter)))
    alone = "\r" in sample.replace("\r\n", "")
    found = None if alone else records(spark, path, delimiter, encoding)
    raw = of_records(found, len(names)) if found is not None else of_lines(spark, path, len(names), delimiter, encoding, alone)
    return typed(raw, decimal_of(sample, delimiter)).toDF(*names)


TOO_LONG = "Error tokenizing data: a row has more fields than the header."


def of_lines(spark: SparkSession, path: str, width: int, delimiter: str, encoding: str, whole: bool) -> DataFrame:
    fields = ", ".join(f"c{k} string" for k in range(width))
    raw = (
        spark.read.schema(f"{fields}, __corrupt string")
        .options(header=True, sep=delimiter, encoding=encoding, quote='"', escape='"', multiLine=whole, mode="PERMISSIVE")
        .options(columnNameOfCorruptRecord="__corrupt", enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    # a record longer than the header is an error; a shorter one is padded
    long = raw.where(F.col("__corrupt").isNotNull() & F.col(f"c{width - 1}").isNotNull())
    if long.select(*raw.columns).head(1):  # all columns: a parser that needs fewer doesn't see the others
        raise ValueError(TOO_LONG)
    return raw.drop("__corrupt")


def of_records(found: DataFrame, width: int) -> DataFrame:
    """The records but for each file's header, as columns c0, c1 ..., longer ones refused and shorter ones padded."""
    heads = found.groupBy("file").agg(F.min(ORDINAL).alias("head"), F.max(F.size("fields")).alias("longest")).collect()  # a row for each file
    if max(r["longest"] for r in heads) > width:
        raise ValueError(TOO_LONG)
    fields = [F.get("fields", F.lit(k)).alias(f"c{k}") for k in range(width)]
    if len(heads) == 1:
        return found.where(F.col(ORDINAL) > heads[0]["head"]).select(*fields)
    known = found.sparkSession.createDataFrame([(r["file"], r["head"]) for r in heads], "file long, head long")
    return found.join(F.broadcast(known), "file").where(F.col(ORDINAL) > F.col("head")).select(*fields)


def read_xlsx(spark: SparkSession, payload: bytes, sheet: int | str) -> DataFrame:
    rows = read_sheet(payload, sheet)
    if not rows:
        raise EmptyDatasetError("The dataset contains no columns.")
    names, cells = header_names(rows[0]), rows[1:]
    if not cells:
        raise EmptyDatasetError("The dataset contains no data rows.")
    kinds = []
    for k in range(len(names)):
        types = {type(r[k]) for r in cells if r[k] is not None}
        kind = "double"
        if types == {int}:
            kind = "bigint"
        elif types == {bool}:
            kind = "boolean"
        elif types and not types <= {int, float}:
            kind = "timestamp_ntz" if {t.__name__ for t in types} == {"datetime"} else "string"
        kinds.append(kind)
    cast = {"double": float, "string": str}
    data = [tuple(None if x is None else cast.get(kind, lambda v: v)(x) for x, kind in zip(r, kinds, strict=True)) for r in cells]
    return spark.createDataFrame(data, ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds))).toDF(*names)


def validated(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise EmptyDatasetError("The dataset contains no columns.")
    if df.isEmpty():
        raise EmptyDatasetError("The dataset contains no data rows.")
    return df


def read_dataset(spark: SparkSession, source: object, filename: str | None = None, *, sheet_name: int | str = 0) -> DataFrame:
    """A path (of any store Spark reads; a folder holds CSV files with one header each), bytes, or a stream."""
    name = filename_of(source, filename)
    kind = Path(name).suffix.lower()
    if kind not in SUPPORTED_EXTENSIONS | {PARQUET}:
        raise UnsupportedFileTypeError(f"Unsupported file type '{kind}'. Supported types are: {', '.join(sorted(SUPPORTED_EXTENSIONS))}.")
    try:
        if kind == PARQUET:
            return validated(spark.read.parquet(str(source)))
        if kind == ".xlsx":
            payload = payload_of(source) if not isinstance(source, (str, Path)) else spark.read.format("binaryFile").load(str(source)).first()["content"]
            return validated(read_xlsx(spark, bytes(payload), sheet_name))
        if isinstance(source, (str, Path)):
            return validated(read_csv(spark, str(source), head_of(spark, str(source))))
        payload = payload_of(source)  # a stream lives on the driver; Spark reads it from a file
        return validated(read_csv(spark, placed(spark, payload), payload[:HEAD]))
    except (EmptyDatasetError, UnsupportedFileTypeError, DatasetReadError):
        raise
    except Exception as error:
        raise DatasetReadError(f"Unable to read dataset '{name}'.") from error
