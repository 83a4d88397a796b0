"""S1-S7 - locale-aware CSV ingest, distributed.

Every check is a Spark aggregate over all lines (not a sample):
encoding (S2), delimiter consistency (S3/S4), missing-value tokens (S5),
decimal comma / thousands spaces (S6) and integer/float typing (S7).

A folder may hold files of different origin: encoding, delimiter and header are found for each file, in one scan, and
files of equal answers are read together (a job a group, not a file). Columns are matched by name between groups.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
ENCODINGS = ["utf-8", "cp1252"]
# pandas' default missing-value tokens plus the French conventions the reference adds.
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FRENCH_NA_TOKENS = ["N/D", "ND", "N/C", "NC", "NR", "Non renseigné", "n.d.", "n.d"]
THOUSANDS_SEPARATORS = ["\u202f", "\xa0", " "]
DELIMITERS = [",", ";", "\t"]
# Bytes that have no character in cp1252.
CP1252_UNDEFINED = ["81", "8D", "8F", "90", "9D"]
NUMERIC_SHARE = 0.9

INT_RE = r"^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SUPPORTED = {".csv": "csv", ".txt": "csv", ".tsv": "csv", ".parquet": "parquet"}


class UnsupportedFileFormatError(Exception):
    """Unknown extension, undecodable text or no consistent delimiter."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fields(line: Column, delimiter: str) -> Column:
    """Fields of a line: delimiters inside a quoted field don't count. A quote that doesn't open a field is text."""
    plain = F.replace(line, F.lit('""'), F.lit(""))
    bare = F.when(F.instr(line, '"') > 0, F.regexp_replace(plain, r'(^|[,;\t])"[^"]*"(?=[,;\t]|$)', "$1")).otherwise(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """S2-S4 for each file below ``path`` with a line that is not blank: ``file, n_lines, encoding, delimiter, header``.

    One scan of all lines; a file's state is a few counts. ``encoding``: utf-8 if each line is valid, else cp1252, null if
    a byte has no character there. ``delimiter``: the candidate that gives the header two fields or more and each line as
    many; the one with most fields wins; ',' if no candidate divides the header; null if none is consistent. All
    candidates are ASCII, so lines are counted before their encoding is known.
    """
    line = F.col("value")
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("_block"),
                                         F.monotonically_increasing_id().alias("_at")).where(F.trim(line) != "")
    counts = [c for i, d in enumerate(DELIMITERS) for c in (F.min(_fields(line, d)).alias(f"mn{i}"), F.max(_fields(line, d)).alias(f"mx{i}"))]
    undefined = F.expr(" OR ".join(f"contains(CAST(value AS BINARY), X'{x}')" for x in CP1252_UNDEFINED))
    # a block of a file is read in order by one task, so its first line has the least number of the least block
    each = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.bool_and(F.expr("is_valid_utf8(value)")).alias("valid"),
                                     F.bool_or(undefined).alias("undefined"), *counts,
                                     F.min_by(line, F.struct("_block", "_at")).alias("header"))
    head = [_fields(F.col("header"), d) for d in DELIMITERS]
    fits = [F.when((n >= 2) & (F.col(f"mn{i}") == n) & (F.col(f"mx{i}") == n), F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")))
            for i, (d, n) in enumerate(zip(DELIMITERS, head))]
    best = F.array_max(F.array_compact(F.array(*fits)))["d"]
    one_column = reduce(lambda x, y: x & y, [n < 2 for n in head])
    encoding = F.when(F.col("valid"), ENCODINGS[0]).when(~F.col("undefined"), ENCODINGS[1])
    return each.select("file", "n_lines", encoding.alias("encoding"), F.when(one_column, ",").otherwise(best).alias("delimiter"), "header")


def _groups(spark: SparkSession, path: str, encoding: str | None, sep: str | None) -> list[tuple[str, str, list[str]]]:
    """(encoding, delimiter, files) of files that can be read together: their header is the same too."""
    found = file_formats(spark, path)
    groups = found.groupBy("encoding", "delimiter", "header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not groups:
        raise UnsupportedFileFormatError(f"empty file: {path}")
    for g in groups:
        if encoding is None and g["encoding"] is None:
            raise UnsupportedFileFormatError(f"neither of {ENCODINGS} fits {g['files'][0]}")
        if sep is None and g["delimiter"] is None:
            raise UnsupportedFileFormatError(f"no consistent delimiter in {g['files'][0]}")
    return sorted((encoding or g["encoding"], sep or g["delimiter"], [_literal(f) for f in g["files"]]) for g in groups)


def _literal(uri: str) -> str:
    """A file's URI as a path for a reader: no character of it is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """Utf-8 unless some line is not valid UTF-8 (checked on every line), then cp1252."""
    ok = spark.read.text(path).agg(F.min(F.expr("is_valid_utf8(value)")).alias("ok")).first()["ok"]
    return "utf-8" if ok is None or ok else "cp1252"


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """S3/S4 of a file, or of a folder whose files agree."""
    found = {sep for _, sep, _ in _groups(spark, path, ENCODINGS[0], None)}
    if len(found) > 1:
        raise UnsupportedFileFormatError(f"files of different delimiters in {path}")
    return found.pop()


def _normalized(c):
    x = F.col(c)
    for s in THOUSANDS_SEPARATORS:
        x = F.replace(x, F.lit(s), F.lit(""))
    return F.replace(x, F.lit(","), F.lit("."))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None) -> DataFrame:
    """S1 (CSV branch) + S5-S7: a typed DataFrame from a header CSV, or a folder of them.

    ``encoding`` and ``sep``, where given, hold for all files; else each file has its own. Doubled quotes in a quoted
    field are one quote. A column that a file lacks is null in its rows; types are found over all files together.
    """
    if encoding is not None and sep is not None:
        groups = [(encoding, sep, path)]
    else:
        groups = _groups(spark, path, encoding, sep)
    parts = []
    for charset, delimiter, files in groups:
        if charset.lower() in ("cp1252", "windows-1252"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
            charset = "windows-1252"
        parts.append(spark.read.option("header", True).option("sep", delimiter).option("encoding", charset).option("escape", '"')
                     .option("inferSchema", False).option("nullValue", None).option("emptyValue", "")
                     .option("mode", "PERMISSIVE").csv(files))
    raw = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    na = PANDAS_NA_TOKENS + FRENCH_NA_TOKENS
    # NA tokens (compared on the stripped text, as a CSV reader does for unquoted fields)
    df = raw.select(*[F.when(F.trim(F.col(c)).isin(*na) | F.col(c).isNull(), F.lit(None).cast("string"))
                      .otherwise(F.col(c)).alias(c) for c in raw.columns])
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(c))
        aggs += [F.count(F.col(c)).alias(f"n{i}"),
                 F.count(F.when(v.rlike(INT_RE), v.try_cast("bigint"))).alias(f"i{i}"),
                 F.count(F.when(v.rlike(FLOAT_RE), 1)).alias(f"f{i}"),
                 F.count(F.when(v.rlike(INT_RE), 1)).alias(f"g{i}"),
                 F.count(F.when(F.trim(_normalized(c)).rlike(FLOAT_RE), 1)).alias(f"d{i}")]
    st = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        n, ni, nf, nd, digits = st[f"n{i}"], st[f"i{i}"], st[f"f{i}"], st[f"d{i}"], st[f"g{i}"]
        v = F.trim(F.col(c))
        if n and ni == n:
            out.append(v.cast("bigint").alias(c))                           # S7 integer
        elif n and digits == n:
            out.append(F.col(c))                                            # whole numbers beyond 64 bits stay text
        elif n and nf == n:
            out.append(v.cast("double").alias(c))                           # S7 float
        elif n and nd / n >= NUMERIC_SHARE:                                 # S6 decimal comma
            nv = F.trim(_normalized(c))
            out.append(F.when(nv.rlike(FLOAT_RE), nv.cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def import_file(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension; missing file and unknown extension raise."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    kind = SUPPORTED.get(ext)
    if kind is None:
        raise UnsupportedFileFormatError(f"unsupported file format: {ext or path}")
    if kind == "parquet":
        return spark.read.parquet(path)
    return read_csv(spark, path)
