"""CSV sources: encodings per file, separators, long lines, line repair, ZIP members, null tokens
and type inference over all rows (SRC1-SRC6, SRC11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import col, tidy_names
from ..functions.schema import quoted
from ..session import settle
from .charset import charset_lines

# Cell texts read as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SEPARATORS = [",", ";", "\t", "|"]
RAGGED = "_corrupt_record"


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """Encoding per file under a path, decided by every line of it (SRC2): path, length, encoding.

    Files are read as lines, in splits; a line is checked where it is read and only flags leave it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        (F.col("_metadata.file_block_start") == 0).alias("first_block"),
        F.col("value").cast("binary").alias("head"),
    )
    return encoding_of(lines)


def encoding_of(lines: DataFrame) -> DataFrame:
    """Encoding of each ``path`` from its lines (path, length, head): marked UTF-8 or UTF-16, valid UTF-8
    throughout, else Windows-1252 if a line that is not valid UTF-8 has bytes that are control characters in
    Latin-1 and letters there, else Latin-1. A mark can only begin a file's first line; the bytes FE and FF that start
    the UTF-16 mark never occur in UTF-8 text."""
    start = F.hex(F.substring("head", 1, 3))
    marked = start.startswith("FFFE") | start.startswith("FEFF")
    if "first_block" in lines.columns:
        marked = marked & F.col("first_block")
    valid = F.is_valid_utf8(F.col("head").cast("string"))
    letters = ~valid & F.hex("head").rlike("^(..)*[89]")
    encoding = (
        F.when(F.bool_or(marked), "utf-16")
        .when(F.bool_and(valid), "utf-8")
        .when(F.bool_or(letters), "windows-1252")
        .otherwise("iso-8859-1")
    )
    return lines.groupBy("path").agg(F.max("length").alias("length"), encoding.alias("encoding"))


def sniff_separator(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """Separator that occurs equally often, and most often, in all lines (SRC3); one aggregate."""
    lines = _lines(spark, path, encoding)
    counts = [
        F.struct(F.min(_times("value", s)).alias("low"), F.max(_times("value", s)).alias("high"), F.avg(_times("value", s)).alias("mean")).alias(f"s{i}")
        for i, s in enumerate(SEPARATORS)
    ]
    row = lines.filter(F.trim("value") != "").agg(*counts).first()
    best, best_rank = ",", (False, 0.0)
    for i, s in enumerate(SEPARATORS):
        c = row[f"s{i}"]
        if c["mean"]:
            rank = (c["low"] == c["high"], c["mean"])
            if rank > best_rank:
                best, best_rank = s, rank
    return best


def _times(column: str, separator: str) -> Column:
    return F.length(col(column)) - F.length(F.replace(col(column), F.lit(separator), F.lit("")))


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines of text files. Other encodings than UTF-8 are read as one wide CSV column."""
    if encoding.lower() in ("utf-8", "utf8"):
        return spark.read.text(path)
    return spark.read.csv(
        path, schema="value string", sep="\u0001", encoding=encoding, quote="", escape="", mode="PERMISSIVE"
    )


def scan_csv(
    spark: SparkSession, path: str | list[str], encoding: str = "utf-8", sep: str = ",", multiline: bool = False,
    skip_long_lines: bool = True, infer: bool = True, skip_initial_space: bool = False,
) -> DataFrame:
    """CSV with header as a typed table (SRC1, SRC4, SRC7, SRC11).

    Cells are scanned as text; rows with more cells than the header leave (or are cut), shorter
    rows are filled with nulls.
    """
    options = {
        "header": True, "sep": sep, "encoding": encoding, "multiLine": multiline, "escape": '"',
        "ignoreLeadingWhiteSpace": skip_initial_space, "ignoreTrailingWhiteSpace": False,
        # a row can only be seen to be too long if all its cells are parsed
        "columnPruning": False,
    }
    reader = spark.read.format("csv").options(**options)
    header = reader.load(path).schema
    fields = [T.StructField(f.name, T.StringType()) for f in header]
    schema = T.StructType([*fields, T.StructField(RAGGED, T.StringType())])
    raw = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=RAGGED).schema(schema).load(path)
    if skip_long_lines:
        # separators outside of quotes tell how many cells a marked row has
        bare = raw.withColumn("__bare", F.regexp_replace(RAGGED, '"[^"]*"', ""))
        # a named cell takes part, for Spark refuses scans that read nothing but the mark
        spaces = F.coalesce(_times("__bare", sep), F.length(col(fields[0].name)) * 0, F.lit(0))
        raw = bare.filter(spaces < len(fields)).drop("__bare")
    table = tidy_names(raw.drop(RAGGED))
    return infer_types(null_tokens(table)) if infer else null_tokens(table)


def scan_csv_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """All CSV files under a path, each read in its own encoding, by name (SRC2).

    Files are grouped by encoding: as many scans as there are encodings, not as there are files. UTF-16 and Windows-1252
    are read as lines in byte ranges, so a cell of such a file cannot hold a line end; files of one header are one scan.
    """
    groups = file_encodings(spark, path).groupBy("encoding").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    parts = []
    for r in groups.orderBy("encoding").collect():
        if r["encoding"] in ("utf-8", "iso-8859-1"):
            parts.append(scan_csv(spark, r["paths"], encoding=r["encoding"], infer=False, **options))
        else:
            lines = settle(charset_lines(spark, r["paths"], r["encoding"]))
            parts += line_tables(lines, options.get("sep", ","))
    if not parts:
        raise ValueError(f"no files under {path}")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return infer_types(table)


def line_tables(lines: DataFrame, sep: str) -> list[DataFrame]:
    """The files of ``lines`` (path, split, number, value) as tables of text, one for each different header."""
    first = (F.col("split") == 0) & (F.col("number") == 0)
    heads = lines.filter(first).select("path", F.col("value").alias("__head"))
    layouts = [r["__head"] for r in heads.select("__head").distinct().orderBy("__head").collect()]  # a row a layout
    body = lines.filter(~first).join(heads, "path")
    return [cells_of(body.filter(F.col("__head") == F.lit(head)).select("value"), head, sep) for head in layouts]


def null_tokens(df: DataFrame) -> DataFrame:
    """Text cells that spell a missing value become null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~col(c).isin(NULL_TOKENS), col(c)) for c in texts}) if texts else df


def infer_types(df: DataFrame) -> DataFrame:
    """Narrowest type every present cell of a text column fits: boolean, bigint, double, else text.

    One aggregate over all rows decides all columns. A column without cells is double.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    whole, decimal = r"^\s*[-+]?\d{1,18}\s*$", r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$|^\s*[-+]?(inf|Infinity)\s*$"
    parts = []
    for i, c in enumerate(texts):
        cell = col(c)
        parts += [
            F.count(cell).alias(f"n{i}"),
            F.bool_and(cell.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
            F.bool_and(cell.rlike(whole)).alias(f"w{i}"),
            F.bool_and(cell.rlike(decimal)).alias(f"d{i}"),
        ]
    row = df.agg(*parts).first()
    typed = {}
    for i, c in enumerate(texts):
        trimmed = F.trim(col(c))
        if not row[f"n{i}"]:
            typed[c] = F.lit(None).cast("double")
        elif row[f"b{i}"]:
            typed[c] = trimmed.cast("boolean")
        elif row[f"w{i}"]:
            typed[c] = trimmed.cast("bigint")
        elif row[f"d{i}"]:
            typed[c] = F.regexp_replace(trimmed, "^([-+]?)inf$", "$1Infinity").cast("double")
    return df.withColumns(typed) if typed else df


def repaired_lines(lines: DataFrame) -> DataFrame:
    """Lines stripped, without blanks and trailing commas, with balanced quotes (SRC5)."""
    text = F.regexp_replace(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")), ",+$", "")
    quotes = F.length(F.regexp_replace(text, '[^"]', ""))
    return (
        lines.filter(F.trim("value") != "")
        .withColumn("value", F.when(quotes % 2 == 1, F.concat(text, F.lit('"'))).otherwise(text))
        .filter("value != ''")
    )


def parse_lines(lines: DataFrame, header: str, sep: str = ",") -> DataFrame:
    """Lines of one layout, without header lines, as a typed table; lines with too many cells leave."""
    return infer_types(cells_of(lines, header, sep))


def cells_of(lines: DataFrame, header: str, sep: str) -> DataFrame:
    """The cells of lines as text, missing ones null."""
    names = [n.strip().strip('"') for n in header.split(sep)]
    spare = "__spare"
    schema = ", ".join(f"{quoted(n)} string" for n in [*names, spare])
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
    parsed = lines.select(F.from_csv("value", schema, options).alias("row")).select("row.*")
    return null_tokens(tidy_names(parsed.filter(F.col(spare).isNull()).drop(spare)))


def scan_broken_csv(
    spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",", header: str | None = None
) -> DataFrame:
    """Line-by-line reading of malformed files (SRC5). All files share one header line, by default
    the first line of the first file.

    One header line of each file leaves; further lines that read like it are rows. As equal lines are
    interchangeable, it does not matter which one of them leaves.
    """
    lines = repaired_lines(_lines(spark, path, encoding).select("value", F.col("_metadata.file_path").alias("file")))
    header = header or lines.first()["value"]
    alike = lines.filter(F.col("value") == F.lit(header)).groupBy("file", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = alike.filter("n > 1").select("value", F.explode(F.expr("sequence(2, n)"))).select("value")
    return parse_lines(lines.filter(F.col("value") != F.lit(header)).select("value").unionByName(rows), header, sep)


def scan_zip_csv(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """Typed table of the first CSV member of every archive under a path; they share one header line (SRC6).

    Each archive is opened once, by the task that unpacks it: its lines are written, and header, types and rows come from
    what was written.
    """
    paths = path if isinstance(path, list) else [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]
    lines = settle(charset_lines(spark, paths, encoding))
    header = repaired_lines(lines.filter("number = 0").orderBy("path").limit(1).select("value")).first()["value"]
    return parse_lines(repaired_lines(lines.filter("number > 0").select("value")), header, sep)


def table_metadata(df: DataFrame, roles: dict[str, str] | None = None, bytes_read: int | None = None) -> DataFrame:
    """Rows, columns, names, types, roles and size as rows (item, value) (SRC9)."""
    from ..operators.profile import rows_frame

    rows = [("rows", str(df.count())), ("columns", str(len(df.columns)))]
    rows += [(f"type of {n}", t) for n, t in df.dtypes]
    rows += [(f"role of {c}", r) for c, r in (roles or {}).items()]
    if bytes_read is not None:
        rows.append(("size_kb", f"{bytes_read / 1024:.2f}"))
    return rows_frame(df.sparkSession, rows, "item string, value string")
