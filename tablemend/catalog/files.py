"""Source and sink queries: the given tables written as text to the shared folder and read back."""

import io
import math
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators.roles import detect_roles
from ..session import shared_folder
from ..sinks import versions
from ..sources import csv
from ..sources.charset import opened
from .registry import damaged_sql, defective, register, table


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_SQL = "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from {0}"


@register("csv_scan", damaged_sql("customer") + " " + CUSTOMER_SQL.format("d"))
def csv_scan(spark, folder):
    """Missing numbers are spelled NA and null in turn, missing text is blank."""
    damaged = defective(spark, folder, "customer")
    spelled = F.coalesce(F.col("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "NA").otherwise("null"))
    path = _scratch(spark)
    damaged.withColumn("c_acctbal", spelled).fillna("", ["c_mktsegment"]).write.option("emptyValue", "").csv(path, header=True)
    return csv.scan_csv(spark, path)


@register("csv_long_lines", CUSTOMER_SQL.format("customer where c_custkey % 7 <> 0"))
def csv_long_lines(spark, folder):
    cells = [F.col(c).cast("string") for c in CUSTOMER]
    line = F.concat_ws(",", *cells, F.when(F.col("c_custkey") % 7 == 0, "spare"))
    path = _scratch(spark)
    rows = table(spark, folder, "customer").select(line.alias("value"))
    # a file a part of the table, each with the header first
    head = F.when(F.col("n") == 0, F.array(F.lit(",".join(CUSTOMER)), "value")).otherwise(F.array("value"))
    first = rows.withColumn("n", F.monotonically_increasing_id() % (1 << 33))
    first.select(F.explode(head).alias("value")).write.text(path)
    return csv.scan_csv(spark, path)


@register("csv_dialect", CUSTOMER_SQL.format("customer"))
def csv_dialect(spark, folder):
    path = _scratch(spark)
    table(spark, folder, "customer").write.csv(path, header=True, sep=";")
    return csv.scan_csv(spark, path, sep=csv.sniff_separator(spark, path), skip_initial_space=True)


@register("csv_repair_scan", CUSTOMER_SQL.format("customer"))
def csv_repair_scan(spark, folder):
    """Quotes left open, trailing commas and blank lines between."""
    key = F.col("c_custkey")
    line = F.concat(
        F.concat_ws(",", key, "c_nationkey", "c_acctbal", "c_mktsegment"),
        F.lit(',"'), F.col("c_name"),
        F.when(key % 3 == 0, "").otherwise('"'), F.when(key % 5 == 0, ",,").otherwise(""), F.when(key % 4 == 0, "\n").otherwise(""),
    )
    path = _scratch(spark)
    table(spark, folder, "customer").select(line.alias("value")).write.text(path)
    header = "c_custkey,c_nationkey,c_acctbal,c_mktsegment,c_name"
    return csv.scan_broken_csv(spark, path, header=header).select(*CUSTOMER)


@register(
    "encoding_scan",
    r"""select doc_id, case when doc_id % 2 = 0 or not regexp_matches(text, '[\x{80}-\x{FF}]')
    then 'utf-8' else 'iso-8859-1' end as encoding from documents""",
)
def encoding_scan(spark, folder):
    narrow = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(narrow)
    files = table(spark, folder, "documents").select(
        F.col("doc_id").alias("path"), F.octet_length(content).alias("length"), content.alias("head")
    )
    return csv.encoding_of(files).select(F.col("path").alias("doc_id"), "encoding")


@register("encoded_folder_scan", "select doc_id, lang, replace(text, chr(10), ' ') as line from documents")
def encoded_folder_scan(spark, folder):
    """Half of the rows are written as UTF-8, half as Latin-1; both come back alike."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"))
    path = _scratch(spark)
    wide = F.col("line").rlike(r"[^\x00-\xff]")
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.filter((F.col("doc_id") % 2 == 0) | wide).write.options(**kept).csv(f"{path}/a")
    rows.filter((F.col("doc_id") % 2 == 1) & ~wide).write.options(**kept, encoding="ISO-8859-1").csv(f"{path}/b")
    return csv.scan_csv_folder(spark, f"{path}/*/*.csv").withColumn("line", F.coalesce("line", F.lit("")))


@register("zip_csv_scan", CUSTOMER_SQL.format("customer"))
def zip_csv_scan(spark, folder):
    """One archive per thousand customers in the shared folder, each with a text file before its CSV member."""
    bins = table(spark, folder, "customer").withColumn("bin", F.floor(F.col("c_custkey") / 1000).cast("string"))
    path = _scratch(spark)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("about.txt", "customers")
            archive.writestr("customers.csv", rows[CUSTOMER].to_csv(index=False))
        return pd.DataFrame({"path": [put(path, f"{rows['bin'].iloc[0]}.zip", packed.getvalue())]})

    written = bins.groupBy("bin").applyInPandas(pack, "path string").collect()
    return csv.scan_zip_csv(spark, sorted(r["path"] for r in written))


def put(folder: str, name: str, raw: bytes) -> str:
    """Write a file of a task to the shared folder; a task that runs again writes the same file again."""
    system, place = opened(f"{folder.rstrip('/')}/{name}")
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(raw)
    return f"{folder.rstrip('/')}/{name}"


#: Bytes of text of a written file; a task holds one file.
FILE_BYTES = 4 << 20


@register("charset_folder_scan", "select doc_id, lang, replace(regexp_replace(text, '[\x80-\x9F]', '?', 'g'), chr(10), ' ') as line from documents")
def charset_folder_scan(spark, folder):
    """A third of the rows is written as UTF-16, a third as Windows-1252 and a third as UTF-8; all come back alike."""
    clean = F.regexp_replace("text", "[\\x{80}-\\x{9f}]", "?")
    rows = table(spark, folder, "documents").select("doc_id", "lang", F.replace(clean, F.lit("\n"), F.lit(" ")).alias("line"))
    charset = F.element_at(F.array(F.lit("utf-16"), F.lit("windows-1252"), F.lit("utf-8")), F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int") + 1)
    path = _scratch(spark)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        charset = rows["charset"].iloc[0]
        cells = rows[["doc_id", "lang", "line"]]
        if charset == "windows-1252":
            # what the charset lacks stays in a file of its own, and the euro sign tells the charset
            fits = cells["line"].map(lambda t: t is None or t.encode("cp1252", "ignore").decode("cp1252") == t)
            cells, rest = cells[fits], cells[~fits]
            if len(rest):
                put(path, f"{rows['part'].iloc[0]}-rest.csv", rest.to_csv(index=False).encode())
            cells = pd.concat([cells, pd.DataFrame({"doc_id": [-1], "lang": ["\u20ac"], "line": [""]})])
        put(path, f"{rows['part'].iloc[0]}-{charset}.csv", cells.to_csv(index=False).encode("cp1252" if charset == "windows-1252" else charset))
        return pd.DataFrame({"path": [charset]})

    size = table(spark, folder, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(4, math.ceil(size / (3 * FILE_BYTES)))
    parted = rows.withColumn("charset", charset).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(files)).cast("string"))
    parted.groupBy("charset", "part").applyInPandas(pack, "path string").collect()
    found = csv.scan_csv_folder(spark, f"{path}/*.csv")
    return found.filter("doc_id >= 0").select("doc_id", "lang", F.coalesce("line", F.lit("")).alias("line"))


@register(
    "table_metadata",
    """select 'rows' as item, cast(count(*) as varchar) as value from customer union all select 'columns', '5'
    union all select * from (values ('type of c_custkey', 'bigint'), ('type of c_name', 'string'), ('type of c_nationkey', 'int'),
    ('type of c_acctbal', 'double'), ('type of c_mktsegment', 'string'), ('role of c_custkey', 'numerical'),
    ('role of c_name', 'identifier'), ('role of c_nationkey', 'numerical'), ('role of c_acctbal', 'numerical'),
    ('role of c_mktsegment', 'target'))""",
)
def table_metadata(spark, folder):
    customers = table(spark, folder, "customer")
    return csv.table_metadata(customers, detect_roles(customers))


@register(
    "versioned_snapshots",
    damaged_sql("orders")
    + """ select 'before' as version, count(*) as n from d union all select 'after', count(*) from (select distinct * from d)""",
)
def versioned_snapshots(spark, folder):
    before = defective(spark, folder, "orders")
    path = _scratch(spark)
    versions.write_version(path, "before", {"orders": before})
    versions.write_version(path, "after", {"orders": before.dropDuplicates()})
    return spark.read.parquet(f"{path}/orders").groupBy("version").agg(F.count(F.lit(1)).alias("n"))
