"""Readers: tags, chunks, source trees, stores."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Store

CHUNK_FIELDS = "schema_version int, symbol string, symbol_type string, symbol_id string, ctags_kind string, file string, start_line int, end_line int, code string, content string, source string"


def read_tag_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value); a missing file has no lines. seq grows with the position."""
    try:
        return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).select("seq", "value")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "seq long, value string")
        raise


def shaped_chunks(rows: DataFrame, index_pass: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with code and id filled in. The index pass prefers content, the compile pass code; a row with neither id nor symbol goes."""
    order = ("content", "source", "code") if index_pass else ("code", "content", "source")
    code = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in order))
    known = F.when(F.col("symbol").isNotNull(), F.concat(F.lit("func:"), "file", F.lit(":"), "symbol"))
    out = rows.select(*keep, "file", "symbol", F.coalesce("symbol_id", known).alias("symbol_id"), "symbol_type", F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"), code.alias("code"))
    return out if index_pass else out.filter("symbol_id is not null")


def read_chunks(spark: SparkSession, path: str, index_pass: bool = False) -> DataFrame:
    return shaped_chunks(spark.read.schema(CHUNK_FIELDS).json(path), index_pass)


def parse_chunks(lines: DataFrame, column: str = "value", index_pass: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """As read_chunks, of JSON strings in a column; the columns ``keep`` stay beside them."""
    return shaped_chunks(lines.select(*keep, F.from_json(column, CHUNK_FIELDS).alias("c")).select(*keep, "c.*"), index_pass, keep)


def read_sources(spark: SparkSession, root: str, folders: tuple[str, ...] = ("drivers", "include")) -> DataFrame:
    """(file, text) of .c and .h files below the folders; paths are relative to root."""
    paths = [f"{root}/{f}" for f in folders]
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,h}").text(paths)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{root.rstrip('/')}/", "").alias("file"), F.col("value").alias("text"))


def read_listed(spark: SparkSession, root: str, files: tuple[str, ...]) -> DataFrame:
    """Only the listed files; missing ones are skipped."""
    store = Store(spark, root)
    there = [f"{root}/{f}" for f in files if store.exists(f)]
    if not there:
        return spark.createDataFrame([], "file string, text string")
    rows = spark.read.option("wholetext", True).text(there)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{root.rstrip('/')}/", "").alias("file"), F.col("value").alias("text"))


def mock_chunks(spark: SparkSession) -> DataFrame:
    """Two records: a global list, and a function with a safe iteration, a lock and a call."""
    code = "int mock_work(struct list_head *head, int flags)\n{\n\tstruct item *pos;\n\tstruct item *next;\n\tspin_lock(&table_lock);\n\tlist_for_each_entry_safe(pos, next, head, node) {\n\t\ttouch(pos);\n\t}\n}\n"
    return spark.createDataFrame([(0, None, None, "mock/globals.c", 1, "LIST_HEAD(mock_list);"), (1, "func:mock/work.c:mock_work", "mock_work", "mock/work.c", 1, code)], "seq long, symbol_id string, symbol string, file string, start_line int, code string")


def table_names(spark: SparkSession, root: str) -> list[str]:
    """Parquet tables below a folder."""
    return [n for n in Store(spark, root).names() if n.endswith(".parquet")]


def describe_store(spark: SparkSession, root: str) -> DataFrame:
    """Tables below a folder: columns, rows, and bytes stored."""
    store, rows = Store(spark, root), []
    for name in table_names(spark, root):
        df = spark.read.parquet(f"{root}/{name}")
        rows.append((name.removesuffix(".parquet"), ", ".join(df.columns), df.count(), store.size(name)))
    return spark.createDataFrame(rows, "name string, columns string, rows long, bytes long")


def sample_rows(table: DataFrame, order: str, most: int = 25) -> DataFrame:
    """The first rows of a registry."""
    return table.orderBy(order).limit(most)


def commit_of(root: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"
