"""Writers: chunks, graph exports, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def graph_json(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON line a symbol, with its outgoing edges in order."""
    out = edges.groupBy(F.col("src").alias("symbol_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "dst", "edge_type", "confidence"))).alias("edges"))
    return symbols.join(out, "symbol_id", "left").select(F.to_json(F.struct("symbol_id", "file_path", "symbol_name", "subsystem", "edges")).alias("value"))


def name_keys(symbols: DataFrame) -> DataFrame:
    """Each name with the symbols that have it, by file."""
    keys = F.transform(F.sort_array(F.collect_list(F.struct("file_path", "symbol_id"))), lambda x: x["symbol_id"])
    return symbols.groupBy("symbol_name").agg(keys.alias("keys"))


def edge_dump(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.filter(F.col("src") == symbol).select("dst", "edge_type", "confidence")


def fact_report(facts: DataFrame) -> DataFrame:
    """A printable line a fact, in timeline order within its function. Functions are in no order: to sort all would
    take the facts twice, once for the bounds of the ranges."""
    line = F.format_string("%5d %-14s %s", "line", "domain", "semantic_id")
    rows = facts.select("symbol_id", "line", "domain", "semantic_id").repartition("symbol_id")
    return rows.sortWithinPartitions("symbol_id", "line", "semantic_id").select("symbol_id", line.alias("report"))


def symbol_report(locals_: DataFrame) -> DataFrame:
    """A printable line a parameter or local, in the order of declaration."""
    line = F.format_string("%5d %-9s %s %s%s", "line", "storage", "type.type_name", F.repeat(F.lit("*"), F.col("type.pointer_level")), "name")
    return locals_.orderBy("symbol_id", "ordinal").select("symbol_id", line.alias("report"))


def collection_report(collections: DataFrame) -> DataFrame:
    line = F.format_string("%s: %s (%s) in %s", "name", "family", "declaration_macro", "declaration_file")
    return collections.orderBy("name").select(line.alias("report"))


def stamps() -> dict[str, Column]:
    """The present time as reports and file names have it."""
    now = F.current_timestamp()
    return {"iso": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "plain": F.date_format(now, "yyyy-MM-dd HH:mm:ss"), "file": F.date_format(now, "yyyyMMdd_HHmmss")}


def save_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[-1]).cast("string").alias("value")).write.mode("overwrite").text(path)
