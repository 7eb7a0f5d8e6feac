"""Tables of the compiled store: nodes, edges, symbols, vocabularies, and their write rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import node_id


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of the rows of a key, the last by order."""
    names = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*names), F.struct(*order)) if names else F.lit(None)
    return rows.groupBy(*keys).agg(newest.alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in names])


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in names])


def insert_ignore(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source_id", "target_id", "edge_kind"])


def connect(edges: DataFrame) -> DataFrame:
    """Typed edges with no zero end; kinds in upper case; each once."""
    ok = (F.col("source_id") != 0) & (F.col("target_id") != 0)
    return insert_ignore(edges.filter(ok).withColumn("edge_kind", F.upper("edge_kind")))


def intern(values: DataFrame, value: str, order: str, empty_zero: bool = True, ranges: int | None = None) -> DataFrame:
    """Dense ids from 1 in order of first appearance; '' is 0.

    Ids are counted within ranges of first appearance (twice the session's shuffle partitions, unless
    given), then offset by the ranges before: the only single-task step is over one row a range.
    """
    ranges = ranges or min(10_000, 2 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first"))
    named = first.filter(F.col("value") != "") if empty_zero else first
    bounds = named.select(F.percentile_approx("first", [i / ranges for i in range(1, ranges)], 10_000).alias("b"))
    part = F.size(F.filter("b", lambda x: x < F.col("first")))
    dealt = named.crossJoin(F.broadcast(bounds)).withColumn("part", part).drop("b")  # bounds is one row
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("first", "value")))
    out = ranked.join(F.broadcast(sizes), "part").select((F.col("before") + F.col("rank")).cast("long").alias("id"), "value")
    return out.union(first.filter(F.col("value") == "").select(F.lit(0).cast("long").alias("id"), "value")) if empty_zero else out


def display_token() -> Column:
    last = F.element_at(F.split("semantic_id", ":", -1), -1)
    named = F.when(F.col("domain").isin("Call", "Synchronization"), F.col("name"))
    return F.coalesce(named, F.nullif(last, F.lit("")), F.lit("unknown"))


def node_rows(facts: DataFrame) -> DataFrame:
    """One row per fact; facts of one identity collapse to the last."""
    kind = F.coalesce("category", F.lit("unknown"))
    ident = node_id(F.col("domain"), F.col("file"), F.lit("global"), F.col("semantic_id"), kind)
    payload = F.to_json(F.struct(F.col("semantic_id").alias("symbol"), F.lit("global").alias("scope_coord"), F.col("domain").alias("domain")))
    rows = facts.select(ident.alias("node_id"), kind.alias("ontology_kind"), "fact_type", "file", display_token().alias("token"), F.col("line").alias("line_number"), F.lit(1).alias("metadata_version"), payload.alias("metadata_payload"), "symbol_id", "extractor", "ordinal")
    return last_wins(rows, ["node_id"], ["extractor", "ordinal", "symbol_id"]).drop("extractor", "ordinal")


def edge_rows(relationships: DataFrame) -> DataFrame:
    """Relationships as edges between node ids, which they carry; each once. Edges without a target go."""
    return insert_ignore(relationships.select("source_id", "target_id", F.col("type").alias("edge_kind")).filter("target_id is not null"))


def symbol_rows(locals_: DataFrame) -> DataFrame:
    """Keyed by function, name and place, so that repeated names stay apart."""
    key = F.concat_ws(":", "symbol_id", "name", "ordinal")
    return locals_.select(key.alias("symbol_key"), "name", F.col("type.type_name").alias("type"), F.col("symbol_id").alias("scope_id"), "file")


def assignment_payload(facts: DataFrame) -> DataFrame:
    """JSON of op, kind, lhs, rhs, for assignments that name an operator and a target."""
    rows = facts.filter((F.col("domain") == "Assignment") & (F.length(F.trim("expr")) > 0) & (F.col("operator") != ""))
    payload = F.struct(F.col("operator").alias("op"), F.col("kind").alias("kind"), F.col("expr").alias("lhs"), F.coalesce("rhs", F.lit("")).alias("rhs"))
    return rows.select("symbol_id", "semantic_id", F.to_json(payload).alias("payload"))


def write_table(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.mode("overwrite").parquet(path)


def megabytes(size: int | float) -> float:
    return round(size / 1048576, 3)


def rate(rows: int, seconds: float) -> float:
    """Rows a second; a run of no time counts as a millisecond."""
    return round(rows / max(seconds, 0.001), 1)


def report(rows: dict[str, int], sizes: dict[str, int], seconds: dict[str, float], **facts: object) -> dict[str, object]:
    """A run's manifest: rows, MB and seconds of each part, their sums, and the given facts."""
    total = sum(seconds.values())
    return {
        **facts,
        "rows": rows,
        "megabytes": {name: megabytes(n) for name, n in sizes.items()},
        "phases": {name: {"seconds": round(s, 3), "share": round(s / max(total, 0.001), 4), "rows_a_second": rate(rows.get(name, 0), s)} for name, s in seconds.items()},
        "total_rows": sum(rows.values()),
        "total_megabytes": megabytes(sum(sizes.values())),
        "seconds": round(total, 3),
    }


def merge_upsert(stored: DataFrame | None, fresh: DataFrame, keys: list[str], batch: int) -> DataFrame:
    """stored and fresh rows with one row a key, that of the latest batch; a batch that is replayed changes nothing."""
    fresh = fresh.withColumn("batch", F.lit(batch).cast("long"))
    every = fresh if stored is None else stored.unionByName(fresh)
    return last_wins(every, keys, ["batch"]).select(*fresh.columns)
