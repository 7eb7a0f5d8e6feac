"""Relationships between the facts of one function: writes, describes, matches, protects."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import node_id

EXPLOSION = 5000
_COLUMNS = ("symbol_id", "file", "line", "type", "source_semantic_id", "target_semantic_id", "relationship_id", "source_id", "target_id")

#: Columns of facts that relationships of this module are made of.
USED = ("symbol_id", "file", "semantic_id", "fact_type", "domain", "category", "line", "name", "resolved", "extractor", "ordinal")


def _edge_id(file: Column, line: Column, kind: str, tail: Column) -> Column:
    return F.concat_ws(":", F.lit("rel"), file, line, F.lit(kind), tail)


def fact_node() -> Column:
    """The node id of a fact, from its own columns: no relationship has to look it up."""
    return node_id(F.col("domain"), F.col("file"), F.lit("global"), F.col("semantic_id"), F.coalesce("category", F.lit("unknown")))


def writes(facts: DataFrame) -> DataFrame:
    """Assignments whose root is a known local, to that local's URI."""
    rows = facts.filter((F.col("domain") == "Assignment") & F.col("resolved").isNotNull())
    target = F.concat_ws(":", F.lit("sym"), F.col("file"), F.replace("symbol_id", F.lit("func:"), F.lit("")), F.col("resolved"))
    return rows.select(
        "symbol_id", "file", "line", F.lit("writes").alias("type"),
        F.col("semantic_id").alias("source_semantic_id"), target.alias("target_semantic_id"),
        _edge_id(F.col("file"), F.col("line"), "writes", F.col("resolved")).alias("relationship_id"),
        fact_node().alias("source_id"), node_id(F.lit("symbol"), F.col("file"), F.col("symbol_id"), target, F.lit("local")).alias("target_id"),
    )


def describes(facts: DataFrame) -> DataFrame:
    """Lock facts and calls on one line, where one's name is part of the other's. The facts of a line are brought together once."""
    rows = facts.filter(F.col("domain").isin("Synchronization", "Call"))
    item = F.struct(F.col("semantic_id").alias("id"), "name", fact_node().alias("node"))
    lines = rows.groupBy("symbol_id", "file", "line").agg(*(F.collect_list(F.when(F.col("domain") == d, item)).alias(n) for d, n in (("Synchronization", "locks"), ("Call", "calls"))))
    pairs = lines.filter("size(locks) > 0 and size(calls) > 0").select("symbol_id", "file", "line", F.explode("locks").alias("s"), "calls").select("symbol_id", "file", "line", "s", F.explode("calls").alias("c"))
    both = pairs.filter(F.col("s.id").contains(F.col("c.name")) | F.col("c.name").contains(F.col("s.name")))
    return both.select(
        "symbol_id", "file", "line", F.lit("describes").alias("type"),
        F.col("s.id").alias("source_semantic_id"), F.col("c.id").alias("target_semantic_id"),
        _edge_id(F.col("file"), F.col("line"), "describes", F.col("c.name")).alias("relationship_id"),
        F.col("s.node").alias("source_id"), F.col("c.node").alias("target_id"),
    )


def scopes(facts: DataFrame, timeline: str = "source", explosion: int | None = None) -> DataFrame:
    """matches and protects edges of each function's facts, over a stack of open guards.

    A closer pops the guard opened last, whatever its lock; one that finds no guard is ignored.
    ``source`` order is (line, semantic_id); ``extractor`` is the order of discovery: loops, calls,
    locks, assignments, read sections. The stack's depth is a running sum, held at 0 from below. At one
    depth openers and closers alternate, so the guard of a closer, or of a fact at any depth up to its
    own, is the last opener of that depth. Functions with more than ``explosion`` edges are left out
    before any edge is made.
    """
    opens = F.col("fact_type").isin("LockAcquire", "RcuReadLock")
    closes = F.col("fact_type").isin("LockRelease", "RcuReadUnlock")
    role = F.when(opens, "o").when(closes, "c").when(F.col("domain").isin("Assignment", "Call", "RCU"), "n")
    order = ["line", "semantic_id", "ordinal"] if timeline == "source" else ["extractor", "ordinal"]
    rows = facts.select("symbol_id", "file", "line", "semantic_id", "ordinal", "extractor", role.alias("role"), fact_node().alias("node")).filter("role is not null")
    function = Window.partitionBy("symbol_id", "file")
    ordered = function.orderBy(*order, "role", "semantic_id", "line")  # one order for all that follows, so rows are sorted once
    along = ordered.rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("role") == "o", 1).when(F.col("role") == "c", -1).otherwise(0)
    rows = rows.withColumn("sum", F.sum(delta).over(along)).withColumn("place", F.row_number().over(ordered))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(along)))
    rows = rows.withColumn("before", F.lag("depth", 1, 0).over(ordered))
    if explosion is not None:
        own = F.when(F.col("role") == "n", F.col("depth")).when((F.col("role") == "c") & (F.col("before") > 0), 1).otherwise(0)
        rows = rows.withColumn("edges", F.sum(own).over(function)).filter(F.col("edges") <= explosion)
    level = F.when(F.col("role") == "o", F.array("depth")).when((F.col("role") == "c") & (F.col("before") > 0), F.array("before"))
    level = level.when((F.col("role") == "n") & (F.col("depth") > 0), F.sequence(F.lit(1).cast("long"), "depth"))
    rows = rows.select("symbol_id", "file", "line", "role", "semantic_id", "node", "place", F.explode(level).alias("level"))
    since = Window.partitionBy("symbol_id", "file", "level").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    guard = F.last(F.when(F.col("role") == "o", F.struct("semantic_id", "node")), ignorenulls=True).over(since)
    edges = rows.withColumn("guard", guard).filter("role <> 'o'")
    kind = F.when(F.col("role") == "c", "matches").otherwise("protects")
    return edges.select(
        "symbol_id", "file", "line", kind.alias("type"),
        F.col("guard.semantic_id").alias("source_semantic_id"), F.col("semantic_id").alias("target_semantic_id"),
        F.concat_ws(":", F.lit("rel"), "file", "line", kind, F.substring_index("guard.semantic_id", ":", -1)).alias("relationship_id"),
        F.col("guard.node").alias("source_id"), F.col("node").alias("target_id"),
    )


def with_ends(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships of a pass of one's own with node ids looked up by semantic id; those with an unknown end go."""
    known = facts.select("symbol_id", F.col("semantic_id").alias("uri"), fact_node().alias("id")).distinct()
    for end in ("source", "target"):
        own = known.select("symbol_id", F.col("uri").alias(f"{end}_semantic_id"), F.col("id").alias(f"{end}_id"))
        relationships = relationships.join(own, ["symbol_id", f"{end}_semantic_id"])
    return relationships


def relationships(facts: DataFrame, timeline: str = "source", explosion: int = EXPLOSION, passes: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """All relationships, those of further passes too; a function with more than ``explosion`` of them has none."""
    every = writes(facts).select(*_COLUMNS).unionByName(describes(facts).select(*_COLUMNS)).unionByName(scopes(facts, timeline).select(*_COLUMNS))
    for more in passes:
        made = more(facts)
        every = every.unionByName((made if "source_id" in made.columns else with_ends(made, facts)).select(*_COLUMNS))
    counted = every.withColumn("n", F.count("*").over(Window.partitionBy("symbol_id")))
    return counted.filter(F.col("n") <= explosion).drop("n")


def open_guards(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Guards that are open at each row, for balanced roles (open, close, fact)."""
    delta = F.when(F.col("role") == "open", 1).when(F.col("role") == "close", -1).otherwise(0)
    return rows.withColumn("depth", F.sum(delta).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
