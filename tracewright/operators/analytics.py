"""Profiling reports over edges, nodes, dictionaries and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def hubs(edges: DataFrame, k: int = 15) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree")).orderBy(F.desc("out_degree"), "src").limit(k)


def degree_stats(edges: DataFrame) -> DataFrame:
    """total, sources, mean, p50, p95, p99, max. A percentile is the value at 0-based position floor(n * p).

    Degrees are few distinct numbers, so they are counted first and positions are found in the counts.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    spread = degree.groupBy("d").agg(F.count("*").alias("n"))
    running = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("upto", F.sum("n").over(running)).crossJoin(F.broadcast(spread.agg(F.sum("n").alias("sources"), F.sum(F.col("d") * F.col("n")).alias("total"))))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("sources") * p), F.col("d")))
    return placed.agg(F.max("total").alias("total"), F.max("sources").alias("sources"), F.round(F.max(F.col("total") / F.col("sources")), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("d").alias("max"))


def guard_hotspots(edges: DataFrame, k: int = 10) -> DataFrame:
    """Per guard of protects edges, its targets by domain (the prefix of the id)."""
    domain = F.substring_index("target_semantic_id", ":", 1)
    known = ("assign", "call", "sync", "iter")
    sums = [F.count_if(domain == d).alias(d) for d in known] + [F.count_if(~domain.isin(*known)).alias("other"), F.count("*").alias("total")]
    return edges.filter(F.col("type") == "protects").groupBy(F.col("source_semantic_id").alias("guard")).agg(*sums).orderBy(F.desc("total"), "guard").limit(k)


def string_class(text: Column) -> Column:
    out = F.when(text.contains(":"), "colon").when(text.contains("/"), "slash").when(text.contains("("), "paren").when(text.contains(" "), "space")
    return out.otherwise("clean")


def string_classes(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(string_class(F.col(column)).alias("class")).agg(F.count("*").alias("n"))


def length_sums(values: DataFrame, column: str, key: str) -> DataFrame:
    return values.agg(F.count("*").alias("n"), F.countDistinct(key).alias("distinct_keys"), F.sum(F.length(column)).alias("characters"))


def top_groups(rows: DataFrame, key: str, k: int = 3, order: str | None = None) -> DataFrame:
    """The commonest; of equals those first seen by ``order``, without it those of the smaller key."""
    seen = F.min(order if order else key).alias("first")
    return rows.groupBy(key).agg(F.count("*").alias("n"), seen).orderBy(F.desc("n"), "first", key).limit(k).drop("first")


def token_counts(rows: DataFrame, column: str, order: str, k: int = 5) -> DataFrame:
    """The k commonest domains (first parts of ids with a colon) and path-like parts (with a slash, .c or .h); of equals those first seen."""
    parts = F.split(column, ":", -1)
    paths = F.filter(parts, lambda x: x.contains("/") | x.contains(".c") | x.contains(".h"))
    token = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("token"))
    found = rows.filter(F.col(column).contains(":")).select(order, F.explode(F.concat(F.array(token("domain", parts[0])), F.transform(paths, lambda x: token("path", x)))).alias("t"))
    counted = found.groupBy("t.kind", "t.token").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = [counted.filter(F.col("kind") == kind).orderBy(F.desc("n"), "first", "token").limit(k) for kind in ("domain", "path")]
    return best[0].union(best[1]).drop("first")


def bytes_per_record(rows: DataFrame, *columns: str) -> DataFrame:
    """Records, and their mean length over the columns."""
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0))
    return rows.agg(F.count("*").alias("records"), F.round(F.sum(length) / F.greatest(F.count("*"), F.lit(1)), 1).alias("bytes_per_record"))


def distinct_functions(ids: DataFrame, column: str) -> DataFrame:
    """Functions named in ids: what follows :func: less its last two parts."""
    name = F.regexp_extract(column, r":func:(.*):[^:]*:[^:]*$", 1)
    return ids.select(F.nullif(name, F.lit("")).alias("f")).agg(F.countDistinct("f").alias("functions"), F.count("*").alias("n"))


def savings(values: DataFrame, column: str) -> DataFrame:
    """Bytes of strings against 8-byte ids, and against 1-byte codes for few distinct values."""
    sums = values.agg(F.count("*").alias("n"), F.sum(F.octet_length(column)).alias("string_bytes"), F.sum(F.when(F.col(column).isNotNull(), 8)).alias("id_bytes"))
    distinct = values.select(column).distinct().agg(F.sum(F.octet_length(column)).alias("dictionary_bytes"))
    both = sums.crossJoin(distinct)
    return both.withColumn("saved_share", F.round(1 - (F.col("id_bytes") + F.col("dictionary_bytes")) / F.greatest("string_bytes", F.lit(1)), 6))


def frontend_counts(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """raw tags, functions, variables, wrappers, duplicates, canonical symbols."""
    a = raw.agg(F.count("*").alias("raw"), F.count_if(F.col("kind").isin("function", "f")).alias("functions"), F.count_if(F.col("kind").isin("variable", "v")).alias("variables"))
    b = kept.agg(F.count_if("is_wrapper").alias("wrappers"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"), F.count("*").alias("canonical"))
    return a.crossJoin(b)


def per_domain(facts: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    dim = facts.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    return dim.join(facts.groupBy("domain").agg(F.count("*").alias("n")), "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))


def crowded_lines(facts: DataFrame, least: int = 2) -> DataFrame:
    return facts.groupBy("symbol_id", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def caller_stats(calls: DataFrame, caller: str, callee: str) -> DataFrame:
    return calls.groupBy(caller).agg(F.count("*").alias("calls"), F.size(F.collect_set(callee)).alias("distinct_callees")).orderBy(F.desc("calls"), caller)


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("edge_type") == "FUNCTION_POINTER_DISPATCH").alias("dispatch"), F.count_if(F.col("edge_type") == "SYNTHETIC_CONTINUATION").alias("synthetic"))
    return symbols.agg(F.count("*").alias("symbols")).crossJoin(kinds)


def truncated_branches(edges: DataFrame, limit: int = 5) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.sum(F.greatest(F.lit(0), F.col("n") - limit)).alias("truncated"))


#: The parts of the tree that macro aliases are counted by; a path counts for the first that it begins with.
MACRO_PREFIXES = ("kernel/", "drivers/", "tools/", "include/", "arch/", "fs/")


def macro_pairs(aliases: DataFrame) -> DataFrame:
    """(pair, n, first, and a count for each prefix) of aliases (seq, alias, target, file_path)."""
    under = F.when(F.lit(False), F.lit(""))
    for p in MACRO_PREFIXES:
        under = under.when(F.col("file_path").startswith(p), p)
    counts = [F.count_if(under == p).alias(f"in_{p.strip('/')}") for p in MACRO_PREFIXES]
    pair = F.concat("alias", F.lit(" -> "), "target")
    return aliases.groupBy(pair.alias("pair")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), *counts)


def macro_totals(aliases: DataFrame, symbols: DataFrame, callable_names: DataFrame) -> DataFrame:
    """Aliases, their distinct names, and how many distinct targets are symbols, and of these have code (column symbol)."""
    targets = aliases.select("target").distinct().join(symbols.select(F.col("symbol_name").alias("target")).distinct(), "target", "left_semi")
    coded = targets.join(callable_names.select(F.col("symbol").alias("target")).distinct(), "target", "left_semi")
    sums = aliases.agg(F.count("*").alias("aliases"), F.countDistinct("alias").alias("names"))
    return sums.crossJoin(targets.agg(F.count("*").alias("known_targets"))).crossJoin(coded.agg(F.count("*").alias("callable_targets")))


def macro_report(pairs: DataFrame, totals: DataFrame, top: int = 50, top_each: int = 100) -> DataFrame:
    """(section, place, line): totals, the commonest pairs of all and of each part of the tree, then all pairs."""

    def section(number: int, rows: DataFrame, count: str, most: int | None, note: str) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.desc(count), "first", "pair"))
        kept = rows.filter(F.col(count) > 0).orderBy(F.desc(count), "first", "pair")
        kept = kept.limit(most).withColumn("place", rank) if most else kept.withColumn("place", F.lit(None).cast("int"))
        line = F.concat(F.lit("  "), "pair", F.lit(f" ({note}"), F.col(count).cast("string"), F.lit(" times)"))
        return kept.select(F.lit(number).alias("section"), "place", F.col(count).alias("n"), "first", line.alias("line"))

    said = (("aliases", "Total raw aliases extracted"), ("names", "Unique alias names"), ("known_targets", "Targets resolving to known symbols"), ("callable_targets", "Targets resolving to callable symbols"))
    heads = F.array(*(F.concat(F.lit(f"{text}: "), F.col(c).cast("string")) for c, text in said))
    out = totals.select(F.lit(0).alias("section"), F.posexplode(heads).alias("place", "line")).select("section", "place", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), "line")
    out = out.unionByName(section(1, pairs, "n", top, "defined "))
    for k, p in enumerate(MACRO_PREFIXES):
        out = out.unionByName(section(2 + k, pairs, f"in_{p.strip('/')}", top_each, ""))
    return out.unionByName(section(2 + len(MACRO_PREFIXES), pairs, "n", None, "")).orderBy("section", "place", F.desc("n"), "first", "line")


def cursor_usage(facts: DataFrame) -> DataFrame:
    """Which of a function's iterations (by ordinal) use a variable as cursor."""
    loops = facts.filter(F.col("domain") == "Iteration").withColumn("nth", F.row_number().over(Window.partitionBy("symbol_id").orderBy("line", "semantic_id", "ordinal")))
    return loops.groupBy("symbol_id", F.col("args")[0].alias("cursor")).agg(F.sort_array(F.collect_list("nth")).alias("iterations"))
