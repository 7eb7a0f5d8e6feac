"""Corpora over the driver's tables: generated C functions, paths, symbols, edges, tags and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import count_of

#: Order of an order's items: (l_orderkey, l_linenumber) repeats, so the whole row is the key.
#: The first four alone give the order of items that differ in them, and a function's text has nothing else of an item.
ITEM_KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _function(line: Column, head: list[Column], tail: list[Column]) -> Column:
    """Lines of one function from its items' lines in order."""
    return F.array_join(F.concat(F.array(*head), line, F.array(*tail)), "\n")


def functions(spark: SparkSession, sf_dir: str, style: str = "locks") -> DataFrame:
    """One C function per order: seq, symbol_id, symbol, file, start_line, code.

    locks: a lock inside a read section around an assignment and a call per item. loops: an iteration
    macro per item. comments: as locks, with block and line comments between.
    """
    item = F.struct(*ITEM_KEY[:4])  # items that are equal in these give equal lines, so the rest need not be moved
    # dealt by number: what is done with a function costs far more than its bytes, by which partitions would be merged
    items = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    orders = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    key = F.col("l_orderkey").cast("string")
    call = lambda x: F.concat(F.lit("fn_"), (x["l_partkey"] % 50).cast("string"), F.lit("(o);"))
    store = lambda x: F.concat(F.lit("   o->qty = "), x["l_quantity"].cast("bigint").cast("string"), F.lit(";"))
    head = [F.concat(F.lit("void fn_order_"), key, F.lit("(struct order *o, int cpu)")), F.lit("{"), F.lit("struct line_item *it;"), F.lit("int total;")]
    guards = [F.lit("rcu_read_lock();"), F.lit("spin_lock(&o->lock);")], [F.lit("spin_unlock(&o->lock);"), F.lit("rcu_read_unlock();"), F.lit("}")]
    if style == "loops":
        macro = lambda x: F.when(x["l_partkey"] % 2 == 0, F.lit("list_for_each_entry")).otherwise(F.lit("list_for_each_entry_rcu"))
        lines = F.flatten(F.transform("items", lambda x: F.array(F.concat(macro(x), F.lit("(it, &o->list_"), (x["l_suppkey"] % 7).cast("string"), F.lit(", node)")), F.lit("it->seen++;"))))
        code = _function(lines, head, [F.lit("}")])
    elif style == "comments":
        noted = lambda x: F.array(F.concat(F.lit("/* item "), x["l_partkey"].cast("string"), F.lit("\n   call(x); */")), F.concat(store(x), F.lit(" // was = 0;")), call(x))
        code = _function(F.flatten(F.transform("items", noted)), head + guards[0], guards[1])
    else:
        code = _function(F.flatten(F.transform("items", lambda x: F.array(store(x), call(x)))), head + guards[0], guards[1])
    file = F.concat(F.lit("drivers/n"), F.col("l_orderkey") % 25, F.lit("/c"), F.col("l_orderkey") % 10, F.lit(".c"))
    symbol = F.concat(F.lit("fn_order_"), key)
    return orders.select(F.col("l_orderkey").alias("seq"), F.concat(F.lit("func:"), file, F.lit(":"), symbol).alias("symbol_id"), symbol.alias("symbol"), file.alias("file"), (F.col("l_orderkey") % 1000 + 1).cast("int").alias("start_line"), code.alias("code"))


def placed(functions: DataFrame) -> DataFrame:
    """Where each function begins if its file has them all in order: seq, symbol, file, first_line."""
    own = functions.select("seq", "symbol", "file", (count_of(F.col("code"), "\n") + 1).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("seq")) - F.col("lines")
    return own.select("seq", "symbol", "file", (before + 1).cast("int").alias("first_line"))


def whole_files(functions: DataFrame, placed: DataFrame) -> DataFrame:
    """The files of the functions, a function a row: file, first_line, text. A file grows with the tables, and would not fit a row."""
    return functions.select("seq", "file", F.col("code").alias("text")).join(placed.select("seq", "first_line"), "seq").drop("seq")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge per item: src (order), dst (part), kind, confidence, seq."""
    order = Window.partitionBy("l_orderkey").orderBy(*ITEM_KEY)
    seq = (F.col("l_orderkey") * 1000 + F.row_number().over(order)).cast("long")
    kind = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("kind"), F.col("l_discount").alias("confidence"), (F.col("l_quantity") > 25).alias("is_deterministic"), seq.alias("seq"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per customer, a slice of them under tools/."""
    top = F.when(F.col("c_custkey") % 11 == 0, F.lit("tools/n")).when(F.col("c_custkey") % 7 == 0, F.lit("kernel/sched/n")).when(F.col("c_custkey") % 5 == 0, F.lit("net/n")).otherwise(F.lit("drivers/n"))
    path = F.concat(top, F.col("c_nationkey"), F.lit("/"), F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey"), F.lit(".c"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), path.alias("path"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous function names over the paths: seq, file_path, symbol_name, symbol_id."""
    name = F.concat(F.lit("fn_"), F.col("seq") % 97)
    return paths(spark, sf_dir).select("seq", F.col("path").alias("file_path"), name.alias("symbol_name"), F.concat("path", F.lit("::"), name).alias("symbol_id"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user: signup opens a guard, purchase closes one, all others are facts."""
    role = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").otherwise("fact")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", role.alias("role"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag lines (value) of parts: repeats at several lines, wrappers and headers among them."""
    name = F.when(F.col("p_partkey") % 13 == 0, F.lit("module_init")).when(F.col("p_partkey") % 17 == 0, F.lit("ACPI_EXPORT_SYMBOL")).otherwise(F.concat(F.lit("sym_"), F.col("p_partkey") % 300))
    file = F.when(F.col("p_partkey") % 19 == 0, F.lit("tools/perf/x.c")).otherwise(F.concat(F.lit("drivers/d"), F.col("p_size"), F.lit(".c")))
    kind = F.when(F.col("p_partkey") % 4 == 3, F.lit("v")).when(F.col("p_partkey") % 23 == 0, F.lit("macro")).otherwise(F.lit("f"))
    tab = F.lit("\t")
    line = F.concat(name, tab, file, tab, F.lit("/^x$/;\""), tab, kind, tab, F.lit("line:"), F.col("p_partkey"), tab, F.lit("signature:(real_"), F.col("p_partkey") % 40, F.lit(")"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), line.alias("value"))
    return rows
