"""Vector top-k, query understanding and prompt assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import kit


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def top_k(vectors: DataFrame, key: str, column: str, query: list[float], k: int = 5) -> DataFrame:
    """The k nearest by cosine, exact; ties go to the smaller key. A projection and a top-k, no shuffle of vectors."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(column), wanted), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: So many query vectors go to the workers at a time.
QUERY_BLOCK = 2_048


def nearest(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, score, rank): for each of the queries, rows like those of vectors, the k nearest by cosine, exact.

    Queries are taken in blocks of bounded size, each block one pass over the vectors; every batch of
    rows gives its own k best to each query, so k rows a batch and query are exchanged, not pairs.
    Ties go to the smaller key. Vectors of no length, and null ones, are near nothing.
    """
    kind = vectors.schema[key].dataType.simpleString()
    numbered = queries.select(key, column).filter(F.col(column).isNotNull())
    blocks = max(1, -(-numbered.count() // block))
    out = None
    for n in range(blocks):
        own = numbered.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == n).toPandas()
        ids = own[key].tolist()
        wanted = np.array(own[column].tolist(), float).reshape(len(own), -1)
        size = np.linalg.norm(wanted, axis=1, keepdims=True)
        wanted = wanted / np.where(size > 0, size, 1)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, wanted=wanted) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                rows = pa.Table.from_batches([rows]).filter(rows.column(1).is_valid()).combine_chunks()
                if not len(rows) or not ids:
                    continue
                matrix = np.array(rows.column(1).to_pylist(), float)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                keys = np.array(rows.column(0).to_pylist())
                order = np.argsort(keys, kind="stable")
                matrix, length, keys = matrix[order], length[order], keys[order]
                scores = np.where(length > 0, np.round(matrix / np.where(length > 0, length, 1) @ wanted.T, 6), -2.0)
                best = np.argsort(-scores, axis=0, kind="stable")[:k]  # of equal scores the smaller key
                found = np.take_along_axis(scores, best, 0)
                query = [q for _ in range(len(best)) for q in ids]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(keys[best].ravel()), pa.array(found.ravel())], names=["query", key, "score"])

        part = vectors.select(key, column).mapInArrow(run, f"query {kind}, {key} {kind}, score double")
        out = part if out is None else out.union(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return out.filter("score > -2").withColumn("rank", rank).filter(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    """Distinct identifiers of a query, in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*(F.lit(w) for w in kit.STOP_WORDS)))


def token_search(queries: DataFrame, key: str, text: str, symbols: DataFrame) -> DataFrame:
    """Tokens of queries that are symbols."""
    names = symbols.select(F.lower("symbol_name").alias("token")).distinct()
    return queries.select(key, F.explode(tokens(F.col(text))).alias("token")).join(names, "token", "left_semi").select(key, "token")


def mode_of(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for prefix, mode in kit.MODES.items():
        out = out.when(text.startswith(prefix), mode)
    return out.otherwise("runtime_spine")


def query_of(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^[1-5]-", ""))


def profile_of(text: Column) -> Column:
    """Key of the first profile with a keyword in the text; generic for 5-; null for none."""
    low = F.lower(text)
    out = F.when(low.startswith("5-"), "generic")
    for key, words in kit.PROFILE_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, key)
    return out


#: Domains of a question, in their order, with the words that tell them, and where traces of some begin.
DOMAIN_WORDS = (
    ("interrupt_entry", ("vector", "idt")),
    ("interrupt", ("interrupt", "irq")),
    ("timer", ("timer",)),
    ("softirq", ("softirq",)),
    ("wakeup", ("wake", "sleep")),
    ("scheduler", ("schedule", "scheduler", "context switch")),
)
DOMAIN_ENTRY = (("interrupt_entry", "idtentry"), ("interrupt", "generic_handle_irq"), ("scheduler", "schedule"))


def domains_of(text: Column) -> Column:
    """All domains with a word in the text; kernel for none."""
    low = F.lower(text)
    found = [F.when(reduce(Column.__or__, (low.contains(w) for w in words)), F.lit(domain)) for domain, words in DOMAIN_WORDS]
    found = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("kernel")))


def entry_of(symbol: Column, domains: Column) -> Column:
    """Where a trace of the domains begins; the symbol itself where they name nothing."""
    out = F.when(F.lit(False), F.lit(""))
    for domain, entry in DOMAIN_ENTRY:
        out = out.when(F.array_contains(domains, domain), entry)
    return out.otherwise(symbol)


def runtime_lines(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(query, place, line) of trace edges (query, place, src, dst, context); names are (symbol_id, name)."""
    both = _named_ends(edges, names)
    return both.select("query", "place", F.concat(F.lit("["), F.upper("context"), F.lit("] "), "a", F.lit("  -> "), "b").alias("line"))


def dispatch_lines(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(place, line) of every dispatch edge (src, dst, edge_type, seq), in the order of registration."""
    both = _named_ends(edges.filter(F.col("edge_type") == "FUNCTION_POINTER_DISPATCH"), names)
    return both.select(F.col("seq").alias("place"), F.concat(F.lit("[DISPATCH] "), "a", F.lit(" -> "), "b").alias("line"))


def _named_ends(edges: DataFrame, names: DataFrame) -> DataFrame:
    a, b = names.select(F.col("symbol_id").alias("src"), F.col("name").alias("a")), names.select(F.col("symbol_id").alias("dst"), F.col("name").alias("b"))
    return edges.join(a, "src").join(b, "dst")


def _joined(*order: str, of: str = "line", by: str = "\n") -> Column:
    """The column's values, in order, as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, of))), lambda x: x[of]), by)


#: What a reader of the prompt is told to do.
INSTRUCTIONS = "Explain the path from the flow and the code above alone. Follow the flow's edges in order. Tell direct calls from dispatch. Add nothing that stands in neither."


def prompts(questions: DataFrame, runtime: DataFrame, dispatch: DataFrame, code: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(query, prompt) of questions (query, question, subsystem), with the lines of each one's trace, all dispatch lines, and its code."""
    flow = runtime.groupBy("query").agg(_joined("place").alias("flow"))
    ways = dispatch.agg(_joined("place").alias("ways"))  # one row
    rows = questions.join(flow, "query", "left").join(code.select("query", F.col("prompt").alias("code")), "query", "left").crossJoin(F.broadcast(ways))
    parts = (("QUESTION", "question"), ("SUBSYSTEM", "subsystem"), ("RUNTIME EXECUTION FLOW", "flow"), ("SEMANTIC DISPATCH FLOW", "ways"), ("RELEVANT KERNEL CODE", "code"))
    text = F.concat_ws("\n\n", *(F.concat(F.lit(f"{title}:\n"), F.coalesce(column, F.lit(""))) for title, column in parts), F.lit(f"Instructions:\n{instructions}"))
    return rows.select("query", text.alias("prompt"))


def prompt_code(trace: DataFrame, chunks: DataFrame, nodes: int = 8, per_block: int = 600, total: int = 6000) -> DataFrame:
    """Of each trace (query, symbol, place): the code of its first distinct symbols under FILE and SYMBOL, cut to budgets.

    Of the first ``nodes`` places, each symbol once; those without code are left out. Of several chunks
    of a symbol the last by seq counts.
    """
    place = Window.partitionBy("query").orderBy("place", "symbol")
    near = trace.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= nodes).groupBy("query", "symbol").agg(F.min("r").alias("r"))
    last = chunks.groupBy("symbol").agg(F.max_by(F.struct("file", "code"), "seq").alias("c"))
    found = near.join(last, "symbol").filter(F.length("c.code") > 0)
    block = F.concat(F.lit("FILE: "), "c.file", F.lit("\nSYMBOL: "), "symbol", F.lit("\n\n"), F.left("c.code", F.lit(per_block)))
    code = found.select("query", "r", block.alias("block")).groupBy("query")
    return code.agg(F.left(_joined("r", of="block", by="\n\n"), F.lit(total)).alias("prompt"), F.count("*").alias("symbols"))


def expand_context(calls: DataFrame, present: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """Up to ``limit`` callees' code for each caller that is not present yet."""
    new = calls.select("symbol", "callee").distinct().join(present.select(F.col("symbol").alias("callee")).distinct(), "callee", "left_anti")
    ranked = new.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy("callee"))).filter(F.col("r") <= limit)
    return ranked.join(chunks.select(F.col("symbol").alias("callee"), "code"), "callee").select("symbol", "callee", "code")


def concatenated_code(chunks: DataFrame) -> DataFrame:
    """Code of each lower-cased symbol in order, with its first spelling, first file, all files, and the last code."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"])
    rows = chunks.groupBy(F.lower("symbol").alias("name"))
    return rows.agg(F.array_join(parts, "\n").alias("code"), F.min_by("symbol", "seq").alias("symbol"), F.min_by("file", "seq").alias("file"), F.sort_array(F.collect_set("file")).alias("files"), F.max_by("code", "seq").alias("last_code"), F.count("*").alias("chunks"))


def mermaid(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(place, line): ``graph TD``, then a line an edge (place, src, dst, edge_type), labelled by its type; dotted for macro
    aliases, thick for dispatch, plain otherwise."""
    kind = F.col("edge_type")
    arrow = F.when(kind == "MACRO_ALIAS", F.concat(F.lit("-. "), kind, F.lit(" .->"))).when(kind == "FUNCTION_POINTER_DISPATCH", F.concat(F.lit("== "), kind, F.lit(" ==>")))
    arrow = arrow.otherwise(F.concat(F.lit("-- "), kind, F.lit(" -->")))
    lines = _named_ends(edges, names).select(F.col("place").cast("long").alias("place"), F.concat(F.lit("    "), "a", arrow, "b").alias("line"))
    return edges.sparkSession.createDataFrame([(-1, "graph TD")], "place long, line string").unionByName(lines)


def trace_lines(nodes: DataFrame, edges: DataFrame, annotations: DataFrame, names: DataFrame) -> DataFrame:
    """(depth, place, part, nth, line): each node (place, symbol_id, depth) by depth, then its annotations
    (place, symbol_id, dst, edge_type), then the first edge (place, src, dst, edge_type) that leaves it."""
    at = nodes.select("symbol_id", "depth", F.col("place").alias("node"))
    name = names.select("symbol_id", "name")
    head = nodes.join(name, "symbol_id").select("depth", F.col("place").alias("node"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("nth"), F.concat(F.lit("[Depth="), "depth", F.lit("] "), "name").alias("line"))
    to = name.select(F.col("symbol_id").alias("dst"), "name")
    noted = annotations.join(at, "symbol_id").join(to, "dst", "left").select("depth", "node", F.lit(1).alias("part"), F.col("place").cast("long").alias("nth"), F.concat(F.lit("    ├── ["), "edge_type", F.lit("] "), F.coalesce("name", "dst")).alias("line"))
    first = edges.groupBy(F.col("src").alias("symbol_id")).agg(F.min_by(F.struct("dst", "edge_type"), "place").alias("e")).select("symbol_id", "e.*")
    left = first.join(at, "symbol_id").join(to, "dst", "left").select("depth", "node", F.lit(2).alias("part"), F.lit(0).cast("long").alias("nth"), F.concat(F.lit("    └── ➔ ["), "edge_type", F.lit("] "), F.coalesce("name", "dst")).alias("line"))
    return head.unionByName(noted).unionByName(left).orderBy("depth", "node", "part", "nth")


def embed(chunks: DataFrame, text: str, model: Callable[[list[str]], Iterable[Iterable[float]]], batch: int = 64) -> DataFrame:
    """chunks with an ``embedding``; the model is called with ``batch`` texts at a time, in the workers."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in (rows.slice(i, batch) for i in range(0, len(rows), batch)):
                made = [[float(x) for x in v] for v in model([t or "" for t in part.column(text).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.float32()))], names=[*names, "embedding"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def numbered(vectors: DataFrame, order: str) -> DataFrame:
    """vectors with ``vec_no``, the running ordinal from 0 in which a store would have added them."""
    from .store import intern

    keyed = vectors.withColumn("_key", F.col(order).cast("string"))
    ids = intern(keyed.select("_key", order), "_key", order, empty_zero=False)
    return keyed.join(ids.select(F.col("value").alias("_key"), (F.col("id") - 1).alias("vec_no")), "_key").drop("_key")
