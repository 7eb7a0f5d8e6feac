"""Symbols, their resolution, and the typed edges between them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import edge_id, symbol_id
from ..functions.paths import parts, subsystem
from ..plans import kit
from ..plans.kit import Profile
from .store import first_wins

EDGE = ("edge_id", "src", "dst", "edge_type", "confidence", "subsystem", "resolution_source", "is_deterministic")


def register_symbols(rows: DataFrame) -> DataFrame:
    """(seq, file_path, symbol_name, ...): the first of an identity, with id and subsystem."""
    kept = first_wins(rows, ["file_path", "symbol_name"], ["seq"])
    return kept.withColumn("symbol_id", symbol_id(F.col("file_path"), F.col("symbol_name"))).withColumn("subsystem", subsystem(F.col("file_path")))


def unique_names(symbols: DataFrame, fold_case: bool = True) -> DataFrame:
    """Names that occur in one file only, with that file."""
    name = F.lower("symbol_name") if fold_case else F.col("symbol_name")
    files = symbols.groupBy(name.alias("name")).agg(F.min("file_path").alias("file_path"), F.max("file_path").alias("other"))
    return files.filter(F.col("file_path") == F.col("other")).drop("other")


def resolve_unique(calls: DataFrame, symbols: DataFrame, callee: str) -> DataFrame:
    """Calls whose name, whatever its case, is in one file only, and there in its own case."""
    names = unique_names(symbols)
    strict = symbols.select("file_path", F.col("symbol_name").alias("_strict"), F.col("symbol_id").alias("target_id"))
    located = calls.join(names, F.lower(F.col(callee)) == names["name"]).drop("name")
    return located.join(strict, (located["file_path"] == strict["file_path"]) & (F.col(callee) == F.col("_strict"))).drop("_strict", "file_path")


def _levels(file: Column, *more: Column) -> Column:
    """Keys by which paths are near each other: (level, key) for 0 to 4 leading directories, and any more levels."""
    dirs = parts(file)
    near = [F.when(F.size(dirs) >= k, F.struct(F.lit(k).alias("level"), F.array_join(F.slice(dirs, 1, k), "/").alias("key"))) for k in range(1, 5)]
    whole = F.struct(F.lit(0).alias("level"), F.lit("").alias("key"))
    return F.filter(F.array(whole, *near, *more), lambda x: x.isNotNull())


def _at(level: int, key: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), key.alias("key"))


def _near(refs: DataFrame, wanted: DataFrame, key: str, name: str, file: str, *more: tuple[int, Column]) -> DataFrame:
    """Rows of a reference's key, its name, whether it has a file, and, for each level it shares with candidates, what ``wanted`` says of them.

    Candidates are summed up by (name, level, key) beforehand, so a reference meets at most one row a
    level, however many candidates its name has.
    """
    asked = refs.select(key, F.col(name).alias("_n"), (F.coalesce(file, F.lit("")) != "").alias("_filed"), F.explode(_levels(F.col(file), *(_at(n, c) for n, c in more))).alias("_l"))
    asked = asked.select(key, "_n", "_filed", F.col("_l.level").alias("_level"), F.col("_l.key").alias("_key"))
    return asked.join(wanted, ["_n", "_level", "_key"], "left")


def resolve_best(refs: DataFrame, symbols: DataFrame, key: str, name: str, file: str) -> DataFrame:
    """Per reference the one candidate, or the best by 100 * (same file) + 10 * locality; null if the best is not above 0 or tied.

    The best candidates are those of the deepest level that has any: one file, else the most common
    leading directories (at most 4); without any in common those under tools/ come last.
    """
    tools = F.col("file_path").startswith("tools/")
    cand = symbols.select(F.col("symbol_name").alias("_n"), F.col("symbol_id").alias("_id"), tools.alias("_tools"), F.explode(_levels(F.col("file_path"), _at(5, F.col("file_path")))).alias("_l"))
    summed = cand.groupBy("_n", F.col("_l.level").alias("_level"), F.col("_l.key").alias("_key")).agg(
        F.count("_id").alias("_all"), F.min("_id").alias("_first"), F.count(F.when(~F.col("_tools"), F.col("_id"))).alias("_out"), F.min(F.when(~F.col("_tools"), F.col("_id"))).alias("_first_out")
    )
    met = _near(refs, summed, key, name, file, (5, F.col(file)))
    stranger = F.col("_filed") & (F.col("_level") == 0) & (F.col("_out") == 0)
    outside = F.col("_filed") & (F.col("_level") == 0) & ~stranger
    score = F.when(F.col("_level") == 5, F.when(F.col("_filed"), 150).otherwise(100)).when(~F.col("_filed"), 0).when(stranger, -50).otherwise(10 * F.col("_level"))
    found = F.when(F.col("_all") > 0, F.struct(score.cast("int").alias("score"), F.when(outside, F.col("_out")).otherwise(F.col("_all")).alias("times"), F.when(outside, F.col("_first_out")).otherwise(F.col("_first")).alias("id"), F.col("_level").alias("level")))
    best = met.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_level") == 0, F.col("_all"))), F.lit(0)).alias("candidates"), F.max(found).alias("b"))
    # where the reference has no file, all candidates are equal
    fine = (F.col("candidates") == 1) | ((F.col("b.score") > 0) & (F.col("b.times") == 1))
    return best.select(key, "candidates", F.col("b.score").alias("score"), F.when(fine, F.col("b.id")).alias("resolved_id"))


def alias_best(calls: DataFrame, aliases: DataFrame, key: str, callee: str, file: str) -> DataFrame:
    """Per call the alias's target: the one, or the best by same file, locality and same directory; the first registered of equals; else the callee."""
    own, there = F.array_join(parts(F.col("file_path")), "/"), F.array_join(parts(F.col(file)), "/")
    cand = aliases.select("seq", "target", F.col("alias").alias("_n"), F.col("file_path").startswith("tools/").alias("_tools"), F.size(parts(F.col("file_path"))).alias("_deep"), F.explode(_levels(F.col("file_path"), _at(5, own), _at(6, F.col("file_path")))).alias("_l"))
    first = lambda c: F.min(F.when(c, F.struct("seq", "target")))
    summed = cand.groupBy("_n", F.col("_l.level").alias("_level"), F.col("_l.key").alias("_key")).agg(first(F.lit(True)).alias("_first"), first(~F.col("_tools")).alias("_out"), F.max("_deep").alias("_deep"))
    met = _near(calls, summed, key, callee, file, (5, there), (6, F.col(file)))
    low = F.col("_level")
    filed = F.when(low == 6, 250).when(low == 5, 100 + 10 * F.least("_deep", F.lit(4))).when((low == 0) & F.col("_out").isNull(), -50).otherwise(10 * low)
    score = F.when(F.col("_filed"), filed).otherwise(F.when(low == 6, 200).when(low == 5, 100).otherwise(0))
    taken = F.when(F.col("_filed") & (low == 0) & F.col("_out").isNotNull(), F.col("_out")).otherwise(F.col("_first"))
    best = met.withColumn("_t", taken).groupBy(key, F.col("_n").alias(callee)).agg(F.max_by("_t.target", F.when(F.col("_t").isNotNull(), F.struct(score.alias("s"), (-F.col("_t.seq")).alias("q")))).alias("_t"))
    return best.select(key, callee, F.coalesce("_t", callee).alias("target"))


def register_aliases(aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """Aliases whose target is a symbol and no MMIO primitive."""
    known = symbols.select(F.col("symbol_name").alias("target")).distinct()
    return aliases.filter(~F.col("target").isin(*kit.MMIO)).join(known, "target", "left_semi")


def resolve_entry(entries: DataFrame, symbols: DataFrame, key: str, name: str, files: str, generic: str) -> DataFrame:
    """The first of the entry's files that has the name; else, unless generic, the only file that has it."""
    listed = entries.select(key, name, F.posexplode(files).alias("_pos", "file_path"))
    found = listed.join(symbols.select("file_path", F.col("symbol_name").alias("_n"), "symbol_id"), ["file_path"]).filter(F.col(name) == F.col("_n"))
    first = found.groupBy(key).agg(F.min_by("symbol_id", "_pos").alias("_listed"))
    only = symbols.groupBy(F.col("symbol_name").alias("_u")).agg(F.min("symbol_id").alias("_only"), F.count("*").alias("_k")).filter("_k = 1").drop("_k")
    out = entries.join(first, key, "left").join(only, F.col(name) == F.col("_u"), "left")
    return out.select(key, F.coalesce("_listed", F.when(~F.col(generic), F.col("_only"))).alias("symbol_id"))


def code_calls(chunks: DataFrame) -> DataFrame:
    """Names before a parenthesis in raw code, without stop-listed and non-execution names and self-calls; each once."""
    names = F.array_distinct(F.regexp_extract_all("code", F.lit(kit.PLAIN_CALL), F.lit(1)))
    rows = chunks.select(*(["seq"] if "seq" in chunks.columns else []), "symbol", "file", F.explode(names).alias("callee"))
    return rows.filter(~F.col("callee").isin(*kit.IGNORED_CALLS) & (F.col("callee") != F.col("symbol")) & ~F.col("callee").isin(*kit.NON_EXECUTION))


def confidence(caller: Column, callee: Column, profile: Profile) -> Column:
    """0.1 for low-signal names, else 1, plus spine and transition boosts."""
    base = F.when(callee.isin(*profile.low_signal), 0.1).otherwise(1.0) if profile.low_signal else F.lit(1.0)
    for name, weight in profile.boost.items():
        base = base + F.when(callee == name, weight).otherwise(0.0)
    for (a, b), weight in profile.transitions.items():
        base = base + F.when((caller == a) & (callee == b), weight).otherwise(0.0)
    return base


def typed_edges(rows: DataFrame, edge_type: str, source: str, deterministic: bool = True) -> DataFrame:
    """(src, dst, confidence, seq) as edges; the first of an identity stays."""
    named = rows.withColumn("edge_type", F.lit(edge_type)).withColumn("edge_id", edge_id(F.col("src"), F.col("dst"), F.lit(edge_type)))
    of = F.col("subsystem") if "subsystem" in rows.columns else subsystem(F.substring_index("src", "::", 1))
    kept = first_wins(named.select("edge_id", "src", "dst", "edge_type", F.col("confidence").cast("double").alias("confidence"), of.alias("subsystem"), "seq"), ["edge_id"], ["seq"])
    return kept.select("edge_id", "src", "dst", "edge_type", "confidence", "subsystem", F.lit(source).alias("resolution_source"), F.lit(deterministic).alias("is_deterministic"), "seq")


def resolved_calls(chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Calls of chunks (seq, symbol, file, code), with the name that each stands for after macro aliases, in the order of the chunks."""
    return named_calls(code_calls(chunks), aliases)


def named_calls(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Calls as of code_calls, with the name that each stands for after macro aliases."""
    # an alias is looked up once a file and name, whatever the number of calls, and only names that are aliases
    known = aliases.select(F.col("alias").alias("callee")).distinct()
    asked = calls.join(known, "callee", "left_semi").select("callee", "file").distinct().withColumn("place", F.struct("file", "callee"))
    through = alias_best(asked, aliases, "place", "callee", "file").select(F.col("place.file").alias("file"), "callee", "target")
    # equal keys: a file may be unknown
    at = (calls["callee"] == through["callee"]) & calls["file"].eqNullSafe(through["file"])
    named = calls.join(through, at, "left").select(calls["seq"], calls["symbol"], calls["file"], calls["callee"], F.coalesce(through["target"], calls["callee"]).alias("target"))
    named = named.groupBy("symbol", "file", "callee", "target").agg(F.min("seq").alias("seq"))
    return named.withColumn("call_id", F.concat_ws("|", "file", "symbol", "callee")).filter(~F.col("target").isin(*kit.NON_EXECUTION))


def unresolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(problem, callee, n, first): callees that no file has (missing) or several have (ambiguous), whatever their case."""
    files = symbols.groupBy(F.lower("symbol_name").alias("_name")).agg((F.min("file_path") != F.max("file_path")).alias("_several"))
    found = calls.join(files, F.lower("target") == F.col("_name"), "left")
    problem = F.when(F.col("_name").isNull(), "missing").when(F.col("_several"), "ambiguous")
    return found.select(problem.alias("problem"), F.col("target").alias("callee"), "seq").filter("problem is not null").groupBy("problem", "callee").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def call_edges(calls: DataFrame, symbols: DataFrame, aliases: DataFrame, profile: Profile) -> DataFrame:
    """Direct calls and calls through macro aliases, of chunks whose own symbol is registered; numbered as the chunks are. ``calls`` as of code_calls."""
    found = resolve_unique(named_calls(calls, aliases), symbols, "target")
    rows = found.select(symbol_id(F.col("file"), F.col("symbol")).alias("src"), F.col("target_id").alias("dst"), confidence(F.col("symbol"), F.col("target"), profile).alias("confidence"), "seq", (F.col("target") != F.col("callee")).alias("aliased"))
    rows = rows.join(symbols.select(F.col("symbol_id").alias("src")), "src", "left_semi")
    direct = typed_edges(rows.filter("not aliased"), "DIRECT_CALL", "regex_call_parse")
    return direct.unionByName(typed_edges(rows.filter("aliased"), "MACRO_ALIAS", "macro_expansion"))


def interfaces(providers: DataFrame) -> DataFrame:
    """The pseudo-symbols kind:op that dispatch goes through, as registered symbols; their subsystem is the kind."""
    name, file = F.concat("kind", F.lit(":"), "op"), F.concat(F.lit("<"), "kind", F.lit("_interface>"))
    rows = providers.groupBy("kind", "op").agg(F.min("seq").alias("seq"))
    return rows.select(file.alias("file_path"), name.alias("symbol_name"), "seq", symbol_id(file, name).alias("symbol_id"), F.col("kind").alias("subsystem"))


def dispatch_edges(providers: DataFrame, symbols: DataFrame) -> DataFrame:
    """Provider tables (seq, kind, provider, file, op, func): from the pseudo-symbol kind:op to each implementation found."""
    keyed = providers.withColumn("_k", F.concat_ws("|", "kind", "provider", "file", "op", "func"))
    found = resolve_best(keyed, symbols, "_k", "func", "file").filter("resolved_id is not null").select("_k", "resolved_id")
    interface = F.concat(F.lit("<"), F.col("kind"), F.lit("_interface>::"), F.col("kind"), F.lit(":"), F.col("op"))
    rows = keyed.join(found, "_k").select(interface.alias("src"), F.col("resolved_id").alias("dst"), F.lit(1.0).alias("confidence"), "seq", F.col("kind").alias("subsystem"))
    return typed_edges(rows, "FUNCTION_POINTER_DISPATCH", "provider")


def bridge_edges(bridges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Synthetic continuations (a, b, seq) whose two names are unique; the interfaces' names count."""
    only = symbols.groupBy("symbol_name").agg(F.min("symbol_id").alias("id"), F.count("*").alias("k")).filter("k = 1").drop("k")
    a, b = only.select(F.col("symbol_name").alias("a"), F.col("id").alias("src")), only.select(F.col("symbol_name").alias("b"), F.col("id").alias("dst"))
    rows = bridges.join(a, "a").join(b, "b").select("src", "dst", F.lit(100.0).alias("confidence"), "seq")
    return typed_edges(rows, "SYNTHETIC_CONTINUATION", "reconstructed_execution_continuity")


def bridges_of(spark, profile: Profile) -> DataFrame:
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(profile.bridges.items())], "a string, b string, seq long")


def known_sources(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges, all of whose sources must be registered; the job fails at the first that is not."""
    there = symbols.select(F.col("symbol_id").alias("src")).distinct().withColumn("_known", F.lit(True))
    checked = edges.join(there, "src", "left")
    fault = F.raise_error(F.concat(F.lit("unknown source symbol: "), F.col("src")))
    return checked.withColumn("src", F.when(F.col("_known"), F.col("src")).otherwise(fault)).drop("_known")


def ordered_out(edges: DataFrame, node: str = "src") -> DataFrame:
    """rank of each edge at its source: by confidence and determinism, then as registered."""
    order = Window.partitionBy(node).orderBy(F.desc("confidence"), F.desc("is_deterministic"), "seq")
    return edges.withColumn("rank", F.row_number().over(order))


def adjacency(frontier: DataFrame, edges: DataFrame, forward: bool = True) -> DataFrame:
    """Edges that leave (or reach) the frontier's ids."""
    end = "src" if forward else "dst"
    return edges.join(frontier.select(F.col("id").alias(end)), end, "left_semi")


def candidates(symbols: DataFrame, name: str) -> DataFrame:
    """All symbols of a name, by file."""
    return symbols.filter(F.col("symbol_name") == name).orderBy("file_path")


def symbols_in(symbols: DataFrame, file: str) -> DataFrame:
    """All symbols of a file, by name."""
    return symbols.filter(F.col("file_path") == file).orderBy("symbol_name")


def build_graph(chunks: DataFrame, symbols: DataFrame, aliases: DataFrame, providers: DataFrame | None, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of a profile: calls, dispatch, bridges. Interfaces are registered before bridges, which may name them.

    ``seq`` numbers edges as they are registered: first all calls by chunk, then dispatch, then bridges.
    """
    symbols = _registered(symbols)
    calls = call_edges(code_calls(chunks), symbols, register_aliases(aliases, symbols), profile)
    symbols, made = _profile_edges(symbols, providers, profile)
    return symbols, known_sources(_staged([calls, *made]), symbols)


def _profile_edges(symbols: DataFrame, providers: DataFrame | None, profile: Profile) -> tuple[DataFrame, list[DataFrame]]:
    """Dispatch and bridges over registered symbols, and these with the interfaces."""
    made = []
    if providers is not None:
        made.append(dispatch_edges(providers, symbols))
        # only dispatch that is found registers its interface
        used = made[0].select(F.col("src").alias("symbol_id")).distinct()
        symbols = symbols.unionByName(interfaces(providers).join(used, "symbol_id", "left_semi"))
    if profile.bridges:
        made.append(bridge_edges(bridges_of(symbols.sparkSession, profile), symbols))
    return symbols, made


def _registered(symbols: DataFrame) -> DataFrame:
    return register_symbols(symbols).select("file_path", "symbol_name", "seq", "symbol_id", "subsystem")


def _staged(made: list[DataFrame], first: int = 0) -> DataFrame:
    staged = [e.withColumn("stage", F.lit(k)) for k, e in enumerate(made, first)]
    return reduce(DataFrame.unionByName, staged).withColumn("seq", F.struct("stage", "seq")).drop("stage")


def edges_of(calls: DataFrame, symbols: DataFrame, aliases: DataFrame, providers: DataFrame | None, profile: Profile) -> Callable[[list[str]], DataFrame]:
    """build_graph's edges of the given sources, made when a walk asks for them; ``calls`` as of code_calls.

    A name is resolved among the symbols of that name alone, whatever their case. So dispatch and bridges
    are made once, over the names of the profile's tables and bridges, and kept; a step takes the calls
    of its sources and all symbols of the names that these or their aliases may mean. The names that
    reach the driver are bounded by the profile's files and by the texts of a step's functions.
    """

    def named(names: set[str]) -> DataFrame:
        return symbols.filter(F.lower("symbol_name").isin(*{x.lower() for x in names}))

    fixed = {x for ends in profile.bridges.items() for x in ends}
    if providers is not None:
        providers = providers.persist()
        fixed |= _values(providers, "func")
    every, made = _profile_edges(_registered(named(fixed)), providers, profile)
    others = known_sources(_staged(made, 1), every).persist() if made else None

    def leaving(sources: list[str]) -> DataFrame:
        own = calls.filter(symbol_id(F.col("file"), F.col("symbol")).isin(*sources))
        called = _values(own, "callee")
        rest = [others.filter(F.col("src").isin(*sources))] if made else []
        if rest and not called:
            return rest[0]
        through = aliases.filter(F.col("alias").isin(*called))
        few = _registered(named({s.rpartition("::")[2] for s in sources} | called | _values(through, "target")))
        return reduce(DataFrame.unionByName, rest, _staged([call_edges(own, few, register_aliases(through, few), profile)]))

    return leaving


def _values(rows: DataFrame, column: str) -> set[str]:
    return {r[0] for r in rows.select(column).distinct().collect() if r[0] is not None}
