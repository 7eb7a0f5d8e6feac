"""Facts of functions: calls, locks, read sections, loops, assignments, locals, collections.

A rule finds matches in the cleaned code of a chunk (symbol_id, file, start_line, clean_code,
local_names) and says what each match's columns are. All rules that are wanted go over one chunk in
one projection and fan out once; none shuffles. Facts share one wide schema.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import c_type, clean_code, count_of, first_argument, first_identifier, lookup_name, matches, slug
from ..plans import kit
from ..plans.kit import LINUX, Kit

FACT = {
    "symbol_id": "string", "file": "string", "semantic_id": "string", "fact_type": "string", "domain": "string", "category": "string", "line": "int", "name": "string", "expr": "string",
    "operator": "string", "kind": "string", "resolved": "string", "flag": "boolean", "args": "array<string>", "rhs": "string", "extractor": "int", "ordinal": "int",
}


@dataclass(frozen=True)
class Rule:
    """Matches of a chunk as an array of (line, g1, g2), and their FACT columns; ``number`` is the place in the order of discovery."""

    number: int
    found: Callable[[Kit], Column]
    columns: Callable[[Kit], dict[str, Column]]
    keep: Callable[[Kit], Column] = lambda _: F.lit(True)


def prepared(chunks: DataFrame, compat_comments: bool = False) -> DataFrame:
    """Chunks with comments stripped once, and the names of parameters and locals."""
    clean = chunks.withColumn("clean_code", clean_code(F.col("code"), compat_comments))
    return clean.withColumn("local_names", F.array_distinct(declared(F.col("clean_code"), False)))


def facts_by(chunks: DataFrame, rules: Sequence[Rule], dialect: Kit = LINUX) -> DataFrame:
    """Facts of the rules, in one pass over prepared chunks."""

    def numbered(rule: Rule) -> Column:
        place = F.lit(rule.number).alias("extractor")
        return F.transform(rule.found(dialect), lambda m, i: F.struct(place, i.cast("int").alias("ordinal"), m["line"].alias("at"), m["g1"].alias("g1"), m["g2"].alias("g2")))

    every = F.concat(*(numbered(r) for r in rules))
    rows = chunks.select("symbol_id", "file", "start_line", "local_names", F.explode(every).alias("m")).select("symbol_id", "file", "local_names", (F.col("start_line") + F.col("m.at")).cast("int").alias("line"), "m.*")

    def chosen(of: Callable[[Rule], Column | None]) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for r in rules:
            value = of(r)
            if value is not None:
                out = out.when(F.col("extractor") == r.number, value)
        return out

    made = {r.number: r.columns(dialect) for r in rules}
    rows = rows.filter(chosen(lambda r: r.keep(dialect)))
    plain = {"symbol_id", "file", "line", "extractor", "ordinal"}
    return rows.select(*[(F.col(n) if n in plain else chosen(lambda r, n=n: made[r.number].get(n))).cast(k).alias(n) for n, k in FACT.items()])


def _resolved(expression: Column) -> Column:
    root = first_identifier(expression)
    return F.when(F.array_contains("local_names", root), root)


def _id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _calls_found(dialect: Kit) -> Column:
    """Calls in the body, after the first brace. The argument text runs to the last ) before a ;."""
    start = F.instr("clean_code", "{")
    body = F.when(start > 0, F.expr("substring(clean_code, instr(clean_code, '{') + 1)")).otherwise("")
    head = count_of(F.expr("left(clean_code, instr(clean_code, '{'))"), "\n")
    placed = lambda head: F.transform(matches(body, dialect.call, 2), lambda m: F.struct((m["line"] + head).alias("line"), m["g1"].alias("g1"), m["g2"].alias("g2")))
    return F.element_at(F.transform(F.array(head), placed), 1)  # counted once


def _calls(_: Kit) -> dict[str, Column]:
    arguments = F.trim("g2")
    return {
        "semantic_id": _id("call", F.col("file"), F.col("line"), F.col("g1")),
        "fact_type": F.lit("Call"), "domain": F.lit("Call"), "category": F.lit("CALL"), "name": F.col("g1"),
        "args": F.when(arguments != "", F.array(arguments)).otherwise(F.array().cast("array<string>")),
    }


def _sync(dialect: Kit) -> dict[str, Column]:
    p = F.col("g1")
    role = F.when(p.isin(*dialect.acquire), "acquire").when(p.isin(*dialect.release), "release").otherwise("interrupt")
    lock = F.when(role != "interrupt", first_argument(F.trim("g2")))
    return {
        "semantic_id": _id("sync", F.col("file"), F.col("line"), role, p),
        "fact_type": F.when(role == "interrupt", "InterruptState").otherwise(F.concat(F.lit("Lock"), F.initcap(role))),
        "domain": F.lit("Synchronization"), "name": p, "expr": lock,
        "kind": F.coalesce(_literal_map(dialect.interrupt)[p], role),
        "resolved": F.when(role != "interrupt", _resolved(lock)),
        "flag": F.coalesce(_literal_map(dialect.acquire | dialect.release)[p], F.lit(False)),
    }


def _assignments(_: Kit) -> dict[str, Column]:
    target = F.trim("g1")
    kind = F.when(target.contains("->") | target.contains("."), "Struct Field").when(target.contains("["), "Array Element").otherwise("Local Variable")
    root = F.nullif(F.regexp_extract(target, r"^([a-zA-Z_][a-zA-Z0-9_]*)", 1), F.lit(""))
    short = F.when(kind == "Local Variable", "local").otherwise("struct")
    return {
        "semantic_id": _id("assign", F.col("file"), F.col("line"), short, slug(target)),
        "fact_type": F.lit("Assignment"), "domain": F.lit("Assignment"), "expr": target,
        "operator": F.substring_index("g2", kit.GROUPS, 1), "rhs": F.trim(F.substring_index("g2", kit.GROUPS, -1)),
        "kind": kind, "resolved": F.when(F.array_contains("local_names", root), root),
    }


def _mutations_found(dialect: Kit) -> Column:
    """g2 holds the operator and the right side."""
    found = matches(F.col("clean_code"), dialect.mutation, 3)
    return F.transform(found, lambda m: F.struct(m["line"].alias("line"), m["g1"].alias("g1"), F.concat(F.trim(m["g2"]), F.lit(kit.GROUPS), m["g3"]).alias("g2")))


def _rcu(dialect: Kit) -> dict[str, Column]:
    api = F.col("g1")
    role = _literal_map({name: role for role, names in reversed(dialect.rcu.items()) for name in names})[api]
    target = first_argument(F.trim("g2"))
    pointed = role.isin("deref", "publish", "loop")
    tail = F.when(pointed, F.concat(api, F.lit("_"), slug(target))).otherwise(api)
    kinds = _literal_map({"read_lock": "RcuReadLock", "read_unlock": "RcuReadUnlock", "deref": "RcuDereference", "publish": "RcuPublish", "grace_period": "RcuGracePeriod", "loop": "RcuIteration"})
    return {
        "semantic_id": _id("rcu", F.col("file"), F.col("line"), role, tail),
        "fact_type": kinds[role], "domain": F.lit("RCU"), "name": api, "expr": F.when(pointed, target),
        "kind": role, "resolved": F.when(pointed, _resolved(target)),
    }


def _iterations(dialect: Kit) -> dict[str, Column]:
    macro, parts = F.col("g1"), F.transform(F.split(F.trim("g2"), ",", -1), lambda x: F.trim(x))
    cursor_at, list_at, family = (_literal_map({m: own[k] for m, own in dialect.iterators.items()})[macro] for k in range(3))
    collection = F.coalesce(F.get(parts, list_at), F.lit(""))
    member = F.when(macro.contains("_entry") & (F.size(parts) >= 3), F.element_at(parts, -1)).otherwise("next")
    return {
        "semantic_id": _id("iter", F.col("file"), F.col("line"), macro),
        "fact_type": F.lit("Iteration"), "domain": F.lit("Iteration"), "category": F.lit("CONTROL_FLOW"), "name": macro,
        "expr": collection, "kind": family, "resolved": _resolved(collection),
        "args": F.array(F.coalesce(F.get(parts, cursor_at), F.lit("unknown")), member),
    }


def _named(names: Sequence[str]) -> Column:
    """Uses of the names; a chunk without any of them, as most are, is not searched by pattern."""
    there = reduce(Column.__or__, (F.col("clean_code").contains(n) for n in sorted(names)))
    return F.when(there, matches(F.col("clean_code"), kit.any_of(names), 2)).otherwise(F.array().cast("array<struct<line:int,g1:string,g2:string>>"))


ITERATIONS = Rule(1, lambda k: _named(list(k.iterators)), _iterations)
CALLS = Rule(2, _calls_found, _calls, lambda k: ~F.col("g1").isin(k.call_exclusions()))
SYNC = Rule(3, lambda k: _named([*k.acquire, *k.release, *k.interrupt]), _sync)
ASSIGNMENTS = Rule(4, _mutations_found, _assignments)
RCU = Rule(5, lambda k: _named(sorted({x for names in k.rcu.values() for x in names})), _rcu)
RULES = (ITERATIONS, CALLS, SYNC, ASSIGNMENTS, RCU)


def extract_iterations(chunks: DataFrame, dialect: Kit = LINUX) -> DataFrame:
    return facts_by(chunks, [ITERATIONS], dialect)


def extract_calls(chunks: DataFrame, dialect: Kit = LINUX) -> DataFrame:
    return facts_by(chunks, [CALLS], dialect)


def extract_sync(chunks: DataFrame, dialect: Kit = LINUX) -> DataFrame:
    return facts_by(chunks, [SYNC], dialect)


def extract_assignments(chunks: DataFrame, dialect: Kit = LINUX) -> DataFrame:
    return facts_by(chunks, [ASSIGNMENTS], dialect)


def extract_rcu(chunks: DataFrame, dialect: Kit = LINUX) -> DataFrame:
    return facts_by(chunks, [RCU], dialect)


def rcu_warnings(facts: DataFrame) -> DataFrame:
    """Dereferences and publications whose target is no known local."""
    rows = facts.filter(F.col("fact_type").isin("RcuDereference", "RcuPublish") & F.col("resolved").isNull())
    text = F.format_string("%s:%d: %s of unresolved target %s", "file", "line", "name", F.coalesce("expr", F.lit("")))
    return rows.select("symbol_id", "semantic_id", text.alias("warning"))


_DECLARED = "(?md)" + kit.DECLARATION.replace(r"\s", r"[^\S\n]").replace("[^;]*", "[^;\n]*")


def declared(code: Column, typed: bool = True) -> Column:
    """Array of parameters, then locals: name, storage, type, declaration_line (within the chunk); untyped, the names alone.

    Locals are declared in lines after the one with the first brace; all such lines are found in one pass.
    """
    found = F.regexp_extract(code, kit.PARAMETERS, 1)

    def parameter(text: Column) -> Column:
        text = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
        name = F.element_at(F.regexp_extract_all(text, F.lit(f"({kit.IDENTIFIER})"), F.lit(1)), -1)
        if not typed:
            return name
        raw = F.trim(F.regexp_replace(text, F.concat(F.lit(r"\b"), name, F.lit(r"\b")), F.lit("")))
        at = F.call_function("locate", text, code, F.instr(code, "("))
        line = F.size(F.split(F.call_function("left", code, F.greatest(at - 1, F.lit(0))), "\n", -1))
        return F.struct(name.alias("name"), F.lit("parameter").alias("storage"), c_type(raw, F.lit("")).alias("type"), line.cast("int").alias("declaration_line"))

    texts = F.filter(F.split(found, ",", -1), lambda x: x.rlike(r"[a-zA-Z_]"))
    none = (F.trim(found) == "") | (F.trim(found) == "void")
    parameters = F.transform(F.when(none, F.array().cast("array<string>")).otherwise(texts), parameter)
    inner = F.regexp_extract(code, r"(?s)\A[^{]*\{[^\n]*\n(.*)\z", 1)
    before = count_of(code, "\n") - count_of(inner, "\n")

    def locals_of(m: Column) -> Column:
        raw = F.trim(m["g1"])

        def one(part: Column) -> Column:
            base = F.trim(F.substring_index(part, "=", 1))
            name = F.regexp_extract(base, f"({kit.IDENTIFIER})", 1)
            if not typed:
                return name
            return F.struct(name.alias("name"), F.lit("local").alias("storage"), c_type(raw, base).alias("type"), (before + m["line"] + 1).cast("int").alias("declaration_line"))

        return F.filter(F.transform(F.split(m["g2"], ",", -1), one), lambda x: (x["name"] if typed else x) != "")

    lines = F.filter(matches(inner, _DECLARED, 2), lambda m: ~F.regexp_extract(m["g1"], r"(\w+)\s*$", 1).isin(*kit.RESERVED))
    return F.concat(parameters, F.flatten(F.transform(lines, locals_of)))


def extract_locals(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("symbol_id", "file", "start_line", F.posexplode(declared(F.col("clean_code"))).alias("ordinal", "d"))
    return rows.select("symbol_id", "file", "ordinal", "d.name", "d.storage", "d.type", "d.declaration_line", (F.col("start_line") + F.col("d.declaration_line") - 1).cast("int").alias("line"))


def extract_collections(chunks: DataFrame) -> DataFrame:
    """Global collection declarations; of one name the last stays (by chunk order, pattern, place)."""

    def declared_by(number: int, pattern: str, *what: str) -> Column:
        family, type_name, macro = (F.lit(x) for x in what)
        return F.transform(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)), lambda x, i: F.struct(F.lit(number).alias("pattern"), i.alias("place"), x.alias("name"), family.alias("family"), type_name.alias("type_name"), macro.alias("macro")))

    found = [declared_by(k, *row) for k, row in enumerate(kit.COLLECTIONS)]
    rows = chunks.select("seq", "file", F.explode(F.flatten(F.array(*found))).alias("c"))
    last = F.max_by(F.struct("c.family", "c.type_name", "c.macro", "file"), F.struct("seq", "c.pattern", "c.place"))
    return rows.groupBy(F.col("c.name").alias("name")).agg(last.alias("d")).select("name", "d.family", "d.type_name", F.col("d.macro").alias("declaration_macro"), F.col("d.file").alias("declaration_file"))


def extract_facts(
    chunks: DataFrame,
    more: Sequence[Callable[[DataFrame], DataFrame]] = (),
    rules: Sequence[Rule] = RULES,
    dialect: Kit = LINUX,
) -> DataFrame:
    """All facts of prepared chunks, in one wide table; ``extractor`` and ``ordinal`` keep the order of discovery.

    A rule of one's own goes into ``rules``; an extractor that no rule can express takes prepared
    chunks, returns rows of the FACT columns, and goes into ``more``.
    """
    return reduce(DataFrame.unionByName, (f(chunks) for f in more), facts_by(chunks, rules, dialect))


def bind_collections(collections: DataFrame, symbols: DataFrame) -> DataFrame:
    """Collections with the first registered symbol of their name, if any; a leading & does not matter."""
    first = symbols.groupBy(F.col("symbol_name").alias("bare")).agg(F.min_by("symbol_id", "seq").alias("symbol_id"))
    return collections.withColumn("bare", lookup_name(F.col("name"))).join(first, "bare", "left").drop("bare")
