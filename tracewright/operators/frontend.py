"""From tag lines to canonical symbols and code chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.paths import is_noise
from ..functions.text import count_of, strip_comments
from ..plans import kit


def parse_tags(lines: DataFrame) -> DataFrame:
    """(seq, value) lines to tags: symbol, file, pattern, kind, line, signature, typeref, extensions.

    Headers, blank lines, lines without the field separator, with fewer than three base fields, or
    without a positive line number are dropped.
    """
    halves = F.split("value", ';"\t', 2)
    base, extra = F.split(halves[0], "\t", -1), F.split(halves[1], "\t", -1)
    rows = lines.filter(~F.col("value").startswith("!_TAG_") & (F.trim("value") != "") & F.col("value").contains(';"\t')).select("seq", base.alias("b"), extra.alias("e")).filter(F.size("b") >= 3)
    pairs = F.transform(F.filter("e", lambda x: x.contains(":")), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("v")))
    # of a repeated key the last
    fields = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.map_from_arrays(F.array(x["k"]), F.array(x["v"]))))
    bare = F.filter("e", lambda x: ~x.contains(":") & (x != ""))
    rows = rows.withColumn("extensions", fields).withColumn("kind", F.coalesce(F.col("extensions")["kind"], F.get(bare, F.lit(0)), F.lit("")))
    rows = rows.withColumn("line", F.expr("try_cast(extensions['line'] as int)")).filter("line > 0")
    return rows.select("seq", F.col("b")[0].alias("symbol"), F.col("b")[1].alias("file"), F.col("b")[2].alias("pattern"), "kind", "line", F.col("extensions")["signature"].alias("signature"), F.col("extensions")["typeref"].alias("typeref"), F.map_filter("extensions", lambda k, _: ~k.isin("line", "kind", "signature", "typeref")).alias("extensions"))


@dataclass(frozen=True)
class TagRule:
    """Which tags are wrappers around a definition that their signature names."""

    name: str
    applies: Callable[[], Column]


ACPI = TagRule("acpi", lambda: F.col("symbol").isin(*kit.WRAPPERS_ACPI))
BPF = TagRule("bpf", lambda: reduce(Column.__or__, (F.col("symbol").startswith(p) for p in kit.WRAPPERS_BPF)))
MODULE = TagRule("module", lambda: F.col("symbol").isin(*kit.WRAPPERS_MODULE))
TAG_RULES = (ACPI, BPF, MODULE)


def canonical_tags(tags: DataFrame, rules: Sequence[TagRule] = TAG_RULES) -> DataFrame:
    """Functions and variables outside of noise paths; wrappers, by any of the rules, take their signature's name."""
    bare = F.trim(F.regexp_replace(F.coalesce("signature", F.lit("")), r"^[()]+|[()]+$", ""))
    real = reduce(Column.__or__, (r.applies() for r in rules), F.lit(False)) & (bare != "")
    kinds = F.when(F.col("kind").isin("function", "f") | real, "function").when(F.col("kind").isin("variable", "v"), "variable")
    rows = tags.filter(~is_noise(F.col("file"))).withColumn("is_wrapper", real).withColumn("symbol_type", kinds)
    return rows.filter("symbol_type is not null").withColumn("symbol", F.when(real, bare).otherwise(F.col("symbol")))


def dedup_tags(rows: DataFrame) -> DataFrame:
    """Per file and symbol the smallest line, and how many others there were."""
    first = F.min_by(F.struct("line", "symbol_type", "is_wrapper", "seq"), F.struct("line", "seq"))
    return rows.groupBy("file", "symbol").agg(first.alias("f"), (F.count("*") - 1).alias("duplicates")).select("file", "symbol", "f.line", "f.symbol_type", "f.is_wrapper", "f.seq", "duplicates")


def tag_check(tags: DataFrame, sentinels: tuple[str, ...]) -> DataFrame:
    """Functions with a line and a name that is not all capitals: how many, and whether each sentinel is among them."""
    rows = tags.filter(F.col("kind").isin("function", "f") & (F.col("symbol") != F.upper("symbol")))
    return rows.agg(F.count("*").alias("functions"), *(F.max(F.col("symbol") == s).alias(f"has_{s}") for s in sentinels))


def name_files(tags: DataFrame) -> DataFrame:
    return tags.groupBy("symbol").agg(F.sort_array(F.collect_list("file")).alias("files"))


#: Lines of a file that are cut in one row.
BLOCK = 1024


def _first(sources: DataFrame) -> Column:
    """The line of its file that a source's text begins on."""
    return F.col("first_line") if "first_line" in sources.columns else F.lit(1)


def _lines(sources: DataFrame) -> DataFrame:
    """(file, i, line, last) of the sources; last: the last line of its text."""
    numbered = lambda x: F.transform(x, lambda line, at: F.struct((_first(sources) + at).alias("i"), line.alias("line"), (at + 1 == F.size(x)).alias("last")))
    # made in the array, so that no row carries the text, which is split once
    rows = F.flatten(F.transform(F.array(F.split("text", "\n", -1)), numbered))
    return sources.select("file", F.explode(rows).alias("l")).select("file", "l.*")


def _sorted(rows: DataFrame) -> DataFrame:
    """Joined by sorting. Spark's guess of their size goes by the sources' files, not by the lines that texts hold, and a guess
    that is too low would send whole texts or all symbols through the driver."""
    return rows.hint("merge")


def _net() -> Column:
    return count_of(F.col("line"), "{") - count_of(F.col("line"), "}")


def _along() -> WindowSpec:
    """A file's marks (1) and what is asked (0) in order; what is asked stands before its own line."""
    return Window.partitionBy("file").orderBy("i", "mark").rowsBetween(Window.unboundedPreceding, 0)


def _back(*keys: str) -> WindowSpec:
    """The same from the end."""
    return Window.partitionBy("file", *keys).orderBy(F.desc("i"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)


def _marked(asked: DataFrame, marks: DataFrame) -> DataFrame:
    """What is asked (by start) among the marks (file, i, net, ..), with the depth, before what is asked and after a mark,
    and the file's last line."""
    both = asked.withColumn("mark", F.lit(0)).withColumn("i", F.col("start")).unionByName(marks.withColumn("mark", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("depth", F.coalesce(F.sum("net").over(_along()), F.lit(0)))
    return both.withColumn("last", F.max(F.when(F.col("mark") == 1, F.col("i"))).over(_back()))


def _blocks(sources: DataFrame) -> DataFrame:
    """(file, block, at, lines): the files' lines, ``BLOCK`` a row, from the line at on."""

    def dealt(x: Column) -> Column:
        first = _first(sources)
        last = first + F.size(x) - 1
        block = lambda i: F.floor((i - 1) / BLOCK).cast("int")

        def part(b: Column) -> Column:
            at = F.greatest(first, b * BLOCK + 1)
            return F.struct(b.alias("block"), at.alias("at"), F.slice(x, at - first + 1, F.least(last, (b + 1) * BLOCK) - at + 1).alias("lines"))

        return F.transform(F.sequence(block(first), block(last)), part)

    parts = F.flatten(F.transform(F.array(F.split("text", "\n", -1)), dealt))
    rows = sources.select("file", F.explode(parts).alias("p")).select("file", "p.*").repartition("file", "block")
    whole = rows.groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("at", "lines"))).alias("parts"))
    return whole.select("file", "block", F.col("parts")[0]["at"].alias("at"), F.flatten("parts.lines").alias("lines"))


def _cut(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines start to stop (null: to the last) of each symbol, out of blocks of lines. What lies in one block is cut there;
    the rest is cut in each of its blocks and joined."""
    names = ["symbol", "symbol_type", "start", "stop"]
    block = lambda i: F.floor((i - 1) / BLOCK).cast("int")
    until = F.least("last", F.coalesce("stop", "last"))
    asked = asked.filter(until >= F.col("start")).select("file", *names, until.alias("until"), block(F.col("start")).alias("block"), block(until).alias("to"))
    blocks = _blocks(sources)

    def cut(rows: DataFrame) -> DataFrame:
        held = rows.groupBy("file", "block").agg(F.collect_list(F.struct(*names, "until", "times")).alias("asked")).join(_sorted(blocks), ["file", "block"])

        def own(s: Column) -> Column:
            start = F.greatest(s["start"], F.col("at"))
            length = F.least(s["until"], F.col("at") + F.size("lines") - 1) - start + 1
            return F.struct(s.alias("s"), F.array_join(F.slice("lines", start - F.col("at") + 1, length), "\n").alias("code"))

        return held.select("file", "block", F.explode(F.transform("asked", own)).alias("r")).select("file", "block", "r.s.*", "r.code")

    inside = cut(asked.filter("block = to").withColumn("times", F.lit(1)))
    across = asked.filter("block < to").groupBy("file", *names, "until", "block", "to").agg(F.count("*").cast("int").alias("times"))
    parts = cut(across.withColumn("block", F.explode(F.sequence("block", "to"))))
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "code"))), lambda x: x["code"]), "\n")
    joined = parts.groupBy("file", *names, "times").agg(code.alias("code")).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return inside.select("file", *names, "code").unionByName(joined.select("file", *names, "code"))


def function_blocks(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """The brace block from each function's line. It ends on the first closing line, from its first opening on,
    where the depth is back. One that never is runs to the end of its file, and has no stop.

    If that is not the first closing line after the opening, it is the first later line that falls
    through the depth, so each line stands for the depths that it falls through.
    """
    opens, closes = F.col("line").contains("{"), F.col("line").contains("}")
    marks = _lines(sources).filter(opens | closes | F.col("last")).select("file", "i", _net().alias("net"), opens.alias("opens"), closes.alias("closes"))
    both = _marked(symbols, marks).withColumn("closer", F.min(F.when(F.col("closes"), F.struct("i", "depth"))).over(_back()))
    both = both.withColumn("opened", F.min(F.when(F.col("opens"), F.struct("i", "closer"))).over(_back()))
    level = F.when(F.col("mark") == 0, F.array("depth")).when(F.col("net") < 0, F.sequence(F.col("depth"), F.col("depth") - F.col("net") - 1))
    closer = F.col("opened.closer")
    both = both.select(*symbols.columns, "mark", "last", "depth", closer.alias("closer"), F.when(F.col("mark") == 0, closer["i"]).otherwise(F.col("i")).alias("i"), F.explode(level).alias("level"))
    asked = both.withColumn("end", F.min(F.when(F.col("mark") == 1, F.col("i"))).over(_back("level"))).filter("mark = 0")
    stop = F.when(F.col("closer.depth") <= F.col("depth"), F.col("closer.i")).when(F.col("closer").isNotNull(), F.col("end"))
    return asked.select(*symbols.columns, stop.alias("stop"), "last")


def initializer_blocks(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Initialised structs: from the file's first line that has the name between ``struct`` and ``=``, to where its braces balance.

    One that is balanced on its first line ends there if that has a semicolon, else on the first later
    line with balanced braces. A declaration without ``=`` is none, so such a symbol has no row.
    """
    lines = _lines(sources)
    head = F.regexp_extract("line", r"struct\s+(.*)=", 1)
    heads = lines.filter(F.col("line").contains("struct") & F.col("line").contains("=")).select("file", "i", F.explode(F.array_distinct(F.regexp_extract_all(head, F.lit(r"(\w+)"), F.lit(1)))).alias("symbol"))
    first = heads.groupBy("file", "symbol").agg(F.min("i").alias("start"))
    asked = symbols.drop("start").distinct().join(_sorted(first), ["file", "symbol"]).select(*symbols.columns)
    marks = lines.select("file", "i", _net().alias("net"), F.col("line").contains(";").alias("ends"))
    both = _marked(asked, marks).withColumn("own", F.min(F.when(F.col("mark") == 1, F.struct("i", "net", "ends"))).over(_back()))
    after = F.when(F.col("mark") == 0, F.col("start") + 1).otherwise(F.col("i"))
    both = both.select(*symbols.columns, "mark", "last", "own", after.alias("i"), F.col("depth").alias("level"))
    asked = both.withColumn("end", F.min(F.when(F.col("mark") == 1, F.col("i"))).over(_back("level"))).filter("mark = 0")
    here = (F.col("own.net") == 0) & F.col("own.ends")
    return asked.select(*symbols.columns, F.when(here, F.col("start")).otherwise(F.col("end")).alias("stop"), "last")


def bodies(symbols: DataFrame, sources: DataFrame, variable_suffix: str = "_sched_class") -> DataFrame:
    """Code chunks of symbols (file, symbol, symbol_type, line) out of sources (file, text): functions by their
    line, variables, of the suffix only, by their initializer. What never ends is recorded as ending on its first line (a
    function) or on none (a variable). A file may come in several rows, each with its first_line, and is then never in one row."""
    wanted = symbols.select("file", "symbol", "symbol_type", F.col("line").alias("start"))
    functions = _cut(function_blocks(wanted.filter(F.col("symbol_type") == "function"), sources), sources)
    variables = _cut(initializer_blocks(wanted.filter((F.col("symbol_type") != "function") & F.col("symbol").endswith(variable_suffix)), sources), sources)
    rows = functions.unionByName(variables)
    function = F.col("symbol_type") == "function"
    ident = F.concat(F.when(function, "func:").otherwise("var:"), "file", F.lit(":"), "symbol")
    end = F.coalesce("stop", F.when(function, F.col("start")).otherwise(0)).cast("int")
    return rows.select(F.lit(2).alias("schema_version"), "symbol", "symbol_type", ident.alias("symbol_id"), "file", F.col("start").alias("start_line"), end.alias("end_line"), "code").filter(F.trim("code") != "")


def macro_aliases(sources: DataFrame) -> DataFrame:
    """#define A(..) B(..) lines of sources (file, text)."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(kit.MACRO_ALIAS), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(kit.MACRO_ALIAS), F.lit(2)).alias("t"))
    return sources.select(F.col("file").alias("file_path"), F.posexplode(pairs).alias("place", "m")).select(F.col("m.a").alias("alias"), F.col("m.t").alias("target"), "file_path", "place")


def _nesting(pieces: DataFrame) -> DataFrame:
    """pieces (row, i, piece), cut before each brace, with opens and the depth after the brace. Braces that never
    close and those that close nothing count for nothing. One sort from each end of a text, whatever its length."""
    text = Window.partitionBy("row")
    along, back = text.orderBy("i").rowsBetween(Window.unboundedPreceding, 0), text.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    brace = F.substring("piece", 1, 1)
    rows = pieces.withColumn("delta", F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0))
    rows = rows.withColumn("sum", F.sum("delta").over(along))
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("sum").over(along))).withColumn("later", F.min("sum").over(back))
    idle = (F.col("sum") < F.lag("floor", 1, 0).over(text.orderBy("i"))) | ((F.col("delta") == 1) & (F.col("later") >= F.col("sum")))
    rows = rows.withColumn("delta", F.when(idle, 0).otherwise(F.col("delta")))
    return rows.select("row", "i", "piece", (F.col("delta") == 1).alias("opens"), F.sum("delta").over(along).alias("depth"))


def provider_tables(sources: DataFrame, profile) -> DataFrame:
    """Initialised operation tables of a profile's files: seq, kind, provider, file, op, func.

    A table is a head, by macro or by struct type, and the brace block after it, nested braces
    included. seq numbers slots by file, pattern and place. A text is cut before each brace, and a
    slot's tables are the last openers of each depth before it, so no text is read once a table.
    """
    place = F.array_position(F.array(*(F.lit(x) for x in profile.provider_files)), F.col("file"))
    rows = sources.filter(F.col("file").isin(*profile.provider_files)).select("file", place.cast("long").alias("at"), strip_comments(F.col("text")).alias("text"))
    heads = []
    for p in profile.providers:
        if p.macro:
            heads.append((p, rf"{p.macro}\((\w+)\)\s*=\s*\z", p.suffix))
        if p.struct:
            heads.append((p, rf"(?:static\s+)?(?:const\s+)?struct\s+{p.struct}\s+(\w+)\s*=\s*\z", ""))
    if not heads:
        return sources.sparkSession.createDataFrame([], "seq long, kind string, provider string, file string, op string, func string")
    # equal texts of a file have equal tables, so each is read once
    rows = rows.withColumn("row", F.sha2(F.concat_ws("|", "file", "text"), 256)).groupBy("row", "file", "at").agg(F.first("text").alias("text"))
    texts = rows.select("row", "file", "at")
    pieces = rows.select("row", F.posexplode(F.split("text", r"(?=[{}])", -1)).alias("i", "piece"))
    pair = r"\.(\w+)\s*=\s*(\w+)"
    slots = F.arrays_zip(F.regexp_extract_all("piece", F.lit(pair), F.lit(1)).alias("op"), F.regexp_extract_all("piece", F.lit(pair), F.lit(2)).alias("func"))
    order = Window.partitionBy("row").orderBy("i")
    laid = _nesting(pieces).select("row", "i", "opens", "depth", slots.alias("slots"), *(F.nullif(F.regexp_extract("piece", head, 1), F.lit("")).alias(f"head{n}") for n, (_, head, _) in enumerate(heads)))
    nth = [F.count(f"head{n}").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1 for n in range(len(heads))]
    found = [F.when(F.col(f"head{n}").isNotNull(), F.struct(F.lit(n).alias("n"), nth[n].alias("nth"), F.lit(p.kind).alias("kind"), F.concat(f"head{n}", F.lit(suffix)).alias("provider"))) for n, (p, _, suffix) in enumerate(heads)]
    # a head ends the piece before its brace
    laid = laid.withColumn("heads", F.filter(F.array(*found), lambda x: x.isNotNull()))
    laid = laid.withColumn("own", F.when(F.col("opens"), F.lag("heads").over(order)))
    levels = F.when(F.size("slots") > 0, F.sequence(F.lit(1).cast("long"), "depth")).when(F.col("opens"), F.array("depth"))
    levels = laid.filter((F.col("depth") > 0) & (F.col("opens") | (F.size("slots") > 0))).select("row", "i", "opens", "depth", "own", "slots", F.explode(levels).alias("level"))
    since = Window.partitionBy("row", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    opener = F.last(F.when(F.col("opens") & (F.col("depth") == F.col("level")), F.struct("i", "own")), ignorenulls=True).over(since)
    inside = levels.withColumn("opener", opener).select("row", "i", F.explode("opener.own").alias("head"), "slots").select("row", "i", "head.*", F.posexplode("slots").alias("place", "s"))
    slot = F.row_number().over(Window.partitionBy("row", "n", "nth").orderBy("i", "place")) - 1
    seq = F.col("at") * (1 << 48) + F.col("n") * (1 << 40) + F.col("nth") * (1 << 16) + F.col("slot")
    out = inside.withColumn("slot", slot).filter(F.col("s.op").isin(*profile.operations)).join(texts, "row")
    return out.select(seq.alias("seq"), "kind", "provider", "file", "s.op", "s.func").groupBy("kind", "provider", "file", "op", "func").agg(F.min("seq").alias("seq")).select("seq", "kind", "provider", "file", "op", "func")


def line_audit(sources: DataFrame) -> DataFrame:
    """Lines with blanks only, trailing blanks, or tabs; the first that holds."""
    rows = sources.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    problem = F.when((F.trim("line") == "") & (F.col("line") != ""), "blank").when(F.col("line").rlike(r"[ \t]+$"), "trailing").when(F.col("line").contains("\t"), "tab")
    return rows.select("file", (F.col("at") + 1).alias("line"), problem.alias("problem")).filter("problem is not null")


def tidy(sources: DataFrame) -> DataFrame:
    """The text that line_audit() has nothing to say of: no blanks at the ends of lines, and no tabs."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.replace(F.rtrim(F.regexp_replace(x, r"[ \t]+$", "")), F.lit("\t"), F.lit("        ")))
    return sources.select("file", F.array_join(lines, "\n").alias("text"))


def definitions(names: DataFrame, sources: DataFrame) -> DataFrame:
    """Function definitions of the names (column name) in sources, with their code: a line that has the
    name before a parenthesis, does not end in a semicolon, and is not indented."""
    heads = _lines(sources).filter(F.col("line").rlike(r"^[A-Za-z_].*\b\w+\s*\([^;]*$")).select("file", F.col("i").alias("line"), F.regexp_extract("line", r"\b(\w+)\s*\(", 1).alias("symbol"))
    found = heads.join(names.select(F.col("name").alias("symbol")).distinct(), "symbol", "left_semi").withColumn("symbol_type", F.lit("function"))
    return bodies(found, sources)


def provider_kind(symbol: Column, profile) -> Column:
    """Kind of the first provider pattern whose suffix ends the name."""
    out = F.when(F.lit(False), F.lit(""))
    for p in profile.providers:
        out = out.when(symbol.endswith(p.suffix), p.kind)
    return out
