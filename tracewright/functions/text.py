"""Source text as columns: comment removal that keeps lines, and pattern matches with their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import kit

#: Before a match, between its groups, and after them.
_MARK, _NEXT, _END = "\u0001", "\u0005", "\u0006"


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def clean_code(code: Column, compat_comments: bool = False) -> Column:
    """Comments removed, their newlines kept. compat_comments: a // blanks all that follows it."""
    pattern = kit.COMMENT_TO_END if compat_comments else kit.COMMENT
    between = F.split(code, pattern, -1)
    lines = F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, r"[^\n]", ""))
    cleaned = F.array_join(F.zip_with(between, lines, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(code.contains("/*") | code.contains("//"), cleaned).otherwise(code)


def strip_comments(code: Column) -> Column:
    """Comments removed with their newlines."""
    return F.regexp_replace(code, kit.COMMENT, "")


def matches(text: Column, pattern: str, groups: int) -> Column:
    """Array of (line, g1 .. gn) of all matches, left to right; line counts newlines before the match, from 0.

    The text is searched once, whatever the number of groups: a match is preceded by a mark and its groups, each with a
    mark after it. Cut at the marks, the text has a stride of pieces a match, of which the last is plain text; the
    lines of the plain pieces give the matches' lines in their order. The marks themselves, control characters,
    are dropped from the text first, if it has any. A null text has no matches.
    """
    marks, stride = (_MARK, _NEXT, _END), groups + 1
    own = _MARK + _NEXT.join(f"${k}" for k in range(1, groups + 1)) + _END + "$0"

    def marked(text: Column) -> Column:
        bare = reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit("")), marks, text)
        return F.regexp_replace(F.when(text.rlike(f"[{''.join(marks)}]"), bare).otherwise(text), pattern, own)

    def found(pieces: Column) -> Column:
        plain = F.filter(pieces, lambda _, i: i % stride == 0)
        times = lambda line: F.size(F.split(line, _MARK, -1)) - 1
        own_lines = F.transform(F.split(F.array_join(plain, _MARK), "\n", -1), lambda line, i: F.when(line.contains(_MARK), F.array_repeat(i, times(line))).otherwise(F.array().cast("array<int>")))
        return F.transform(F.flatten(own_lines), lambda line, m: F.struct(line.alias("line"), *(F.get(pieces, m * stride + k).alias(f"g{k}") for k in range(1, groups + 1))))

    # bound by lambdas, so that no text is made or searched again for each use
    return F.element_at(F.transform(F.transform(F.array(F.coalesce(text, F.lit(""))), lambda t: F.split(marked(t), f"[{''.join(marks)}]", -1)), found), 1)


def first_argument(arguments: Column) -> Column:
    return F.trim(F.element_at(F.split(arguments, ",", -1), 1))


def slug(expression: Column) -> Column:
    """Member access and indexes as underscores."""
    for old, new in (("->", "_"), (".", "_"), ("[", "_"), ("]", "")):
        expression = F.replace(expression, F.lit(old), F.lit(new))
    return expression


def first_identifier(expression: Column) -> Column:
    found = F.regexp_extract(expression, r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b", 1)
    return F.nullif(found, F.lit(""))


def lookup_name(expression: Column) -> Column:
    """Without leading & and blanks."""
    return F.trim(F.regexp_replace(expression, "^&+", ""))


def c_type(raw: Column, declarator: Column) -> Column:
    """Struct of type_name, kind, qualifiers, pointer_level."""
    words = "|".join(kit.QUALIFIERS)
    plain = F.trim(F.replace(F.regexp_replace(raw, rf"\b({words})\b", ""), F.lit("*"), F.lit("")))
    kind, name = F.lit("builtin"), plain
    typedef = plain.endswith("_t") | ~plain.isin(*kit.BUILTIN_TYPES)
    kind = F.when(plain.rlike(r"\bstruct\b"), "struct").when(plain.rlike(r"\benum\b"), "enum").when(plain.rlike(r"\bunion\b"), "union").when(typedef, "typedef").otherwise(kind)
    name = F.when(kind.isin("struct", "enum", "union"), F.trim(F.regexp_replace(plain, F.concat(F.lit(r"\b"), kind, F.lit(r"\b")), F.lit("")))).otherwise(plain)
    qualifiers = F.filter(F.array(*(F.lit(q) for q in kit.QUALIFIERS)), lambda q: raw.contains(q))
    return F.struct(name.alias("type_name"), kind.alias("kind"), qualifiers.alias("qualifiers"), (count_of(raw, "*") + count_of(declarator, "*")).alias("pointer_level"))
