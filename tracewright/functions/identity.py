"""Stable identities: 64-bit node ids, edge ids, and their printed forms."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(domain: Column, file: Column, scope: Column, symbol: Column, kind: Column) -> Column:
    """First 8 bytes of sha256 of the joined parts, as a signed long (two's complement of the unsigned id)."""
    joined = F.concat_ws(":", domain, file, scope, symbol, kind)
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, -10).cast("long")


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.sha1(F.concat_ws(":", source, target, kind))


def execution_id(symbol: Column, cpu: Column, depth: Column, context: Column) -> Column:
    return F.sha1(F.concat_ws(":", symbol, F.coalesce(cpu.cast("string"), F.lit("None")), depth.cast("string"), context))


def hex_id(node: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(node), 16, "0"))


def unsigned(node: Column) -> Column:
    wide = node.cast("decimal(20,0)")
    return F.when(node < 0, wide + F.lit(Decimal(2**64))).otherwise(wide).cast("decimal(20,0)")


def symbol_id(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("::"), name)


def debug_form(domain: Column, file: Column, scope: Column, symbol: Column, kind: Column) -> Column:
    return F.concat_ws(":", domain, file, scope, kind, symbol)
