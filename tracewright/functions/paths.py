"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import kit


def is_noise(path: Column) -> Column:
    """Under tools/, samples/ or Documentation/. Startswith tests reach the scan."""
    out = F.lit(False)
    for prefix in kit.NOISE_PATHS:
        out = out | path.startswith(prefix)
    return out


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def parts(path: Column) -> Column:
    """Directories of a path, as locality_rank compares them."""
    return F.split(directory(path), "/", -1)


def locality_rank(reference: Column, candidate: Column, reference_parts: Column | None = None, candidate_parts: Column | None = None) -> Column:
    """5 for one file, else the common leading directories, at most 4; -5 for a stranger under tools/.

    Give the parts where many pairs are compared: they are then made once a path, before the join.
    """
    a = parts(reference) if reference_parts is None else reference_parts
    b = parts(candidate) if candidate_parts is None else candidate_parts
    same = F.zip_with(F.slice(a, 1, 4), F.slice(b, 1, 4), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    near = F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")
    return F.when(F.coalesce(reference, F.lit("")) == "", 0).when(reference == candidate, 5).when((near == 0) & candidate.startswith("tools/"), -5).otherwise(near).cast("int")


def subsystem(path: Column) -> Column:
    """By the first textual prefix."""
    inner = F.regexp_replace(path, "^/+|/+$", "")
    out = F.when(F.lit(False), F.lit(""))
    for prefix, name in kit.SUBSYSTEMS:
        out = out.when(inner.startswith(prefix), name)
    return out.otherwise("kernel_core")
