"""Comparison of results across engines."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"


def plain(v):
    """Values of both engines in one form."""
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def agree(spark_df, duck_relation):
    assert sorted(spark_df.columns) == sorted(duck_relation.columns)
    a, b = rows_of(spark_df.columns, spark_df.collect()), rows_of(duck_relation.columns, duck_relation.fetchall())
    assert len(a) == len(b)
    assert a == b
