"""A small table folder with every awkward case: nulls, empties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

import pytest

CLASHING = ("row", "shard", "slot", "place", "form", "n_shingles", "bands", "spans", "media", "ids", "report", "score", "kept", "host", "x")


def texts(rng: random.Random) -> list[str | None]:
    word = lambda: "".join(rng.choice("abcdeio") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(80), prose(60)
    near = base.split(" ")
    near[40] = "changed"
    # the passage stands in two texts; three texts are equal; one differs in a word
    out = [base, base, base.upper(), " ".join(near), f"{prose(30)} {passage} {prose(20)}", f"{prose(25)} {passage}", None, "", " \t\n", "one two", "one  two", "x" * 700, "é" * 300 + "🙂", prose(4000), "<|endoftext|> it's 1d10t  #$%", "İstanbul ﬁ \x85 \x1c"]
    return [*out, *(prose(rng.randint(1, 40)) for _ in range(20))]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """(folder, rows): documents has a repeated row, a repeated id, and a null id."""
    rng = random.Random(7)
    rows = [(i, t) for i, t in enumerate(texts(rng))]
    rows += [rows[0], (3, "another text under a used id"), (None, rows[4][1])]
    folder = tmp_path_factory.mktemp("tables")
    extra = ", ".join(f"{c} string" for c in CLASHING)
    data = [(i, t, "en", "src0" if k % 3 else None, len(t or ""), *("e",) * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, None if i == 5 else i % 2, None if i == 6 else int(i % 5 == 0)) for i in range(30)] + [(999, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, " ".join((rows[0][1] or "").split()[5:25])), (1, "One, TWO"), (2, ""), (3, None), (4, "one two"), (4, "one two"), (5, "never seen words stand here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "http://a/é\r\nx", "<p>" + "y" * 200), (2, None, "<p>" + "y" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "z" * 150), (7, "u", "z" * 150), (None, "u", "<p>" + "y" * 200), (8, "u", "é" * 50)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), rows


@pytest.fixture(scope="session")
def empty_tables(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
