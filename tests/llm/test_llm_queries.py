"""Each operator's query against a brute-force version, on the awkward tables and on empty ones."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from support import DATA, agree

from tracewright.llm import queries
from tracewright.llm.bpe import tokenizer_file

QUERIES = queries.QUERIES
SHA = lambda b: hashlib.sha256(b).hexdigest()
body = lambda t: (t or "").encode()


def op(n: int):
    return next(q for name, q in QUERIES.items() if name.startswith(f"op{n}_"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    agree(QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).collect() == []


def test_op1_scores_all_rows(spark, tables):
    folder, rows = tables
    got = op(1)(spark, folder).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows if i is not None}
    assert all(r.held_out == held.get(r.doc_id, False) for r in got)


def test_op1_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op(1)(spark, "/root/testdata/sf0.1").collect()}
    labels = [(got[r.doc_id], r.toxic) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r.doc_id in got]
    held = [(r.predicted, y) for r, y in labels if r.held_out]
    found, wrong = sum(p and y for p, y in held), sum(p and not y for p, y in held)
    assert found >= 0.85 * sum(y for _, y in held)
    assert wrong <= 0.01 * len(held)


def folded_words(t: str | None, pattern: str) -> list[str]:
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_op2_brute(spark, tables):
    folder, rows = tables
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = {(str(r.item_id), tuple(folded_words(r.text, pattern))) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = Counter()
    for i, t in rows:
        w = folded_words(t, pattern)
        hit, ids = set(), set()
        for item, words in items:
            n = min(10, len(words))
            for k in range(len(words) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == words[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(item)
        want[i, len(w), len(hit), len(ids), SHA(",".join(sorted(ids)).encode()), bool(hit)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op(2)(spark, folder).collect()) == want
    assert any(k[5] for k in want)


def removed(rows, length: int) -> Counter:
    seen: dict[bytes, list] = {}
    data = [body(t) for _, t in rows]
    for k, b in enumerate(data):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((k, s))
    gone = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + length] = True
    out = Counter()
    for (i, _), b, g in zip(rows, data, gone, strict=True):
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out[i, len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), SHA(kept)] += 1
    return out


def test_op3_brute(spark, tables):
    folder, rows = tables
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op(3)(spark, folder).collect())
    assert got == removed(rows, 200)


@pytest.mark.parametrize(("length", "kgram", "blocks", "group"), [(40, 13, (8, 4), 256), (40, 13, (8, 4), 3), (24, 8, (8,), 0)])
def test_op3_small_strings_and_hot_groups(spark, length, kgram, blocks, group):
    """group: cores with more blocks take the way of hot groups, down to single windows."""
    import random

    from tracewright.llm.substrings import remove_repeats

    rng = random.Random(length + group)
    parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(30, 200))) for _ in range(4)]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 20) : rng.randint(21, 200)] if rng.random() < 0.7 else "ab" * rng.randint(0, 9) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(100, "x" * 300), (101, "x" * 300), (102, "ab" * 200), (103, None)]
    read = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "t", length, kgram=kgram, blocks=blocks, group=group)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in read.collect()) == removed(rows, length)


def test_op4_brute(spark, tables):
    folder, rows = tables
    words = [folded_words(t, r"[^\x20\x09-\x0D]+") for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    known = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    label = {k: rows[k][0] for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a in known:
            for b in known:
                n = len(sets[a] & sets[b])
                if (100 * n >= 85 * len(sets[a] | sets[b])) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    changed, label[a], label[b] = True, low, low
    # rows of one id share its smallest component
    want = Counter((rows[k][0], len(sets[k])) for k in range(len(rows)))
    got = op(4)(spark, folder).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == want
    by = {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 3)}
    assert by == {rows[k][0]: label[k] for k in range(len(rows)) if rows[k][0] not in (None, 3)}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.kept for r in got} >= {True, False}


def test_op5_op6_against_the_library(spark, tables):
    from tokenizers import Tokenizer

    folder, rows = tables
    t = Tokenizer.from_file(tokenizer_file())
    want5, order = Counter(), []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want5[i, len(ids), SHA(np.array(ids, "<u4").tobytes()), SHA(t.decode(ids, skip_special_tokens=False).encode())] += 1
        order.append((i, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()), len(ids) + 1))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op(5)(spark, folder).collect()) == want5
    got = sorted(op(6)(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == Counter(order)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][:-1]


def test_op7_round_trip(spark, tables):
    folder, rows = tables
    got = op(7)(spark, folder).collect()
    want = Counter()
    for i, t in rows:
        p = body(t) + bytes(-len(body(t)) % 64 if t else 64)
        want[i, len(body(t)), len(p), SHA(p), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    forms = {}
    for r in got:  # equal texts, equal values
        assert forms.setdefault((r.n_bytes, r.payload_sha256), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op8_law(spark, tables):
    folder, rows = tables
    got = op(8)(spark, folder).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(body(t)) + 16, zlib.crc32(body(t))) for i, t in rows)
    by: dict[int, list[int]] = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 40
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_op9_records(spark, tables):
    folder, _ = tables
    got = op(9)(spark, folder).collect()
    y, z = SHA(b"<p>" + b"y" * 200), SHA(b"z" * 150)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_digest == y) == Counter([(1, "response", None), (2, "revisit", 1), (None, "revisit", 1)])
    assert Counter((r.page_id, r.record_type) for r in got if r.payload_digest == z) == Counter([(7, "response"), (7, "response")])
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in got if r.payload_bytes < 150} == {(3, 0, "response"), (4, 0, "response"), (5, 5, "response"), (6, 5, "response"), (8, 100, "response")}


def test_op9_negative_and_null_ids(spark):
    """A null id is no smaller than others; one whose group has the id -1 refers to it."""
    from tracewright.llm.warc import archive_pages, read_archives

    page = "q" * 120
    rows = [(-1, "u", page), (None, "u", page), (None, "u", "n" * 120), (None, "u", "n" * 120)]
    got = read_archives(archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "t")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(-1, "response", None), (None, "revisit", -1), (None, "response", None), (None, "response", None)])


def test_op10_all_rows_and_accuracy(spark, tables):
    folder, rows = tables
    got = op(10)(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    read = {r.doc_id: r for r in op(10)(spark, "/root/testdata/sf0.1").collect()}
    held = [(read[r.doc_id].accepted, r.quality) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if read[r.doc_id].held_out]
    assert sum(a == bool(q) for a, q in held) >= 0.98 * len(held)
    assert all(a for a, q in held if q)


def test_op10_shrinkage_against_plain_sums(spark, tables):
    """Sites and scores follow from the evidence by the formulas, group by group; repeated rows and null sites too."""
    from tracewright.llm import quality

    folder, _ = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.quality_scores(docs, labels, "t").collect()
    site_of = {(r.doc_id, r.text): (r.source, r.lang) for r in docs.collect()}
    rows = sorted((r.evidence, r.site) for r in scored)
    assert len(rows) == len(scored) == docs.count() and len(site_of) == len({r.key for r in scored})
    evidence = spark.createDataFrame([(x, "h", "p", i) for i, x in enumerate([0.9, 0.8, 0.2, 0.9])], "e double, h string, p string, i long")
    groups = evidence.groupBy("h").agg(*[f.alias(n) for f, n in ((quality.F.sum("e"), "total"), (quality.F.count("*"), "n"), (quality.F.sum(quality.F.col("e") * (1 - quality.F.col("e"))), "within"))])
    assert quality.strength(groups, 0.7) == 1e6  # one group tells nothing of how groups differ
    assert all(0 < s < 1 for _, s in rows)


def test_op10_is_judged_by_row(spark):
    """A bad row takes no other row of its id along; a null id is judged too; a repeated label counts once."""
    from tracewright.llm import quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels, "t").collect()}
    bad, good = min(scores, key=scores.get), max(scores, key=scores.get)
    more = docs.filter(docs.doc_id == good).withColumn("doc_id", quality.F.lit(bad).cast("long")).union(docs.filter(docs.doc_id == bad).withColumn("doc_id", quality.F.lit(None).cast("long")))
    kept = quality.keep_good(docs.union(more), labels.union(labels), "t").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert (bad, texts[good]) in {(r.doc_id, r.text) for r in kept}
    assert (bad, texts[bad]) not in {(r.doc_id, r.text) for r in kept} and None not in {r.doc_id for r in kept}


def test_page_site(spark):
    from tracewright.llm.quality import F, page_site

    rows = spark.createDataFrame([("https://A.org/x/y?q",), ("http://b.org",), ("junk",), (None,)], "u string")
    assert [tuple(r) for r in rows.select(*page_site(F.col("u"))).collect()] == [("a.org", "/x"), ("b.org", ""), (None, "junk"), (None, None)]


def test_op1_scores_do_not_follow_the_sampling_rates(spark):
    """A cap that binds on clean rows alone leaves the scores of rows without decisive evidence where they are."""
    import random

    from tracewright.llm.toxicity import toxicity_scores

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(3))
    data = []
    for i in range(3600):
        toxic = i % 8 == 0
        said = [word() for _ in range(20)]
        # the stem stands in three quarters of the toxic and a tenth of the clean texts
        if rng.random() < (0.75 if toxic else 0.1):
            said[rng.randrange(20)] = "stupid"
        data.append((i, " ".join(said), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in data], "doc_id long, toxic int")
    whole, capped = ({r.doc_id: r.score for r in toxicity_scores(docs, labels, "t", **bounds).collect()} for bounds in ({}, {"fit_clean": 500}))
    hit, plain = ([i for i, t, _ in data if ("stupid" in t) == x] for x in (True, False))
    for ids in (hit, plain):
        a, b = (np.mean([s[i] for i in ids]) for s in (whole, capped))
        assert abs(a - b) < 0.12
