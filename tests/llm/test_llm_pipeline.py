"""Every stage on its own input, against plain versions."""

from __future__ import annotations

import corpus_pipeline
from support import DATA

from tracewright.llm.decontam import words_of
from tracewright.llm.shingles import shingle_sets


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        rows = out.collect()
        sizes.append(len(rows))
        if k == 4:
            assert sorted(r.doc_id for r in rows) == sorted(before)
            assert all(len(r.ids) == r.n_tokens for r in rows)
            break
        assert out.columns == columns
        assert all(r.n_chars == len(r.text) for r in rows)
        after = {r.doc_id: r.text for r in rows}
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert all(i in after for i, q in labels.items() if q and i in before)
        if k == 1:
            sets = dict(zip(after, map(set, shingle_sets([t.encode() for t in after.values()])), strict=True))
            ids = sorted(after)
            assert not [1 for x, a in enumerate(ids) for b in ids[:x] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        if k == 2:
            seen: dict[bytes, set[int]] = {}
            for i, t in before.items():
                b = t.encode()
                for s in range(0, len(b) - 199):
                    seen.setdefault(b[s : s + 200], set()).add(i)
            shared = {x for x, own in seen.items() if len(own) > 1}
            for i, t in after.items():
                b = t.encode()
                assert t == before[i] or not any(b[s : s + 200] in shared for s in range(len(b) - 199))
        if k == 3:
            windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [words_of(r.text.encode())] for k in range(max(1, len(w) - 9))}
            for t in after.values():
                w = words_of(t.encode())
                assert not any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9))
        path = f"{corpus_pipeline.Scratch.path(spark, 'test', 'stage')}"
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), after
    assert sizes[0] > sizes[1] >= sizes[2]


def test_run_and_entry(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"](spark, DATA).count() > 0
    assert [n for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) if not any(q.startswith(f"op{n}_") for q in e.queries())] == []


def test_repeated_rows_and_ids_keep_one_copy(spark):
    """Stages 2 and 3 on repeated rows, repeated ids and null ids: one copy of each text stays, and no other text goes."""
    import random

    rng = random.Random(3)
    prose = [" ".join("".join(rng.choice("abcdeio") for _ in range(6)) for _ in range(100)) for _ in range(9)]
    near = prose[5].split(" ")
    near[30] = "changed"
    rows = [(1, prose[0]), (1, prose[0])]  # a repeated row
    rows += [(None, prose[1]), (None, prose[1])]  # all copies without an id
    rows += [(2, prose[2]), (None, prose[2])]  # a copy without an id
    rows += [(3, prose[3]), (4, prose[3]), (4, prose[4])]  # another text under an id that loses its group
    rows += [(5, prose[5]), (6, prose[6]), (6, " ".join(near))]  # a near copy under a repeated id
    rows += [(None, prose[7]), (None, prose[8]), (None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(1, 0), (None, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (None, 7), (None, 8)]
    order = lambda pairs: sorted(pairs, key=repr)
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    path = corpus_pipeline.Scratch.path(spark, "test", "near")
    kept.write.parquet(path)
    kept = spark.read.parquet(path)
    assert order((r.doc_id, r.text) for r in kept.collect()) == order([(i, prose[k]) for i, k in want] + [(None, None), (7, ""), (7, "")])
    read = corpus_pipeline.repeated_passages(spark, kept, DATA).collect()
    assert order((r.doc_id, r.text) for r in read if r.text) == order((i, prose[k]) for i, k in want)


def test_stages_on_awkward_and_empty_tables(spark, tables, empty_tables):
    """Nulls, empties, repeats and clashing columns pass every stage, and no text is lost but by a stage's rule."""
    for folder in (tables[0], empty_tables):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = corpus_pipeline.Scratch.path(spark, "test", "awkward")
            stage(spark, docs, folder).write.parquet(path)
            out = spark.read.parquet(path)
            had, left = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] if k < 4 or x is docs else x.collect() for x in (docs, out))
            if folder == empty_tables:
                assert left == []
            elif k == 4:
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted((i is None, i or 0) for i, _ in had)
            else:
                assert out.columns == columns
            if k in (0, 1):
                assert set(left) <= set(had)
            if k == 1 and folder == tables[0]:
                sets = {t: frozenset(s.tolist()) for t, s in zip((t for _, t in had), shingle_sets([(t or "").encode() for _, t in had]), strict=True)}
                near = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
                parent = list(range(len(had)))
                for i, (_, a) in enumerate(had):
                    for j in range(i):
                        if near(sets[a], sets[had[j][1]]):
                            old, new = parent[i], parent[j]
                            parent = [new if p == old else p for p in parent]
                groups: dict[int, list[tuple]] = {}
                for p, row in zip(parent, had, strict=True):
                    groups.setdefault(p, []).append(row)
                first = [min((i is None, i or 0) for i, _ in own) for own in groups.values()]
                assert sorted((i is None, i or 0) for i, _ in left) == sorted(first)
            docs = out
