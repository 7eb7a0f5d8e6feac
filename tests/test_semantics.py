"""Rules that the generated corpora do not reach, on hand-made code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracewright.engine import Engine, Project
from tracewright.functions.paths import locality_rank
from tracewright.functions.text import clean_code, matches
from tracewright.operators import extract, frontend, graph, relate, store, traverse
from tracewright.plans import kit
from tracewright.plans.profiles import PROFILES, SCHED, detect
from tracewright.sources.readers import mock_chunks
from tracewright.sources.writers import fact_report
from tracewright.streaming.ingest import ingest, stream_chunks


def chunk(spark, code, start=10):
    return extract.prepared(spark.createDataFrame([(0, "func:a/b.c:f", "f", "a/b.c", start, code)], "seq long, symbol_id string, symbol string, file string, start_line int, code string"))


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


def test_comments_keep_lines(spark):
    text = "a /* x\n\ny */ b // c\nd // e"
    assert one(spark, clean_code(F.col("v")), text) == "a \n\n b \nd "
    assert one(spark, clean_code(F.col("v"), True), text) == "a \n\n b \n"


def test_match_lines(spark):
    found = one(spark, matches(F.col("v"), kit.CALL, 2), "a(1);\n\nb(2,\n3); c();\n")
    assert [(m["line"], m["g1"], m["g2"]) for m in found] == [(0, "a", "1"), (2, "b", "2,\n3"), (3, "c", "")]


def test_greedy_arguments_swallow_inner_calls(spark):
    rows = extract.extract_calls(chunk(spark, "void f(void)\n{\nif (foo(x)) { bar(y);\nbaz(z);\n}")).collect()
    assert [(r.name, r.line) for r in rows] == [("baz", 13)]


def test_unspaced_operators(spark):
    rows = extract.extract_assignments(chunk(spark, "void f(int x)\n{\nx-=1;\nif (a>=b) x++;\n}")).collect()
    assert ("x-", "=") in {(r.expr, r.operator) for r in rows}


def test_guards_nest_and_pop_in_order(spark):
    code = "void f(struct q *q)\n{\nrcu_read_lock();\nmutex_lock(&q->m);\nq->a = 1;\nrcu_read_unlock();\nq->b = 2;\nmutex_unlock(&q->m);\n}"
    rows = relate.scopes(extract.extract_facts(chunk(spark, code))).collect()
    pairs = {(r.type, r.source_semantic_id.split(":")[-1], r.target_semantic_id.split(":", 2)[-1]) for r in rows}
    assert ("matches", "mutex_lock", "15:read_unlock:rcu_read_unlock") in pairs  # the last opened guard, whatever it locks
    assert sum(r.type == "protects" for r in rows) == 3


def test_unbalanced_closers_are_ignored(spark):
    rows = relate.scopes(extract.extract_facts(chunk(spark, "void f(int x)\n{\nspin_unlock(&l);\nx = 1;\n}"))).collect()
    assert rows == []


def test_locals_and_parameters(spark):
    code = "static int f(const struct page *p, unsigned long n, char *s)\n{\n\tint a = 1, *b;\n\tu32 c;\n\treturn 0;\n\tgoto out;\n}"
    rows = extract.extract_locals(chunk(spark, code)).orderBy("ordinal").collect()
    assert [(r.name, r.storage, r.type["type_name"], r.type["kind"], r.type["pointer_level"], r.declaration_line) for r in rows] == [
        ("p", "parameter", "page", "struct", 1, 1), ("n", "parameter", "unsigned long", "typedef", 0, 1), ("s", "parameter", "char", "builtin", 1, 1),
        ("a", "local", "int", "builtin", 0, 3), ("b", "local", "int", "builtin", 1, 3), ("c", "local", "u32", "typedef", 0, 4),
    ]
    assert extract.extract_locals(chunk(spark, "void f(void)\n{\n}")).count() == 0


def test_rcu_roles_and_iterations(spark):
    code = "void f(struct h *head)\n{\np = rcu_dereference(head->next);\nrcu_assign_pointer(head->a[0], p);\nhash_for_each(table, bkt, tmp, obj, node)\n;\nsynchronize_rcu();\n}"
    facts = extract.extract_facts(chunk(spark, code)).collect()
    rcu = {r.kind: (r.expr, r.resolved) for r in facts if r.domain == "RCU"}
    assert rcu == {"deref": ("head->next", "head"), "publish": ("head->a[0]", "head"), "grace_period": (None, None)}
    loop = next(r for r in facts if r.domain == "Iteration")
    assert (loop.expr, loop.args, loop.kind) == ("table", ["obj", "next"], "hash")


def test_locality(spark):
    rank = lambda a, b: one(spark, locality_rank(F.lit(a), F.lit(b)))
    assert [rank("", "a"), rank("a/b.c", "a/b.c"), rank("a/b/c/d/e.c", "a/b/c/d/f.c"), rank("a/x.c", "a/y/z.c"), rank("net/x.c", "tools/y.c"), rank("net/x.c", "fs/y.c")] == [0, 5, 4, 1, -5, 0]


def test_bodies(spark):
    text = "int x;\nvoid f(void)\n{\n\tif (a) {\n\t}\n}\nstruct s x_sched_class = {\n.a = b,\n};\nvoid g(void)\n{\n"
    symbols = spark.createDataFrame([("f", "function", "a.c", 2), ("x_sched_class", "variable", "a.c", 7), ("x", "variable", "a.c", 1), ("g", "function", "a.c", 10)], "symbol string, symbol_type string, file string, line int")
    rows = {r.symbol: r for r in frontend.bodies(symbols, spark.createDataFrame([("a.c", text)], "file string, text string")).collect()}
    assert set(rows) == {"f", "x_sched_class", "g"}
    assert (rows["f"].end_line, rows["f"].code.count("\n")) == (6, 4)
    assert rows["x_sched_class"].code.endswith("};")
    assert (rows["g"].start_line, rows["g"].end_line) == (10, 10)


def test_tags_are_parsed_strictly(spark):
    lines = ["!_TAG_FILE\tx", "", "f\ta.c\t/^f$/;\"\tf\tline:3\tsignature:(int)\tfoo:bar", "g\ta.c\t/^g$/;\"\tf", "h\ta.c", "k\ta.c\t/^k$/;\"\tf\tline:0", "v\ta.c\t/^v$/;\"\tkind:v\tline:9"]
    rows = frontend.parse_tags(spark.createDataFrame(list(enumerate(lines)), "seq long, value string")).orderBy("seq").collect()
    assert [(r.symbol, r.kind, r.line) for r in rows] == [("f", "f", 3), ("v", "v", 9)]
    assert rows[0].extensions == {"foo": "bar"}


def test_best_resolution_rejects_ties(spark):
    symbols = spark.createDataFrame([("a/x.c", "f", "a/x.c::f"), ("a/y.c", "f", "a/y.c::f"), ("b/z.c", "g", "b/z.c::g")], "file_path string, symbol_name string, symbol_id string")
    refs = spark.createDataFrame([(1, "f", "a/q.c"), (2, "f", "a/x.c"), (3, "g", "zz/k.c"), (4, "none", "a/x.c")], "k long, name string, file string")
    got = {r.k: r.resolved_id for r in graph.resolve_best(refs, symbols, "k", "name", "file").collect()}
    assert got == {1: None, 2: "a/x.c::f", 3: "b/z.c::g", 4: None}


def test_traces(spark):
    rows = [("a::s", "a::t", "DIRECT_CALL", 1.0), ("a::s", "a::d", "FUNCTION_POINTER_DISPATCH", 1.0), ("a::d", "a::e", "SYNTHETIC_CONTINUATION", 1.0), ("a::d", "a::x", "DIRECT_CALL", 90.0), ("a::e", "a::s", "DIRECT_CALL", 1.0), ("a::t", "a::m", "MACRO_ALIAS", 1.0)]
    edges = spark.createDataFrame([(f"e{i}", a, b, k, c, True, i) for i, (a, b, k, c) in enumerate(rows)], "edge_id string, src string, dst string, edge_type string, confidence double, is_deterministic boolean, seq long")
    assert [n for n, _ in traverse.descent(edges, "a::s").nodes] == ["a::s", "a::d", "a::e"]
    assert [n for n, _ in traverse.dispatch_trace(edges, "a::s").nodes] == ["a::s", "a::d", "a::e"]
    full = traverse.full_branch(edges, "a::s")
    assert {n for n, _ in full.nodes} == {"a::s", "a::t", "a::d", "a::e", "a::x", "a::m"}
    assert traverse.full_branch(edges, "a::s", max_nodes=3).stats["hit_node_limit"]
    assert traverse.descent(edges, "a::t").annotations == [("a::t", "a::m", "MACRO_ALIAS")]


def test_working_set_filters_kinds(spark):
    edges = spark.createDataFrame([(1, 2, "PROTECTS"), (1, 3, "DATA_FLOW")], "src long, dst long, kind string")
    rows = traverse.working_set(edges, 1, traverse.QueryContext(frozenset({"PROTECTS", "MATCHES"}), max_depth=2)).collect()
    assert [(r.src, r.dst) for r in rows] == [(1, 2)]
    assert traverse.working_set(edges, 1, traverse.QueryContext(frozenset({"PROTECTS"}), max_depth=0)).count() == 0


def test_profiles():
    assert (detect("1-Explain the Linux scheduler"), detect("a thread"), detect("nothing"), detect("5-x y")) == ("sched", "vfs", None, "generic")
    assert len(PROFILES) == 8
    assert SCHED.transitions[("schedule", "__schedule")] == 20.0


def test_last_and_first_wins(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, seq long")
    assert {(r.k, r.v) for r in store.last_wins(rows, ["k"], ["seq"]).collect()} == {(1, "b"), (2, "c")}
    assert {(r.k, r.v) for r in store.first_wins(rows, ["k"], ["seq"]).collect()} == {(1, "a"), (2, "c")}


def test_engine_end_to_end(spark, tmp_path):
    engine, project = Engine(spark), Project("p", str(tmp_path), str(tmp_path / "w"))
    events: list[str] = []
    result = engine.compile(project, "mock", on_event=lambda kind, _: events.append(kind))
    assert result.success, result.diagnostics
    assert (result.rows["collections"], events[0], events[-1]) == (1, "started", "finished")
    assert Project.load(spark, project.workspace) == project
    with engine.session(project) as session:
        assert session.query_symbol("touch").count() == 0  # swallowed by the loop's greedy arguments
        assert session.query_symbol("spin").count() == 1
        anchor = session.query_symbol("spin").first()["node_id"]
        assert session.working_set(anchor, traverse.QueryContext(frozenset({"protects", "matches"}))).count() >= 0
    try:
        session.query_symbol("x")
    except RuntimeError:
        pass
    else:
        raise AssertionError("a closed session must not answer")
    failed = engine.compile(project, "linux")
    assert not failed.success and "FileNotFoundError" in failed.diagnostics[0]


def test_incremental_ingest_equals_batch(spark, tmp_path):
    mock_chunks(spark).filter("symbol_id is not null").drop("seq").coalesce(1).write.json(str(tmp_path / "in"))
    told: list[int] = []
    ingest(stream_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), lambda n, _: told.append(n)).awaitTermination()
    nodes = spark.read.parquet(str(tmp_path / "out" / "nodes"))
    facts = extract.extract_facts(extract.prepared(mock_chunks(spark).filter("symbol_id is not null")))
    assert told == [0]
    assert {r.node_id for r in nodes.collect()} == {r.node_id for r in store.node_rows(facts).collect()}


def test_working_set_cap_against_a_plain_walk(spark):
    """The same edges as a queue would record, where the cap of nodes binds."""
    import random

    from tracewright.operators.traverse import QueryContext, working_set

    rng = random.Random(2)
    rows = sorted({(rng.randrange(30), rng.randrange(30), rng.choice("ab")) for _ in range(120)})
    edges = spark.createDataFrame(rows, "src long, dst long, kind string")
    for most in (1, 2, 7, 100):
        visited, queue, want = {0}, [(0, 0)], []
        while queue:
            here, depth = queue.pop(0)
            if depth >= 3:
                continue
            for src, dst, kind in (r for r in rows if r[0] == here):
                want.append((src, dst, kind, depth))
                if dst not in visited and len(visited) < most:
                    visited.add(dst)
                    queue.append((dst, depth + 1))
        got = working_set(edges, 0, QueryContext(frozenset("ab"), 3, most)).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_full_branch_on_a_hub(spark):
    """Of a node with more edges than reach the driver, the best five are taken, and the rest are told as left out."""
    from tracewright.operators.traverse import full_branch

    rows = [("a.c::hub", f"a.c::n{k}", f"e{k}", "DIRECT_CALL", k / 1000, True, k) for k in range(900)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_id string, edge_type string, confidence double, is_deterministic boolean, seq long")
    trace = full_branch(edges, "a.c::hub")
    assert [e[2] for e in trace.edges] == ["e899", "e898", "e897", "e896", "e895"]
    assert trace.stats["truncated_branches"] == 895


def test_unknown_source_is_an_error(spark):
    from tracewright.operators.graph import known_sources

    symbols = spark.createDataFrame([("a",)], "symbol_id string")
    assert known_sources(spark.createDataFrame([("a", "b")], "src string, dst string"), symbols).count() == 1
    with pytest.raises(Exception, match="unknown source symbol: x"):
        known_sources(spark.createDataFrame([("x", "b")], "src string, dst string"), symbols).collect()


def test_another_dialect_and_own_rules(spark):
    from dataclasses import replace

    from tracewright.operators.extract import RULES, Rule, extract_facts, prepared
    from tracewright.operators.frontend import TagRule, canonical_tags
    from tracewright.plans import profiles
    from tracewright.plans.kit import LINUX

    code = "void f(int a)\n{\n\ttake(&a);\n\tgive(&a);\n}\n"
    chunk = prepared(spark.createDataFrame([("func:x.c:f", "x.c", 1, code)], "symbol_id string, file string, start_line int, code string"))
    other = replace(LINUX, name="other", acquire={"take": False}, release={"give": False})
    assert [r.fact_type for r in extract_facts(chunk, dialect=other).filter("domain = 'Synchronization'").orderBy("line").collect()] == ["LockAcquire", "LockRelease"]
    # a rule of one's own takes its place among the others
    lines = Rule(9, lambda _: F.array(F.struct(F.lit(0).alias("line"), F.lit("whole").alias("g1"), F.lit("").alias("g2"))), lambda _: {"semantic_id": F.lit("own:1"), "domain": F.lit("State"), "name": F.col("g1")})
    assert [(r.name, r.line) for r in extract_facts(chunk, rules=(*RULES, lines)).filter("domain = 'State'").collect()] == [("whole", 1)]
    tags = spark.createDataFrame([("WRAP", "a.c", "macro", 3, "(inner)", 1)], "symbol string, file string, kind string, line int, signature string, seq long")
    assert canonical_tags(tags).count() == 0
    assert canonical_tags(tags, [TagRule("wrap", lambda: F.col("symbol") == "WRAP")]).first().symbol == "inner"
    profiles.register("own", replace(profiles.GENERIC, name="own"))
    assert profiles.get("own").name == "own"
    with pytest.raises(KeyError, match="no profile"):
        profiles.get("none")


def test_streaming_upserts_across_batches(spark, tmp_path):
    """A function that is compiled again replaces its rows; a batch that is replayed changes nothing."""
    from tracewright.streaming.ingest import read_table, upsert_batch

    def batch(*codes):
        return spark.createDataFrame([(f"func:a.c:f{k}", f"f{k}", "a.c", 1, c) for k, c in codes], "symbol_id string, symbol string, file string, start_line int, code string")

    out = str(tmp_path / "store")
    body = "void f{0}(struct q *q)\n{{\nspin_lock(&q->l);\nq->a = 1;\nspin_unlock(&q->l);\n}}\n"
    upsert_batch(batch((1, body.format(1)), (2, body.format(2))), 0, out)
    first = {n: read_table(spark, out, n).count() for n in ("nodes", "edges", "symbols")}
    assert upsert_batch(batch((1, body.format(1))), 0, out) == {}
    upsert_batch(batch((2, body.format(2)), (3, body.format(3).replace("q->a", "q->b"))), 1, out)
    assert read_table(spark, out, "symbols").count() == 3
    nodes = read_table(spark, out, "nodes")
    assert nodes.count() == nodes.select("node_id").distinct().count() > first["nodes"] - 1
    assert {r.name for r in read_table(spark, out, "facts").filter("domain = 'Synchronization'").collect()} == {"spin_lock", "spin_unlock"}


def test_workspace_store_and_reports(spark, tmp_path):
    from tracewright.operators import frontend, store
    from tracewright.sources import readers, writers
    from tracewright.sources.storage import Store

    at = Store(spark, (tmp_path / "w").as_uri())
    assert not at.exists() and at.names() == []
    at.make()
    at.write("x.json", "é")
    at.write("x.json", "{}")
    assert (at.read("x.json"), at.size("x.json"), at.names()) == ("{}", 2, ["x.json"])
    (tmp_path / "src" / "drivers" / "a").mkdir(parents=True)
    (tmp_path / "src" / "drivers" / "a" / "x.c").write_text("int x;")
    (tmp_path / "src" / "drivers" / "a" / "x.txt").write_text("no")
    (tmp_path / "src" / "include").mkdir()
    (tmp_path / "src" / "include" / "y.h").write_text("int y;")
    root = str(tmp_path / "src")
    assert sorted(map(tuple, readers.read_sources(spark, root).collect())) == [("drivers/a/x.c", "int x;"), ("include/y.h", "int y;")]
    assert [tuple(r) for r in readers.read_listed(spark, root, ("include/y.h", "none.c")).collect()] == [("include/y.h", "int y;")]
    spark.range(30).write.parquet(f"{root}/t.parquet")
    told = readers.describe_store(spark, root).first()
    assert (told.name, told.columns, told.rows) == ("t", "id", 30) and told.bytes > 0
    assert readers.sample_rows(spark.range(30), "id").count() == 25
    chunks = spark.createDataFrame([("a.c", "f", "int f;")], "file string, symbol string, code string")
    writers.write_chunks(chunks, f"{root}/c.jsonl")
    assert readers.read_chunks(spark, f"{root}/c.jsonl").first().symbol_id == "func:a.c:f"
    writers.save_lines(chunks.select("code"), f"{root}/lines")
    assert spark.read.text(f"{root}/lines").first().value == "int f;"
    made = store.report({"a": 10}, {"a": 1 << 20}, {"a": 0.0}, version=1)
    assert made["megabytes"] == {"a": 1.0} and made["phases"]["a"]["rows_a_second"] == 10_000.0 and made["version"] == 1
    stamp = spark.range(1).select(*[c.alias(n) for n, c in writers.stamps().items()]).first()
    assert len(stamp.plain) == 19 and len(stamp.file) == 15 and stamp.iso[10] == "T"
    untidy = spark.createDataFrame([("a", "x \n\ty\n  ")], "file string, text string")
    assert frontend.line_audit(frontend.tidy(untidy)).count() == 0


def test_query_loop_and_cache(spark, tmp_path):
    from tracewright.engine import Engine, Project

    rows = [("a.c::f", "b.c::g", "e", "DIRECT_CALL", 1.0, True, 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_id string, edge_type string, confidence double, is_deterministic boolean, seq long")
    engine = Engine(spark)
    got = list(engine.answer(edges, iter(["2-how", "", "5-a.c f", "5-alone", "exit", "2-after"]), lambda _: "a.c::f"))
    assert [t for t, _ in got] == ["2-how", "5-a.c f", "5-alone"]
    assert [n for n, _ in got[0][1].nodes] == ["a.c::f", "b.c::g"] and len(got[1][1].edges) == 1 and "ValueError" in got[2][1]
    project = Project("p", str(tmp_path), str(tmp_path / "w"))
    assert engine.cached(project) is None
    told = []
    result = engine.compile(project, "mock", on_event=lambda kind, what: told.append((kind, what)))
    assert result.success and set(result.phases) >= {"facts", "nodes", "edges"} and result.as_dict()["timing"]["phases"]
    assert told[0][0] == "started" and told[-1][0] == "finished" and ("phase", {"name": "edges"}) in told
    assert engine.cached(project) is not None
    assert engine.cached(project, "sched") is None and engine.cached(project, enabled=False) is None


def test_prompt_has_its_parts(spark):
    from tracewright.operators import retrieve

    names = spark.createDataFrame([("a", "fa"), ("b", "fb"), ("i", "k:op")], "symbol_id string, name string")
    walk = spark.createDataFrame([(1, 0, "a", "b", "process_context")], "query int, place long, src string, dst string, context string")
    edges = spark.createDataFrame([("i", "b", "FUNCTION_POINTER_DISPATCH", 3), ("a", "b", "DIRECT_CALL", 1)], "src string, dst string, edge_type string, seq long")
    asked = spark.createDataFrame([(1, "how?", "kernel/sched"), (2, "no trace", "mm")], "query int, question string, subsystem string")
    code = spark.createDataFrame([(1, "FILE: a.c")], "query int, prompt string")
    made = {r.query: r.prompt for r in retrieve.prompts(asked, retrieve.runtime_lines(walk, names), retrieve.dispatch_lines(edges, names), code, "do so").collect()}
    assert made[1] == "QUESTION:\nhow?\n\nSUBSYSTEM:\nkernel/sched\n\nRUNTIME EXECUTION FLOW:\n[PROCESS_CONTEXT] fa  -> fb\n\nSEMANTIC DISPATCH FLOW:\n[DISPATCH] k:op -> fb\n\nRELEVANT KERNEL CODE:\nFILE: a.c\n\nInstructions:\ndo so"
    assert "RUNTIME EXECUTION FLOW:\n\n\nSEMANTIC" in made[2]


def test_provider_tables_of_one_long_file(spark):
    tables = 12_000
    text = "} int f(void) { if (a) { } }\n" + "".join(f"static const struct sched_class c{k} = {{ .opts = {{ .pick_task = p{k} }}, /* }} */ .yield_task = y{k}, }};\n" for k in range(tables)) + "DEFINE_SCHED_CLASS(last) = { .pick_task = x };\nstruct sched_class never = { .pick_task = no, .in = { .yield_task = no },"
    rows = frontend.provider_tables(spark.createDataFrame([("kernel/sched/rt.c", text)], "file string, text string"), SCHED).orderBy("seq").collect()
    assert len(rows) == 2 * tables + 1
    # the macro's pattern is numbered before the struct's
    assert [(r.provider, r.op, r.func) for r in rows[:3]] == [("last_sched_class", "pick_task", "x"), ("c0", "pick_task", "p0"), ("c0", "yield_task", "y0")]
    assert rows[-1].func == f"y{tables - 1}" and len({r.seq for r in rows}) == len(rows)


def test_bodies_across_rows_and_blocks(spark):
    body = lambda k, n: f"void f{k}(void)\n{{\n\tif (a) {{ b(); }} else {{\n" + "\tx;\n" * n + "\t}\n}"
    pieces = [body(k, 700 * (k % 3)) for k in range(9)] + ["void open(void)\n{\n" + "y;\n" * 2000 + "z;"]
    starts = [1 + sum(p.count("\n") + 1 for p in pieces[:k]) for k in range(len(pieces))]
    symbols = spark.createDataFrame([*((f"f{k}", "function", "a.c", starts[k]) for k in range(9)), ("open", "function", "a.c", starts[9])], "symbol string, symbol_type string, file string, line int")
    in_rows = spark.createDataFrame([("a.c", n, p) for n, p in zip(starts, pieces)], "file string, first_line int, text string")
    in_one = spark.createDataFrame([("a.c", "\n".join(pieces))], "file string, text string")
    for sources in (in_rows, in_one):
        rows = {r.symbol: r for r in frontend.bodies(symbols.union(symbols.filter("symbol = 'f1'")), sources).collect()}
        assert {s: r.code for s, r in rows.items()} == {**{f"f{k}": pieces[k] for k in range(9)}, "open": pieces[9]}
        assert all(rows[f"f{k}"].end_line == starts[k + 1] - 1 for k in range(9)) and rows["open"].end_line == starts[9]
    assert frontend.bodies(symbols.union(symbols.filter("symbol = 'f1'")), in_rows).filter("symbol = 'f1'").count() == 2


def test_bodies_send_no_texts_through_the_driver(spark):
    sources = spark.range(40).select(F.concat(F.lit("k/f"), "id", F.lit(".c")).alias("file"), F.lit("int f(void)\n{\n}\nstruct s a_sched_class = {\n\t.x = 1,\n};").alias("text"))
    asked = F.explode(F.array(F.struct(F.lit("f").alias("symbol"), F.lit("function").alias("symbol_type")), F.struct(F.lit("a_sched_class").alias("symbol"), F.lit("variable").alias("symbol_type")))).alias("s")
    cut = frontend.bodies(sources.select("file", asked).select("file", "s.*", F.lit(1).alias("line")), sources)
    assert [(r.symbol, r.start_line, r.end_line, r["count"]) for r in cut.groupBy("symbol", "start_line", "end_line").count().sort("symbol").collect()] == [("a_sched_class", 4, 6, 40), ("f", 1, 3, 40)]
    rows = cut._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in rows and "Broadcast" not in rows


def test_aliases_are_looked_up_once_a_file_and_name(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, f"f{k}", f"a/x{k % 2}.c" if k else None, "void f(void)\n{\nrd(a);\nother(b);\nrd(c);\n}") for k in range(40)], "seq long, symbol string, file string, code string")
    aliases = spark.createDataFrame([(1, "rd", "first", "b/y.c"), (2, "rd", "near", "a/x1.c"), (3, "none", "z", "a/x1.c")], "seq long, alias string, target string, file_path string")
    looked, best = [], graph.alias_best
    monkeypatch.setattr(graph, "alias_best", lambda calls, *more: looked.append(calls.count()) or best(calls, *more))
    rows = graph.resolved_calls(chunks, aliases).collect()
    assert looked == [3]
    assert {(r.file, r.callee, r.target) for r in rows} == {("a/x0.c", "rd", "near"), ("a/x1.c", "rd", "near"), (None, "rd", "first"), *((f, "f", "f") for f in ("a/x0.c", "a/x1.c", None)), *((f, "other", "other") for f in ("a/x0.c", "a/x1.c", None))}
    assert len(rows) == 3 * 40


def test_a_text_is_searched_once(spark):
    rows = spark.createDataFrame([("a(1,\n2); b();",)], "v string").select(matches(F.col("v"), kit.CALL, 2).alias("m"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_extract_all" not in plan
    assert [(r.line, r.g1, r.g2) for r in rows.first().m] == [(0, "a", "1,\n2"), (1, "b", "")]


def test_searches_find_what_their_published_patterns_find(spark):
    """Patterns that do not go back, on random texts of the characters that matter."""
    from random import Random

    draw = Random(7)
    parts = ["a", "b1", "_", "1", " ", "\n", "\t", ".", "-", ">", "->", "[", "]", "[i]", "=", "==", "+", "++", "--", "+=", "-=", "|=", "^=", "&", "*", "/", "!", ";", "(", ")", ",", "é", "spin_lock", "spin_lock_irqsave", "raw_", "rcu_", "rcu_dereference", "_bh", "call_rcu", "\u0001"]
    texts = spark.createDataFrame([("".join(draw.choice(parts) for _ in range(draw.randrange(60))),) for _ in range(4000)], "v string").repartition(4)
    rcu = sorted({x for names in kit.RCU.values() for x in names})
    locks = [*kit.ACQUIRE, *kit.RELEASE, *kit.INTERRUPT]
    plain = lambda names: r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\s*\(([^;]*)\)"
    for fast, published, groups in ((kit.LINUX.mutation, kit.MUTATION, 3), (kit.any_of(rcu), plain(rcu), 2), (kit.any_of(locks), plain(locks), 2), (kit.any_of(kit.ITERATORS), plain(kit.ITERATORS), 2), (kit.any_of(["take"]), plain(["take"]), 2)):
        both = texts.select("v", matches(F.col("v"), fast, groups).alias("a"), matches(F.col("v"), published, groups).alias("b"))
        assert both.filter("not a <=> b").collect() == []
        bare = F.regexp_replace("v", "\u0001", "")
        assert texts.filter(F.size(matches(F.col("v"), published, groups)) != F.size(F.regexp_extract_all(bare, F.lit(published), F.lit(1)))).count() == 0


def test_matches_with_newlines_and_marks_in_groups(spark):
    found = one(spark, matches(F.col("v"), r"(\w+)\(([^)]*)\)", 2), "\u0001a(1,\n\n2) b(\u0005)\nc(\u0006x)\n\nd()")
    assert [(m["line"], m["g1"], m["g2"]) for m in found] == [(0, "a", "1,\n\n2"), (2, "b", ""), (3, "c", "x"), (5, "d", "")]
    assert one(spark, matches(F.col("v"), r"(\w+)\(([^)]*)\)", 2), "none\n") == []
    assert one(spark, matches(F.col("v"), r"(\w+)\(([^)]*)\)", 2), None) == []


def test_every_primitive_is_dealt_over_all_tasks(spark):
    """One small file of orders is read by one task; its functions are not searched by that task alone."""
    from tracewright.plans.queries import QUERIES

    plan = QUERIES["ext_every_primitive"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.index("Generate explode") < plan.index("REPARTITION_BY_NUM")


def test_fact_lines_are_ordered_within_their_function_only(spark):
    facts = spark.createDataFrame([(f"s{k % 3}", k, "Call", f"c{k}") for k in range(30, 0, -1)], "symbol_id string, line int, domain string, semantic_id string")
    report = fact_report(facts)
    assert "rangepartitioning" not in report._jdf.queryExecution().toString()
    rows = [(r.symbol_id, int(r.report.split()[0])) for r in report.collect()]
    assert all([n for s, n in rows if s == f"s{j}"] == sorted(k for k in range(1, 31) if k % 3 == j) for j in range(3))
