"""Walks over edges that are made when they are asked for."""

from __future__ import annotations

from tracewright.operators import frontend, graph, traverse
from tracewright.plans.profiles import SCHED

CORE, FAIR = "kernel/sched/core.c", "kernel/sched/fair.c"


def _parts(spark):
    bodies = {
        ("context_switch", CORE): "only(a); twice(b); rd(c); Shout(d); near(e); far(f); gone(g);",
        ("near", "lib/a.c"): "only(a); far(b);",
        ("twin", "lib/a.c"): "near(a);",
        ("twin", "lib/b.c"): "only(a); near(b);",
        ("unregistered", "lib/c.c"): "only(a);",
    }
    chunks = spark.createDataFrame([(10 + k, s, f, f"void {s}(void)\n{{\n{b}\n}}") for k, ((s, f), b) in enumerate(bodies.items())], "seq long, symbol string, file string, code string")
    named = [(CORE, "__pick_next_task"), (CORE, "context_switch"), (FAIR, "pick_next_task_fair"), ("lib/a.c", "only"), ("lib/a.c", "twice"), ("lib/b.c", "twice"), ("lib/b.c", "shout"), ("lib/a.c", "near"), ("lib/a.c", "twin"), ("lib/b.c", "twin"), ("lib/b.c", "far"), ("lib/c.c", "FAR"), ("lib/c.c", "readl_one")]
    symbols = spark.createDataFrame([(k, f, s) for k, (f, s) in enumerate(named)], "seq long, file_path string, symbol_name string")
    aliases = spark.createDataFrame([(1, "rd", "readl_one", "kernel/sched/x.c"), (2, "rd", "nothing", CORE), (3, "near", "twice", "net/x.c")], "seq long, alias string, target string, file_path string")
    text = "DEFINE_SCHED_CLASS(fair) = {\n\t.pick_next_task = pick_next_task_fair,\n\t.yield_task = nowhere,\n};\n"
    files = spark.createDataFrame([(FAIR, text)], "file string, text string")
    return chunks, symbols, aliases, frontend.provider_tables(files, SCHED), SCHED


def test_edges_on_demand_are_those_of_the_whole_graph(spark):
    chunks, *rest = _parts(spark)
    symbols, edges = graph.build_graph(chunks, *rest)
    whole = {tuple(r) for r in edges.collect()}
    assert {e[3] for e in map(list, whole)} == {"DIRECT_CALL", "MACRO_ALIAS", "FUNCTION_POINTER_DISPATCH", "SYNTHETIC_CONTINUATION"}
    leaving, at = graph.edges_of(graph.code_calls(chunks), *rest), edges.columns.index("src")
    every = sorted(r.symbol_id for r in symbols.collect())
    assert {tuple(r) for r in leaving([*every, "lib/c.c::unregistered"]).select(*edges.columns).collect()} == whole
    for src in (f"{CORE}::context_switch", "lib/b.c::twin", "<scheduler_class_interface>::scheduler_class:pick_next_task", "lib/b.c::far"):
        assert {tuple(r) for r in leaving([src]).select(*edges.columns).collect()} == {e for e in whole if e[at] == src}


def test_a_walk_takes_the_same_way_on_demand(spark):
    chunks, *rest = _parts(spark)
    edges = graph.build_graph(chunks, *rest)[1].persist()
    leaving = graph.edges_of(graph.code_calls(chunks), *rest)
    for start in (f"{CORE}::__pick_next_task", "lib/b.c::twin"):
        a, b = (traverse.descent(e, start, SCHED) for e in (edges, leaving))
        assert (a.nodes, a.edges, a.annotations) == (b.nodes, b.edges, b.annotations) and len(a.nodes) > 1
    edges.unpersist()


def test_graph_walk_moves_no_symbols_for_its_edges(spark, monkeypatch):
    """Edges of all sources at once were what filled the disk."""
    from support import DATA

    from tracewright.plans.queries import QUERIES

    monkeypatch.setattr(graph, "build_graph", lambda *_: 1 / 0)
    assert QUERIES["graph_walk"](spark, DATA).count() == 4
