"""Bounded graph questions: working sets, descents, dispatch traces and full branch expansion.

A working set is a loop of frontier joins, a job a level. Ranked walks are inherently sequential and
bounded (at most 75 nodes, 20 levels): each step asks for the edges of the nodes at hand only, ranked
and cut in the cluster, so what reaches the driver is bounded by the budget, not by the graph.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import locality_rank
from ..plans import kit
from ..plans.kit import Profile
from ..plans.profiles import GENERIC


@dataclass(frozen=True)
class QueryContext:
    """Which relationships a working set follows, and how far."""

    kinds: frozenset[str]
    max_depth: int = 3
    max_nodes: int = 50
    profile: str = "default"


def working_set(edges: DataFrame, anchor: object, context: QueryContext) -> DataFrame:
    """Edges recorded by a breadth-first walk: src, dst, kind, depth of the source.

    Nodes nearer than max_depth are expanded; all their allowed edges are recorded; targets are
    enqueued, in the order in which they are met, while fewer than max_nodes were visited.
    """
    spark = edges.sparkSession
    allowed = edges.filter(F.col("kind").isin(*sorted(context.kinds))).select("src", "dst", "kind")
    kind = edges.schema["src"].dataType.simpleString()
    visited, frontier = {anchor}, [anchor]
    found = spark.createDataFrame([], f"src {kind}, dst {kind}, kind string, depth int")
    for depth in range(context.max_depth):
        if not frontier:
            break
        # a frontier has at most max_nodes nodes; their edges stay in the cluster
        ids = spark.createDataFrame([(x, k) for k, x in enumerate(frontier)], f"src {kind}, place int")
        rows = allowed.join(F.broadcast(ids), "src")
        found = found.unionByName(rows.select("src", "dst", "kind", F.lit(depth).alias("depth")))
        known = spark.createDataFrame([(x,) for x in visited], f"dst {kind}")
        room = context.max_nodes - len(visited)
        if depth + 1 == context.max_depth or room <= 0:
            break
        new = rows.join(F.broadcast(known), "dst", "left_anti").groupBy("dst").agg(F.min(F.struct("place", "dst", "kind")).alias("met"))
        frontier = [r["dst"] for r in new.orderBy("met").limit(room).collect()]
        visited.update(frontier)
    return found


def reach(edges: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of all nodes within so many steps, without a node cap: joins only, least depth first."""
    step = edges.select("src", "dst").distinct()
    seen = anchors.select("id", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        out = frontier.join(step, frontier["id"] == step["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = out.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"))
        seen = seen.union(frontier)
    return seen


def decode(ids: DataFrame, nodes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ids with file path and symbol name; defaults where the dictionaries have none, hex where no node is."""
    from ..functions.identity import hex_id

    named = ids.join(nodes.select(F.col("node_id").alias("id"), "file_id", "token_id"), "id", "left")
    named = named.join(files.select(F.col("id").alias("file_id"), F.col("value").alias("_file")), "file_id", "left").join(symbols.select(F.col("id").alias("token_id"), F.col("value").alias("_symbol")), "token_id", "left")
    name = F.when(F.col("file_id").isNull() & F.col("token_id").isNull(), hex_id(F.col("id"))).otherwise(F.coalesce("_symbol", F.lit("unknown_symbol")))
    return named.select("id", F.coalesce("_file", F.lit("unknown_file")).alias("file"), name.alias("name"))


@dataclass
class Trace:
    nodes: list[tuple[str, int]] = field(default_factory=list)  # symbol id, depth
    edges: list[tuple[str, str, str, str]] = field(default_factory=list)  # src, dst, edge id, type
    annotations: list[tuple[str, str, str]] = field(default_factory=list)  # node, target, edge type
    stats: dict[str, object] = field(default_factory=dict)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges with their place in the trace."""
        nodes = spark.createDataFrame([(k, *n) for k, n in enumerate(self.nodes)], "place long, symbol_id string, depth int")
        return nodes, spark.createDataFrame([(k, *e) for k, e in enumerate(self.edges)], "place long, src string, dst string, edge_id string, edge_type string")

    def notes(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *n) for k, n in enumerate(self.annotations)]
        return spark.createDataFrame(rows, "place long, symbol_id string, dst string, edge_type string")


#: The order of a node's edges, and what is asked of an edge that a walk may take.
_ORDER = (F.desc, "confidence"), (F.desc, "is_deterministic"), (F.asc, "seq")
_EDGE = ("src", "dst", "edge_id", "edge_type", "confidence", "is_deterministic", "seq")


#: All edges, or what makes the edges of given sources when they are asked for.
Edges = DataFrame | Callable[[list[str]], DataFrame]


def _of(edges: Edges, ids: list[str]) -> DataFrame:
    return edges.filter(F.col("src").isin(*ids)) if isinstance(edges, DataFrame) else edges(ids)


class _Out:
    """Outgoing edges by node, in their order; asked for once a node.

    Of each node's edges only the first ``most`` of each group come to the driver, in an order that puts
    all that a walk can take among them; ``total`` is how many there were.
    """

    def __init__(self, edges: Edges, most: int, groups: tuple[str, ...], first: tuple[str, ...] = ()):
        order = [f(c) for f, c in (*((F.desc, c) for c in first), *_ORDER)]
        self.edges, self.most, self.groups, self.order = edges, most, groups, order
        self.held: dict[str, list] = {}

    def __call__(self, ids: list[str]) -> dict[str, list]:
        new = [i for i in ids if i not in self.held]
        if new:
            self.held |= {i: [] for i in new}
            own = _of(self.edges, new).withColumn("total", F.count("*").over(Window.partitionBy("src")))
            own = own.withColumn("nth", F.row_number().over(Window.partitionBy("src", *self.groups).orderBy(*self.order))).filter(F.col("nth") <= self.most)
            for r in own.orderBy("src", *(f(c) for f, c in _ORDER)).collect():
                self.held[r["src"]].append(r)
        return {i: self.held[i] for i in ids}


#: Annotations of a node that a walk keeps, by type.
NOTES = 25


def _walk(edges: Edges, start: str, order: tuple[str, ...], profile: Profile, depth: int, stop_at_terminals: bool, drop_low_signal: bool) -> Trace:
    # of a kind at most one edge to each visited node is in the way, and one more is taken
    name = F.substring_index("dst", "::", -1)
    quiet = name.isin(*profile.low_signal) if profile.low_signal and drop_low_signal else F.lit(False)
    out = _Out(lambda ids: _of(edges, ids).withColumn("_quiet", quiet), max(depth + 1, NOTES), ("edge_type", "_quiet"))
    trace, visited, here, came = Trace(), set(), start, None
    for level in range(depth):
        if here in visited:
            break
        visited.add(here)
        trace.nodes.append((here, level))
        if came is not None:
            trace.edges.append((came["src"], here, came["edge_id"], came["edge_type"]))
        leaving = out([here])[here]
        name = here.rpartition("::")[2]
        if not leaving or (stop_at_terminals and name in profile.terminals and not any(e["edge_type"] == "SYNTHETIC_CONTINUATION" for e in leaving)):
            break
        open_ways = [e for e in leaving if e["edge_type"] in kit.TRAVERSABLE]
        trace.annotations += [(here, e["dst"], e["edge_type"]) for e in leaving if e["edge_type"] not in kit.TRAVERSABLE and e["nth"] <= NOTES]
        fresh = [e for e in open_ways if e["dst"] not in visited]
        if not fresh:
            break
        came = None
        for kind in order:
            ways = [e for e in fresh if e["edge_type"] == kind]
            if kind == "DIRECT_CALL" and drop_low_signal:
                ways = [e for e in ways if e["dst"].rpartition("::")[2] not in profile.low_signal]
            if ways:
                came = max(ways, key=lambda e: e["confidence"])
                break
        came = came or open_ways[0]
        here = came["dst"]
    return trace


def descent(edges: Edges, start: str, profile: Profile = GENERIC, max_depth: int = 16) -> Trace:
    """One path: synthetic before dispatch before direct, each by confidence; the profile's depth limit counts if set."""
    depth = max_depth if profile.depth_limit is None else profile.depth_limit
    return _walk(edges, start, ("SYNTHETIC_CONTINUATION", "FUNCTION_POINTER_DISPATCH", "DIRECT_CALL"), profile, depth, True, False)


runtime_spine = descent


def dispatch_trace(edges: Edges, start: str, profile: Profile = GENERIC, max_depth: int = 16) -> Trace:
    """One path: dispatch before synthetic before direct, low-signal calls left out; terminals and the profile's limit do not count."""
    return _walk(edges, start, ("FUNCTION_POINTER_DISPATCH", "SYNTHETIC_CONTINUATION", "DIRECT_CALL"), profile, max_depth, False, True)


def branch_scores(edges: DataFrame, root_file: str, profile: Profile) -> DataFrame:
    """Allowed edges with their score, without the penalty for revisits."""
    name, file = F.substring_index("dst", "::", -1), F.substring_index("dst", "::", 1)
    kind = F.create_map(*(F.lit(x) for kv in kit.PRIORITY.items() for x in kv))[F.col("edge_type")]
    boost = F.lit(0.0)
    if profile.name != "generic":
        for n, w in profile.boost.items():
            boost = boost + F.when(name == n, w).otherwise(0.0)
    noise = F.when(name.isin(*kit.PRINT_NOISE), -50).otherwise(0)
    for prefix in kit.NOISE_PATHS:
        noise = noise - F.when(file.startswith(prefix), 100).otherwise(0)
    noise = noise - F.when(name.isin(*kit.UTILITY_NOISE), 5).otherwise(0) - F.when(name.isin(*kit.SYNC_NOISE), 10).otherwise(0)
    score = 10 * kind + 10 * boost + F.col("confidence") + noise + locality_rank(F.lit(root_file), file)
    return edges.filter(F.col("edge_type").isin(*kit.PRIORITY)).withColumn("score", score)


def full_branch(edges: Edges, start: str, profile: Profile = GENERIC, max_depth: int = 8, branches: int = 5, max_nodes: int = 75) -> Trace:
    """Breadth first: a node's best branches by score, less 25 for each earlier visit of the target; nodes up to a budget."""
    # a visited target has lost 25 a visit, so beyond the best branches one edge of each kind to each node may come before
    out = _Out(lambda ids: branch_scores(_of(edges, ids), start.rpartition("::")[0], profile), branches + max_nodes * len(kit.PRIORITY), (), ("score",))
    trace, queue, depth_of, expanded, visits, signed, omitted = Trace(), deque([(start, 0)]), {start: 0}, set(), {}, set(), 0
    while queue and len(depth_of) < max_nodes:
        here, depth = queue.popleft()
        if depth >= max_depth or here in expanded:
            continue
        expanded.add(here)
        # a level's edges are fetched in one job
        leaving = out([here, *(x for x, d in queue if d < max_depth)])[here]
        omitted += max(0, leaving[0]["total"] - branches) if leaving else 0
        scored = [(e["score"] - 25 * visits.get(e["dst"], 0), e) for e in leaving]
        ranked = sorted(scored, key=lambda x: -x[0])
        for _, e in [x for x in ranked if x[0] >= 0][:branches]:
            to = e["dst"]
            if to not in depth_of:
                if len(depth_of) >= max_nodes:
                    break
                depth_of[to] = depth + 1
                queue.append((to, depth + 1))
            visits[to] = visits.get(to, 0) + 1
            if (here, to, e["edge_type"]) not in signed:
                signed.add((here, to, e["edge_type"]))
                trace.edges.append((here, to, e["edge_id"], e["edge_type"]))
    trace.nodes = list(depth_of.items())
    trace.stats = {"total_nodes": len(depth_of), "total_edges": len(trace.edges), "hit_node_limit": len(depth_of) >= max_nodes, "truncated_branches": omitted, "max_depth_reached": max_depth}
    return trace


def generic_entry(edges: DataFrame, query: str, **bounds) -> Trace:
    """``file function`` as the start of a full branch expansion under the generic profile."""
    file, _, function = query.strip().partition(" ")
    if not function.strip():
        raise ValueError("a generic entry is a file and a function, with a blank between")
    return full_branch(edges, f"{file}::{function.strip()}", GENERIC, **bounds)


MODES = {"runtime_spine": runtime_spine, "implementation_descent": descent, "dispatch_analysis": dispatch_trace, "full_branch_expansion": full_branch}
