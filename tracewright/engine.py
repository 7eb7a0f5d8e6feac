"""The library's front: compile a project into tables, open a session on them, ask for traces."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import traverse
from .operators.extract import extract_collections, extract_facts, extract_locals, prepared, rcu_warnings
from .operators.relate import relationships
from .operators.store import edge_rows, last_wins, node_rows, report, symbol_rows
from .plans import kit
from .plans.profiles import PROFILES, detect
from .sources.readers import commit_of, mock_chunks, read_chunks
from .sources.storage import Store

VERSION = 1
TABLES = ("nodes", "edges", "symbols", "collections", "facts")


@dataclass(frozen=True)
class Project:
    name: str
    source_dir: str
    workspace: str

    def save(self, spark: SparkSession) -> None:
        store = Store(spark, self.workspace)
        store.make()
        store.write("project.json", json.dumps(self.__dict__))

    @classmethod
    def load(cls, spark: SparkSession, workspace: str) -> Project:
        return cls(**json.loads(Store(spark, workspace).read("project.json")))


@dataclass
class Result:
    success: bool
    seconds: float = 0.0
    rows: dict[str, int] = field(default_factory=dict)
    diagnostics: list[str] = field(default_factory=list)
    tables: dict[str, str] = field(default_factory=dict)
    phases: dict[str, float] = field(default_factory=dict)
    warnings: int = 0

    def as_dict(self) -> dict[str, object]:
        timing = {"seconds": round(self.seconds, 3), "phases": {k: round(v, 3) for k, v in self.phases.items()}}
        return {"success": self.success, "timing": timing, "rows": self.rows, "diagnostics": self.diagnostics, "warnings": self.warnings, "tables": self.tables}


def mock_driver(spark: SparkSession, _: str | None) -> DataFrame:
    return mock_chunks(spark)


def chunk_driver(spark: SparkSession, path: str | None) -> DataFrame:
    """A path that is not there is tried below the working folder."""
    if not path:
        raise FileNotFoundError("a chunk path is needed")
    if not Store(spark, path).exists():
        path = f"file://{os.getcwd()}/{path}"
        if not Store(spark, path).exists():
            raise FileNotFoundError(path)
    return read_chunks(spark, path).withColumn("seq", F.monotonically_increasing_id())


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.drivers: dict[str, Callable[[SparkSession, str | None], DataFrame]] = {"mock": mock_driver, "linux": chunk_driver}

    def register(self, name: str, driver: Callable[[SparkSession, str | None], DataFrame]) -> None:
        self.drivers[name] = driver

    def compile(
        self,
        project: Project,
        driver: str = "linux",
        chunks: str | None = None,
        timeline: str = "source",
        on_event: Callable[[str, dict[str, object]], None] | None = None,
        profile: str = "generic",
    ) -> Result:
        """Compile chunks into the project's tables. What goes wrong is in the result. on_event is told of each phase."""
        began, tell = time.time(), on_event or (lambda _, __: None)
        seconds: dict[str, float] = {}

        @contextmanager
        def phase(name: str) -> Iterator[None]:
            start = time.time()
            tell("phase", {"name": name})
            yield
            seconds[name] = time.time() - start
            tell("phase done", {"name": name, "seconds": round(seconds[name], 3)})

        source = None
        try:
            project.save(self.spark)
            tell("started", {"project": project.name, "driver": driver})
            source = self.drivers[driver](self.spark, chunks).persist()
            code = prepared(source.filter("symbol_id is not null"))
            made: dict[str, DataFrame] = {}
            with phase("facts"):
                made["facts"] = facts = self._write(project, "facts", extract_facts(code))
            with phase("nodes"):
                made["nodes"] = self._write(project, "nodes", node_rows(facts), "node_id")
            with phase("edges"):
                made["edges"] = self._write(project, "edges", edge_rows(relationships(facts, timeline)), "source_id")
            with phase("symbols"):
                made["symbols"] = self._write(project, "symbols", last_wins(symbol_rows(extract_locals(code)), ["symbol_key"], ["file", "scope_id", "name", "type"]))
            with phase("collections"):
                made["collections"] = self._write(project, "collections", extract_collections(source))
            with phase("warnings"):
                warned = self._write(project, "warnings", rcu_warnings(facts)).count()
            store = Store(self.spark, project.workspace)
            rows = {name: df.count() for name, df in made.items()}
            sizes = {name: store.size(f"{name}.parquet") for name in made}
            told = report(rows, sizes, seconds, version=VERSION, profile=profile, commit=commit_of(project.source_dir))
            store.write("manifest.json", json.dumps(told, indent=2, sort_keys=True))
            tell("finished", {"rows": told["total_rows"], "seconds": round(time.time() - began, 3)})
            tables = {n: f"{project.workspace}/{n}.parquet" for n in made}
            return Result(True, time.time() - began, rows, validate(self.spark, project), tables, seconds, warned)
        except Exception as e:  # the contract of compile(): errors are captured in the result
            tell("failed", {"error": type(e).__name__})
            return Result(False, time.time() - began, diagnostics=[f"{type(e).__name__}: {e}"], phases=seconds)
        finally:
            if source is not None:
                source.unpersist()

    def _write(self, project: Project, name: str, df: DataFrame, sort_by: str | None = None) -> DataFrame:
        path = f"{project.workspace}/{name}.parquet"
        (df.sortWithinPartitions(sort_by) if sort_by else df).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def is_current(self, project: Project, profile: str = "generic") -> bool:
        """Whether the manifest is of this version, commit and profile."""
        store = Store(self.spark, project.workspace)
        told = json.loads(store.read("manifest.json")) if store.exists("manifest.json") else {}
        return (told.get("version"), told.get("commit"), told.get("profile")) == (VERSION, commit_of(project.source_dir), profile)

    def cached(self, project: Project, profile: str = "generic", enabled: bool = True) -> Session | None:
        """A session on what was compiled before, if that is wanted, current and readable; else none."""
        try:
            usable = enabled and self.is_current(project, profile) and not any(": unreadable" in x or ": missing" in x for x in validate(self.spark, project))
        except Exception:  # the contract of cached(): what cannot be read is compiled again
            return None
        return Session(self.spark, project) if usable else None

    def status(self, project: Project, profile: str = "generic") -> dict[str, object]:
        return {"project": project.name, "current": self.is_current(project, profile), "diagnostics": validate(self.spark, project)}

    def answer(self, edges: DataFrame, lines: Iterator[str], entry: Callable[[str], str]) -> Iterator[tuple[str, traverse.Trace | str]]:
        """A query loop: a trace for each line, or what is wrong with it; ends at ``exit`` or ``quit``. Blank lines are skipped."""
        for line in lines:
            text = line.strip()
            if text.lower() in ("exit", "quit"):
                return
            if text:
                try:
                    yield text, self.trace(edges, text, entry(text))
                except (ValueError, KeyError) as e:
                    yield text, f"{type(e).__name__}: {e}"

    def session(self, project: Project) -> Session:
        return Session(self.spark, project)

    def trace(self, edges: DataFrame, query: str, start: str, **bounds) -> traverse.Trace:
        """``N-question``: the number chooses the mode, the question's words the profile; of ``5-file function``
        these are where the trace begins."""
        mode = kit.MODES.get(query[:2], "runtime_spine")
        if mode == "generic_entrypoint":
            return traverse.generic_entry(edges, query[2:], **bounds)
        return traverse.MODES[mode](edges, start, PROFILES[detect(query) or "generic"], **bounds)


class Session:
    """Read access to a project's tables."""

    def __init__(self, spark: SparkSession, project: Project):
        self.spark, self.project, self.closed = spark, project, False

    def table(self, name: str) -> DataFrame:
        if self.closed:
            raise RuntimeError("the session is closed")
        return self.spark.read.parquet(f"{self.project.workspace}/{name}.parquet")

    def query_symbol(self, name: str, limit: int = 50) -> DataFrame:
        """Nodes whose token has the name in it."""
        return self.table("nodes").filter(F.col("token").contains(name)).orderBy("token", "node_id").limit(limit)

    def working_set(self, anchor: int, context: traverse.QueryContext) -> DataFrame:
        edges = self.table("edges").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("edge_kind").alias("kind"))
        return traverse.working_set(edges, anchor, context)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def validate(spark: SparkSession, project: Project) -> list[str]:
    """What is wrong with a project's tables: missing, unreadable, empty, or edges without their node."""
    out, store = [], Store(spark, project.workspace)
    for name in TABLES:
        if not store.exists(f"{name}.parquet"):
            out.append(f"{name}: missing")
            continue
        try:
            if spark.read.parquet(f"{project.workspace}/{name}.parquet").isEmpty():
                out.append(f"{name}: empty")
        except Exception as e:
            out.append(f"{name}: unreadable, {type(e).__name__}")
    if not any(x.startswith(("nodes", "edges")) for x in out):
        nodes = spark.read.parquet(f"{project.workspace}/nodes.parquet").select(F.col("node_id").alias("source_id"))
        loose = spark.read.parquet(f"{project.workspace}/edges.parquet").join(nodes, "source_id", "left_anti").count()
        if loose:
            out.append(f"edges: {loose} without their source node")
    return out
