"""Incremental ingest: chunks as they arrive are upserted into the store's tables, a committed batch at a time.

Facts and relationships stay within a function, so the query itself holds no state. Every table has a
key; a batch's rows replace those of their keys. Tables are kept in buckets of their keys' hashes, and
a batch rewrites the buckets that it touches under its own version; a small pointer file names the
versions that count and is replaced last, so a batch that fails half way, or is replayed, leaves
the store as if it had run once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract_collections, extract_facts, extract_locals, prepared
from ..operators.relate import relationships
from ..operators.store import edge_rows, merge_upsert, node_rows, symbol_rows
from ..sources.readers import CHUNK_FIELDS, shaped_chunks
from ..sources.storage import Store

KEYS = {"facts": ["symbol_id", "extractor", "ordinal"], "nodes": ["node_id"], "edges": ["source_id", "target_id", "edge_kind"], "symbols": ["symbol_key"], "collections": ["name"]}
BUCKETS, POINTER = 64, "versions.json"


def stream_chunks(spark: SparkSession, folder: str, files_a_batch: int = 10) -> DataFrame:
    return shaped_chunks(spark.readStream.schema(CHUNK_FIELDS).option("maxFilesPerTrigger", files_a_batch).json(folder))


def compile_batch(chunks: DataFrame) -> dict[str, DataFrame]:
    """All tables of a batch. The facts are extracted once: they are persisted until the caller unpersists them."""
    chunks = chunks if "seq" in chunks.columns else chunks.withColumn("seq", F.monotonically_increasing_id())
    code = prepared(chunks)
    facts = extract_facts(code).persist()
    return {"facts": facts, "nodes": node_rows(facts), "edges": edge_rows(relationships(facts)), "symbols": symbol_rows(extract_locals(code)), "collections": extract_collections(chunks)}


def _versions(store: Store) -> dict[str, dict[str, int]]:
    return json.loads(store.read(POINTER)) if store.exists(POINTER) else {"batch": -1, **{name: {} for name in KEYS}}


def _paths(out: str, name: str, versions: dict[str, int]) -> list[str]:
    return [f"{out}/{name}/version={v}/bucket={b}" for b, v in sorted(versions.items())]


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """A table as of the last batch that was committed, with the batch that last set each row."""
    paths = _paths(out, name, _versions(Store(spark, out))[name])
    return spark.read.parquet(*paths) if paths else None


def upsert_batch(batch: DataFrame, number: int, out: str) -> dict[str, int]:
    """Merge a batch into the store; rows written of each table. A batch that was committed is not written again."""
    spark = batch.sparkSession
    store = Store(spark, out)
    store.make()
    now = _versions(store)
    if number <= now["batch"]:
        return {}
    chunks, written = batch.persist(), {}
    tables = compile_batch(chunks)
    for name, fresh in tables.items():
        keys = KEYS[name]
        dealt = fresh.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).persist()
        touched = [str(r["bucket"]) for r in dealt.select("bucket").distinct().collect()]
        old = {b: v for b, v in now[name].items() if b in touched}
        stored = spark.read.option("basePath", f"{out}/{name}").parquet(*_paths(out, name, old)).drop("version") if old else None
        merged = merge_upsert(stored, dealt, keys, number)
        if touched:
            merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{out}/{name}/version={number}")
        written[name] = dealt.count()
        dealt.unpersist()
        now[name] |= dict.fromkeys(touched, number)
    tables["facts"].unpersist()
    chunks.unpersist()
    store.write(POINTER, json.dumps(now | {"batch": number}))
    return written


def ingest(chunks: DataFrame, out: str, checkpoint: str, on_batch: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Start the query; it ends when all files at hand are done. on_batch is told how many rows each batch wrote of each table."""

    def write(batch: DataFrame, number: int) -> None:
        written = upsert_batch(batch, number, out)
        if on_batch:
            on_batch(number, written)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
