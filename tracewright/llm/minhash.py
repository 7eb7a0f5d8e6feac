"""Near-duplicates by similarity sketches filled in rounds of hashed bins, banding and exact verification.

Sketch: in round r every shingle is hashed into one of the bins with value (r, hash); a bin keeps its
least value. After as many rounds as there are bins, round bins + k puts all shingles into bin k, so
every bin fills. Two sketches agree in a bin with the probability of their sets' similarity, with
concentration as for independent hashes.

Equal texts (by words) are one representative, numbered for the search: doc_ids may repeat or be null,
so they take no part in it. Representatives that share a band are candidates.
Within a band's bucket not all pairs are made: the member with the fewest shingles of its own is
compared with all others, components are formed, and only members outside the bucket's main
component that could still reach the threshold, by bounds on the intersection, are compared on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, Scratch, ensure_importable, having, only, table
from .components import connected_components
from .polyhash import mix
from .shingles import normal_form, shingle_sets

#: At a similarity of 0.85, two sets share no band with a probability of (1 - 0.85^6)^40 = 6e-9.
BANDS, ROWS = 40, 6
NUMERATOR, DENOMINATOR = 85, 100
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One uint64 a bin: the round in the high 16 bits, below it the hash."""
    out = np.full(bins, np.iinfo(np.uint64).max, _U)
    low = _U((1 << 48) - 1)
    n, done = len(shingles), 0
    while n and done < 2 * bins:
        rounds = np.arange(done, min(2 * bins, done + max(1, min(bins, 4 * bins // n))))
        if done < bins:
            rounds = rounds[rounds < bins]
        hashes = mix(shingles[:, None] + (rounds.astype(_U) + _U(1)) * _STEP)
        values = (rounds.astype(_U) << _U(48)) | (hashes & low)
        if done < bins:
            np.minimum.at(out, (((hashes >> _U(32)) * _U(bins)) >> _U(32)).ravel().astype(np.int64), values.ravel())
        else:
            out[rounds - bins] = np.minimum(out[rounds - bins], values.min(axis=0))
        done = int(rounds[-1]) + 1
        if int(out.max()) >> 48 < 2 * bins:
            break
    return out


def band_keys(sketched: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=_U) * _STEP
    for column in sketched.reshape(bands, rows).T:
        keys = mix(keys ^ column)
    return keys.view(np.int64)


def form_digest(text: bytes) -> bytes | None:
    form = normal_form(text)
    return hashlib.blake2b(form, digest_size=16).digest() if form else None


def row_key() -> Column:
    """128 bits of doc_id (null or not) and text: rows of one key are repeated rows."""
    return F.struct(F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.lit(1), "text", "doc_id").alias("g")).alias("key")


def sketch_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
        forms, sizes, keys = [], [], []
        for text, own in zip(texts, shingle_sets(texts), strict=True):
            forms.append(form_digest(text))
            sizes.append(len(own))
            keys.append(band_keys(sketch(own, bands * rows), bands, rows) if len(own) else None)
        made = [pa.array(forms, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *made], names=["doc_id", "key", "form", "n_shingles", "bands"])


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of representatives, of those rows whose text has the representative's form."""
    for batch in batches:
        texts = [t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
        own = [k for k, (t, form) in enumerate(zip(texts, batch.column("form").to_pylist(), strict=True)) if form_digest(t) == form]
        sets = pa.array([s.view(np.int64) for s in shingle_sets([texts[k] for k in own])], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(own, pa.int64())), sets], names=["rep", "shingles"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the size of their full sets' intersection, and whether they reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.select("a", "b", "both", (DENOMINATOR * F.col("both") >= NUMERATOR * (F.size("sa") + F.size("sb") - F.col("both"))).alias("near"))


def _search(docs: DataFrame, owner: str, bands: int, rows: int, nulls: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, text) as (doc_id, key, form, n_shingles, bands), and for every form that is not
    alone (form, winner): of all rows that links reach, the first by doc_id (nulls last) and key. Rows of a
    null doc_id take part where ``nulls``."""
    ensure_importable(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = Scratch.write(docs.select("doc_id", row_key(), "text").mapInArrow(lambda it: sketch_batches(it, bands, rows), f"doc_id {kind}, key struct<h:long,g:long>, form binary, n_shingles long, bands array<long>"), owner, "sketches")
    known = sketches.filter("form is not null" if nulls else "form is not null and doc_id is not null")
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("winner")
    forms = known.groupBy("form").agg(winner, F.count("*").alias("n"), F.first("bands").alias("bands"))
    # numbered once: what is written does not change
    forms = Scratch.write(forms.withColumn("rep", F.monotonically_increasing_id()), owner, "forms")
    in_band = forms.select("rep", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    buckets = Scratch.write(in_band.join(shared, "band"), owner, "buckets")
    searched = having(forms.select("rep", "form", F.col("winner.key.h").alias("h")), buckets.select("rep").distinct(), "rep")
    searched = Scratch.write(searched, owner, "searched")
    # one row of each form gives its text; where hashes clash, the form tells
    texts = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    texts = texts.join(F.broadcast(searched) if searched.count() <= MAX_BROADCAST_ROWS else searched, "h").select("rep", "form", "text")
    sets = texts.mapInArrow(set_batches, "rep long, shingles array<long>").groupBy("rep").agg(F.first("shingles").alias("shingles"))
    sets = Scratch.write(sets, owner, "sets")
    own = sets.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("rep").alias("rep"), F.count("*").alias("n")).filter("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    facts = sets.select("rep", F.size("shingles").cast("long").alias("size")).join(own, "rep", "left")
    # common: shingles that any other candidate has; the most that an intersection can be
    facts = facts.select("rep", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))
    # common / (size + other - common) >= threshold bounds the other's size
    facts = facts.withColumn("most", F.floor(F.col("common") * (NUMERATOR + DENOMINATOR) / NUMERATOR) - F.col("size"))
    facts = Scratch.write(facts.filter(F.col("most") * DENOMINATOR >= F.col("size") * NUMERATOR), owner, "facts")
    members = buckets.join(facts, "rep")
    least = members.groupBy("band").agg(F.min("size").alias("least"))
    members = members.join(least, "band").filter("least <= most").drop("least")
    best = members.groupBy("band").agg(F.count("*").alias("n"), F.max_by("rep", F.struct(F.col("common") / F.col("size"), -F.col("rep"))).alias("center")).filter("n > 1").drop("n")
    members = Scratch.write(members.join(best, "band"), owner, "members")
    star = members.filter("rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
    star = Scratch.write(star, owner, "star")
    star = Scratch.write(overlaps(star, sets), owner, "overlaps")
    links = star.filter("near").select("a", "b")
    found = Scratch.write(connected_components(links, owner), owner, "components")
    # what the stars have left: members outside of their bucket's main component, against all others of it
    now = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = now.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("components")).filter("components > 1").select("band", "main")
    now = now.join(main, "band").select("band", "rep", "center", "size", "common", "most", "component", "main", F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b"))
    # of a member's shingles: those of its bucket's center, and others that some candidate has
    now = now.join(star.select("a", "b", "both"), ["a", "b"], "left").withColumn("inside", F.coalesce("both", "size")).withColumn("outside", F.col("common") - F.col("inside"))
    now = Scratch.write(now.select("band", "rep", "size", "most", "component", "main", "inside", "outside"), owner, "now")
    x = now.filter("component <> main").select("band", *[F.col(c).alias(f"x_{c}") for c in ("rep", "size", "most", "component", "inside", "outside")])
    y = now.drop("main")
    bound = F.least("x_inside", "inside") + F.least("x_outside", "outside")
    fits = (F.col("x_component") != F.col("component")) & (F.col("size") <= F.col("x_most")) & (F.col("x_size") <= F.col("most")) & (DENOMINATOR * bound >= NUMERATOR * (F.col("x_size") + F.col("size") - bound))
    rest = x.join(y, (x["band"] == y["band"]) & fits).select(F.least("x_rep", "rep").alias("a"), F.greatest("x_rep", "rep").alias("b")).distinct()
    rest = Scratch.write(rest.join(star.select("a", "b"), ["a", "b"], "left_anti"), owner, "rest")
    more = overlaps(rest, sets).filter("near").select("a", "b")
    joined = Scratch.write(links.union(more), owner, "links")
    found = connected_components(joined, owner)
    labelled = forms.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = labelled.filter("component is not null").select("form", "winner", "component")
    first = linked.groupBy("component").agg(F.min("winner").alias("winner"))
    target = linked.drop("winner").join(first, "component").select("form", "winner")
    return sketches, target.union(labelled.filter("component is null and n > 1").select("form", "winner"))


def near_components(docs: DataFrame, owner: str = "minhash", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Null, empty and blank texts have no shingles, and are components of their own, as are rows of a
    null doc_id. Rows of equal words are one document to the search. The component is the smallest
    doc_id that links reach.
    """
    sketches, target = _search(docs, owner, bands, rows, False)
    rows_out = sketches.select("doc_id", "form", "n_shingles").join(target.select("form", F.col("winner.doc_id").alias("target")), "form", "left")
    return rows_out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("target", "doc_id")).alias("component_id"))


def without_near(docs: DataFrame, owner: str = "minhash", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, a null one only where there is no other.

    Decided by row, so repeated rows, other texts under a used doc_id and rows of a null doc_id are
    told apart. Texts without words stay.
    """
    sketches, target = _search(docs, owner, bands, rows, True)
    found = sketches.select("form", "key").join(target.select("form", F.col("winner.key").alias("first")), "form")
    counted = Scratch.write(found.groupBy("key").agg(F.min("first").alias("first"), F.count("*").alias("n")).filter("key <> first or n > 1"), owner, "counted")
    kept = having(docs.select(row_key().alias("_key"), "*"), counted.filter("key <> first").select(F.col("key").alias("_key")), "_key", "left_anti")
    again = counted.filter("key = first").select(F.col("key").alias("_key"))
    if not again.isEmpty():
        kept = having(kept, again, "_key", "left_anti").union(having(kept, again, "_key").dropDuplicates(["_key"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_minhash(spark, sf_dir):
    """All documents at a similarity of 0.85 over 5-word shingles."""
    found = near_components(table(spark, sf_dir, "documents"), "op4")
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
