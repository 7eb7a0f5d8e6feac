"""Exact removal of long repeated substrings, by a hash-compared suffix sort of the places in doubt.

1. Anchors: of every window of LENGTH bytes, the k-gram of least hash. Equal windows choose equal
   anchors, so only places whose anchor occurs elsewhere are looked at on. A run is the windows of
   one anchor occurrence; if all runs of an anchor are equal, they are repeated as they stand.
2. The other runs are cut into blocks of windows. What all windows of a block have in common (its
   core) must occur elsewhere, else none is repeated; if the whole block does, all are. Only blocks
   in between, at the ends of repeats, go on to smaller blocks.
3. The last blocks are sorted as suffixes, in groups of equal cores: neighbours that agree over
   LENGTH bytes are repeated, verified byte for byte. Cores of more than GROUP blocks are not brought
   together in a task, but cut down to single windows, which are counted by hash.

All steps but the last exchange hashes and positions, not texts, and count by partial aggregation.
Texts are told apart by uid and length, so exact copies are the same place; they are known to be
repeated by counting whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ensure_importable, having, only, table
from .polyhash import PrefixHash, chunks, mix
from .suffixes import repeated

LENGTH, KGRAM = 200, 64
BLOCKS, GROUP = (32, 8), 256
#: Texts are hashed in pieces of so many bytes; the arrays over a piece take some 150 times as much.
PIECE = 1 << 18
_U = np.uint64
_NONE = np.iinfo(np.uint64).max


def text_uid(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big", signed=True)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values)
    full = np.full(-(-n // width) * width, _NONE, _U)
    full[:n] = values
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(pieces: list[bytes], length: int, kgram: int) -> tuple[np.ndarray, ...]:
    """Per run: the piece, the anchor's offset in it, first and last window start, and hashes of anchor and run.

    Each piece has at least ``length`` bytes and at most 2^24 together. Ties go to the leftmost.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    hashes, width, at = PrefixHash(data), length - kgram + 1, np.arange(len(data) - kgram + 1)
    grams = mix(hashes.of(at, at + kgram))
    own = sliding_least((grams & ~_U((1 << 24) - 1)) | at.astype(_U), width)
    starts = np.arange(len(data) - length + 1)
    piece = np.repeat(np.arange(len(pieces)), sizes)[starts]
    inside = starts + length <= ends[piece]
    starts, piece = starts[inside], piece[inside]
    anchor = (own[starts] & _U((1 << 24) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(piece) != 0)]))
    first, last = starts[edge], starts[np.append(edge[1:], len(starts)) - 1]
    piece, anchor = piece[edge], anchor[edge]
    run = mix(hashes.of(first, last + length) ^ mix((anchor - first).astype(_U)))
    zero = ends[piece] - sizes[piece]
    return piece, anchor - zero, first - zero, last - zero, grams[anchor].view(np.int64), run.view(np.int64)


RUNS = "uid long, n_bytes long, p long, first long, last long, anchor long, run long"


def run_batches(batches: Iterator[pa.RecordBatch], length: int, kgram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces: list[tuple[int, int, int, bytes]] = []
        for text in pc.cast(batch.column("text"), pa.binary()).to_pylist():
            if text is not None and len(text) >= length:
                uid = text_uid(text)
                # long texts in pieces that share all but one byte of a window
                for at in range(0, len(text) - length + 1, PIECE):
                    pieces.append((uid, len(text), at, text[at : at + PIECE + length - 1]))
        for i, j in chunks([len(x[3]) for x in pieces], PIECE):
            piece, p, first, last, anchor, run = anchor_runs([x[3] for x in pieces[i:j]], length, kgram)
            uid, n, at = (np.array([x[k] for x in pieces[i:j]], np.int64)[piece] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, n, p + at, first + at, last + at, anchor, run)], names=["uid", "n_bytes", "p", "first", "last", "anchor", "run"])


def block_hashes(text: bytes, starts: np.ndarray, block: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each block's core and of all of it, and whether all of it lies in the text.

    A block of one window has its hash as core and another of its halves as whole.
    """
    hashes = PrefixHash(np.frombuffer(text, np.uint8))
    core = mix(hashes.of(starts + block - 1, starts + length))
    end = starts + block - 1 + length
    whole = (starts >= 0) & (end <= len(text))
    a, b = np.where(whole, starts, 0), np.where(whole, end, 0)
    full = mix(hashes.of(a, b)) if block > 1 else mix(mix(hashes.of(a, a + (b - a) // 2)) ^ (hashes.of(a + (b - a) // 2, b) * _U(3)))
    return core.view(np.int64), full.view(np.int64), whole


def joined_starts(column: pa.Array) -> list[np.ndarray]:
    return [np.unique(np.array(x, np.int64)) for x in column.to_pylist()]


def block_batches(batches: Iterator[pa.RecordBatch], block: int, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for text, uid, starts in zip(pc.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("uid").to_pylist(), joined_starts(batch.column("starts")), strict=True):
            if text_uid(text) == uid:
                core, full, whole = block_hashes(text, starts, block, length)
                for x, y in zip(out, (core, full, whole, np.full(len(starts), uid), np.full(len(starts), len(text)), starts), strict=True):
                    x.append(y)
        if out[0]:
            flat = [pa.array(np.concatenate(x)) for x in out]
            yield pa.RecordBatch.from_arrays(flat, names=["core", "full", "whole", "uid", "n_bytes", "start"])


def byte_batches(batches: Iterator[pa.RecordBatch], block: int, length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each block, as far as they lie in the text, with the core's hash."""
    for batch in batches:
        rows: list[tuple] = []
        for text, uid, starts in zip(pc.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("uid").to_pylist(), joined_starts(batch.column("starts")), strict=True):
            if text_uid(text) == uid:
                core = block_hashes(text, starts, block, length)[0].tolist()
                rows += [(c, uid, len(text), max(0, s), text[max(0, s) : s + block - 1 + length]) for c, s in zip(core, starts.tolist(), strict=True)]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["core", "uid", "n_bytes", "start", "bytes"])


def sorted_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From blocks in order of their cores: windows that are repeated."""
    held: list[tuple] = []

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        sizes = np.array([len(r[4]) for r in rows], np.int64)
        count = sizes - length + 1
        block = np.repeat(np.arange(len(rows)), count)
        place = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        starts = (np.cumsum(sizes) - sizes)[block] + place
        uid, n, first = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        start = first[block] + place
        owners = mix(uid[block].view(_U) ^ mix(start.astype(_U) + _U(1))).view(np.int64)
        core = np.array([r[0] for r in rows], np.int64)
        hit = repeated(data, starts, np.cumsum(np.diff(core, prepend=core[:1]) != 0)[block], owners, length)
        # runs of hits within a block
        edge = np.concatenate([[True], block[1:] != block[:-1]])
        opens, closes = hit & (edge | ~np.append(False, hit[:-1])), hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False))
        of = block[opens]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[of], n[of], start[opens], start[closes])], names=["uid", "n_bytes", "first", "last"])

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("core", "uid", "n_bytes", "start", "bytes")), strict=True)
        if len(held) >= 4 * GROUP:
            cut = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)
            for i, j in group_chunks(held[:cut]):
                yield settle(held[i:j])
            held = held[cut:]
    for i, j in group_chunks(held):
        yield settle(held[i:j])


def group_chunks(rows: list[tuple], limit: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of about limit rows that do not cut a core's group."""
    i = 0
    while i < len(rows):
        j = min(len(rows), i + limit)
        while j < len(rows) and rows[j][0] == rows[j - 1][0]:
            j += 1
        yield i, j
        i = j


class _Search:
    """The steps after the anchors, over one table of texts."""

    def __init__(self, docs: DataFrame, heads: DataFrame, owner: str, length: int):
        self.docs, self.heads, self.owner, self.length = docs, heads, owner, length

    def with_text(self, places: DataFrame) -> DataFrame:
        """Starts gathered a text (no more of them than the text has bytes), with one row that holds the text."""
        gathered = Scratch.write(places.groupBy("uid", "n_bytes").agg(F.collect_set("start").alias("starts")).join(self.heads, ["uid", "n_bytes"]), self.owner, "places")
        return having(self.docs, gathered.select("doc_id"), "doc_id").join(gathered, "doc_id")

    def blocks(self, places: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
        """Intervals of windows that are repeated for sure, and the blocks in doubt with their cores' number."""
        rows = Scratch.write(self.with_text(places).mapInArrow(lambda it, b=block, n=self.length: block_batches(it, b, n), "core long, full long, whole boolean, uid long, n_bytes long, start long"), self.owner, "blocks")
        place = F.xxhash64("uid", "n_bytes", "start")
        ends = (F.min("place").alias("lo"), F.max("place").alias("hi"))
        cores = rows.select("core", place.alias("place")).groupBy("core").agg(*ends).filter("lo <> hi").select("core")
        cores = Scratch.write(cores, self.owner, "cores")
        wholes = rows.filter("whole").select("core", "full", place.alias("place")).groupBy("core", "full").agg(*ends).filter("lo <> hi").select("core", "full", "lo")
        wholes = Scratch.write(wholes, self.owner, "wholes")
        judged = rows.join(cores, "core").join(wholes, ["core", "full"], "left").withColumn("sure", F.col("whole") & F.col("lo").isNotNull())
        # of equal blocks one stays in the search, as the others' witness
        judged = Scratch.write(judged.select("core", "uid", "n_bytes", "start", "sure", (~F.col("sure") | (F.col("lo") == place)).alias("goes_on")), self.owner, "judged")
        Scratch.free(rows, cores, wholes)
        sure = judged.filter("sure").select("uid", "n_bytes", F.col("start").alias("first"), (F.col("start") + block - 1).alias("last"))
        going = judged.filter("goes_on")
        open_cores = going.groupBy("core").agg(F.count("*").alias("n"), F.count_if(~F.col("sure")).alias("open")).filter("open > 0").select("core", "n")
        return sure, Scratch.write(going.join(open_cores, "core").select("core", "uid", "n_bytes", "start", "n"), self.owner, "doubt")

    @staticmethod
    def cut(doubt: DataFrame, block: int, to: int) -> DataFrame:
        """Starts of the smaller blocks of blocks, that have a window in the text."""
        return doubt.select("uid", "n_bytes", F.explode(F.sequence("start", F.col("start") + block - to, F.lit(to))).alias("start"))

    def within(self, places: DataFrame, block: int) -> DataFrame:
        return places.filter((F.col("start") + block - 1 >= 0) & (F.col("start") + self.length <= F.col("n_bytes")))


def repeated_windows(docs: DataFrame, heads: DataFrame, owner: str, length: int = LENGTH, kgram: int = KGRAM, blocks: tuple[int, ...] = BLOCKS, group: int = GROUP) -> DataFrame:
    """Intervals (uid, n_bytes, first, last) of window starts that also start at another place of the distinct texts."""
    search = _Search(docs, heads, owner, length)
    runs = Scratch.write(docs.mapInArrow(lambda it: run_batches(it, length, kgram), RUNS), owner, "runs")
    place = F.xxhash64("uid", "n_bytes", "first")
    anchors = runs.groupBy("anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min("run").alias("a"), F.max("run").alias("b")).filter("lo <> hi").select("anchor", (F.col("a") == F.col("b")).alias("sure"))
    # written first, so that both sides of the join come straight from exchanges, which AQE can split where they are skewed
    anchors = Scratch.write(anchors, owner, "anchors")
    shared = Scratch.write(runs.join(anchors, "anchor").select("uid", "n_bytes", "p", "first", "last", "sure"), owner, "shared")
    Scratch.free(runs, anchors)
    found = [shared.filter("sure").select("uid", "n_bytes", "first", "last")]
    block = blocks[0]
    # blocks are laid out from the anchor, so that equal windows fall into equal blocks
    k = F.sequence(F.floor((F.col("p") - F.col("last")) / block), F.floor((F.col("p") - F.col("first")) / block))
    places = shared.filter("not sure").select("uid", "n_bytes", "p", F.explode(k).alias("k")).select("uid", "n_bytes", (F.col("p") - F.col("k") * block - (block - 1)).alias("start"))
    for to in (*blocks[1:], None):
        sure, doubt = search.blocks(places, block)
        found.append(sure)
        if to is not None:
            places, block = search.within(search.cut(doubt, block, to), to), to
    few, many = doubt.filter(F.col("n") <= group), doubt.filter(F.col("n") > group)
    size = block
    lines = search.with_text(few).mapInArrow(lambda it: byte_batches(it, size, length), "core long, uid long, n_bytes long, start long, bytes binary")
    lines = lines.repartition(F.col("core")).sortWithinPartitions("core")
    found.append(Scratch.write(lines.mapInArrow(lambda it: sorted_batches(it, length), "uid long, n_bytes long, first long, last long"), owner, "sorted"))
    while block > 1 and not many.isEmpty():
        to = 2 if block > 2 else 1
        sure, many = search.blocks(search.within(search.cut(many, block, to), to), to)
        found.append(sure)
        block = to
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def removal_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, listed in zip(pc.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("spans"), strict=True):
            spans = listed.values
            delta = np.zeros(len(text) + 1, np.int32)
            windows = np.column_stack([spans.field("first").to_numpy(), spans.field("last").to_numpy()])
            np.add.at(delta, np.maximum(windows[:, 0], 0), 1)
            np.add.at(delta, np.minimum(windows[:, 1] + length, len(text)), -1)
            gone = np.cumsum(delta[:-1]) > 0
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "n_kept", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, owner: str = "substrings", length: int = LENGTH, **options) -> DataFrame:
    """Every row of docs (doc_id, text and others) with n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Removes each byte that a string of ``length`` bytes covers which starts anywhere else too, judged
    on the input. Null and empty texts, and those shorter than length, stay as they are (null: no
    bytes). Equal texts of at least length bytes go whole. Rows of a null doc_id are searched too.
    Columns of the names above are replaced.
    """
    ensure_importable(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    uid = F.conv(F.substring(F.sha2(body, 256), 1, 16), 16, -10).cast("long").alias("uid")
    size = F.octet_length(body).cast("long").alias("n_bytes")
    long = docs.filter(F.octet_length("text") >= length).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    heads = Scratch.write(long.select("doc_id", uid, size).groupBy("uid", "n_bytes").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), owner, "heads")
    windows = repeated_windows(long, heads.drop("n"), owner, length, **options)
    copied = heads.filter("n > 1").select(F.struct("uid", "n_bytes").alias("id"))
    spans = windows.groupBy("uid", "n_bytes").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = Scratch.write(spans.join(copied.select("id.*"), ["uid", "n_bytes"], "left_anti").select(F.struct("uid", "n_bytes").alias("id"), "spans"), owner, "spans")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(uid, size).alias("id"), body.alias("text"))
    kept = "n_kept long, n_spans long, kept_sha256 string, kept binary"
    gone = having(row, copied, "id").select("row", F.lit(0).cast("long").alias("n_kept"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.lit("").cast("binary").alias("kept"))
    clean = having(row, copied.union(spans.select("id")), "id", "left_anti").select("row", F.col("id.n_bytes").alias("n_kept"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
    hit = having(row, spans.select("id"), "id").join(spans, "id")
    schema = T.StructType([row.schema["row"], *T._parse_datatype_string(kept)])
    cut = hit.select("row", "text", "spans").mapInArrow(lambda it: removal_batches(it, length), schema)
    out = clean.union(gone).union(cut)
    total = F.octet_length(F.coalesce(F.col("row.text"), F.lit(""))).cast("long")
    return out.select("row.*", total.alias("n_bytes"), (total - F.col("n_kept")).alias("n_removed"), "n_spans", "kept_sha256", "kept")


def op3_suffix_repeats(spark, sf_dir):
    """All documents, strings of 200 bytes."""
    read = remove_repeats(only(table(spark, sf_dir, "documents"), "doc_id", "text"), "op3")
    return read.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
