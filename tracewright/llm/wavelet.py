"""Token ids in wavelet-matrix files: bit-planes with rank and select support, one file a shard.

A plane holds one bit of every id, from the highest bit down; after each plane, ids with a 0 move
stably before those with a 1. Access, counting and occurrence lookup walk the planes by rank, the
way back by select. The file is succinct (about one bit for each bit of an id) and is the only copy.

File: magic, then little-endian uint64 header (ids, planes, documents, bytes of the document table),
uint64 zeros a plane, the zlib-compressed document table (int64 keys, int64 counts, int64 1 for null
keys), then for each plane its bits in uint8, padded to whole blocks, and the uint32 number of ones before each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CachedEncoder, byte_chars, ship, slices, tokenizer_file
from .common import Scratch, ensure_importable, table
from .files import Ranged, put

MAGIC, BLOCK_BITS = b"TWWAVEL1", 512
SHARD_TOKENS, END_ID, LOOKUPS = 1 << 21, 2, 1 << 13
#: Characters encoded together: the more, the fewer pieces are met anew.
SLICE_CHARS = 1 << 22


def build(ids: np.ndarray, keys: list[int | None], counts: list[int]) -> list[bytes]:
    """The parts of a file. ids below 2^32; keys (null or not) and counts tell the documents in order."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    kind = np.uint16 if planes <= 16 else np.uint32
    ids, zeros, body = ids.astype(kind), [], []
    blocks = -(-len(ids) // BLOCK_BITS)
    for b in range(planes - 1, -1, -1):
        ones = (ids & kind(1 << b)) != 0
        packed = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
        bits = np.packbits(ones, bitorder="little")
        packed[: len(bits)] = bits
        inside = np.bitwise_count(packed).reshape(blocks, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint32)
        before = np.zeros(blocks, np.uint32)
        np.cumsum(inside[:-1], out=before[1:])
        body += [packed.tobytes(), before.astype("<u4").tobytes()]
        zeros.append(len(ids) - int(inside.sum()))
        ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])
    nulls = [k is None for k in keys]
    table = zlib.compress(np.array([[k or 0 for k in keys], counts, nulls], "<i8").tobytes(), 3)
    return [MAGIC, np.array([len(ids), planes, len(keys), len(table), *zeros], "<u8").tobytes(), table, *body]


class WaveletMatrix:
    """A file's tokens. Planes are fetched by range when first needed."""

    def __init__(self, file: Ranged):
        head = file.read(0, len(MAGIC) + 32)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.file, (self.n, self.planes, docs, table) = file, np.frombuffer(head, "<u8", 4, len(MAGIC)).tolist()
        at = len(head)
        self.zeros = np.frombuffer(file.read(at, 8 * self.planes), "<u8").astype(np.int64)
        at += 8 * self.planes
        self.keys, self.counts, self.nulls = np.frombuffer(zlib.decompress(file.read(at, table)), "<i8").reshape(3, docs)
        self.body, self.blocks, self._plane = at + table, -(-self.n // BLOCK_BITS), {}

    def plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._plane:
            size = self.blocks * (BLOCK_BITS // 8 + 4)
            raw = self.file.read(self.body + k * size, size)
            split = self.blocks * BLOCK_BITS // 8
            self._plane[k] = np.frombuffer(raw, np.uint8, split), np.frombuffer(raw, "<u4", self.blocks, split).astype(np.int64)
        return self._plane[k]

    def ones_before(self, k: int, at: np.ndarray) -> np.ndarray:
        """rank: the ones of plane k before each position, of which at most n."""
        bits, before = self.plane(k)
        if not self.blocks:
            return np.zeros(len(at), np.int64)
        block = np.minimum(at // BLOCK_BITS, self.blocks - 1)
        own = np.bitwise_count(bits.reshape(self.blocks, BLOCK_BITS // 8)[block]).astype(np.int64).cumsum(axis=1)
        rest = at - block * BLOCK_BITS
        full = rest // 8
        count = before[block] + np.where(full > 0, np.take_along_axis(own, np.maximum(full - 1, 0)[:, None], 1)[:, 0], 0)
        part = (rest % 8).astype(np.uint8)
        byte = bits[np.minimum(at // 8, len(bits) - 1)] & ((np.uint16(1) << part) - 1).astype(np.uint8)
        return count + np.bitwise_count(byte)

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for k in range(self.planes):
            bit = (self.plane(k)[0][at // 8] >> (at % 8).astype(np.uint8)) & 1
            ones = self.ones_before(k, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def range_of(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences among positions start..end stand below the last plane."""
        span = np.array([start, end], np.int64)
        if token < 0 or token >> self.planes:
            return 0, 0
        for k in range(self.planes):
            ones = self.ones_before(k, span)
            span = self.zeros[k] + ones if token >> (self.planes - 1 - k) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self.range_of(token, start, self.n if end is None else end)
        return b - a

    def select_bit(self, k: int, bit: int, nth: int) -> int:
        """The position of the nth (from 0) such bit of plane k."""
        bits, before = self.plane(k)
        starts = np.arange(self.blocks, dtype=np.int64) * BLOCK_BITS
        have = before if bit else starts - before
        block = int(np.searchsorted(have, nth, side="right")) - 1
        own = np.unpackbits(bits[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(own == bit)[nth - int(have[block])])

    def locate(self, token: int, nth: int) -> int:
        """Position of the token's nth occurrence (from 0), or -1."""
        a, b = self.range_of(token, 0, self.n)
        if not 0 <= nth < b - a:
            return -1
        at = a + nth
        for k in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - k) & 1
            at = self.select_bit(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: one pass over the planes, from the last to the first, undoing each move."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.plane(k)[0], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(ids)
            back[np.flatnonzero(~ones)] = ids[: self.zeros[k]]
            back[np.flatnonzero(ones)] = ids[self.zeros[k] :] | kind(1 << (self.planes - 1 - k))
            ids = back
            del self._plane[k]
        return ids.astype(np.uint32)


_library: dict[str, CachedEncoder] = {}


def library_encoder(name: str) -> CachedEncoder:
    """The tokenizers library's model, asked once for each distinct word while a worker remembers it."""
    if name not in _library:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(name))
        added = {x.content: i for i, x in tokenizer.get_added_tokens_decoder().items()}
        _library[name] = CachedEncoder(partial(encode_words, tokenizer.model), added)
    return _library[name]


#: The character that stands for each byte that has none of its own, as byte-level vocabularies write it.
_AS_WRITTEN = {b: c for c, b in byte_chars().items()}


def encode_words(model, words: list[str]) -> list[bytes]:
    """Ids of each word. The words are cut already, so they go to the library's model without its own cutting."""
    ask, of, ids, ends = model.tokenize, attrgetter("id"), [], [0]
    for w in words:
        written = "\u0120" + w[1:] if w[0] == " " and w.isascii() and w[1:].isalpha() else w.encode().decode("latin-1").translate(_AS_WRITTEN)
        ids.extend(map(of, ask(written)))
        ends.append(4 * len(ids))
    raw = np.array(ids, "<u4").tobytes()
    return [raw[a:b] for a, b in pairwise(ends)]


def write_shards(batches: Iterator[pa.RecordBatch], name: str, folder: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    encoder, end = library_encoder(name), np.uint32(end_id).tobytes()
    made: list[tuple] = []
    coded: list[bytes] = []
    keys: list[int | None] = []
    counts: list[int] = []
    part = TaskContext.get().partitionId()

    def close() -> None:
        if keys:
            ids = np.frombuffer(b"".join(coded), "<u4")
            made.append((put(folder, f"tokens-{part}-{len(made)}", build(ids, keys, counts)), part, len(made), len(ids)))
            for x in (coded, keys, counts):
                x.clear()

    total = 0
    for batch in batches:
        keys_in, at = batch.column("key").to_pylist(), 0
        for texts in slices(batch.column("text").to_pylist(), SLICE_CHARS):
            for own in encoder(texts):
                n = len(own) // 4 + 1
                if keys and total + n > shard_tokens:
                    close()
                    total = 0
                coded.append(own + end)
                keys.append(keys_in[at])
                counts.append(n)
                total, at = total + n, at + 1
    close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["shard", "part", "seq", "tokens"])


def read_shards(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[pa.RecordBatch]:
    """Documents of each shard. Their ends are first looked up by rank: each must hold the end id."""
    for batch in batches:
        for uri, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with Ranged(uri) as file:
                matrix = WaveletMatrix(file)
                ends = np.cumsum(matrix.counts)
                if matrix.count(end_id) < len(ends) or any((matrix.access(at) != end_id).any() for at in np.split(ends - 1, range(LOOKUPS, len(ends), LOOKUPS))):
                    raise ValueError(f"{uri} is damaged: a document does not end with the end id")
                raw = memoryview(matrix.all().astype("<u4").tobytes())
            starts = ends - matrix.counts
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            keys = pa.array(matrix.keys, pa.int64(), mask=matrix.nulls.astype(bool))
            columns = [keys, pa.array(base + starts), pa.array(matrix.counts, pa.int64()), pa.array(sums, pa.int64()), pa.array([uri] * len(sums), pa.string()), pa.array(starts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_start"])


def write_token_shards(
    docs: DataFrame,
    tokenizer_path: str,
    owner: str = "tokens",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode docs (doc_id, text) in ascending doc_id order into files; the manifest, with ``base``, the ids before a shard.

    Null text is empty and has the end id alone. Rows of a null doc_id come first and are read back
    with a null one. Equal doc_ids stand in order of their texts' hashes, so many rows of one doc_id
    are dealt over tasks. An empty table makes no file.
    """
    spark = docs.sparkSession
    name, folder = ship(spark, tokenizer_path), Scratch.path(spark, owner, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    dealt = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").select("key", "text")
    made = dealt.mapInArrow(lambda it: write_shards(it, name, folder, end_id, shard_tokens), "shard string, part long, seq long, tokens long")
    made = Scratch.write(made, owner, "manifest")
    # one row a partition, then one a shard
    parts = made.groupBy("part").agg(F.sum("tokens").alias("own"))
    parts = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return made.join(parts, "part").select("shard", "tokens", (F.col("before") + within).alias("base"))


def read_token_shards(manifest: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and where it lies."""
    ensure_importable(manifest.sparkSession)
    n = max(1, min(manifest.count(), 20_000))
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, shard_start long"
    return manifest.select("shard", "base").repartition(n).mapInArrow(lambda it: read_shards(it, end_id), fields)


def op6_wavelet_matrix(spark, sf_dir):
    """All documents' ids through wavelet-matrix shards."""
    manifest = write_token_shards(table(spark, sf_dir, "documents"), tokenizer_file(), "op6")
    read = read_token_shards(manifest)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")
