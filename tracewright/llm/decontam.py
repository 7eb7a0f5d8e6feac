"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

Document words stream through the automaton, which yields the longest item substring that ends at
each word. A length of ``window`` words or more, or a whole shorter item, marks its words as hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, only, table

WINDOW = 10
#: Items are put into automata of at most so many bytes of text each; documents pass through one after another.
BLOCK_BYTES = 1 << 20
REPORT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<first:long,last:long>>, clean_text string"

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to lower case, everything that is no word byte to a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class TokenAutomaton:
    """States of the generalised suffix automaton, and which items own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(words) for _, words in coded)])
        #: For a state whose matches can reach the window: the state of exactly the window's length.
        self.ancestor = [self._above(v, window) if n >= window else -1 for v, n in enumerate(self.length)]
        self.owners: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for item, words in coded:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.owners.setdefault(self.ancestor[v], set()).add(item)
            if len(words) < window:
                whole.setdefault(self._above(v, len(words)), []).append((len(words), item))
        #: Short items that end wherever a match is in the state.
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for v in range(len(self.length)) if whole else ():
            u, found = v, []
            while u > 0:
                found += whole.get(u, [])
                u = self.link[u]
            if found:
                self.whole[v] = found

    def _above(self, v: int, n: int) -> int:
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that holds the string of p followed by w, and nothing longer."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal hit runs [first, last] of word positions, and the items whose windows occur."""
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]).astype(np.int8)))
        spans: list[list[int]] = []
        items: set[str] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            v = n = 0
            for at, w in enumerate(codes[a:b].tolist(), a):
                while w not in self.next[v] and v:
                    v = self.link[v]
                    n = self.length[v]
                if w not in self.next[v]:
                    continue
                v, n = self.next[v][w], n + 1
                hit = 0
                if n >= self.window:
                    hit = self.window
                    items |= self.owners.get(self.ancestor[v], set())
                for length, item in self.whole.get(v, ()):
                    if length <= n:
                        items.add(item)
                        hit = max(hit, length)
                if hit:
                    first = at - hit + 1
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first - 1:
                        spans[-1][1] = at
                    else:
                        spans.append([first, at])
        return spans, items


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_FOLD))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b][1]
    return b"".join([*kept, text[at:]])


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[Broadcast]:
    """Broadcast automata. The driver holds the items of one block at a time, of at most about block_bytes."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    blocks = []
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        coded = [(r["id"], words_of(r["text"].encode())) for r in own.distinct().orderBy("id", "text").toLocalIterator()]
        blocks.append(spark.sparkContext.broadcast(TokenAutomaton(coded, window)))
    return blocks


def scan_batches(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast], text_index: int, cut_over: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.cast(batch.column(text_index), pa.binary()).to_pylist()
        words = [words_of(text or b"") for text in texts]
        found: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in texts]
        for block in blocks:
            automaton = block.value
            for (spans, items), own in zip(found, words, strict=True):
                more, hit = automaton.scan(own)
                spans += more
                items |= hit
            if len(blocks) > 1:  # a worker holds one automaton at a time
                del automaton, block._value
        out: list[tuple] = []
        for text, own, (spans, items) in zip(texts, words, found, strict=True):
            spans = merged(spans)
            out.append((len(own), sum(b - a + 1 for a, b in spans), sorted(items), [{"first": a, "last": b} for a, b in spans], cut(text, [x for x in spans if x[1] - x[0] + 1 > cut_over]).decode() if cut_over is not None and text is not None else None))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string()]
        made = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=["n_words", "n_hit", "item_ids", "spans", "clean_text"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:text_index], *batch.columns[text_index + 1 :], made], names=[*(n for k, n in enumerate(batch.schema.names) if k != text_index), "report"])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut_over: int | None = 0) -> DataFrame:
    """Struct column ``row`` (the document's other columns) and struct column ``report`` (see REPORT).

    clean_text lacks the hit spans of more than cut_over words (None: no clean_text is made).
    Null and empty texts have no words and no hits; a null text stays null. Items without words never
    occur, rows of a null id are ignored, repeated items count once. Without items nothing is hit.
    Each automaton is built once on the driver; its size is bounded by block_bytes.
    """
    ensure_importable(docs.sparkSession)
    blocks = item_blocks(items, id_col, item_text_col, window, block_bytes)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    slim = docs.select((F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([slim.schema["row"], T.StructField("report", T._parse_datatype_string(REPORT))])
    return slim.mapInArrow(lambda it: scan_batches(it, blocks, 1, cut_over), schema)


def remove_contamination(docs: DataFrame, items: DataFrame, max_words: int = 0, max_cover: float = 0.5, **options) -> DataFrame:
    """docs without contamination, same columns: hit spans of more than max_words words are cut out of
    ``text``; documents of which more than max_cover of the words are hit go whole. n_chars follows."""
    names = docs.columns
    read = decontaminate(docs, items, cut_over=max_words, **options)
    read = read.filter(F.col("report.n_hit") <= max_cover * F.col("report.n_words"))
    kept = read.select(*[F.col("report.clean_text" if c == "text" else f"row.`{c}`").alias(c) for c in names])
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else kept


def op2_suffix_automaton(spark, sf_dir):
    """Every document against every benchmark item; windows of ten words."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    read = decontaminate(docs, table(spark, sf_dir, "benchmark"), cut_over=None)
    r = "report."
    digest = F.sha2(F.array_join(r + "item_ids", ",").cast("binary"), 256)
    return read.select(F.col("row.doc_id").alias("doc_id"), F.col(r + "n_words").alias("n_words"), F.col(r + "n_hit").alias("n_hit"), F.size(r + "item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col(r + "n_hit") > 0).alias("contaminated"))
