"""Byte-level BPE in batched numpy merge rounds, equal to the tokenizers library's results.

Texts are cut at added tokens and split into words by the vocabulary's pattern. Words not seen
before are encoded together: their symbols lie in one flat array, a round finds every adjacent
pair's rank by binary search over the sorted pair keys and merges the lowest-ranked pair of each
word. Encoded words are kept as little-endian bytes, so that a text is one join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, only, table

#: The word pattern of byte-level BPE (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a generation that a worker remembers, and the longest that it does.
CACHED_WORDS, CACHED_CHARS = 300_000, 64
NO_RANK = np.int64(1 << 60)
#: ASCII marks; the apostrophe, which may begin a word of letters, is left out.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, spec: dict):
        model, chars = spec["model"], byte_chars()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only plain byte-level BPE without normaliser or prefix space is read")
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(chars[c] for c in token) for token, i in vocab.items()}
        self.pieces |= {i: text.encode() for text, i in self.added.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of non-empty words, in rounds over those words that still have a pair to merge."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        own = np.repeat(np.arange(len(words)), sizes)  # the word of each symbol
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(len(ids), NO_RANK)  # of each symbol with the next, within a word
        stale = np.arange(len(ids))
        while len(ids):
            inside = stale[stale + 1 < len(ids)]
            ranks[stale] = NO_RANK
            inside = inside[own[inside] == own[inside + 1]]
            ranks[inside] = self.rank(ids[inside], ids[inside + 1])
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            lengths = np.diff(starts, append=len(ids))
            best = np.minimum.reduceat(ranks, starts)
            done = best == NO_RANK
            if done.any():
                ended = np.flatnonzero(done)
                for k, a, b in zip(own[starts[ended]].tolist(), starts[ended].tolist(), (starts + lengths)[ended].tolist(), strict=True):
                    out[k] = ids[a:b]
                going = np.repeat(~done, lengths)
                ids, own, ranks, best, lengths = ids[going], own[going], ranks[going], best[~done], lengths[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == np.repeat(best, lengths))
            # of pairs that overlap (a run of one symbol), every other from the left
            fresh = np.concatenate([[True], np.diff(at) > 1])
            if not fresh.all():
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.results[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, own, ranks = ids[keep], own[keep], ranks[keep]
            at -= np.arange(len(at))
            stale = np.unique(np.concatenate([at, at[at > 0] - 1]))
        return out


class CachedEncoder:
    """Texts to little-endian uint32 ids, through an encoder of many words and a bounded memory of words.

    A space with no white space after it always begins a word, so texts are cut there first, and what
    stands between is remembered whole; only new pieces are split by the pattern. What is remembered
    has two generations: when the younger is full it becomes the older, and a piece that is met again
    moves back into the younger without being encoded again.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], added: dict[str, int]):
        self.encode_words, self.added = encode, {k: np.uint32(v).tobytes() for k, v in added.items()}
        self.pattern, self.wide, self.begins = regex.compile(PATTERN), re.compile(r" \s"), re.compile(r" (?=\S)")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.after: dict[str, bytes] = {}  # pieces that follow a space, with that space
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = dict(self.added)  # words that do not begin with a space
        self.long: list[str] = []  # of this call, not to be remembered

    def split(self, text: str) -> list[str]:
        """Words, and added tokens as words."""
        if self.cut is None or not any(x in text for x in self.added):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def special(self, text: str) -> bool:
        """Whether more than single spaces before words, and added tokens, has to be told apart."""
        return any(x in text for x in self.added) or self.wide.search(text) is not None

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """Words of the beginning (of a text with added tokens: of all), and the pieces after spaces."""
        if any(x in text for x in self.added):
            return self.split(text), []
        first, *tail = self.begins.split(text)
        return self.pattern.findall(first), tail

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Most texts are cut, and their pieces told apart and put together, in arrays: a piece costs Python work only once a call."""
        odd = [k for k, text in enumerate(texts) if self.special(text)]
        plain = [*range(len(texts))] if not odd else sorted({*range(len(texts))}.difference(odd))
        cut = [self.pieces(texts[k]) for k in odd]
        lists = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
        ends, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        place, pieces, starts = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), ends[:-1]
        heads = [self.pattern.findall(pieces[k]) for k in place[starts].tolist()]
        place[starts] = len(pieces) + np.arange(len(plain))  # a text's beginning follows no space
        after = np.zeros(len(pieces) + len(plain), bool)
        after[place] = True
        wanted = [x for x, used in zip(pieces, after.tolist(), strict=False) if used]

        new = {x for x, own in zip(wanted, map(self.after.get, wanted), strict=True) if own is None}
        new.update(x for _, tail in cut for x in tail if x not in self.after)
        met = {x: self.older[x] for x in new if x in self.older}
        self.after |= met
        new.difference_update(met)
        self._learn(new, set().union(*heads, *(head for head, _ in cut)))

        known, ids = self.after.get, [b""] * len(texts)
        table = pa.array([*(known(x, b"") for x in pieces), *(b"".join(map(self._word, head)) for head in heads)], pa.large_binary())
        joined = table.take(pa.array(place))
        raw = joined.buffers()[2]
        at = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[ends].tolist()
        view = memoryview(raw) if raw is not None else memoryview(b"")
        for k, a, b in zip(plain, at, at[1:], strict=False):
            ids[k] = bytes(view[a:b])
        for k, (head, tail) in zip(odd, cut, strict=True):
            ids[k] = b"".join([*map(self._word, head), *map(self.after.__getitem__, tail)])
        self._forget()
        return ids

    def _learn(self, new: set[str], words: set[str]) -> None:
        """Encode pieces that follow a space, and words."""
        whole, ended, split = set(), {}, {}
        for x in new:
            if x.isalpha():  # one word with the space before it
                whole.add(x)
            elif (body := x.rstrip(_MARKS)).isalpha():  # marks after letters are a word of their own
                ended[x] = body, x[len(body) :]
            elif len(own := self.pattern.findall(" " + x)) > 1:
                split[x] = own
            else:
                whole.add(x)
        words = words.union(*split.values())
        words.update(marks for _, marks in ended.values())
        spaced = {w[1:] for w in words if len(w) > 1 and w[0] == " "}.union(body for body, _ in ended.values())
        whole.update(x for x in spaced if x not in self.after)
        fresh = list(whole)
        fresh_words = [w for w in words if w not in self.words and (len(w) == 1 or w[0] != " ")]
        coded = self.encode_words([*(" " + x for x in fresh), *fresh_words])
        self.after |= zip(fresh, coded, strict=False)
        self.words |= zip(fresh_words, coded[len(fresh) :], strict=True)
        for x, (body, marks) in ended.items():
            self.after[x] = self.after[body] + self.words[marks]
        for x, own in split.items():
            self.after[x] = b"".join(map(self._word, own))
        self.long += [x for x in (*fresh, *ended, *split, *fresh_words) if len(x) > CACHED_CHARS and x not in self.added]

    def _forget(self) -> None:
        """Long strings at once, others when a generation is full."""
        for x in self.long:
            self.after.pop(x, None)
            self.words.pop(x, None)
        self.long.clear()
        if len(self.after) > CACHED_WORDS:
            self.older, self.after = self.after, {}
        if len(self.words) > CACHED_WORDS:
            self.words = dict(self.added)

    def _word(self, word: str) -> bytes:
        return self.after[word[1:]] if len(word) > 1 and word[0] == " " else self.words[word]


def slices(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about limit characters, so that memory does not follow the batch."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own


_loaded: dict[str, tuple[ByteBPE, CachedEncoder]] = {}


def loaded(name: str) -> tuple[ByteBPE, CachedEncoder]:
    """Once a worker process; the vocabulary file was sent to every executor."""
    if name not in _loaded:
        bpe = ByteBPE.load(SparkFiles.get(name))
        _loaded[name] = bpe, CachedEncoder(lambda words: [x.astype("<u4").tobytes() for x in bpe.encode_words([w.encode() for w in words])], bpe.added)
    return _loaded[name]


_shipped: set[tuple[str, str]] = set()


def ship(spark, path: str) -> str:
    """Send the vocabulary file to the executors of this application; its name there."""
    ensure_importable(spark)
    known = (spark.sparkContext.applicationId, path)
    if known not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(known)
    return path.replace("\\", "/").rpartition("/")[2]


def decode(pieces: dict[int, bytes], ids: np.ndarray) -> str:
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_batches(batches: Iterator[pa.RecordBatch], name: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe, encoder = loaded(name)
    for batch in batches:
        rows = []
        for texts in slices([t or "" for t in batch.column("text").to_pylist()]):
            for coded in encoder(texts):
                ids = np.frombuffer(coded, "<u4")
                text = decode(bpe.pieces, ids)
                rows.append((len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids if with_ids else None, text if with_ids else None))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Struct ``row`` (the other columns), n_tokens, digests, and with with_ids also ``ids`` and ``decoded``.

    Null and empty texts have no tokens. Long texts are encoded whole; words longer than CACHED_CHARS
    are not remembered. Special tokens' strings in a text become their ids, as in the library.
    """
    name = ship(docs.sparkSession, tokenizer_path)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    slim = docs.select((F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("row"), F.col(f"`{text_col}`").alias("text"))
    more = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return slim.mapInArrow(lambda it: encode_batches(it, name, with_ids), T.StructType([slim.schema["row"], *more]))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_numpy_bpe(spark, sf_dir):
    """Every document encoded and decoded again, with the public 50k byte-level vocabulary."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    read = bpe_round_trip(docs, tokenizer_file(), with_ids=False)
    return read.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
