"""Toxicity of restored text: a noisy channel undone by Viterbi decoding, then a learned lexicon.

Tokens that look altered (digits or marks for letters, separators inside a word, letters set apart,
long repetitions) become a lattice of readings; the likeliest path under a character trigram model of
the whole corpus is the restored word. Words and word beginnings that are commonest among toxic
labels, by likelihood ratio, are the stems; a logistic regression weighs how often they occur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ensure_importable, table
from .fitting import bounded_sample, fit_logistic, held_out, sigmoid

#: The model is fitted on at most so many toxic and so many other labelled documents, each kind weighed by
#: the inverse of its sampling rate, so the kinds' shares in the sample do not move the scores.
FIT_TOXIC, FIT_CLEAN = 3_000, 6_000
#: Stems are whole words or beginnings of these lengths, in at least LEAST_DOCS toxic documents, and commoner
#: there by a log likelihood ratio of SIGNIFICANT nats: less than one of a hundred million reaches it by chance.
LENGTHS, SIGNIFICANT, LEAST_DOCS, RIDGE = (4, 5, 6, 7, 8), 18.0, 4, 1e-3
THRESHOLD = 0.7
CACHED = 400_000

#: Letters that marks and digits commonly stand for.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS, CENSORED = ".-_~/\\ '`^,:;=", "*#%"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Character classes of the model: 0 none, 1-26 letters, 27 any letter beyond.
CLASSES = 28
_CLASS = bytes(c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if c >= 128 else 0 for c in range(256))
_OPENS, _CLOSES, _ALONE = r"[\"'\[{<]*", r"[.,;:?!\"')\]}>]*", r"(?:[^\W\d_]|[0-9@$!|+*])"
_UNIT = re.compile(rf"({_OPENS})({_ALONE})({_CLOSES})([ \t]*)")
_APART = re.compile(rf"(?<!\S){_OPENS}{_ALONE}{_CLOSES}(?:[ \t]+{_OPENS}{_ALONE}{_CLOSES}){{2,}}(?!\S)")
#: Channel of separators, and of the space after a letter that stands alone: nothing, or the end of a word.
_NARROW, _WIDE = [("", -0.3), (" ", -1.2)], [(" ", -0.1), ("", -4.0)]
_LONG = re.compile(r"([^\W\d_])\1\1")
_WORDS = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"[$€£]?\d[\d.,:/%+-]*|[^\w@$|€£¡]*")
_EDGES = " \t.,;:?!\"'()[]{}<>#%&*$|~-_=/\\"


def trigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of class trigrams; runs of no letters count as one break."""
    counts = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for text in pc.cast(batch.column("text"), pa.binary()).to_pylist():
            if text:
                c = np.frombuffer(b"\0\0" + text.translate(_CLASS) + b"\0", np.uint8).astype(np.int32)
                c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
                counts += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])


def train_characters(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over classes, interpolated with bigrams, from every text of docs. The driver gets CLASSES^3 counts."""
    rows = docs.select("text").mapInArrow(trigram_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    bi = tri.sum(axis=0) + 0.1
    bi /= bi.sum(axis=1, keepdims=True)
    strength = 5.0
    return np.log((tri + strength * bi[None]) / (tri.sum(axis=2, keepdims=True) + strength))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, its readings and their log probabilities in the channel."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c + c, -0.2), (c, -1.7)] if n == 2 else [(c, -0.4), (c + c, -1.2)])
        elif c in READINGS:
            ways = [(r, -0.2) for r in READINGS[c]]
            out.append(ways + [(r + r, -0.9) for r in READINGS[c]] if n > 1 else ways)
        elif c in CENSORED:
            out.append([("", -1.5)] + ([(x, -3.0) for x in LETTERS] if n == 1 else []))
        else:
            out.append(_NARROW if c in SEPARATORS else [("", -1.0)])
    return out


def apart_lattice(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of a run of letters that stand alone; wide gaps and punctuation make a word's end likelier."""
    units = list(_UNIT.finditer(run.lower()))
    while units and units[-1][2] in _EDGES:
        units.pop()
    while units and units[0][2] in _EDGES and units[0][2] not in "$@":
        units.pop(0)
    out: list[list[tuple[str, float]]] = []
    for k, m in enumerate(units):
        if k:
            last = units[k - 1]
            out.append(_WIDE if last[3] or len(last[4]) > 1 or m[1] else _NARROW)
        out += lattice(m[2])
    return out


def class_of(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c != " " else 0


def viterbi(lattice_of: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading. States are the last two classes; ties go to the reading first in order."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in lattice_of:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for reading, cost in ways:
                x, y, s = a, b, score + cost
                for c in reading:
                    k = class_of(c)
                    s += model[x, y, k]
                    x, y = y, k
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = s, (path, reading)
        states = after
    path, out = max(states.items(), key=lambda kv: kv[1][0] + model[kv[0][0], kv[0][1], 0])[1][1], []
    while path:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out))


def restored(token: str, model: np.ndarray) -> list[str]:
    """Words of a token in lower case: as it stands and, where it looks altered, as it is restored."""
    token = token.lower()
    if token.isalpha() and not _LONG.search(token):
        return [token]
    words = _WORDS.findall(token)
    core = token.strip(_EDGES)
    core = token[token.find(core) - 1] + core if core and token[:1] in "$@" and token.find(core) else core
    if _NUMBER.fullmatch(core) or (core.isalpha() and not _LONG.search(core)):
        return words
    return [*words, *viterbi(lattice(core), model).split()]


def spelled_apart(text: str, model: np.ndarray | None = None) -> list[str]:
    """Words whose letters stand alone, put together; the model finds where they end, without it only wide gaps do."""
    if " " not in text and "\t" not in text:
        return []
    lattices = [apart_lattice(x) for x in _APART.findall(text) if sum(map(len, _WORDS.findall(x))) > 1]  # as restored()
    read = ("".join(ways[0][0] for ways in x) if model is None else viterbi(x, model) for x in lattices)
    return [w for x in read for w in x.split()]


def token_counts(text: str, model: np.ndarray) -> Counter[str]:
    """How often each token occurs; words spelled apart count as tokens too."""
    return Counter([*text.split(), *spelled_apart(text, model)])


def stems_of(token: str, model: np.ndarray) -> set[str]:
    """The token's words, marked by a blank at the end, and their beginnings."""
    out: set[str] = set()
    for w in restored(token, model):
        out.add(w + " ")
        out.update(w[:n] for n in LENGTHS if n < len(w))
    return out


def places_of(token: str, model: np.ndarray, place: dict[str, int]) -> tuple[int, ...]:
    """Which stems a token counts for: those of stems_of() that have a place."""
    found = []
    for w in restored(token, model):
        for f in (w + " ", *(w[:n] for n in LENGTHS if n < len(w))):
            if f in place:
                found.append(place[f])
    return tuple(set(found)) if found else ()


def restore_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Of labelled documents: tokens, and the stems with how often they occur."""
    seen: dict[str, tuple[str, ...]] = {}
    for whole in batches:
        for batch in (whole.slice(i, 50) for i in range(0, len(whole), 50)):  # a text has many stems
            tokens, stems = [], []
            for text in batch.column("text").to_pylist():
                own = token_counts(text or "", shared.value)
                found: Counter[str] = Counter()
                for t, n in own.items():
                    if t not in seen:
                        seen[t] = tuple(stems_of(t, shared.value))
                    for stem in seen[t]:
                        found[stem] += n
                tokens.append(sum(own.values()))
                stems.append(list(found.items()))
                if len(seen) > CACHED // 16:
                    seen = {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(tokens, pa.int64()), pa.array(stems, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "toxic", "tokens", "stems"])


def inputs(counts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.hstack([np.log1p(counts), 5 * np.sqrt(counts / np.maximum(tokens, 1)[:, None])])


@dataclass
class ToxicModel:
    stems: list[str]
    weights: np.ndarray  # of inputs(), then the intercept

    def score(self, counts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return sigmoid(inputs(counts, tokens) @ self.weights[:-1] + self.weights[-1])


def learn_stems(docs: DataFrame, labels: DataFrame, shared, owner: str, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> ToxicModel:
    """Held-out rows, null labels and repeated texts do not take part. The driver gets the significant stems of the
    sample, and their counts for each of its documents: as many as the sample gives, whatever the input."""
    known = labels.select("doc_id", "toxic").na.drop().filter(~held_out("doc_id")).dropDuplicates(["doc_id"])
    of = known.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c")).first()
    sample = bounded_sample(known.filter("toxic = 1"), "doc_id", fit_toxic).union(bounded_sample(known.filter("toxic <> 1"), "doc_id", fit_clean))
    own = docs.join(F.broadcast(sample), "doc_id").dropDuplicates(["text"]).select("doc_id", (F.col("toxic") == 1).alias("toxic"), "text")
    read = Scratch.write(own.mapInArrow(lambda it: restore_batches(it, shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic boolean, tokens long, stems map<string,long>"), owner, "restored")
    read_of = read.agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).first()
    t, c = float(read_of["t"]), float(read_of["c"])
    if not t or not c:
        return ToxicModel([], np.array([-3.0 if not t else 0.0]))
    # documents, not occurrences: one text may repeat a word at will
    found = read.select("toxic", F.explode(F.map_keys("stems")).alias("f")).groupBy("f")
    found = found.agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).filter(F.col("a") >= LEAST_DOCS)
    due = (F.col("a") + F.col("b")) * (t / (t + c))
    beyond = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (F.col("a") + F.col("b") - due))).otherwise(0.0)
    gain = F.col("a") * F.log(F.col("a") / due) + beyond
    ranked = found.filter(F.col("a") > due).select("f", F.round(gain, 6).alias("gain")).filter(F.col("gain") >= SIGNIFICANT)
    chosen: list[str] = []
    taken: set[str] = set()
    begun: set[str] = set()  # all beginnings of the taken
    for row in ranked.orderBy(F.desc("gain"), "f").collect():
        # of a beginning and its continuations only the best
        stem = row["f"].strip()
        if stem not in begun and not any(stem[:n] in taken for n in range(1, len(stem))):
            chosen.append(row["f"])
            taken.add(stem)
            begun.update(stem[:n] for n in range(1, len(stem) + 1))
    counts = read.select("toxic", "tokens", F.array(*(F.coalesce(F.col("stems")[x], F.lit(0)) for x in chosen)).alias("counts") if chosen else F.array().cast("array<long>").alias("counts")).toPandas()
    x = inputs(np.stack(counts["counts"].to_numpy()).astype(float).reshape(len(counts), len(chosen)), counts["tokens"].to_numpy(float))
    y = counts["toxic"].to_numpy(float)
    stands_for = np.where(y > 0, max(1.0, of["t"] / max(1, fit_toxic)), max(1.0, of["c"] / max(1, fit_clean)))
    w, mean, scale = fit_logistic(x, y, RIDGE, counts_for=stands_for)
    raw = w[:-1] / scale
    return ToxicModel(chosen, np.append(raw, w[-1] - float((raw * mean).sum())))


def score_batches(batches: Iterator[pa.RecordBatch], shared, learned: ToxicModel) -> Iterator[pa.RecordBatch]:
    model, seen, place = shared.value, {}, {f: k for k, f in enumerate(learned.stems)}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        counts, tokens = np.zeros((len(texts), len(place))), np.zeros(len(texts))
        for row, text in enumerate(texts):
            if not text:
                continue
            own = token_counts(text, model)
            tokens[row] = sum(own.values())
            for t in [t for t in own if t not in seen]:
                seen[t] = places_of(t, model, place)
            for t, n in own.items():
                for k in seen[t]:
                    counts[row, k] += n
            if len(seen) > CACHED:
                seen = {}
        hits = [[learned.stems[k].strip() for k in np.flatnonzero(x)] for x in counts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(learned.score(counts, tokens), pa.float64()), pa.array(hits, pa.list_(pa.string()))], names=["doc_id", "score", "stems"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, owner: str = "toxicity", **bounds) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, score, stems (those that occur).

    Null and empty texts have the score of documents without any stem. Without labels of both kinds
    all scores are equal. Repeated rows have equal scores.
    """
    ensure_importable(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train_characters(docs))
    learned = learn_stems(docs, labels, shared, owner, **bounds)
    return docs.mapInArrow(lambda it: score_batches(it, shared, learned), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, stems array<string>")


def op1_deobfuscated_toxicity(spark, sf_dir):
    """Every document, with labels from outside of the held-out third."""
    read = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "op1")
    return read.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
