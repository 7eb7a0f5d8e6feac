"""Parts of the operators on their own: formats, structures, models."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest

from tracewright.llm import gif, zip64
from tracewright.llm.decontam import TokenAutomaton, cut, merged, words_of
from tracewright.llm.minhash import sketch
from tracewright.llm.polyhash import PrefixHash, mix
from tracewright.llm.sharding import plan_ring
from tracewright.llm.suffixes import repeated, sort_suffixes
from tracewright.llm.toxicity import CLASSES, restored, spelled_apart, trigram_batches
from tracewright.llm.wavelet import WaveletMatrix, build


class Memory:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]


def test_zip64_both_ways():
    members = [("a/b.txt", b"hello"), ("é.bin", bytes(1000)), ("empty", b"")]
    for wide in (True, False):
        data = b"".join(zip64.pack(members, wide))
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None
            assert [(n, z.read(n)) for n in z.namelist()] == members
        found = zip64.directory(Memory(data).read, len(data))
        assert {n: data[(at := zip64.data_offset(Memory(data).read, m)) : at + m.size] for n, m in found.items()} == dict(members)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"y" * 10)
        z.comment = b"PK\x05\x06 a comment"
    data = other.getvalue()
    assert zip64.directory(Memory(data).read, len(data))["x"].size == 10
    with pytest.raises(ValueError, match="not a ZIP"):
        zip64.directory(Memory(b"nothing").read, 7)


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        window, letters = rng.choice([2, 3, 4]), [b"a", b"b", b"c"][: rng.choice([2, 3])]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(0, 4))]
        doc = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 25))]
        hit, ids = set(), set()
        for item, words in items:
            n = min(window, len(words))
            for k in range(len(words) - n + 1 if n else 0):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == words[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(item)
        spans, found = TokenAutomaton(items, window).scan(doc)
        assert ({x for a, b in spans for x in range(a, b + 1)}, found) == (hit, ids)
        assert merged(spans) == spans


def test_blocks_of_items_equal_one_automaton(spark):
    from tracewright.llm.decontam import decontaminate

    docs = spark.createDataFrame([(i, f"alpha beta gamma delta w{i} epsilon zeta") for i in range(5)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "beta gamma delta"), (1, "w3 epsilon"), (2, "zeta")], "item_id long, text string")
    one, many = (sorted((r.row.doc_id, r.report.n_hit, tuple(r.report.item_ids), r.report.clean_text) for r in decontaminate(docs, items, block_bytes=b).collect()) for b in (1 << 20, 70))
    assert one == many
    assert one[3][1:3] == (6, ("0", "1", "2"))


def test_cut_keeps_the_rest():
    text = "Keep, this: DROP that & these; end".encode()
    assert words_of(text) == [b"keep", b"this", b"drop", b"that", b"these", b"end"]
    assert cut(text, [[2, 4]]) == b"Keep, this: ; end"


def test_suffix_sort_and_repeats():
    rng = np.random.default_rng(0)
    for _ in range(60):
        length = int(rng.integers(1, 6))
        n = int(rng.integers(length, 50))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        m = int(rng.integers(1, 30))
        starts, groups = rng.integers(0, n - length + 1, m), np.sort(rng.integers(0, 3, m))
        order = sort_suffixes(data, PrefixHash(data), starts, groups, length)
        keys = [(groups[i], bytes(data[starts[i] : starts[i] + length])) for i in order]
        assert keys == sorted(keys)
        hit = repeated(data, starts, groups, starts.astype(np.int64), length)
        own = [(g, bytes(data[s : s + length])) for g, s in zip(groups, starts, strict=True)]
        assert hit.tolist() == [any(own[i] == own[j] and starts[i] != starts[j] for j in range(m)) for i in range(m)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    assert (sketch(np.array([5], np.uint64), 240) < np.iinfo(np.uint64).max).all()
    gaps = []
    for share in (0.5, 0.85, 0.95):
        common = mix(rng.integers(0, 1 << 62, int(1000 * share)).astype(np.uint64))
        a, b = (np.concatenate([common, mix(rng.integers(0, 1 << 62, 1000 - len(common)).astype(np.uint64))]) for _ in range(2))
        true = len(common) / (2000 - len(common))
        gaps.append(abs((sketch(a, 2000) == sketch(b, 2000)).mean() - true))
    assert max(gaps) < 0.06


def test_wavelet_null_keys():
    matrix = WaveletMatrix(Memory(b"".join(build(np.array([7, 2, 2], np.uint32), [None, 0], [2, 1]))))
    assert matrix.nulls.tolist() == [1, 0] and matrix.keys.tolist() == [0, 0] and matrix.access(np.array([1, 2])).tolist() == [2, 2]


def test_wavelet_access_count_locate():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        for top in (1, 300, 50257):
            ids = rng.integers(0, top, n).astype(np.uint32)
            matrix = WaveletMatrix(Memory(b"".join(build(ids, [5], [n]))))
            if n:
                at = rng.integers(0, n, 30)
                assert (matrix.access(at) == ids[at]).all()
                for token in (int(ids[0]), 70_000):
                    where = np.flatnonzero(ids == token)
                    assert matrix.count(token, n // 3, n) == int((where >= n // 3).sum())
                    assert [matrix.locate(token, k) for k in (0, len(where) - 1, len(where))] == ([int(where[0]), int(where[-1]), -1] if len(where) else [-1, -1, -1])
            assert (WaveletMatrix(Memory(b"".join(build(ids, [5], [n])))).all() == ids).all()


def plain_lzw(data: bytes, bits: int) -> tuple[list[int], bool]:
    """Samples of a stream, code by code, and whether any code was of the table."""
    stream, clear, at = int.from_bytes(data, "little"), 1 << bits, 0
    table, width, last, out, used = {}, bits + 1, None, [], False
    while True:
        code = stream >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, last = {i: [i] for i in range(clear)}, bits + 1, None
            continue
        if code == clear + 1:
            return out, used
        used |= code > clear
        own = table[code] if code in table else [*last, last[0]]
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = [*last, own[0]]
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
        out += own
        last = own


def plain_gif(data: bytes) -> list[tuple[int, int, list[list[tuple[int, int, int]]], bool]]:
    """(height, disposal, screen, whether table codes occur) of each frame, sample by sample."""
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    assert data[:6] == b"GIF89a" and not data[10] & 0x80
    screen, at, out = [[(0, 0, 0)] * width for _ in range(height)], 13, []
    while data[at] == 0x21:
        assert data[at + 1 : at + 3] == b"\xf9\x04"
        disposal, clear = data[at + 3] >> 2, data[at + 6] if data[at + 3] & 1 else None
        at += 8
        left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        assert data[at] == 0x2C and data[at + 9] & 0x80 and (left, top, w) == (0, 0, width)
        n = 2 << (data[at + 9] & 7)
        palette = [tuple(data[at + 10 + 3 * k : at + 13 + 3 * k]) for k in range(n)]
        at += 10 + 3 * n
        bits, stream = data[at], b""
        at += 1
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        samples, used = plain_lzw(stream, bits)
        assert len(samples) == w * h
        for k, x in enumerate(samples):
            if x != clear:
                screen[k // w][k % w] = palette[x]
        out.append((h, disposal, [list(row) for row in screen], used))
        if disposal == 2:
            for row in range(h):
                screen[row] = [(0, 0, 0)] * width
    assert data[at:] == b";"
    return out


def test_lzw_both_ways():
    rng = np.random.default_rng(0)
    streams = []
    for n in (0, 1, 254, 255, 5000, 30_000):
        for bits, top in ((2, 4), (5, 2), (8, 256)):
            data = rng.integers(0, top, n).astype(np.uint8)
            stream = gif.lzw_compress(data.tobytes(), bits)
            assert plain_lzw(stream, bits)[0] == data.tolist()
            streams.append(((stream, bits, n), data))
    for got, (_, data) in zip(gif.lzw_decode([s for s, _ in streams]), streams, strict=True):
        assert (got == data).all()
    with pytest.raises(ValueError, match="out of range"):
        gif.lzw_decode([(np.packbits(gif.code_bits(np.array([256, 65, 300, 257], np.uint16), 9), bitorder="little").tobytes(), 8, 10)])


def test_frames_against_a_plain_decoder():
    """Local palettes, transparency, both disposals and table codes, pixel by pixel."""
    rng = random.Random(4)
    prose = "".join(rng.choice(["the ", "quick ", "fox ", "é "]) for _ in range(3000)).encode()
    zeros = prose[:4096] + bytes(4096) + prose[:5000]
    for payload in (gif.padded(prose), gif.padded(zeros), gif.padded(b""), rng.randbytes(64 * 150), bytes(range(256)) * 20):
        stored = gif.encode_gif(payload)
        plain, read = plain_gif(stored), list(gif.decode_gif(stored))
        assert b"".join(gif.shown_samples(f).tobytes() for f in read) == payload
        assert [(f.height, f.disposal, f.canvas.tolist()) for f in read] == [(h, d, [[list(p) for p in row] for row in screen]) for h, d, screen, _ in plain]
        for f, (h, _, screen, _) in zip(read, plain, strict=True):
            want = np.zeros(64, int)
            for r, g, b in (p for row in screen[:h] for p in row):
                want[r // 64 * 16 + g // 64 * 4 + b // 64] += 1
            assert (gif.histogram(f.canvas[:h]) == want).all()
        if payload.startswith(b"the") or len(payload) > 8192:
            assert all(used for *_, used in plain)
    assert {d for _, d, _, _ in plain_gif(gif.encode_gif(gif.padded(zeros)))} == {1, 2}


def test_disposal_transparency_interlace():
    import struct

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(samples, disposal, clear=None, flags=0, box=(0, 0, 2, 5)):
        control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0)
        return control + struct.pack("<BHHHHB", 0x2C, *box, flags) + b"\x02" + gif.sub_blocks(gif.lzw_compress(bytes(samples), 2))

    rows = [1, 1, 2, 2, 3, 3, 1, 1, 2, 2]
    laced = [1, 1, 3, 3, 2, 2, 2, 2, 1, 1]  # rows 0, 4, 2, 1, 3
    laced = [x for r in (0, 4, 2, 1, 3) for x in rows[2 * r : 2 * r + 2]]
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 5, 0x81, 0, 0) + palette + frame(rows, 1) + frame([0, 3], 2, clear=0, box=(0, 0, 2, 1)) + frame([3, 3], 3, box=(0, 1, 2, 1)) + frame(laced, 0, flags=0x40) + b";"
    shown = [f.canvas.copy() for f in gif.decode_gif(data)]
    assert [f.delay_ms for f in gif.decode_gif(data)] == [70] * 4
    red, blue = [255, 0, 0], [0, 0, 255]
    assert shown[0][0].tolist() == [red, red]
    assert shown[1][0].tolist() == [red, blue]  # the clear sample shows what is below
    assert shown[2][0].tolist() == [[0, 0, 0]] * 2 and shown[2][1].tolist() == [blue, blue]  # restored to background
    assert (shown[3] == shown[0]).all()  # rows come out of order


def test_damaged_gifs_are_rows(spark):
    good = gif.encode_gif(bytes(range(192)))
    rows = gif.gif_frames(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray(good[:-20]))], "id long, m binary"), "m").collect()
    by = {r.row.id: r for r in rows}
    assert by[1].error is None and sum(by[1].histogram) == 192
    assert all(by[k].error for k in (2, 3, 4))


def test_ring_moves_little_and_fills():
    loads = {s: 10 for s in range(0, 65536, 8)}
    a, b = plan_ring(loads, 40, epsilon=0.1), plan_ring(loads, 41, epsilon=0.1)
    total = sum(loads.values())
    owner = [{(r.slot, k): r.shard for r in p.itertuples() for k in range(r.first, r.last + 1)} for p in (a, b)]
    assert len(owner[0]) == len(owner[1]) == total
    assert sum(owner[0][k] != owner[1][k] for k in owner[0]) < 0.12 * total
    counts = np.bincount(list(owner[0].values()))
    assert counts.max() <= np.ceil(1.1 * total / 40)


def test_ring_movement_at_the_query_setting():
    """epsilon 0 leaves no slack, so more rows move than the ideal share of 1/41; the README names the figure."""
    loads = dict(zip(range(1 << 16), np.random.default_rng(1).multinomial(200_000, [2**-16] * 2**16).tolist(), strict=True))
    owner = []
    for shards in (40, 41):
        own = np.full(200_000, -1)
        before = np.cumsum([0, *loads.values()])
        for r in plan_ring(loads, shards).itertuples():
            own[before[r.slot] + r.first : before[r.slot] + r.last + 1] = r.shard
        assert np.ptp(np.bincount(own, minlength=shards)) <= 1
        owner.append(own)
    assert 1 / 41 <= (owner[0] != owner[1]).mean() < 0.08


def test_ring_against_a_plain_one():
    """With room for all, a row's shard is the next point clockwise of its slot."""
    from tracewright.llm.sharding import ring_points

    at, owner = ring_points(5, 8, 8)
    plan = plan_ring(dict.fromkeys(range(256), 3), 5, 8, 8, epsilon=50.0)
    for r in plan.itertuples():
        after = [(p, s) for p, s in zip(at.tolist(), owner.tolist(), strict=True) if p >= r.slot]
        assert r.shard == (after[0][1] if after else owner[0]) and (r.first, r.last) == (0, 2)


def test_restoration():
    import pyarrow as pa

    text = " ".join(["the idiot and the moron said stupid things to a clown in the trash", "what a loser said the other and left"] * 50)
    (made,) = trigram_batches(iter([pa.RecordBatch.from_pydict({"text": [text]})]))
    counts = np.zeros(CLASSES**3)
    counts[made.column("gram").to_numpy()] = made.column("n").to_numpy()
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    bi = tri.sum(axis=0) + 0.1
    bi /= bi.sum(axis=1, keepdims=True)
    model = np.log((tri + 5 * bi[None]) / (tri.sum(axis=2, keepdims=True) + 5))
    for altered, word in (("1d10t", "idiot"), ("st.up.id", "stupid"), ("m0r0n!!", "moron"), ("cl0wn", "clown"), ("idiooooot", "idiot"), ("$tup1d", "stupid"), ("l0$er", "loser")):
        assert restored(altered, model)[-1] == word
    assert restored("plain", model) == ["plain"]
    assert restored("good,", model)[0] == "good"
    assert spelled_apart("an i d i o t here") == ["idiot"]
    assert restored("12,345", model) == [] and restored("$1,200.50", model) == [] and restored("***", model) == []
    # with one plain letter, and with none
    assert restored("1d107", model)[-1] == "idiot"
    assert restored("570|01d", model)[-1] != "" and restored("|0$3|2", model) != []
    assert spelled_apart("a s s and a", model) != []


def restoring_model(text: str) -> np.ndarray:
    import pyarrow as pa

    (made,) = trigram_batches(iter([pa.RecordBatch.from_pydict({"text": [text]})]))
    counts = np.zeros(CLASSES**3)
    counts[made.column("gram").to_numpy()] = made.column("n").to_numpy()
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    bi = tri.sum(axis=0) + 0.1
    bi /= bi.sum(axis=1, keepdims=True)
    return np.log((tri + 5 * bi[None]) / (tri.sum(axis=2, keepdims=True) + 5))


SPOKEN = " ".join(["you are a stupid man and the idiot said stupid things to a clown in the trash", "what a loser said the other and left i am an idiot"] * 50)


def test_spelled_apart_finds_the_words():
    model = restoring_model(SPOKEN)
    for text, want in (
        ("you are a s t u p i d man", ["a", "stupid"]),
        ("y o u   s t u p i d   i d i o t", ["you", "stupid", "idiot"]),
        ("so s t u p i d, he said", ["stupid"]),
        ("an i d i o t! he said", ["idiot"]),
        ("an i d 1 o t here", ["idiot"]),
        ('"i d i o t" s/he said', ["idiot"]),
    ):
        assert spelled_apart(text, model) == want
    assert spelled_apart("rows 1 2 3 4 5 and * * * * here", model) == []


def test_long_tokens_are_restored():
    model = restoring_model(SPOKEN)
    assert restored("id" + "i" * 70 + "ot", model)[-1] == "idiot"
    for mark in "_.-":
        found = restored(mark.join(["y0u", "4re", "a", "stup1d", "m4n"] * 4), model)
        assert found.count("stupid") == 4
