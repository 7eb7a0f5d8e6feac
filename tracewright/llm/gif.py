"""GIF media columns: LZW streams, palettes, transparency and disposal, timed frames, colour histograms.

Block codes, the clear/end codes and the interlace order are fixed values of the GIF format.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_importable, only, table
from .polyhash import chunks

EXTENSION, CONTROL, IMAGE, TRAILER = 0x21, 0xF9, 0x2C, 0x3B
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))
BACKGROUND, PREVIOUS = 2, 3
ROW_BYTES, FRAME_ROWS, MOST_CODES = 64, 64, 4096
KEEP = 1
#: The colour of each sample: three bits of red, three of green, two of blue.
COLOURS = np.stack([(np.arange(256) >> 5) * 36, (np.arange(256) >> 2 & 7) * 36, (np.arange(256) & 3) * 85], axis=1).astype(np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    indices: np.ndarray  # as coded
    canvas: np.ndarray  # height x width x RGB of the whole screen


def code_bits(codes: np.ndarray, width: int) -> np.ndarray:
    """Bits of codes of one width, the lowest first."""
    return np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, count=width, bitorder="little").ravel()


def code_width(clear: int, nth: int) -> int:
    """Bits of the nth code (from 1) after a clear code: enough for every entry that the table has by then."""
    return min(12, (clear + nth).bit_length())


def width_groups(clear: int, first: int = 1) -> Iterator[tuple[int, int]]:
    """Widths in their order, with how many codes have each; those of the last width are without end."""
    width = code_width(clear, first)
    while width < 12:
        last = (1 << width) - 1 - clear
        yield width, last - first + 1
        first, width = last + 1, width + 1
    yield 12, 1 << 62


def lzw_codes(data: bytes, bits: int) -> list[list[int]]:
    """Codes of each table, greedy; a table that is full is followed by a clear code and another.

    A node of the table is a dict of its continuations, with its own code under -1.
    """
    clear, tables, codes = 1 << bits, [], []
    if not data:
        return [[clear + 1]]
    fresh, put = clear + 2, codes.append
    roots: list[dict] = [{-1: i} for i in range(clear)]
    node = roots[data[0]]
    for c in memoryview(data)[1:]:
        longer = node.get(c)
        if longer is not None:
            node = longer
            continue
        put(node[-1])
        if fresh < MOST_CODES:
            node[c] = {-1: fresh}
            fresh += 1
        else:
            put(clear)
            tables.append(codes)
            codes, fresh, roots = [], clear + 2, [{-1: i} for i in range(clear)]
            put = codes.append
        node = roots[c]
    codes += [node[-1], clear + 1]
    return [*tables, codes]


def lzw_compress(data: bytes, bits: int = 8) -> bytes:
    """The usual stream: a clear code, then the codes of each table, which widen as the table grows."""
    clear = 1 << bits
    parts = [code_bits(np.array([clear], np.uint16), bits + 1)]
    for codes in lzw_codes(data, bits):
        own, at = np.array(codes, np.uint16), 0
        for width, n in width_groups(clear):
            parts.append(code_bits(own[at : at + n], width))
            at += n
            if at >= len(own):
                break
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def table_codes(bits: np.ndarray, at: int, clear: int) -> tuple[np.ndarray, int, bool]:
    """Codes of one table from a bit on, where what follows its clear code begins, and whether the stream ends."""
    parts = []
    for width, n in width_groups(clear):
        n = min(n, (len(bits) - at) // width)
        full = np.zeros((n, 16), np.uint8)
        full[:, :width] = bits[at : at + n * width].reshape(n, width)
        codes = np.packbits(full.ravel(), bitorder="little").view("<u2")
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            k = int(stop[0])
            return np.concatenate([*parts, codes[:k]]), at + (k + 1) * width, bool(codes[k] == clear + 1)
        parts.append(codes)
        at += n * width
        if len(bits) - at < width:
            break
    return np.concatenate(parts), len(bits), True


def lzw_decode(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """At most ``most`` samples of each stream (data, bits, most). One that ends early gives what it holds; a bad code raises.

    All streams are decoded together. The entry that the nth code of a table makes is that code's string
    and the first sample of the next one's, so a code is a sample, or refers to an earlier code of its
    table: strings are chains of references, whose lengths and beginnings are found by doubling.
    """
    parts, clears, owners = [], [], []
    for k, (data, bits, _) in enumerate(streams):
        stream, at, ended = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"), 0, False
        while not ended:
            codes, at, ended = table_codes(stream, at, 1 << bits)
            parts.append(codes)
            clears.append(1 << bits)
            owners.append(k)
    sizes = np.array([len(x) for x in parts], np.int64)
    codes = np.concatenate([np.zeros(0, np.uint16), *parts]).astype(np.int64)
    clear, start = np.repeat(clears, sizes).astype(np.int64), np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.arange(len(codes))
    plain = codes < clear
    parent = np.where(plain, own, start + codes - clear - 2)
    if ((parent > own) | (parent < start) | (~plain & (parent == own))).any():
        raise ValueError("LZW code out of range")
    depth, root = (~plain).astype(np.int64), parent
    while depth[root].any():
        depth, root = depth + depth[root], root[root]
    first = codes[root]
    last = np.where(plain, codes, first[np.minimum(parent + 1, own)]).astype(np.uint8)
    ends = np.cumsum(depth + 1)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, node = ends - 1, own
    while len(node):  # the samples of each string, from its last
        out[at] = last[node]
        longer = ~plain[node]
        at, node = at[longer] - 1, parent[node[longer]]
    held = np.zeros(len(streams), np.int64)
    np.add.at(held, np.repeat(owners, sizes).astype(np.int64), depth + 1)
    cuts = np.cumsum(held)
    return [out[e - n : e][:most] for e, n, (_, _, most) in zip(cuts.tolist(), held.tolist(), streams, strict=True)]


def sub_blocks(data: bytes) -> bytes:
    n = len(data)
    full = n // 255
    parts = np.full((full, 256), 255, np.uint8)
    parts[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return parts.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def join_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def frame_parts(own: np.ndarray, screen: np.ndarray, disposal: int, delay_ms: int) -> list[bytes]:
    """One frame of samples over what the screen shows: samples that already stand there are transparent.

    The local palette has the colours of the other samples only, so codes are as narrow as these allow.
    """
    same = own == screen
    used = np.flatnonzero(np.bincount(own[~same], minlength=256))
    clear = len(used) if len(used) < 256 and same.any() else -1
    if clear < 0:
        used = np.flatnonzero(np.bincount(own.ravel(), minlength=256))
    colours = len(used) + (clear >= 0)
    bits = max(2, (colours - 1).bit_length())
    index = np.zeros(256, np.uint8)
    index[used] = np.arange(len(used))
    coded = index[own]
    if clear >= 0:
        coded[same] = clear
    palette = np.zeros((1 << bits, 3), np.uint8)
    palette[: len(used)] = COLOURS[used]
    height, width = own.shape
    return [
        struct.pack("<BBBBHBB", EXTENSION, CONTROL, 4, disposal << 2 | (clear >= 0), delay_ms // 10, max(0, clear), 0),
        struct.pack("<BHHHHB", IMAGE, 0, 0, width, height, 0x80 | bits - 1),
        palette.tobytes() + bytes([bits]),
        sub_blocks(lzw_compress(coded.tobytes(), bits)),
    ]


def encode_gif(samples: bytes, width: int = ROW_BYTES, frame_rows: int = FRAME_ROWS, delay_ms: int = 100) -> bytes:
    """Rows of 8-bit samples as an animation, ``frame_rows`` rows a frame, each drawn over the one before it.

    After a frame the screen is kept, or cleared where the next frame has more samples of the cleared
    colour (0) than of those that stand there.
    """
    flat = np.frombuffer(samples, np.uint8).reshape(-1, width)
    pages = [flat[top : top + frame_rows] for top in range(0, len(flat), frame_rows)]
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(len(flat), frame_rows), 0x70, 0, 0)]
    screen = np.zeros((min(len(flat), frame_rows), width), np.uint8)
    for own, after in zip(pages, [*pages[1:], None], strict=True):
        cleared = after is not None and np.count_nonzero(after == 0) > np.count_nonzero(after == own[: len(after)])
        parts += frame_parts(own, screen[: len(own)], BACKGROUND if cleared else KEEP, delay_ms)
        screen[: len(own)] = 0 if cleared else own
    return b"".join([*parts, bytes([TRAILER])])


def shown_samples(frame: Frame) -> np.ndarray:
    """The samples that encode_gif() put where a frame stands, from the colours that the screen shows there."""
    high = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width] // np.array([36, 36, 85], np.uint8)
    return high[:, :, 0] << 5 | high[:, :, 1] << 2 | high[:, :, 2]


@dataclass
class Coded:
    """A frame as it stands in a file."""

    box: tuple[int, int, int, int]  # left, top, width, height
    screen: tuple[int, int]  # height, width
    colours: np.ndarray
    interlaced: bool
    delay_ms: int
    disposal: int
    clear: int  # the transparent index, or -1
    stream: tuple[bytes, int, int]  # for lzw_decode()


def coded_frames(data: bytes) -> Iterator[Coded]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        colours = np.zeros((256, 3), np.uint8)
        colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    common = palette(flags) if flags & 0x80 else np.zeros((256, 3), np.uint8)
    delay, disposal, clear = 0, 0, -1
    while at < len(data) and data[at] != TRAILER:
        if data[at] == EXTENSION:
            label = data[at + 1]
            body, at = join_blocks(data, at + 2)
            if label == CONTROL:
                packed, ticks, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear = ticks * 10, packed >> 2 & 7, index if packed & 1 else -1
            continue
        if data[at] != IMAGE:
            raise ValueError(f"unknown block {data[at]}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette(flags) if flags & 0x80 else common
        bits = data[at]
        stream, at = join_blocks(data, at + 1)
        yield Coded((left, top, w, h), (height, width), colours, bool(flags & 0x40), delay, disposal, clear, (stream, bits, w * h))
        delay, disposal, clear = 0, 0, -1


def shown_frames(frames: Iterable[tuple[Coded, np.ndarray]]) -> Iterator[Frame]:
    """Frames with the screen as shown after each, by palette, transparency and the disposal before it."""
    screen = None
    for f, samples in frames:
        left, top, w, h = f.box
        screen = np.zeros((*f.screen, 3), np.uint8) if screen is None else screen
        indices = np.zeros(w * h, np.uint8)
        indices[: len(samples)] = samples
        indices = indices.reshape(h, w)
        if f.interlaced:
            order = np.concatenate([np.arange(a, h, b) for a, b in INTERLACE])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        before = screen.copy() if f.disposal == PREVIOUS else None
        part = screen[top : top + h, left : left + w]
        own = indices[: part.shape[0], : part.shape[1]]
        if f.clear >= 0:
            np.copyto(part, f.colours[own], where=(own != f.clear)[:, :, None])
        else:
            part[...] = f.colours[own]
        yield Frame(left, top, w, h, f.delay_ms, f.disposal, indices, screen)
        screen = screen.copy() if before is None else before
        if f.disposal == BACKGROUND:
            screen[top : top + h, left : left + w] = 0


def decode_gif(data: bytes) -> Iterator[Frame]:
    """A file's frames as shown, up to where it is damaged; then it raises."""
    return shown_frames((f, lzw_decode([f.stream])[0]) for f in coded_frames(data))


def histogram(canvas: np.ndarray) -> np.ndarray:
    """64 bins: the two high bits of red, green and blue."""
    high = canvas.reshape(-1, 3) >> 6
    return np.bincount(high[:, 0] << 4 | high[:, 1] << 2 | high[:, 2], minlength=64)


FRAMES = "frame int, delay_ms int, disposal int, left int, top int, width int, height int, pixels binary, histogram array<long>, error string"


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, media = batch.column("row"), batch.column("media").to_pylist()
        for i, data in enumerate(media):  # a batch a document: canvases are large
            rows = []
            try:
                for n, f in enumerate(decode_gif(data or b"")):
                    rows.append({"frame": n, "delay_ms": f.delay_ms, "disposal": f.disposal, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "pixels": f.canvas.tobytes(), "histogram": histogram(f.canvas).tolist()})
            except (ValueError, IndexError, struct.error) as e:
                rows.append({"error": str(e)})
            made = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([i] * len(rows), pa.int32())), *made.columns], names=["row", *schema.names])


def gif_frames(df: DataFrame, media_col: str) -> DataFrame:
    """A row for each frame: struct ``row`` (the other columns) and FRAMES; pixels are the RGB screen.

    What is no GIF (null and empty too), or is damaged, gives its frames so far and a row with ``error``.
    """
    ensure_importable(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != media_col]
    slim = df.select((F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("row"), F.col(f"`{media_col}`").alias("media"))
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in FRAMES.split(", "))])
    return slim.mapInArrow(lambda it: _rows(it, schema), T.StructType([slim.schema["row"], *T._parse_datatype_string(FRAMES)]))


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW_BYTES if text else ROW_BYTES)


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store each text as a GIF, read the GIFs back, and describe what was read."""
    names = [x.split(" ")[0] for x in MEDIA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in MEDIA.split(", ")]
    for batch in batches:
        texts = [t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
        rows = []
        for i, j in chunks([len(t) for t in texts], 1 << 20):
            media = [encode_gif(padded(t)) for t in texts[i:j]]
            coded = [list(coded_frames(m)) for m in media]
            samples = iter(lzw_decode([f.stream for frames in coded for f in frames]))
            for text, stored, frames in zip(texts[i:j], media, coded, strict=True):
                parts, bins, length = [], np.zeros(64, np.int64), 0
                for frame in shown_frames((f, next(samples)) for f in frames):
                    parts.append(shown_samples(frame).tobytes())
                    bins += histogram(frame.canvas[: frame.height])
                    length += frame.delay_ms
                payload = b"".join(parts)
                feature = f"frames={len(parts)};ms={length};" + ",".join(f"{k}:{n}" for k, n in enumerate(bins.tolist()) if n)
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *names])


def op7_gif(spark, sf_dir):
    """Every text as coloured samples of a GIF, in frames of 64 rows of 64, and back. Null texts are empty: 64 zero bytes."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.mapInArrow(text_media, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(MEDIA)]))
