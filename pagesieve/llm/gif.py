"""GIF as a media column: LZW streams, palettes, disposal, transparency, timed frames, colour histograms.

``decode`` reads any GIF87a/89a file into composed RGB frames; ``encode`` writes frames of palette indices.
``store`` keeps bytes losslessly as 8-bit grey samples of 192 columns, in frames of at most 256 rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, mapped

WIDTH, ROWS = 192, 256
_SINGLES = {n: [bytes((i,)) for i in range(1 << n)] for n in range(1, 9)}


class GifError(ValueError):
    """The bytes are not a GIF file that can be decoded."""


@dataclass
class Frame:
    """pixels: palette indices (rows, columns). disposal: 0/1 leave, 2 clear to background, 3 restore what was before."""

    pixels: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None
    interlaced: bool = False


@dataclass
class Image:
    width: int
    height: int
    palette: np.ndarray | None = None
    background: int = 0
    frames: list[Frame] = field(default_factory=list)


def lzw_encode(data: bytes, bits: int) -> bytes:
    """GIF's LZW: codes grow from bits + 1 to 12 bits; a full table is cleared."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, starts = [clear], [0]
    table: dict[int, int] = {}
    nxt, last = end + 1, -1
    for c in data:
        key = last << 8 | c
        got = table.get(key, -1) if last >= 0 else c
        if got >= 0:
            last = got
            continue
        codes.append(last)
        if nxt < 4096:
            table[key] = nxt
            nxt += 1
        else:
            codes.append(clear)
            starts.append(len(codes) - 1)
            table.clear()
            nxt = end + 1
        last = c
    if last >= 0:
        codes.append(last)
    codes.append(end)
    # the n-th code after a clear is written when the table holds end + n entries
    values = np.array(codes, np.uint16)
    since = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)]))
    size = np.minimum(_widths(bits)[np.minimum(since, 4095)], 12)
    # a clear code itself has the width reached before it
    for s in starts[1:]:
        size[s] = 12
    size[0] = bits + 1
    grid = ((values[:, None] >> np.arange(12, dtype=np.uint16)) & 1).astype(np.uint8)
    return np.packbits(grid[np.arange(12) < size[:, None]], bitorder="little").tobytes()


def _widths(bits: int, made: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """Width of the n-th code after a clear: before it is read, the decoder's table holds 2**bits + 2 + (n - 2) entries."""
    if bits not in made:
        entries = (1 << bits) + 2 + np.maximum(np.arange(5000) - 2, -1) + 1
        made[bits] = np.minimum(np.maximum(np.ceil(np.log2(entries)), bits + 1), 12).astype(np.int64)
    return made[bits]


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """At most so many bytes of a GIF LZW stream; stops at the end code, or where the stream does."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little").astype(np.uint16)
    total = len(raw)
    raw = np.concatenate([raw, np.zeros(16, np.uint16)])
    growing = _widths(bits)[1:]
    out: list[bytes] = []
    size, at, state = 0, 0, None
    while at < total and size < most:
        # all codes up to the next clear or end, at the widths they have if the table only grows
        widths = growing[: (total - at) // (bits + 1) + 1] if state is None else np.full(min(5000, (total - at) // 12 + 1), 12)
        where = at + np.cumsum(widths) - widths
        n = int(np.searchsorted(where + widths, total, side="right"))
        if n == 0:
            break
        grid = raw[where[:n, None] + _BITS]
        codes = (np.where(_BITS < widths[:n, None], grid, 0) * _POWERS).sum(1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stop[0]) if len(stop) else n
        grown, state = _expand(codes[:upto].tolist(), bits, out, state)
        size += grown
        if not len(stop):
            at = int(where[n - 1] + widths[n - 1])
            if n < len(widths):
                break
            continue
        if codes[upto] == end:
            break
        at, state = int(where[upto] + widths[upto]), None
    return b"".join(out)[:most]


_BITS = np.arange(12)
_POWERS = (1 << _BITS).astype(np.uint16)


def _expand(codes: list[int], bits: int, out: list[bytes], state: tuple[list[bytes], bytes] | None) -> tuple[int, tuple[list[bytes], bytes] | None]:
    """Append what the codes stand for; state is the table and the last entry of codes before, none after a clear."""
    if not codes:
        return 0, state
    before = len(out)
    if state is None:
        table = [*_SINGLES[bits], b"", b""]
        if codes[0] >= 1 << bits:
            raise GifError("a stream begins with a code that is not in the table")
        last = table[codes[0]]
        out.append(last)
        codes = codes[1:]
    else:
        table, last = state
    add, push, n = table.append, out.append, len(table)
    for code in codes:
        if code < n:
            entry = table[code]
            if n < 4096:
                add(last + entry[:1])
                n += 1
        elif code == n < 4096:
            entry = last + last[:1]
            add(entry)
            n += 1
        else:
            raise GifError(f"code {code} is not in the table")
        push(entry)
        last = entry
    return sum(map(len, out[before:])), (table, last)


def _blocks(data: bytes) -> bytes:
    parts = []
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        parts += [bytes((len(part),)), part]
    return b"".join([*parts, b"\0"])


def encode(image: Image) -> bytes:
    """A GIF89a file. Palettes have 2 to 256 RGB rows, rounded up to a power of two with black."""

    def table(p: np.ndarray) -> tuple[int, bytes]:
        size = max(1, (len(p) - 1).bit_length())
        return size, np.vstack([p, np.zeros(((1 << size) - len(p), 3), np.uint8)]).astype(np.uint8).tobytes()

    flags, shared = 0, b""
    if image.palette is not None:
        size, shared = table(image.palette)
        flags = 0x80 | 0x70 | (size - 1)
    out = [b"GIF89a", struct.pack("<HHBBB", image.width, image.height, flags, image.background, 0), shared]
    for f in image.frames:
        own = f.palette if f.palette is not None else image.palette
        if own is None:
            raise GifError("a frame has no palette")
        size, local = table(own)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0, 0))
        rows, columns = f.pixels.shape
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, columns, rows, (0x80 | (size - 1) if f.palette is not None else 0) | (0x40 if f.interlaced else 0)))
        pixels = f.pixels[_row_order(rows)] if f.interlaced else f.pixels
        bits = max(2, size)
        out += [local if f.palette is not None else b"", bytes((bits,)), _blocks(lzw_encode(pixels.astype(np.uint8).tobytes(), bits))]
    return b"".join([*out, b";"])


def _row_order(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(start, rows, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def parse(data: bytes) -> Image:
    """The frames of a GIF file as palette indices; missing pixels of a cut stream are 0."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF signature")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, image = 13, Image(width, height, None, background)

    def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise GifError("a palette is cut off")
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data):
                raise GifError("a block is cut off")
            n = data[at]
            if not n:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    if flags & 0x80:
        image.palette, at = palette(at, flags)
    control = (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1 : at + 2] == b"\xf9" and len(body) >= 4:
                f, delay, index = struct.unpack_from("<BHB", body)
                control = (f >> 2 & 7, delay, index if f & 1 else None)
            at = after
        elif data[at] == 0x2C:
            if at + 11 > len(data):
                raise GifError("a frame is cut off")
            left, top, columns, rows, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, own = at + 10, None
            if flags & 0x80:
                own, at = palette(at, flags)
            bits = data[at] if at < len(data) else 0
            if not 1 < bits < 9:
                raise GifError(f"code size {bits}")
            stream, at = blocks(at + 1)
            got = np.frombuffer(lzw_decode(stream, bits, rows * columns).ljust(rows * columns, b"\0"), np.uint8).reshape(rows, columns)
            if flags & 0x40:
                straight = np.empty_like(got)
                straight[_row_order(rows)] = got
                got = straight
            image.frames.append(Frame(got, left, top, control[1], control[0], control[2], own, bool(flags & 0x40)))
            control = (0, 0, None)
        else:
            raise GifError(f"unknown block {data[at]}")
    return image


def decode(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(start, delay, RGB canvas) of each frame, times in hundredths of a second.

    A frame is drawn over the canvas but for its transparent pixels and what lies outside; before the next one, disposal 2
    clears its area to the background (black: the background index is commonly ignored) and 3 restores the canvas.
    """
    image = parse(data)
    canvas = np.zeros((image.height, image.width, 3), np.uint8)
    out, start = [], 0
    for f in image.frames:
        colours = f.palette if f.palette is not None else image.palette
        if colours is None:
            raise GifError("a frame has no palette")
        full = np.zeros((256, 3), np.uint8)
        full[: len(colours)] = colours
        before = canvas
        canvas = canvas.copy()
        area = canvas[f.top : f.top + f.pixels.shape[0], f.left : f.left + f.pixels.shape[1]]
        pixels = f.pixels[: area.shape[0], : area.shape[1]]
        drawn = full[pixels]
        if f.transparent is None:
            area[:] = drawn
        else:
            shown = pixels != f.transparent
            area[shown] = drawn[shown]
        out.append((start, f.delay, canvas))
        start += f.delay
        if f.disposal == 2:
            canvas = canvas.copy()
            canvas[f.top : f.top + pixels.shape[0], f.left : f.left + pixels.shape[1]] = 0
        elif f.disposal == 3:
            canvas = before
    return out


def histogram(frames: list[tuple[int, int, np.ndarray]], bins: int = 8) -> np.ndarray:
    """Counts of pixels per (frame, channel, bin) of equal width."""
    step = 256 // bins
    return np.array([[np.bincount(rgb[..., c].ravel() // step, minlength=bins) for c in range(3)] for _, _, rgb in frames])


_GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


def store(payload: bytes, delay: int = 4) -> bytes:
    """The GIF that holds the payload (a positive multiple of 192 bytes): one byte is one grey pixel.

    All frames have the canvas's size but the last, which may be lower; none is transparent.
    """
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    height = min(len(samples), ROWS)
    frames = [Frame(samples[i : i + ROWS], delay=delay, disposal=1) for i in range(0, len(samples), ROWS)]
    return encode(Image(WIDTH, height, _GREY, 0, frames))


def read_back(media: bytes) -> tuple[bytes, list[tuple[int, int, np.ndarray]]]:
    """(payload, timed frames cut to their own rows) of a GIF made by store."""
    rows = [f.pixels.shape[0] for f in parse_headers(media)]
    frames = [(s, d, rgb[:n]) for (s, d, rgb), n in zip(decode(media), rows, strict=True)]
    return b"".join(rgb[..., 0].tobytes() for _, _, rgb in frames), frames


def parse_headers(media: bytes) -> list[Frame]:
    """Frames with empty pixels of the right shape: a walk over the blocks that decodes nothing."""
    _, _, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at, out = 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0), []
    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x2C:
            left, top, columns, rows, flags = struct.unpack_from("<HHHHB", media, at + 1)
            out.append(Frame(np.broadcast_to(np.uint8(0), (rows, columns)), left, top))
            at += 11 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0)
        else:
            at += 2
        while media[at]:
            at += 1 + media[at]
        at += 1
    return out


def padded(text: str) -> bytes:
    """UTF-8 with blanks up to a positive multiple of 192 bytes."""
    b = text.encode("utf-8", "surrogatepass")
    return b.ljust(max(1, -(-len(b) // WIDTH)) * WIDTH, b" ")


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary), frames array<struct<start, delay, rows, histogram>> for every row.

    Frames come from the stored bytes, read back; histogram counts the pixels of 8 grey ranges. Null and empty
    texts are stored as 192 blanks. Other columns are ignored; an empty table gives an empty result.
    """
    kind = "array<struct<start: int, delay: int, rows: int, histogram: array<int>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                sizes, media, frames = [], [], []
                for text in part.column(1).to_pylist():
                    payload = padded(text)
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    media.append(m := store(payload))
                    frames.append([{"start": s, "delay": d, "rows": len(rgb), "histogram": np.bincount(rgb[..., 0].ravel() >> 5, minlength=8).tolist()} for s, d, rgb in read_back(m)[1]])
                of = pa.list_(pa.struct([("start", pa.int32()), ("delay", pa.int32()), ("rows", pa.int32()), ("histogram", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(frames, of)], ["doc_id", "n_bytes", "media", "frames"])

    return id_text(docs).transform(mapped, run, f"doc_id long, n_bytes long, media binary, frames {kind}")


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row.

    Null and empty texts are stored as 192 blanks. Rows repeat as given, null ids stay null, other columns are ignored; an
    empty table gives an empty result. Payload columns come from the stored bytes, read back. feature: frames, duration and the grey histogram of all frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                media = store(padded(text))
                payload, frames = read_back(media)
                grey = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
                feature = f"frames={len(frames)};duration={sum(d for _, d, _ in frames)};grey={'/'.join(map(str, grey.tolist()))}"
                rows.append((len(text.encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return id_text(docs).transform(mapped, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


FRAMES = "array<struct<start: int, delay: int, width: int, height: int, red: array<int>, green: array<int>, blue: array<int>>>"


def decoded_frames(media: DataFrame, *, column: str = "media", bins: int = 8) -> DataFrame:
    """media with frames and error: timed frames of the GIF files in a binary column, each with its colour histogram.

    A frame is the canvas as shown, after palette, transparency and the disposal of the one before; start and delay
    count hundredths of a second; red, green, blue count its pixels in so many equal ranges of 0 to 255. Files that are
    no GIF, or broken, have no frames and an error; a stream that is cut short shows colour 0 where it ends; null stays
    null in both. Other columns stay, frames and error are replaced.
    """
    kept = [c for c in media.columns if c not in ("frames", "error")]
    source = media.select(*kept, media[column].cast("binary").alias("_media"))
    three = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("delay", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("red", three), ("green", three), ("blue", three)]))

    def read(data: bytes) -> tuple[list[dict] | None, str | None]:
        try:
            frames = decode(data)
        except (GifError, struct.error, IndexError, ValueError) as e:
            return None, str(e) or type(e).__name__
        counts = histogram(frames, bins) if frames else []
        return [
            {"start": s, "delay": d, "width": rgb.shape[1], "height": rgb.shape[0], **{c: h[i].tolist() for i, c in enumerate(("red", "green", "blue"))}}
            for (s, d, rgb), h in zip(frames, counts, strict=True)
        ], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few files at a time: canvases are as large as the file says
            for part in (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)):
                out = [(None, None) if data is None else read(data) for data in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([f for f, _ in out], kind), pa.array([e for _, e in out], pa.string())], [*kept, "frames", "error"])

    kinds = dict(source.dtypes)
    return source.transform(mapped, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"frames {FRAMES}", "error string"]))
