"""GIF: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``decode`` reads any GIF87a/89a: it follows the code stream, applies the frame's palette, interlacing,
transparency and disposal, and gives the canvas after each frame with its delay. ``encode`` writes
frames of palette indices. ``frames`` does this for a binary column, a row for each frame.

Defined results: a null or empty column gives no frames; a broken stream gives one row with ``error``
set and no frames after the break, and never fails the job; repeated rows give repeated frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_CODE = 4096
BINS = 16
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


@dataclass
class Frame:
    """The canvas as it is shown: RGBA samples, palette indices of the frame itself, and for how long."""

    delay_ms: int
    rgba: np.ndarray
    indices: np.ndarray
    disposal: int
    transparent: int | None


@lru_cache
def _template(least: int) -> np.ndarray:
    size = np.minimum((1 << least) + 2 + np.arange(2 * MAX_CODE), MAX_CODE)
    return np.maximum(np.ceil(np.log2(size)).astype(np.int64), least + 1)


def _widths(least: int, count: int, seen: int = 0) -> np.ndarray:
    """Bits of each code after ``seen`` others since a clear code: the table grows by one for each code but the first."""
    known = _template(least)[seen : seen + count]
    return known if len(known) == count else np.concatenate([known, np.full(count - len(known), 12)])


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as bits, the lowest first."""
    ends = np.cumsum(widths)
    begin = ends - widths
    spread = codes << (begin & 7)
    out = np.zeros((int(ends[-1]) + 7) // 8 + 3, np.int64)
    for k in range(3):
        out += np.bincount((begin >> 3) + k, (spread >> 8 * k) & 255, len(out)).astype(np.int64)
    return out[: (int(ends[-1]) + 7) // 8].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """The code stream of ``data``; the table is cleared when it is full."""
    clear, end = 1 << least, (1 << least) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    full, fresh = MAX_CODE - 1, end + 1
    rest = iter(data)
    prefix = next(rest, -1)
    known, emit = table.get, codes.append
    for byte in rest:
        key = prefix << 8 | byte
        if (code := known(key)) is not None:
            prefix = code
            continue
        emit(prefix)
        if fresh < full:
            table[key] = fresh
            fresh += 1
        else:
            runs.append([*codes, clear])
            codes, table, fresh = [], {}, end + 1
            known, emit = table.get, codes.append
        prefix = byte
    runs.append([*codes, *([prefix] if prefix >= 0 else []), end])
    all_codes = np.array([clear, *(c for run in runs for c in run)], np.int64)
    widths = np.concatenate([[least + 1], *(_widths(least, len(run)) for run in runs)])
    return _pack(all_codes, widths)


def lzw_decode(stream: bytes, least: int, wanted: int) -> bytes:
    """The indices that a code stream stands for, ``wanted`` of them at most."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + bytes(3), np.uint8).astype(np.int64)
    have = len(stream) * 8
    basic = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size = at = 0
    block = MAX_CODE
    while size < wanted and at < have:
        table, before, seen = list(basic), b"", 0
        done = cleared = False
        while not (done or cleared) and at < have and size < wanted:
            widths = _widths(least, min(block, (have - at) // (least + 1) + 1), seen)
            ends = at + np.cumsum(widths)
            fit = int(np.searchsorted(ends, have, "right"))
            if not fit:
                at = have
                break
            begin = (ends - widths)[:fit]
            byte = begin >> 3
            found = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7) & (1 << widths[:fit]) - 1
            stops = np.flatnonzero((found == clear) | (found == end))
            use = int(stops[0]) if len(stops) else fit
            fresh = len(out)
            codes = found[:use].tolist()
            growing = MAX_CODE - len(table) + (not before)  # codes that may add an entry; the first of a table adds none
            emit, learn = out.append, table.append
            for code in codes[:growing]:
                try:
                    entry = table[code]
                except IndexError:
                    if code > len(table) or not before:
                        raise ValueError(f"code {code} beyond a table of {len(table)}") from None
                    entry = before + before[:1]
                emit(entry)
                if before:
                    learn(before + entry[:1])
                before = entry
            for code in codes[growing:]:
                before = table[code]
                emit(before)
            size += sum(map(len, out[fresh:]))
            seen += use
            if len(stops):
                at = int(ends[use])
                done, cleared = found[use] == end, found[use] == clear
            else:
                at = int(ends[fit - 1])
        if done:
            break
    return b"".join(out)[:wanted]


def _sub_blocks(raw: bytes) -> bytes:
    n = len(raw) // 255
    whole = np.frombuffer(raw, np.uint8, n * 255).reshape(n, 255)
    head = np.concatenate([np.full((n, 1), 255, np.uint8), whole], axis=1).tobytes()
    rest = raw[n * 255 :]
    return head + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(frames: list[tuple[np.ndarray, int]], palette: np.ndarray = GREYS, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A GIF89a of (indices of shape (height, width), delay in ms) frames over one palette of 256 colours."""
    height = max(f.shape[0] for f, _ in frames)
    width = max(f.shape[1] for f, _ in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for indices, delay in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, delay // 10, transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, indices.shape[1], indices.shape[0], 0))
        out.append(b"\x08" + _sub_blocks(lzw_encode(indices.astype(np.uint8).tobytes())))
    return b"".join([*out, b"\x3b"])


def _read_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := raw[at]) != 0:
        parts.append(raw[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _interlaced(rows: np.ndarray) -> np.ndarray:
    """Rows stored in four passes, put where they belong."""
    height = len(rows)
    order = np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode(raw: bytes, canvas: bool = True) -> Iterator[Frame]:
    """The frames of a GIF. Without ``canvas`` only their indices are given, no composed samples."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(raw, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    shown = np.zeros((height, width, 4), np.uint8) if canvas else np.zeros((0, 0, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            kind = raw[at + 1]
            body, at = _read_blocks(raw, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear_index = hundredths * 10, packed >> 2 & 7, index if packed & 1 else None
            continue
        if raw[at] != 0x2C:
            raise ValueError(f"block {raw[at]:#x}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", raw, at + 1)
        at, palette = at + 10, common
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette = np.frombuffer(raw, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        least = raw[at]
        stream, at = _read_blocks(raw, at + 1)
        flat = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
        if len(flat) < w * h:
            raise ValueError(f"{len(flat)} of {w * h} samples")
        indices = flat.reshape(h, w)
        if packed & 0x40:
            indices = _interlaced(indices)
        if canvas:
            if palette is None:
                raise ValueError("no palette")
            kept = shown.copy() if disposal == 3 else None
            part = shown.view(np.uint32)[top : top + h, left : left + w, 0]
            inside = indices[: part.shape[0], : part.shape[1]]
            colours = np.zeros((256, 4), np.uint8)
            colours[:, :3], colours[:, 3] = palette[np.minimum(np.arange(256), len(palette) - 1)], 255
            drawn = np.take(colours.view(np.uint32)[:, 0], inside)
            np.copyto(part, drawn, where=True if clear_index is None else inside != clear_index)
        yield Frame(delay, shown.copy(), indices, disposal, clear_index)
        if canvas and disposal == 2:
            shown[top : top + h, left : left + w] = 0
        elif canvas and disposal == 3:
            shown = kept
        delay, disposal, clear_index = 0, 0, None


def histogram(samples: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of 8-bit samples in equal ranges."""
    return np.bincount(samples.ravel() >> (8 - bins.bit_length() + 1), minlength=bins)


def frames(media: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A row for each frame: ``keys``, frame number, delay, start time, size, RGBA samples, histograms by channel."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keys).schema)
    schema = f"{fields}, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"
    names = ["frame", "start_ms", "delay_ms", "width", "height", "rgba", "red", "green", "blue", "error"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(keys).to_pylist()
            for key, raw in zip(own, batch.column(column), strict=True):
                if not (data := raw.as_py()):
                    continue
                rows, start = [], 0
                try:
                    for n, f in enumerate(decode(data)):
                        visible = f.rgba[f.rgba[..., 3] > 0]
                        shades = [histogram(visible[:, c]).tolist() for c in range(3)]
                        rows.append((n, start, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), *shades, None))
                        start += f.delay_ms
                except (ValueError, IndexError, struct.error) as broken:
                    rows.append((len(rows), start, 0, 0, 0, None, None, None, None, str(broken)))
                if rows:
                    yield from pa.Table.from_pylist([key | dict(zip(names, r, strict=True)) for r in rows], schema=arrow).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return media.select(*keys, column).mapInArrow(read, schema)
