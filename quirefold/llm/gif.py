"""GIF reading and writing: LZW streams, palettes, disposal, transparency, frames.

Written from the public GIF89a specification.  Codes are packed and unpacked
with NumPy; only the string table itself is walked code by code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_ONE = [bytes([i]) for i in range(256)]
_FULL = 4096


def _widths(bits: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: the reader's table has one entry less than codes read."""
    first = 1 << bits
    free = np.arange(n) + first + 1
    return np.clip(np.ceil(np.log2(free + 1)).astype(np.int64), bits + 1, 12)


def _pattern(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _patterns:
        w = _widths(bits, _FULL)
        _patterns[bits] = w, np.concatenate([[0], np.cumsum(w)])
    return _patterns[bits]


_patterns: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lzw_compress(data: bytes, bits: int = 8) -> bytes:
    """An LZW stream of samples below 2**bits, with a clear code whenever the table is full."""
    clear = 1 << bits
    segments: list[list[int]] = []
    codes: list[int] = []
    push = codes.append
    table: dict[int, int] = {}
    get = table.get
    free = clear + 2
    stream = iter(data)
    w = next(stream, None)
    if w is not None:
        for b in stream:
            k = w << 8 | b
            c = get(k)
            if c is not None:
                w = c
                continue
            push(w)
            if free < _FULL:
                table[k] = free
                free += 1
            else:
                push(clear)
                segments.append(codes)
                codes = []
                push = codes.append
                table.clear()
                free = clear + 2
            w = b
        push(w)
    push(clear + 1)
    segments.append(codes)
    pattern = _pattern(bits)[0]
    values = np.concatenate([[clear], *segments]).astype(np.uint64)
    widths = np.concatenate([[bits + 1], *(pattern[: len(s)] for s in segments)])
    at = np.cumsum(widths) - widths
    out = np.zeros((int(at[-1] + widths[-1]) + 7) // 8 + 3, np.uint8)
    spread = values << (at & 7).astype(np.uint64)
    for k in range(3):
        part = ((spread >> np.uint64(8 * k)) & np.uint64(255)).astype(np.float64)
        # No two codes share a bit, so adding is joining.
        out += np.bincount((at >> 3) + k, weights=part, minlength=len(out)).astype(np.uint8)
    return out[:-3].tobytes()


def lzw_expand(data: bytes, bits: int, limit: int) -> bytes:
    """The first ``limit`` samples of an LZW stream; ValueError where it is damaged or ends before."""
    if not 2 <= bits <= 8:
        raise ValueError("code size")
    clear = 1 << bits
    pattern, offsets = _pattern(bits)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = 8 * len(data)
    out: list[bytes] = []
    size, at, read = 0, 0, 0  # read: codes since the last clear
    table: list[bytes] = []
    before = b""
    while size < limit:
        if read + 512 < _FULL:
            own, rel = pattern[read:], offsets[read:-1] - offsets[read]
        else:
            own = np.full(_FULL, 12)
            rel = np.arange(_FULL) * 12
        n = int(np.searchsorted(rel + own, total - at, side="right"))
        if not n:
            raise ValueError("the stream ends early")
        own, pos = own[:n], at + rel[:n]
        i = pos >> 3
        codes = ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (pos & 7)) & ((1 << own) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stop[0]) if len(stop) else n
        part = codes[:n].tolist()
        fresh = not table
        if fresh and part:
            table = [*_ONE[:clear], b"", b""]
            if part[0] >= clear:
                raise ValueError("the first code is no sample")
            before = table[part[0]]
            out.append(before)
            size += len(before)
            part = part[1:]
        add, put = table.append, out.append
        grow = max(0, _FULL - len(table)) if table else 0
        for c in part[:grow]:
            try:
                e = table[c]
            except IndexError:
                if c > len(table):
                    raise ValueError("a code beyond the table") from None
                e = before + before[:1]
            add(before + e[:1])
            put(e)
            size += len(e)
            before = e
        for c in part[grow:]:
            e = table[c]
            put(e)
            size += len(e)
        if len(stop):
            if codes[n] != clear:
                break
            at = int(pos[n] + own[n])
            table, read = [], 0
        else:
            at = int(pos[-1] + own[-1])
            read += n
    if size < limit:
        raise ValueError("samples are missing")
    return b"".join(out)[:limit]


@dataclass
class Frame:
    """One frame: its rectangle, its time, and the canvas once it is drawn."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: bytes  # palette indices of the rectangle, rows in display order
    canvas: np.ndarray  # RGBA, uint8


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:  # IndexError where the data end first
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _in_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def _rows_in_order(height: int, interlaced: bool) -> np.ndarray:
    """The display row of each stored row."""
    rows = np.arange(height)
    return np.concatenate([rows[0::8], rows[4::8], rows[2::4], rows[1::2]]) if interlaced else rows


def write_gif(frames: list[tuple[int, int, bytes]], palette: bytes, delay_ms: int = 100) -> bytes:
    """An animation of (width, height, samples), drawn from the top left; the palette has 256 colours."""
    width, height = max(f[0] for f in frames), max(f[1] for f in frames)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\x00\x00", palette]
    for w, h, samples in frames:
        out += [b"\x21\xf9\x04\x04", (delay_ms // 10).to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", w.to_bytes(2, "little"), h.to_bytes(2, "little"), b"\0\x08", _in_blocks(lzw_compress(samples))]
    return b"".join([*out, b"\x3b"])


#: Pixels of the largest canvas or frame that is drawn.
PIXELS = 1 << 26


def read_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order, composed by the rules of disposal and transparency.

    ValueError or IndexError where the data are damaged, cut short, or ask for
    more than ``PIXELS``; frames before that place have been given.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    u16 = lambda k: data[k] | data[k + 1] << 8
    width, height, flags = u16(6), u16(8), data[10]
    at, common = 13, None
    if flags & 0x80:
        n = 3 << (1 + (flags & 7))
        common, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    if width * height > PIXELS:
        raise ValueError("canvas too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, (body[1] | body[2] << 8) * 10
                clear = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h, local = u16(at + 1), u16(at + 3), u16(at + 5), u16(at + 7), data[at + 9]
            at += 10
            palette = common
            if local & 0x80:
                n = 3 << (1 + (local & 7))
                palette, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
            bits = data[at]
            body, at = _blocks(data, at + 1)
            if w * h > PIXELS:
                raise ValueError("frame too large")
            index = np.frombuffer(lzw_expand(body, bits, w * h), np.uint8).reshape(h, w)
            if local & 0x40:
                shown = np.empty_like(index)
                shown[_rows_in_order(h, True)] = index
                index = shown
            table = np.zeros((256, 3), np.uint8)
            if palette is not None:
                table[: len(palette)] = palette
            saved = canvas.copy() if disposal == 3 else None
            inside = index[: max(0, height - top), : max(0, width - left)]
            area = canvas[top : top + h, left : left + w]
            drawn = np.ones(inside.shape, bool) if clear is None else inside != clear
            area[drawn, :3] = table[inside[drawn]]
            area[drawn, 3] = 255
            yield Frame(left, top, w, h, delay, disposal, clear, index.tobytes(), canvas.copy())
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = saved
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("unknown block")
