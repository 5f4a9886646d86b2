"""Media columns: GIF (operator 8).

``store_as_gif`` keeps a binary payload as the samples of an animated GIF;
``read_frames`` decodes any GIF column into timed frames with colour
histograms and the samples of all frames.  Both are narrow.

A payload is the text's UTF-8 bytes and spaces up to a positive multiple of
``ROW``.  A row of samples is ``ROW`` wide, a frame holds up to ``ROWS`` rows,
the palette maps sample k to grey level k, so the samples can be read back
from the drawn canvas.

Defined cases: a null or empty text is one row of spaces; repeated rows give
equal values; a null id is kept; a GIF that is null, damaged anywhere, cut
short or larger than ``gif.PIXELS`` has no frames and a null payload; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import gif
from .common import arrow_batches, by_size, emit, id_and_text

ROW, ROWS, DELAY_MS = 192, 256, 100
#: Grey level k for sample k.
GREY = bytes(v for k in range(256) for v in (k, k, k))
#: Each channel in 4 steps.
BINS = 64

_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FRAME = pa.struct([("number", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64()))])
_READ = pa.schema([*_STORED, ("payload", pa.binary()), ("frames", pa.list_(_FRAME))])
FRAMES = "array<struct<number:int,delay_ms:int,width:int,height:int,disposal:int,histogram:array<bigint>>>"


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")


def to_gif(payload: bytes) -> bytes:
    size = ROW * ROWS
    return gif.write_gif([(ROW, len(part) // ROW, part) for part in (payload[k : k + size] for k in range(0, len(payload), size))], GREY, DELAY_MS)


def histogram(canvas: np.ndarray) -> list[int]:
    """Pixels that are drawn, by two leading bits of red, green and blue."""
    rgb = canvas[canvas[:, :, 3] > 0][:, :3] >> 6
    return np.bincount(rgb[:, 0].astype(np.int64) << 4 | rgb[:, 1].astype(np.int64) << 2 | rgb[:, 2], minlength=BINS).tolist()


def from_gif(data: bytes | None) -> tuple[bytes | None, list[dict]]:
    """The drawn grey samples of every frame's rectangle, and the frames' columns."""
    try:
        parts, rows = [], []
        for k, f in enumerate(gif.read_gif(data or b"")):
            area = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
            parts.append(area[:, :, 0].tobytes())
            rows.append({"number": k, "delay_ms": f.delay_ms, "width": f.width, "height": f.height, "disposal": f.disposal, "histogram": histogram(area)})
        return b"".join(parts), rows
    except (ValueError, IndexError):
        return None, []


def store_as_gif(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, media (the GIF)."""

    def run(batches):
        for t in by_size(batches, limit=1_000_000):
            stored = [payload_of(x) for x in t["text"].to_pylist()]
            yield from emit({"doc_id": t["doc_id"], "n_bytes": [n for n, _ in stored], "media": [to_gif(p) for _, p in stored]}, _STORED)

    arrow_batches(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_frames(media: DataFrame) -> DataFrame:
    """``store_as_gif``'s rows with payload (samples read back) and frames."""

    def run(batches):
        for t in by_size(batches, "media", 1_000_000):
            read = [from_gif(x) for x in t["media"].to_pylist()]
            yield from emit({**{n: t[n] for n in _STORED.names}, "payload": [p for p, _ in read], "frames": [f for _, f in read]}, _READ)

    arrow_batches(media.sparkSession)
    return media.select(*_STORED.names).mapInArrow(run, f"doc_id long, n_bytes long, media binary, payload binary, frames {FRAMES}")
