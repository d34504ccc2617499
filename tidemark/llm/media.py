"""Media columns: GIF files in binary columns, their timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gif
from .runtime import Scratch, texts, tune

FRAMES = "media_id long, frame int, starts_ms long, delay_ms long, disposal int, width int, height int, histogram array<long>"


def timed(data: bytes) -> list[tuple[dict, bytes]]:
    """Of each frame of a GIF, the columns of `frames` and its samples; none of what isn't a GIF."""
    try:
        found = gif.decode(data)
    except ValueError:
        return []
    starts = np.cumsum([0] + [10 * f.delay for f in found])
    return [
        (
            {"frame": i, "starts_ms": int(starts[i]), "delay_ms": 10 * f.delay, "disposal": f.disposal, "width": f.samples.shape[1], "height": f.samples.shape[0], "histogram": gif.histogram(f.shown).tolist()},
            f.samples.tobytes(),
        )
        for i, f in enumerate(found)
    ]


def frames(media: DataFrame) -> DataFrame:
    """A row for each frame of each GIF of ``media`` (media_id, media): its time, disposal, size and colour histogram.

    The histogram counts the visible pixels of the composed canvas by 4 * 4 * 4 colours.  Null, empty and broken media
    have no frames (those before a break count); repeated rows repeat their frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media_id, data in zip(batch.column("media_id").to_pylist(), batch.column("media"), strict=True):
                rows = [{"media_id": media_id} | row for row, _ in timed(data.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_frames_schema)

    tune(media.sparkSession)
    return media.select("media_id", "media").mapInArrow(run, FRAMES)


_frames_schema = pa.schema(
    [("media_id", pa.int64()), ("frame", pa.int32()), ("starts_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]
)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            yield pa.record_batch([pa.array([doc_id], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([gif.encode(payload)], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each text of ``docs``: its UTF-8 bytes and zeros up to a positive multiple of 64 as the
    samples of a grey-scale GIF, 64 to a row.  A null text is empty; a long one takes several frames."""
    tune(docs.sparkSession)
    return texts(docs).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            data = media.as_py()
            found = timed(data)
            payload = b"".join(samples for _, samples in found)
            # the colours that any frame shows, with their pixels in all frames
            shown = np.sum([row["histogram"] for row, _ in found], axis=0)
            colours = ",".join(f"{i}:{shown[i]}" for i in np.flatnonzero(shown).tolist())
            feature = f"frames={len(found)};ms={sum(row['delay_ms'] for row, _ in found)};starts=" + ",".join(str(row["starts_ms"]) for row, _ in found) + f";colours={colours}"
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, _read_schema, strict=True)], schema=_read_schema)


_read_schema = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def read(media: DataFrame) -> DataFrame:
    """What stored GIFs hold: the payload's length, hash and tail, the file's length and hash, and the features of its frames
    as shown (see `frames`): their number, times and summed colour histogram."""
    tune(media.sparkSession)
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    """`read` of `store`, by way of a written table: the stored bytes are read back from the shared folder.

    Repeated rows give equal rows, an empty table an empty one; columns other than doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "media")
    return read(scratch.write(store(docs), "gif"))
