"""Media columns: MPEG audio in a binary column, what its streams hold, and bytes stored in such streams.

Both directions work on Arrow batches, one value after the other, in runs of bounded size; a value is held whole, as its
column has it.

Defined results: a null or empty text is an empty payload, which is filled up to 64 bytes like any other. Null or empty media
have no frames, no duration and no seek points; so has anything else without two agreeing frames in a row. Rows keep their
order and number, repeated rows give the same values, and an empty table gives none. Columns beside those named are dropped.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mpeg
from .common import materialize, release, to_bytes

#: Payloads are filled up to a multiple of so many bytes.
UNIT = 64
#: Bytes of a batch that is handed back.
_RUN = 4_000_000

PROBED = (
    "version int, layer int, sample_rate int, channels int, n_frames long, n_samples long, duration string, seconds double, seek array<long>, right long, wrong long, skipped long, resyncs long, tags map<string,string>, table string, table_frames long"
)


def padded(text: object) -> tuple[int, bytes]:
    data = to_bytes(text)
    return len(data), data + bytes(-len(data) % UNIT if data else UNIT)


def _runs(values, size):
    """Numbers of consecutive values that are of about _RUN bytes together."""
    run, held = [], 0
    for i, v in enumerate(values):
        run.append(i)
        held += size(v)
        if held >= _RUN:
            yield run
            run, held = [], 0
    if run:
        yield run


def store(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as UTF-8, filled up and carried by an MPEG stream, in a written table."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in _runs(texts, lambda v: len(v.as_buffer()) if v.is_valid else 0):
                pairs = [padded(texts[i].as_py()) for i in part]
                media = [mpeg.write(p) for _, p in pairs]
                yield pa.RecordBatch.from_arrays([ids.slice(part[0], len(part)), pa.array([n for n, _ in pairs], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
        release()

    kind = rows.schema[id_col].dataType.simpleString()
    return materialize(rows.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary"), "media")


def probe(rows: DataFrame, column: str = "media") -> DataFrame:
    """The rows with a struct `probed` of their streams' formats, exact durations, frames' places, checksums, tags and tables."""
    schema = pa.struct([(n, _ARROW[t]) for n, t in (x.strip().split(" ", 1) for x in PROBED.split(", "))])

    def told(data):
        s = mpeg.scan(data or b"")
        h, t = s.first, s.table or {}
        return {
            "version": h and h.version, "layer": h and h.layer, "sample_rate": h and h.rate, "channels": h and h.channels, "n_frames": len(s.offsets), "n_samples": s.samples, "duration": str(s.duration), "seconds": float(s.duration), "seek": s.offsets.tolist(),
            "right": s.right, "wrong": s.wrong, "skipped": s.skipped, "resyncs": s.resyncs, "tags": list(s.tags.items()), "table": t.get("kind"), "table_frames": t.get("frames"),
        }

    def run(batches):
        for batch in batches:
            media = batch.column(0)
            for part in _runs(media, lambda v: len(v.as_buffer()) if v.is_valid else 0):
                yield pa.RecordBatch.from_arrays([*(c.slice(part[0], len(part)) for c in batch.columns[1:]), pa.array([told(media[i].as_py()) for i in part], schema)], [*batch.schema.names[1:], "probed"])
        release()

    kept = [c for c in rows.columns if c != "probed"]
    names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(F.col(column).alias("_media"), *kept).mapInArrow(run, f"{names}, probed struct<{PROBED.replace(' ', ':').replace(',:', ',')}>")


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def read_back(stored: DataFrame) -> DataFrame:
    """From a stored table, what its media carry: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def told(n, data):
        s = mpeg.scan(data)
        p = mpeg.carried(data, s)
        return n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), mpeg.describe(s)

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), [told(n.as_py(), m.as_py()) for n, m in zip(batch.column(1), batch.column(2))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        release()

    kind = stored.schema["id"].dataType.simpleString()
    return stored.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
