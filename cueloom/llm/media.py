"""Media columns: AVI motion JPEG files in binary columns, and their shots as timed clips."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm import jpeg
from cueloom.llm.tokens import slices
from cueloom.storage import table

RATE = 25
BINS = 16
#: A cut: a histogram difference above CUT, and DEVIATIONS above the mean of the AROUND frames on each side.
CUT, DEVIATIONS, AROUND = 0.1, 3.0, 8


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes, rate: int = RATE) -> bytes:
    """An AVI file of motion JPEG frames that hold the payload; its length is in an INFO chunk."""
    frames = jpeg.write_frames(np.frombuffer(payload, np.uint8))
    side, most = jpeg.SIDE, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, rate, 0, len(frames), most, -1, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    stored = [_chunk(b"00dc", f) for f in frames]
    starts = np.cumsum([4, *map(len, stored)])[:-1].tolist()
    index = b"".join(b"00dc" + struct.pack("<III", 0x10, a, len(f)) for a, f in zip(starts, frames, strict=True))
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(stored)) + _chunk(b"idx1", index))


class Avi(NamedTuple):
    frames: list[bytes]
    rate: float
    payload: int | None  # its length, where the file says it


def read_avi(data: bytes) -> Avi:
    """Frames of the first video stream, by the index or, where there is none, in the order of the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, payload, movi, index = float(RATE), None, (0, 0), b""
    waiting = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while waiting:
        at, end = waiting.pop()
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = at + 8, at + 8 + n
                else:
                    waiting.append((at + 12, at + 8 + n))
            elif name == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", data, at + 28)
                rate = per / scale if scale else rate
            elif name == b"ICMT" and data[at + 8 : at + 16] == b"payload=":
                payload = int(data[at + 16 : at + 8 + n].rstrip(b"\0"))
            elif name == b"idx1":
                index = data[at + 8 : at + 8 + n]
            at += 8 + n + n % 2
    frames = []
    if index:
        entries = list(struct.iter_unpack("<4sIII", index))
        base = movi[0] if entries and data[movi[0] + entries[0][2] :][:4] == entries[0][0] else 0  # some files count from the start
        frames = [data[base + a + 8 : base + a + 8 + n] for name, _, a, n in entries if name[2:] in (b"dc", b"db")]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, n = struct.unpack_from("<4sI", data, at)
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    return Avi(frames, rate, payload)


def histograms(samples: np.ndarray) -> np.ndarray:
    """Shares of BINS brightness bins of frames [frame, sample]."""
    places = (samples // (256 // BINS)).astype(np.int32) + np.arange(len(samples), dtype=np.int32)[:, None] * BINS
    return np.bincount(places.reshape(-1), minlength=len(samples) * BINS).reshape(-1, BINS) / samples.shape[1]


def cuts(shares: np.ndarray) -> list[int]:
    """Frames at which a shot begins.

    The difference of neighbouring histograms must exceed CUT and stand out from its surroundings.
    """
    step = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    found = [0] if len(shares) else []
    for k in np.flatnonzero(step > CUT).tolist():
        near = np.concatenate([step[max(0, k - AROUND) : k], step[k + 1 : k + 1 + AROUND]])
        if not len(near) or step[k] > near.mean() + DEVIATIONS * near.std():
            found.append(k + 1)
    return found


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, media: the text's UTF-8 bytes, with 0 up to a positive multiple of 64, as an AVI file.

    A null text is empty; keys may be null or repeat: each row has its file; equal texts give equal
    files; other columns are ignored; an empty table gives no rows. A very long text is written and
    read in runs of frames.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                raw = [(t or "").encode() for t in texts.to_pylist()]
                files = [write_avi(b + bytes(-len(b) % 64 if b else 64)) for b in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(raw)], pa.array(list(map(len, raw)), pa.int64()), pa.array(files, pa.binary())], schema.names)
                at += len(raw)

    return docs.select(key, text).mapInArrow(run, schema)


CLIP = "array<struct<clip:int,start_s:double,end_s:double,first_frame:int,frames:int,brightness:double>>"


def look(data: bytes) -> tuple[bytes | None, list[dict]]:
    """The payload, where the file holds one, and the clips of a stored file."""
    avi = read_avi(data)
    payload, shares = None, []
    if avi.payload is not None and avi.frames:
        parts = []
        for i in range(0, len(avi.frames), jpeg.RUN):
            frames = avi.frames[i : i + jpeg.RUN]
            if (blocks := jpeg.read_frames(frames)) is None:
                break
            parts.append(blocks.tobytes())
            shares.append(histograms(jpeg.pixels(jpeg.coefficients(blocks)).reshape(len(frames), -1)))
        else:
            payload = b"".join(parts)[: avi.payload]
    if payload is None:
        shares = [histograms(jpeg.decode(f).reshape(1, -1)) for f in avi.frames]
    shares = np.concatenate([np.zeros((0, BINS)), *shares])
    starts = cuts(shares)
    level = shares @ ((np.arange(BINS) + 0.5) * (256 / BINS))
    return payload, [
        {"clip": i, "start_s": a / avi.rate, "end_s": b / avi.rate, "first_frame": a, "frames": b - a, "brightness": round(float(level[a:b].mean()), 3)}
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(shares)], strict=True))
    ]


def read_media(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Per row: the columns of ``stored`` without the file, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, clips.

    Files of other makers are decoded frame by frame and have null payload columns; a null file
    has no clips and null digests.
    """
    rest = [f for f in stored.schema if f.name != media]
    made = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType())]
    schema = T.StructType([*rest, *[T.StructField(n, t) for n, t in made], T.StructField("clips", T._parse_datatype_string(CLIP))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(schema)][len(rest) :]
        for batch in batches:
            rows = []
            for x in batch.column(len(rest)):
                data = x.as_py()
                payload, clips = look(data) if data is not None else (None, [])
                known = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) if payload is not None else (None, None, None)
                rows.append((*known, len(data) if data is not None else None, hashlib.sha256(data).hexdigest() if data is not None else None, clips))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema.names)

    return stored.select(*[f.name for f in rest], media).mapInArrow(run, schema)


def clip_rows(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per shot: key, clip, start_s, end_s, first_frame, frames, brightness."""
    return read_media(stored.select(key, media), key, media).select(key, F.inline("clips"))


def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(encode_media(table(spark, sf_dir, "documents")))
    shots = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"], c["frames"], c["brightness"])), ",")
    feature = F.concat(F.lit("shots="), F.size("clips"), F.lit(";"), shots).alias("feature")
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)


QUERIES = {"op5_avi_media": op5_avi_media}
ORACLES: dict[str, str] = {}
