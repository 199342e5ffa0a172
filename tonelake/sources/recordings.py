"""Recordings as rows of sample blocks.

Files are listed and read by Spark, so any store that Spark reads will do; the
decoder turns one file's bytes into blocks and keeps only one file in memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples in a block: the blocks in which clipping is judged.
BLOCK = 2048
#: Largest recording, in frames.
MOST_FRAMES = 16_000_000
#: Most channels of a recording that long; a row of Spark holds no more than 2 GB.
MOST_CHANNELS = 33
#: Largest file: that many samples of 32 bits, and room for other chunks.
LARGEST = MOST_FRAMES * MOST_CHANNELS * 4 + (1 << 20)

SCHEMA = "path string, rate int, channels int, frames long, block int, channel int, samples array<float>, error string"


def _chunks(data: bytes | memoryview) -> dict[bytes, bytes | memoryview]:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, found = 12, {}
    while at + 8 <= len(data):
        name, size = bytes(data[at : at + 4]), struct.unpack("<I", data[at + 4 : at + 8])[0]
        if at + 8 + size > len(data):
            raise ValueError(f"a chunk of {size} bytes that the file cuts short")
        found.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def decode(data: bytes | memoryview, rate_hz: int | None = None, channel_count: int | None = None, frame_count: int | None = None) -> tuple[int, np.ndarray]:
    """Rate and samples (frames, channels) of PCM 16, 24, 32 or float 32; full scale is 1.

    Where a rate, a number of channels or of frames is given, the recording must
    have it. A chunk or frame that is cut short is an error, never less samples.
    """
    parts = _chunks(data)
    if len(parts.get(b"fmt ", b"")) < 16 or b"data" not in parts:
        raise ValueError("no format or no data")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", parts[b"fmt "][:16])
    if kind == 0xFFFE and len(parts[b"fmt "]) >= 26:  # the kind proper stands in the extension
        kind = struct.unpack("<H", parts[b"fmt "][24:26])[0]
    raw = parts[b"data"]
    if not channels:
        raise ValueError("no channels")
    if (kind, bits) not in ((3, 32), (1, 16), (1, 24), (1, 32)):
        raise ValueError(f"format {kind} of {bits} bits")
    if len(raw) % (channels * bits // 8):
        raise ValueError("a frame that is cut short")
    if (kind, bits) == (3, 32):
        x = np.frombuffer(raw, "<f4")
    elif (kind, bits) == (1, 16):
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif (kind, bits) == (1, 32):
        x = (np.frombuffer(raw, "<i4") / 2147483648).astype(np.float32)
    else:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24).astype(np.int32) / 2147483648).astype(np.float32)
    for name, want, have in (("rate", rate_hz, rate), ("channels", channel_count, channels), ("frames", frame_count, len(x) // channels)):
        if want is not None and want != have:
            raise ValueError(f"{name} {have}, not {want}")
    if not 1 <= len(x) // channels <= MOST_FRAMES:
        raise ValueError("no frames, or too many")
    if not np.isfinite(x).all():
        raise ValueError("samples that are not finite")
    return rate, x.reshape(-1, channels)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """Samples (frames, channels) as 32-bit float RIFF WAVE."""
    body = np.ascontiguousarray(samples, "<f4").tobytes()
    n = samples.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 3, n, rate, rate * n * 4, n * 4, 32, b"data", len(body))
    return head + body


def _decoded(batches: Iterator[pa.RecordBatch], **expected: int | None) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("block", pa.int32()), ("channel", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                rate, x = decode(memoryview(data.as_buffer()), **expected)  # not copied
            except ValueError as e:
                yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], kind)
                continue
            rows = [
                {"path": path, "rate": rate, "channels": x.shape[1], "frames": len(x), "block": k, "channel": c, "samples": x[k * BLOCK : (k + 1) * BLOCK, c]}
                for k in range(-(-len(x) // BLOCK)) for c in range(x.shape[1])
            ]
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_pylist(rows[at : at + 512], kind)


def recordings(spark: SparkSession, path: str, glob: str = "*.wav", largest: int = LARGEST, rate: int | None = None, channels: int | None = None, frames: int | None = None) -> DataFrame:
    """A row for each block and channel of every recording; what cannot be read, or is not as expected, is a row with an error.

    A task holds one file several times over, so ``largest`` is to fit its memory; the content of larger files is not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    read = files.where(F.col("length") <= largest).select("path", "content").mapInArrow(partial(_decoded, rate_hz=rate, channel_count=channels, frame_count=frames), SCHEMA)
    over = files.where(F.col("length") > largest).select("path", F.concat(F.lit("larger than "), F.lit(largest), F.lit(" bytes")).alias("error"))
    return read.unionByName(over, allowMissingColumns=True)


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
