"""Length-prefixed frames: 4 big-endian bytes of length, then the body; 1 MiB at most."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.schema import MAX_FRAME_BYTES, Refusal


def encode_frame(body: bytes) -> bytes:
    if len(body) > MAX_FRAME_BYTES:
        raise Refusal("FrameTooLarge")
    return struct.pack(">I", len(body)) + body


def read_frame(stream: BinaryIO) -> bytes | None:
    """One frame, or None at the end; the length is checked before anything is allocated."""
    head = stream.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise Refusal("TruncatedFrame")
    (size,) = struct.unpack(">I", head)
    if size > MAX_FRAME_BYTES:
        raise Refusal("FrameTooLarge")
    body = stream.read(size)
    if len(body) < size:
        raise Refusal("TruncatedFrame")
    return body


def decode_frames(data: bytes) -> Iterator[bytes]:
    import io

    stream = io.BytesIO(data)
    while (body := read_frame(stream)) is not None:
        yield body


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``frame`` (from 0), ``body`` of all frames in files below a path that Spark can read."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bodies = list(decode_frames(content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(bodies), pa.string()), pa.array(range(len(bodies)), pa.int64()), pa.array(bodies, pa.binary())],
                    names=["path", "frame", "body"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, frame bigint, body binary")
