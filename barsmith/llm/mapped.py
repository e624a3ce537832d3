"""Read-only arrays that tasks make and every worker maps from a file.

A blob holds named arrays. Spark writes blobs to the shared folder, one line of raw bytes each, and hands the files to
the executors; workers map them, so all workers of an executor share one copy and only pages in use take memory. Nothing
but the names of the files passes through the driver's Python process.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays behind a table of contents, each at a multiple of 8 bytes."""
    at, table = 0, {}
    for name, a in arrays.items():
        table[name] = [a.dtype.str, at, a.size]
        at += a.nbytes + -a.nbytes % 8
    head = json.dumps([at, table]).encode()
    head += b" " * (-len(head) % 8)
    parts = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        parts += [np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 8)]
    return b"".join([*parts, b"\0" * 7])  # the line feed behind it is the eighth


def unpacked(path: str) -> list[dict[str, np.ndarray]]:
    """The blobs of a file, mapped."""
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    at, out = 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8].tobytes(), "little")
        size, table = json.loads(raw[at + 8 : at + 8 + n].tobytes())
        base = at + 8 + n
        out.append({k: raw[base + o : base + o + m * np.dtype(t).itemsize].view(t) for k, (t, o, m) in table.items()})
        at = base + size + 8
    return out


def shipped(blobs: DataFrame, name: str) -> list[str]:
    """Write ``blobs`` (blob) and give the files to all executors; the names under which :func:`arrays` finds them."""
    context = blobs.sparkSession.sparkContext
    path = f"{shared_folder(blobs.sparkSession)}/{name}-{uuid.uuid4().hex}"
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("compression", "none").text(path)  # the bytes as they are
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-") and f.getLen())
    for f in files:
        context.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


def arrays(names: list[str]) -> list[dict[str, np.ndarray]]:
    """In a task: all blobs of the files ``names``."""
    return [blob for n in names for blob in unpacked(SparkFiles.get(n))]
