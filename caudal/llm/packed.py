"""Columns of numbers packed into one binary value, and texts as zstd bytes.

A task's rows for one bucket of a shuffle travel as one value: the columns
byte plane by byte plane, zstd over all. About half the volume of single rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    sizes = np.array([len(c) for c in columns], "<i8").tobytes()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"" for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def unpack_one(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The columns of one value; ``kinds`` has a numpy type code for each."""
    types, out = [np.dtype(k) for k in kinds], []
    data = zstandard.ZstdDecompressor().decompress(blob)
    at = 8 * len(types)
    for t, n in zip(types, np.frombuffer(data, "<i8", len(types)).tolist()):
        planes = np.frombuffer(data, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(-1))
        at += n * t.itemsize
    return out


def unpack(blobs: Iterable[bytes | None], kinds: str) -> list[np.ndarray]:
    """The columns of all values (nulls left out), laid end to end."""
    parts = [unpack_one(b, kinds) for b in blobs if b is not None]
    return [np.concatenate([np.empty(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds)]


def squeezed(column: pa.Array) -> pa.Array:
    """Texts (null: empty) as zstd bytes: a third of the volume in a shuffle."""
    c = zstandard.ZstdCompressor(level=1)
    return pa.array([c.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in column], pa.binary())


def plain(column: pa.Array | pa.ChunkedArray) -> list[str]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(z.as_py()).decode("utf-8", "surrogatepass") for z in column]
