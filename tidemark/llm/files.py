"""Files in the shared folder, written and read by tasks: arrays by name, and plane-coded numbers."""

from __future__ import annotations

import io

import numpy as np
import pyarrow.fs as pafs
import zstandard


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (any that pyarrow knows) and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(uri: str, content: bytes) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(content)


def get(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def pack_arrays(level: int = 1, **arrays: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return zstandard.compress(held.getvalue(), level)


def unpack_arrays(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.decompress(content))) as z:
        return {k: z[k] for k in z.files}


def to_planes(x: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte planes (or bit planes) of unsigned numbers, lowest first, up to the last that is not all zeros."""
    x = np.ascontiguousarray(x)
    rows = x.view(np.uint8).reshape(len(x), x.itemsize)
    most = int(x.max()).bit_length() if len(x) else 0
    if not bits:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(-(-most // 8))]
    each = np.unpackbits(rows[:, : -(-most // 8)], axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(most)]


def from_planes(planes: list[bytes], n: int, dtype: type, bits: bool = False) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    if bits:
        for k, p in enumerate(planes):
            out[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << (k % 8)
    else:
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
    return out.view(dtype).ravel()
