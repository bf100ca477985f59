"""What blocks of documents and shards of a model send each other: sorted 64-bit keys and counts in few bytes, and files of blocks.

A block of documents asks each shard for its distinct keys, and the shard answers in the same order. Shards are equal ranges of keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cellpath.llm.files import locate, whole_file
from cellpath.llm.words import slices


def pack(values: np.ndarray) -> bytes:
    """Numbers as seven bits a byte, the highest bit marking all bytes of a number but its last."""
    values = np.asarray(values, np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 10):
        width += values >> np.uint64(7 * k) > 0
    end = np.cumsum(width)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(end - width)[has] + k] = part | np.where(width[has] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128) + 1
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    values = np.zeros(len(end), np.uint64)
    for k in range(int((end - start).max(initial=0))):
        has = end - start > k
        values[has] |= (raw[start[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return values


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers by bytes, the lowest of all first, compressed: high bytes of small numbers take next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.zeros(0, np.uint8)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def expand(data: bytes, kind: type) -> np.ndarray:
    """Numbers of type ``kind`` that were squeezed."""
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def _starts(shards: int) -> np.ndarray:
    return np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(_starts(shards), keys, "right")


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted keys; shards are equal ranges of hashes."""
    return np.concatenate([[0], np.searchsorted(keys, _starts(shards)), [len(keys)]])


def gather(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Rows gathered to about ``size`` bytes of text."""
    waiting, total = [], 0
    for batch in batches:
        for part in slices(batch, column, size // 4):
            waiting.append(part)
            total += part[column].nbytes
            if total >= size:
                yield pa.Table.from_batches(waiting)
                waiting, total = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def store_block(folder: str, place: tuple[int, int], columns: dict[str, pa.Array]) -> int:
    """Write columns, of any lengths, to a file named by their content and place, so that no attempt of a task spoils another's."""
    sink = pa.BufferOutputStream()
    table = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column) for name, column in columns.items()})
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    content = sink.getvalue()
    name = int.from_bytes(hashlib.blake2b(repr(place).encode() + memoryview(content), digest_size=7).digest())
    with whole_file(folder, f"{name:014x}") as out:
        out.write(content)
    return name


def read_block(folder: str, name: int) -> dict[str, pa.Array]:
    store, root = locate(folder)
    with store.open_input_file(f"{root}/{name:014x}") as source:
        table = pa.ipc.open_file(source).read_all()
    return {c: table[c].combine_chunks().flatten() for c in table.column_names}
