"""Files of an operator's own format below the shared folder, reached alike on any store that Arrow knows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@contextmanager
def whole_file(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A file that appears under its name only when complete.

    Every attempt of a task writes a name of its own; a repeated attempt replaces the same
    content, so lost executors and speculative copies do no harm.
    """
    store, root = locate(folder)
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    store.create_dir(f"{root}/_attempts", recursive=True)
    draft = f"{root}/_attempts/{name}.{attempt}"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, f"{root}/{name}")


def partition_index() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def each(batches: Iterator[pa.RecordBatch], act: Callable[[dict], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Apply ``act`` to every row, given as a dict."""
    for batch in batches:
        for row in batch.to_pylist():
            yield from act(row)
