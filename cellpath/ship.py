"""Make this package importable in Python workers that were not started with it."""

from __future__ import annotations

import io
import os
import zipfile

from pyarrow import fs
from pyspark.sql import SparkSession

from cellpath.session import scratch_path

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, unless they find it by their path already.

    Nothing is sent where the driver's PYTHONPATH or working folder, which local workers
    inherit, holds the package, or where it was submitted as an archive. Called wherever Python functions are handed to Spark.
    """
    root, sc = os.path.dirname(_PACKAGE), spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _done or root in known or root == os.getcwd() or not os.path.isdir(root):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    target = f"{scratch_path(spark, 'code')}.zip"
    store, path = fs.FileSystem.from_uri(target)
    with store.open_output_stream(path) as out:
        out.write(buffer.getvalue())
    sc.addPyFile(target)
    _done.add(sc.applicationId)
