"""Sends this package to the executors, once in each Spark application."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows go to Python in batches of this many bytes at most, however long a text is; Spark's own bound is 64 MB.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def ship(spark: SparkSession) -> SparkSession:
    """Python workers on other machines, or with another working folder, then find the package, too.

    The session's bound on the bytes of a batch that goes to Python is lowered to 8 MB, unless it is lower already: Spark's
    64 MB, several times over in a worker, are too much where texts are long and executors small.
    """
    now = spark.conf.get(_BATCH[0], "64m").strip().lower().removesuffix("b")
    if int(now[:-1] if now[-1].isalpha() else now) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0) > _BATCH[1]:
        spark.conf.set(_BATCH[0], str(_BATCH[1]))
    app = spark.sparkContext.applicationId
    if app not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        top = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        path = os.path.join(top, "lodestone_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("lodestone", os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark
