"""Make this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_shipped: set[str] = set()
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each application, as ``--py-files`` would.

    Rows that go to Python here hold whole texts, so the default of 10,000 rows to an Arrow batch becomes 1,000 where nobody has set it.
    """
    if spark.conf.get(ROWS, "-7") == "-7":  # the given value comes back only where none is set
        spark.conf.set(ROWS, "1000")
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        folder = os.path.join(SparkFiles.getRootDirectory(), "made")  # the driver's folder of the session
        os.makedirs(folder, exist_ok=True)
        file = os.path.join(folder, "quaymark.zip")
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quaymark", os.path.relpath(full, top)))
        sc.addPyFile(file)
        _shipped.add(sc.applicationId)
    return spark
