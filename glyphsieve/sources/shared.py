"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir or by setCheckpointDir().  Only a local session that names none gets a
    temporary folder, for as long as the process lives; a cluster without one is an error."""
    context = spark.sparkContext
    found = spark.conf.get(_KEY, None) or context.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="glyphsieve-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], True)
    return _LOCAL[context.applicationId]
