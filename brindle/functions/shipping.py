"""What executors need: this package, which they may not have installed, and a folder that they share with the driver."""

from __future__ import annotations

import atexit
import hashlib
import io
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch, whichever ends first; a single longer row is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20

_sent: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Ship, and keep the session's Arrow batches small unless it asks for smaller ones already.

    Spark reads these settings when a query runs, so they can't be put back here.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        told = spark.conf.get(key).rstrip("b")
        if not told.isdigit() or not 0 < int(told) <= most:
            spark.conf.set(key, str(most))


#: Tables below so many bytes may be dealt to the cores anew, in parts of so many at least.
SMALL, PART = 64 << 20, 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, which single tasks would read, dealt to all cores; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SMALL or 2 * len(rows.inputFiles()) >= cores:
        return rows
    return rows.repartition(max(1, min(cores, -(-size // PART))))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs on this machine, a new folder. On a cluster it has to be set."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        told = spark.sparkContext.getCheckpointDir()
    return told.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Once for each application; called before functions of this package are given to Spark."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(str(p.relative_to(root.parent)), p.read_text())
    data = packed.getvalue()
    path = Path(tempfile.mkdtemp(prefix="brindle-code-")) / f"brindle-{hashlib.sha256(data).hexdigest()[:12]}.zip"
    path.write_bytes(data)
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
