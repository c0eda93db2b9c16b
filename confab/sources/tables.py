"""Written tables in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of a local session.

    A cluster's executors do not see the driver's folders, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="confab-")
    return _OWN[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/confab/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch for Python workers while a table is written.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage: what was computed survives the loss of executors, and expensive
    (or attempt-dependent) columns are computed once.  Python workers get small Arrow batches
    meanwhile; the session's own setting comes back.
    """
    path, conf = work_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Spark itself sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def read_text(fs, path) -> str:
    """A small UTF-8 file, hidden or not."""
    stream = fs.open(path)
    try:
        return SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def discard(table: DataFrame) -> None:
    """Deletes the files of a :func:`written` table that nothing reads any more."""
    fs, path = hadoop_path(table.sparkSession, table.written_path)
    fs.delete(path, True)
