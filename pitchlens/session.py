"""Session helpers: a tuned local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "pitchlens", driver_memory: str | None = None) -> SparkSession:
    """Session with AQE on and the UI off.

    On a cluster ``master`` is left to spark-submit; ``shuffle_partitions`` is an
    initial value that AQE coalesces at run time (so it may be sized for the
    largest stage, not the smallest).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:  # local mode: the driver JVM is the whole cluster
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Read from the session (and the context's checkpoint dir).  Only a local
    session, whose executors share the driver's disk, may run without it and
    then gets a folder of its own, removed when the interpreter ends; on a
    cluster a missing setting raises, because executors would write to disks
    that no other executor sees.
    """
    sc = spark.sparkContext
    base = (sc.getCheckpointDir()
            or spark.conf.get("spark.checkpoint.dir", None)
            or sc.getConf().get("spark.checkpoint.dir", None))
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pitchlens-ckpt-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh, not yet existing folder under the shared checkpoint folder."""
    return f"{_shared_base(spark)}/{name or 'tmp'}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` as a Parquet table in the shared checkpoint
    folder and continue from the written copy.

    The copy survives executor loss (unlike a local checkpoint), is columnar
    and compressed (cheaper than a serialized RDD checkpoint) and carries file
    statistics the planner can use for the next joins.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """The path and the store that it names, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at, store = _store(spark, path)
    return store.exists(at)


def local_path(spark: SparkSession, path: str) -> str | None:
    """Where a path lies on this machine's disk; None if it names another store."""
    at, store = _store(spark, path)
    return store.makeQualified(at).toUri().getPath() if store.getUri().getScheme() == "file" else None


def create_file(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file, if there is none of the name: of several writers one gets True.

    The text goes into a file of its own first, which then takes the name in one
    step of the store, so a reader never sees half of it.
    """
    at, store = _store(spark, path)
    own, _ = _store(spark, f"{path}.{uuid.uuid4().hex[:12]}")
    out = store.create(own, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE  # a name that is there stays
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(store.makeQualified(own), store.makeQualified(at), none)
        return True
    except Py4JJavaError as e:
        store.delete(own, False)
        if not store.exists(at):
            raise e
        return False


def read_file(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    at, store = _store(spark, path)
    got = store.open(at)
    try:
        return bytes(got.readAllBytes()).decode()
    finally:
        got.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    at, store = _store(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this library has written."""
    at, store = _store(spark, path)
    store.delete(at, True)
