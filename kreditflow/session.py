"""Session construction and shared-folder resolution."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "kreditflow", shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the engine relies on.

    On a cluster ``master`` stays None and the launcher's settings win; the
    builder only fills what is unset.  AQE stays on so shuffle partition counts
    and skewed joins are re-planned at runtime.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", os.environ.get("KREDITFLOW_DRIVER_MEMORY", "16g"))
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> None:
    """What every query needs of a session: a shared folder, and the package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is.  Only a local
    session without one (tests) gets a private folder; on a cluster, where
    executors don't see each other's folders, that would lose data.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="kreditflow-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kreditflow-code-"), "kreditflow.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("kreditflow", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path for a written table under the shared folder, in a folder of the application that goes when it ends."""
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kreditflow-{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        jpath, fs = _file_system(spark, home)
        fs.mkdirs(jpath)
        fs.deleteOnExit(jpath)
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    return f"{home}/{leaf}"


_HOMES: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    """The path and its Hadoop FileSystem, whatever the store."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem, so it works on any store."""
    jpath, fs = _file_system(spark, path)
    return bool(fs.exists(jpath))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder (none if it doesn't exist)."""
    jpath, fs = _file_system(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(jpath)] if fs.exists(jpath) else []


def input_state(spark: SparkSession, *paths: str) -> tuple:
    """What tells whether files have changed: path, size and time of every file of the paths."""
    out = []
    for path in paths:
        jpath, fs = _file_system(spark, path)
        if not fs.exists(jpath):
            out.append((path, None, None))
            continue
        files = fs.listFiles(jpath, True)
        while files.hasNext():
            st = files.next()
            out.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return tuple(sorted(out, key=str))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of this package's own tables."""
    jpath, fs = _file_system(spark, path)
    fs.delete(jpath, True)
