"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for."""
    b = SparkSession.builder.master(master).appName("inkgrid")
    base = DEFAULT_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return attach(b.getOrCreate())


def attach(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors of a session, once: their Python workers need not have it installed.

    The archive is served by the driver; nothing is read from a path on the executors.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_inkgrid_attached", False):
        root = Path(__file__).resolve().parent
        if root.is_dir():
            archive = Path(tempfile.mkdtemp(prefix="inkgrid-")) / "inkgrid_package.zip"
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
                for f in sorted(root.rglob("*.py")):
                    z.write(f, str(f.relative_to(root.parent)))
            sc.addPyFile(str(archive))
        sc._inkgrid_attached = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below the one that the session names in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; on a cluster there is no folder that all machines share, which is an error.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkgrid-shared-")
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/inkgrid-{sc.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        fs, p = _file_system(sc, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)  # by the driver's JVM
    return folder


_folders: set[str] = set()


def _file_system(sc, path: str):
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Writes df once as a compressed table into the shared folder and reads it from there.

    The lineage ends at the table: it survives the loss of executors, and later reads take only the columns they need. The
    tables of an application are deleted when its driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Deletes the tables of :func:`cut` that nothing reads any more."""
    for df in cuts:
        if path := getattr(df, "_cut_path", None):
            fs, p = _file_system(df.sparkSession.sparkContext, path)
            fs.delete(p, True)


def default_parallelism(spark: SparkSession) -> int:
    """Cores the session can use now; the least number of tasks worth starting."""
    return max(1, spark.sparkContext.defaultParallelism)


def data_dir(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)
