"""Session helpers: building a session and cutting lineage into shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "siftwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint folder.

    It is taken from ``spark.checkpoint.dir``. Where that is unset a local
    session gets a temporary folder; on a cluster, whose executors could not
    reach it, this is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="siftwright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
        return sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder that cut an iterative job's lineage.

    Written tables survive lost executors. ``drop`` removes the ones a job no
    longer needs, so an iteration keeps two generations at most.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written files."""
        path = f"{self.root}/t{self._n:05d}"
        self._n += 1
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def cut_by(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """``cut``, hash-partitioned by ``key`` for good: joins on it shuffle the other side only.

        The files belong to an external table of the session's catalogue, whose
        entry goes at once; the returned DataFrame keeps what it needs.
        """
        path = f"{self.root}/t{self._n:05d}"
        self._n += 1
        name = f"scratch_{uuid.uuid4().hex}"
        placed = df.repartition(buckets, key)  # one file a bucket
        placed.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # noqa: B018  resolved while the entry is there
        out._scratch_path = path  # noqa: SLF001
        self.spark.sql(f"drop table {name}")
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MEMORY_AND_DISK = StorageLevel.MEMORY_AND_DISK
