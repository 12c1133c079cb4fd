"""Written tables that cut lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode, and an error on a cluster, whose machines wouldn't see each other's folders."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: no lineage, and safe from the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, dropped as soon as they have served."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Like `written`; a table of the same name gives up its place, once this one is there."""
        path, old = f"{self.at}/{name}-{uuid.uuid4().hex}", self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(n for n in list(self.paths) if n not in names))

    def free_shuffles(self) -> None:
        """Lets the driver drop the shuffle files of plans that nothing refers to any more."""
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
