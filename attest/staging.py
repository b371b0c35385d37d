"""Tables that are written to a folder which driver and executors share, and deleted together."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests on one machine, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="attest-")
    return _OWN[app]


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan can read any more.

    It does so when the driver's collector finds the plans gone, which may otherwise be late. The
    thread that tells the JVM which objects Python has dropped looks once a second.
    """
    import gc
    import time

    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


class Stage:
    """A folder for the tables of one piece of work.

    What is written is read as often as it is needed without its plan being run again, and a lost
    executor costs none of it. `close` deletes the folder: results that still read from it should
    have been written or collected by then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        delete(self.spark, self.path)

    def __enter__(self) -> "Stage":
        return self

    def __exit__(self, *error: object) -> None:
        self.close()
