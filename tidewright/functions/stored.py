"""Tables written on the way, in the folder that all machines share, so that what is read twice isn't computed twice."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder for each application where it is unset and Spark runs on one machine."""
    conf, app = spark.sparkContext.getConf(), spark.sparkContext.applicationId
    found = conf.get("spark.checkpoint.dir") or _own.get(app)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet and read back; a lost executor then costs a read. A nested or struct symbol is kept as it is."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewright/features/{uuid.uuid4().hex}_{name}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete the tables that written() has made in this application; DataFrames that read them must be done with. Returns how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
