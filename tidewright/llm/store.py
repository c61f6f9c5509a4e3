"""Where intermediate tables go: the folder in spark.checkpoint.dir, which every machine sees."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[str]] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, a new temporary folder."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or _own.get(spark.sparkContext.applicationId)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidewright/{uuid.uuid4().hex}/{name}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back. This cuts the lineage: a lost executor costs a file read, not the stages before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_boxes(docs: DataFrame, *names: str) -> DataFrame:
    """(box, names): the columns named, and the whole row as a struct, so that a column of the user's never meets one that an operator adds; select("box.*") gives the row back."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("box"), *names)


def run_and_release(make, name: str) -> DataFrame:
    """save(make()), with the tables that make wrote on the way deleted, as nothing reads them any more."""
    spark = SparkSession.active()
    before = made(spark)
    out = save(make(), name)
    release(spark, before | set(_made[spark.sparkContext.applicationId][-1:]))
    return out


def made(spark: SparkSession) -> set[str]:
    """Paths that save() has written in this application and that still stand."""
    return set(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete the tables that save() has written in this application, but those in keep. DataFrames that read them must be done with."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path not in keep:
            parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
            parent.getFileSystem(conf).delete(parent, True)
    _made[spark.sparkContext.applicationId] = [p for p in paths if p in keep]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that a table may have to be broadcast, as 8 for each number of its rows; Spark's own rows take some 3 times that.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if a count shows that it has BROADCAST_BYTES at most; beyond, joins with it shuffle. Only for saved tables of numbers."""
    for f in df.schema.fields:
        if f.dataType.typeName() not in ("long", "integer", "boolean", "double"):
            raise TypeError(f"{f.name} isn't a number, so a count doesn't bound the table's size")
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= BROADCAST_BYTES else df


#: Rows of whole texts that go to Python at once.
TEXT_ROWS = 2_000


@contextmanager
def text_batches(spark: SparkSession):
    """While it is open, at most TEXT_ROWS rows go to Python at once, as rows with whole texts are long. A smaller number that is set stays; the session is left as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)
