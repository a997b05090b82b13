"""Shared helpers of the training-data operators."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Everything that is not part of a word, once A-Z are lower case: ASCII other than 0-9 and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset on a local master, as in tests, a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows that travel to Python at once: texts may be long, and a worker holds several copies of a batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send Python at most BATCH_ROWS rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends and sizes become known to the planner."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by `cut` that nothing reads any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.cut_path
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """`name`, or the first of name_1, name_2, ... that is no column of the tables, whatever the case of its letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    tries = (name if i == 0 else f"{name}_{i}" for i in itertools.count())
    return next(x for x in tries if x.lower() not in taken)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII texts take the fast built-in, which then means the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")
