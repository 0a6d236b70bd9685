"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
from uuid import uuid4

from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that Python gets at most (one row may be larger), unless the session sets fewer.
BATCH_BYTES = 4 << 20
#: Bytes of a stored table's files that are broadcast at most.
BROADCAST_BYTES = 24 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables that ``stored`` has written and ``discard`` hasn't removed yet.
_made: list[DataFrame] = []
#: Values that ``shared_value`` has sent out and ``stored_alone`` hasn't taken back yet.
_sent: list[Broadcast] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``; sets a folder of our own only where it is unset and the master is
    local. Elsewhere a folder of the driver's would not be seen by the executors, so that is an error."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches are bounded in bytes: rows alone don't bound them."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH, None) or 1 << 31) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: lost executors cost no recomputation
    of its lineage. Spark removes the files once nothing refers to them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Writes df as a table in the shared checkpoint folder and reads it from there. For loops: the next round's plan
    starts from files alone. ``discard`` removes the files; what isn't discarded goes with the folder. The rows of more
    tables like df are added one after the other, and what each has broadcast is let go before the next."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/textloom-{uuid4().hex}"
    df.write.parquet(path)
    for part in more:
        release(spark)
        part.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _made.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    for df in tables:
        if path := getattr(df, "stored_at", None):
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
            _made[:] = [x for x in _made if x is not df]


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of queries that are done: it does so once the driver has
    collected what refers to them, which a driver with much heap does seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_value(spark: SparkSession, value) -> Broadcast:
    """value, broadcast for Python workers."""
    _sent.append(spark.sparkContext.broadcast(value))
    return _sent[-1]


def stored_alone(make) -> DataFrame:
    """The stored result of make(); all else that is stored on the way is discarded once the result is there, and values
    that were shared on the way are taken back from executors and driver."""
    before, sent = list(_made), len(_sent)
    out = stored(make())
    discard(*[x for x in _made if x is not out and not any(x is y for y in before)])
    for value in _sent[sent:]:
        value.destroy()
    del _sent[sent:]
    release(out.sparkSession)
    return out


def small_side(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most ``max_rows`` rows and, if it is a stored table, ``max_bytes`` of files;
    else df as it is, which Spark then joins by a shuffle. Counts df, which should be stored or cut."""
    if path := getattr(df, "stored_at", None):
        sc = df.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(place).getLength() > max_bytes:
            return df
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


KEY = ["k_id", "k_text"]
#: Stands for a null doc_id.
NO_ID = -(2**63)


def text_key(text: Column) -> Column:
    """64 bits of a text. With doc_id beside it, a key for rows: rows that share both are alike in all respects."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """The columns that operators need of documents, others with clashing names left out.

    k_id is doc_id with a stand-in for null, k_text the text's hash.
    """
    return bounded_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"),
        text_key(F.col("text").cast("string")).alias("k_text"),
    )


#: The same key beside columns of the caller, which may have any other name.
OWN_KEY = ["_own_id", "_own_text"]


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of docs' columns (letters of either case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_own_key(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with the key of each row in two more columns, see free_names."""
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.withColumns(dict(zip(names, (own_id, text_key(F.col("text").cast("string"))), strict=True)))


def as_own_key(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(KEY, OWN_KEY, strict=True)))
