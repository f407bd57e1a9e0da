"""Forwarding of a stream of messages: duplicates held back, state committed after the sink.

Each micro-batch is written to the sink under its batch number, and only then are its keys added
to the seen table under the same number.  A batch that is replayed overwrites what it wrote; a
crash between the two delivers again and never loses a message.

The seen table is a folder a batch; ``MERGE`` of them are folded into one, a row a key, so a batch reads a bounded
number of folders however many came before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.operators.dedup import first_owner


#: Folders of keys that are folded into one.
MERGE = 16


def _seen(spark: SparkSession, path: str, batch: int, keep: Column | None = None) -> DataFrame | None:
    """Keys of the batches before ``batch`` with their last time; ``keep`` is what of them still counts when they are folded."""
    fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_of(path)):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(fs_of(path))]
    number = lambda kind: [int(n[2:]) for n in names if n.startswith(f"{kind}=") and int(n[2:]) < batch and fs.exists(fs_of(f"{path}/{n}/_SUCCESS"))]
    folded = max(number("f"), default=-1)
    parts = [f"{path}/b={n}" for n in sorted(number("b")) if n > folded] + [f"{path}/f={folded}"] * (folded >= 0)
    if not parts:
        return None
    seen = spark.read.schema("key string, at timestamp").parquet(*parts)
    if len(parts) > MERGE:  # a replay of the batch folds the same folders again
        one = seen.groupBy("key").agg(F.max("at").alias("at"))
        (one if keep is None else one.where(keep)).write.mode("overwrite").parquet(f"{path}/f={batch - 1}")
        seen = spark.read.schema("key string, at timestamp").parquet(f"{path}/f={batch - 1}")
    return seen


def forwarder(sink: str, state: str, key: Column, order: list[str], ts: str | None = None, window_days: float | None = None) -> Callable[[DataFrame, int], None]:
    """The function of a batch: forwards the first row of each key not seen (within the window, if given)."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("__key", key.cast("string"))
        plain = rows.where("__key is null").drop("__key")
        keyed = first_owner(rows, "__key", order).drop("copies")
        seen = _seen(batch.sparkSession, state, number)
        if seen is not None:
            if ts and window_days is not None:
                lo = F.unix_micros(F.col(ts).cast("timestamp")) - int(window_days * 86_400_000_000)
                s = seen.groupBy(F.col("key").alias("__key")).agg(F.max("at").alias("__at"))
                keyed = keyed.join(s, "__key", "left").where(F.col("__at").isNull() | (F.unix_micros("__at") <= lo)).drop("__at")
            else:
                keyed = keyed.join(seen.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti")
        out = keyed.select(*batch.columns).unionByName(plain)
        out.write.mode("overwrite").parquet(f"{sink}/b={number}")
        sent = batch.sparkSession.read.parquet(f"{sink}/b={number}").withColumn("__key", key.cast("string")).where("__key is not null")
        at = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
        sent.select(F.col("__key").alias("key"), at.alias("at")).write.mode("overwrite").parquet(f"{state}/b={number}")

    return run


def forward_files(spark: SparkSession, folder: str, schema: str, work: str, key: Column, order: list[str], files_a_batch: int = 1) -> DataFrame:
    """Forward all files of a folder now, in batches, and return what was forwarded."""
    work = work.rstrip("/")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    q = src.writeStream.foreachBatch(forwarder(f"{work}/sent", f"{work}/seen", key, order)).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{work}/sent").drop("b")
