"""Keyed tables kept as versions: appended, folded, marked and pruned by whole-version writes.

A version is written in full to a folder of its own and becomes current by the last step, which takes
its number: a small file under a name that must be free.  A run that dies before leaves the old version
current, and of two writers of one version the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.session import read_text, write_new


class VersionedTable:
    """A table of which each write is a new version; readers see the last complete one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        p = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not self._fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        v = version or self.version()
        return self.spark.read.parquet(f"{self.path}/{read_text(self.spark, f'{self.path}/versions/{v}')}") if v else None

    def write(self, df: DataFrame, expect: int | None = None) -> int:
        """Write the next version; with ``expect``, only if that version is still current when the number is taken."""
        v = self.version() if expect is None else expect
        if self.version() != v:
            raise RuntimeError(f"version {self.version()} is current, not {v}")
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        if not write_new(self.spark, f"{self.path}/versions/{v + 1}", folder):
            raise RuntimeError(f"version {v + 1} was made by another writer")
        return v + 1


def appended_if_absent(stored: DataFrame | None, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Stored rows and the first new row of each key that isn't stored: the first writer owns a key."""
    from quaylight.operators.dedup import first_owner

    fresh = first_owner(new, key, order).drop("copies").select(*new.columns)
    return fresh if stored is None else stored.unionByName(fresh.join(stored.select(key), key, "left_anti"))


def pruned(df: DataFrame, ts: str, now: Column, days: float) -> DataFrame:
    """Rows not older than ``days`` before ``now``; with a constant ``now`` the filter reaches the scan."""
    seconds = F.lit(days * 86_400).cast("decimal(18,6)")
    return df.where(F.col(ts) >= now.cast(df.schema[ts].dataType) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))


def non_empty(x: Column) -> Column:
    return F.when(F.trim(x.cast("string")) != "", x)


def folded_mentions(df: DataFrame, key: str, order: list[str], latest: list[str], first: list[str]) -> DataFrame:
    """One row a key: the first non-null of ``first``, the latest non-empty of ``latest``, and the number of mentions."""
    at = F.struct(*order)
    aggs = [F.min_by(c, at).alias(c) for c in first]
    aggs += [F.max_by(F.when(non_empty(F.col(c)).isNotNull(), F.col(c)), F.when(non_empty(F.col(c)).isNotNull(), at)).alias(c) for c in latest]
    return df.groupBy(key).agg(*aggs, F.count("*").alias("mention_count"))


def merged_fold(stored: DataFrame | None, batch: DataFrame, key: str, first: list[str], latest: list[str]) -> DataFrame:
    """Folded batch into folded table: counts add, the stored first values stay, non-empty new ones replace the rest."""
    if stored is None:
        return batch
    a, b = stored.alias("a"), batch.alias("b")
    j = a.join(b, key, "full")
    cols = [F.col(key)] + [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in first]
    cols += [F.coalesce(non_empty(F.col(f"b.{c}")), F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in latest]
    return j.select(*cols, (F.coalesce("a.mention_count", F.lit(0)) + F.coalesce("b.mention_count", F.lit(0))).alias("mention_count"))


def claimed(df: DataFrame, run_id: str, now: str, lease_seconds: int, order: list[Column], key: str) -> DataFrame:
    """The table with its first claimable row leased to ``run_id``: a pure step for a compare-and-set write."""
    free = F.col("owner").isNull() | (F.col("lease_until") < F.lit(now).cast("timestamp"))
    pick = df.where(free).orderBy(*order).limit(1).select(F.col(key).alias("__k"))
    j = df.join(pick, df[key] == F.col("__k"), "left")
    mine = F.col("__k").isNotNull()
    until = F.lit(now).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    return j.withColumn("owner", F.when(mine, F.lit(run_id)).otherwise(F.col("owner"))).withColumn("lease_until", F.when(mine, until).otherwise(F.col("lease_until"))).drop("__k")


def _where(mine: Column, **new: Column) -> dict[str, Column]:
    return {c: F.when(mine, x).otherwise(F.col(c)) for c, x in new.items()}


def held(key: str, id_: str, run_id: str) -> Column:
    """Whether a row is the one named and leased to the run."""
    return F.coalesce((F.col(key) == id_) & (F.col("status") == "sending") & (F.col("owner") == run_id), F.lit(False))


def released(df: DataFrame, key: str, id_: str, run_id: str) -> DataFrame:
    """A failed claim given back: pending and free again, if the run still holds it."""
    return df.withColumns(_where(held(key, id_, run_id), status=F.lit("pending"), owner=F.lit(None).cast("string"), lease_until=F.lit(None).cast("timestamp")))


def renewed(df: DataFrame, key: str, id_: str, run_id: str, now: str, lease_seconds: int) -> DataFrame:
    """A lease prolonged from now, if the run still holds it."""
    until = F.lit(now).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    return df.withColumns(_where(held(key, id_, run_id), lease_until=until))


def sent(df: DataFrame, key: str, id_: str, style: str, at: str, run_id: str | None = None) -> DataFrame:
    """A row marked as sent and its lease ended; with ``run_id`` only if that run holds it."""
    mine = held(key, id_, run_id) if run_id is not None else F.coalesce(F.col(key) == id_, F.lit(False))
    none = F.lit(None)
    return df.withColumns(_where(mine, status=F.lit("sent"), sent_at=F.lit(at), sent_style=F.lit(style), owner=none.cast("string"), lease_until=none.cast("timestamp")))


def marked(df: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Rows with the status and, where one is given, the death signal of their last mark (``key``, order, status, death_signal)."""
    m = marks.groupBy(F.col(key).alias("__k")).agg(F.max_by("status", "order").alias("__s"), F.max_by("death_signal", F.when(F.col("death_signal").isNotNull(), F.col("order"))).alias("__d"))
    j = df.join(m, df[key] == F.col("__k"), "left")
    return j.withColumn("status", F.coalesce("__s", "status")).withColumn("death_signal", F.coalesce("__d", "death_signal")).select(*df.columns)
