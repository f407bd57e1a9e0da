"""Session factory and the few settings the operators read from a session."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(app: str = "quaylight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators are written for.

    Adaptive execution is on (coalescing, skew splitting, late broadcast), the
    session zone is UTC and Arrow carries all Python exchange.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="package-")  # the driver's own copy; Spark hands it out
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a single machine in local mode) is
    one made; on a cluster the setting is required, since a temporary folder
    of the driver would not be seen by the executors.
    """
    d = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if d:
        return d.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    d = "file://" + os.path.join(tempfile.gettempdir(), "quaylight-shared")
    spark.sparkContext.setCheckpointDir(d)
    return d


PLAN_LENGTH_KEY, PLAN_LENGTH = "spark.sql.maxPlanStringLength", "4000b"
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder (or the open scratch folder in it) that nothing else uses."""
    return f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within, everything materialised goes to one folder that is deleted at the end: for steps whose result is written elsewhere."""
    root = fresh_path(spark, "scratch")
    token = _scratch.set(root)
    longest = spark.conf.get(PLAN_LENGTH_KEY)
    spark.conf.set(PLAN_LENGTH_KEY, PLAN_LENGTH)  # the driver keeps the descriptions of all its jobs
    try:
        yield
    finally:
        spark.conf.set(PLAN_LENGTH_KEY, longest)
        _scratch.reset(token)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        # the cleaner drops the shuffles and broadcasts of the finished step once their plans are collected
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage of ``df``: write it once below the shared folder and read it back.

    The copy is a plain table on shared storage, so a lost executor costs a
    re-read and not a re-computation.  With ``by`` it has a folder for each value of that column,
    whose rows are brought together first (those of a large one in several files).
    """
    path = fresh_path(df.sparkSession, name)
    if by:
        rest = [c for c in df.columns if c != by]
        df = df.select(*rest, by).hint("rebalance", by)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole under a name that must be free; False if it is taken.

    The content is written beside it first.  Taking the name is one step that fails if somebody else took it: a
    hard link on a file system, a rename without overwriting elsewhere.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    mine = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{to.getName()}-{uuid.uuid4().hex}")
    fs = to.getFileSystem(conf)
    stream = fs.create(mine, True)
    stream.write(text.encode())
    stream.close()
    try:
        if fs.getScheme() == "file":
            os.link(mine.toUri().getPath(), to.toUri().getPath())
            return True
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(mine, to, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    finally:
        if fs.exists(mine):
            fs.delete(mine, False)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
