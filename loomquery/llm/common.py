"""Shared plumbing: table access, the shared scratch folder, materialised cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOTS: dict[str, tuple[SparkSession, str]] = {}
_PRIVATE: dict[str, str] = {}  # application: folder, in local mode without a setting


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or a private one where that is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = "file://" + tempfile.mkdtemp(prefix="loomquery-")
    return _PRIVATE[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder; the application's scratch is removed when Python exits."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/loomquery-{app}"
    if root not in _ROOTS:
        _ROOTS[root] = (spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, root in _ROOTS.values():
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, root)
            except Exception:  # the JVM may be gone already; the folder is scratch
                pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Survives the loss of any executor, and a plan that uses the result twice
    does not compute it twice.
    """
    path = scratch_path(df.sparkSession, tag)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    if before is not None:  # the write's shuffle files are of no use once it is done
        conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            conf.set(_CLEANUP, before)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def release(*frames: DataFrame) -> None:
    """Delete the files of written frames that nothing will read any more; other frames are left alone."""
    for df in frames:
        path = df.__dict__.pop("_scratch", None)
        if path:
            _delete(df.sparkSession, path)


def held_out(doc_id: Column) -> Column:
    """True for documents kept out of every fit: crc32 of the id's decimal text, mod 4, is 2.  A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with every column that has one of ``names`` renamed by trailing underscores."""
    wanted = {n.lower() for n in names}
    for column in df.columns:
        if column.lower() in wanted:
            df = df.withColumnRenamed(column, fresh_name(df, column + "_"))
    return df


def likely_in(df: DataFrame, columns: list[str], keys: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` whose ``columns`` occur in ``keys`` (of about so many rows), and a few others.

    They are looked up in a broadcast bitmap of hashes: about 16 bits a row of ``keys``, and 16 MB at most, beyond which
    more others pass.  It spares a later join the shuffle of the rest.
    """
    size = 1 << min(27, max(15, (16 * rows - 1).bit_length()))
    names = {k: fresh_name(df, f"__{k}") for k in ("spot", "page", "bits")}
    spot = F.pmod(F.xxhash64(*columns), F.lit(size))
    pages = keys.select(spot.alias("spot")).select("spot", F.shiftright("spot", 15).alias("page")).repartition("page")
    pages = pages.groupBy("page").agg(F.bitmap_construct_agg(F.col("spot").bitwiseAND(0x7FFF)).alias("bits")).toDF(names["page"], names["bits"])
    told = df.withColumn(names["spot"], spot)
    told = told.join(F.broadcast(pages), F.shiftright(names["spot"], 15) == F.col(names["page"]))
    byte = f"conv(hex(substring({names['bits']}, int((`{names['spot']}` & 32767) >> 3) + 1, 1)), 16, 10)"
    return told.filter(F.expr(f"(int({byte}) >> int(`{names['spot']}` & 7)) & 1 = 1")).drop(*names.values())


def size_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, used to decide whether a side may be broadcast."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
