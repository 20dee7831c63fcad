"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The letters that the contracts lower-case, and ASCII white space.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch of texts on its way to a Python worker, where the session sets no bound of its own.
#: Batches bounded by rows alone would grow with the length of texts.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

_SHIPPED: set[str] = set()
_REMEMBERED: dict[str, object] = {}


def remembered(owner: str, make):
    """What a Python worker remembers for ``owner``, made when first asked for.

    Workers live on between stages; one that turns to another operator forgets what the one before it had gathered.
    """
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[owner] = make()
    return _REMEMBERED[owner]


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, as spark-submit --py-files would; once per application.  Bound the batches they get."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    if spark.sparkContext.applicationId not in _SHIPPED:
        package = Path(__file__).parents[1]
        target = Path(tempfile.mkdtemp(prefix="turnmill-")) / "turnmill.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.  Where it names none: a temporary one in local mode (tests), else an error,
    since a folder of one machine would not be seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="turnmill-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``durable()`` tables that nothing reads any more."""
    for df in tables:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(rows: DataFrame, key: Column, gone: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows whose ``key`` is not among the keys of ``gone``, a table of one column.  Up to ``most`` keys go to every task and
    the rows, with their texts, stay where they are; more are joined by shuffle."""
    keys = durable(gone.toDF("_turnmill_gone").distinct())
    few = keys.limit(most + 1).count() <= most
    return rows.join(F.broadcast(keys) if few else keys, key == F.col("_turnmill_gone"), "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Texts of ASCII alone take Spark's byte-wise lower(), which then does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(*parts: Column) -> Column:
    """A draw in (0, 1) that depends on nothing but the given columns."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def with_offsets(df: DataFrame, group: str, order: list[str], weight: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same ``group`` that come before this one.

    A plain window over ``group`` would put a whole group into one task.  Rows are
    dealt into ``buckets`` by a hash of the order columns instead (by default one for each 50,000 rows, 64 at least, so that a bucket doesn't
    grow with the table); the bucket comes first in the order, so a row's sum is the sum of all earlier buckets plus
    the sum inside its own.  Groups x buckets rows are the only thing that is summed per group.
    """
    buckets = buckets or max(64, -(-df.count() // 50_000))
    dealt = df.withColumn("_w", weight.cast("long")).withColumn("_b", F.pmod(F.xxhash64(*order, F.lit("offset")), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_gb")).agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy("_g").orderBy("_gb").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_g", "_gb", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    joined = run.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_gb")), "left")
    return joined.withColumn(out, F.col("_start") + F.col("_in")).drop("_w", "_b", "_g", "_gb", "_s", "_start", "_in")
