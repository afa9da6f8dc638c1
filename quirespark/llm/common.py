"""What the operators of this subpackage share: staging tables in the cluster's
shared folder, joins whose broadcast side is checked first, prefix sums that no
single task carries, and the row conventions for nulls and clashing names."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a checked side of narrow rows (under 100 bytes each) is
#: broadcast: at most about 50 MB in an executor. Larger sides are shuffled.
BROADCAST_ROWS = 200_000

#: Rows of an Arrow batch while a table is staged.
ARROW_ROWS = 2000

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from
    ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder of its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: The folder of this process's tables under the shared one.
OWN = uuid.uuid4().hex


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table; all of them go when this process ends."""
    root = f"{shared_dir(spark)}/stage/{OWN}"
    if root not in registered:
        registered.add(root)
        atexit.register(forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


registered: set[str] = set()


def forget(spark: SparkSession, root: str) -> None:
    with suppress(Exception):  # the session may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, survives the loss of any executor, and is scanned, not recomputed,
    by each later use."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with arrow_rows(spark, ARROW_ROWS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of so many rows to Python meanwhile: texts and sets are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidied(run):
    """A function over batches that returns the memory it freed to the system at its
    end: Python workers live on from task to task."""

    @wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def slices(batch, rows: int):
    """A batch in parts of so many rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def sized(batch, column: str, most: int):
    """A batch in parts whose texts have so many bytes together, or of a single row."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (staged) table holds at most so many rows. Reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large left side with a staged right side: broadcast if the count of
    its rows is within the bound, otherwise a shuffle join whose hot keys AQE splits."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right.hint("merge"), on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come
    before in ``order``, whose first column must be evenly spread hexadecimal.

    Two levels keep any key, hot or not, out of a single task: the order is cut
    into about sqrt(rows) buckets by its leading digits; the sums of buckets are
    accumulated per key, and rows only within their bucket. ``rows`` is the row
    count of ``df`` (an estimate changes only the balance, never a result).
    """
    buckets = max(1, round(rows**0.5))
    cut = F.floor(F.conv(F.substring(order[0], 1, 12), 16, 10).cast("double") / float(16**12) * buckets).cast("long")
    df = df.withColumn("_bucket", cut)
    by = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(by), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    pairs = [df[k].eqNullSafe(sums[k]) for k in (*keys, "_bucket")]
    both = df.join(sums.hint("merge"), pairs)
    return both.select(*(df[c] for c in df.columns if c not in ("_bucket", "_within")), (df["_within"] + sums["_base"]).alias(out))
