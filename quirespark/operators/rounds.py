"""Work in rounds: chains followed by pointer doubling, reach by a growing frontier.

A round is a join over all documents at once; how many there are depends on the longest
chain, by its logarithm, or on the widest reach, never on the number of rows. Each round
is cut off from those before by a table in the folder that the cluster shares, so a
lost executor costs one round."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder of this process's cuts under the shared one.
OWN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-rounds-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, as Parquet in ``spark.checkpoint.dir``: written once, packed, and
    read by the columns that each use needs. They go when this process ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/rounds/{OWN}"
    if root not in registered:
        registered.add(root)
        atexit.register(forget, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


registered: set[str] = set()


def forget(spark: SparkSession, root: str) -> None:
    with suppress(Exception):  # the session may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def climbed(nodes: DataFrame, carry: str = "struct(id)") -> DataFrame:
    """Of each node (doc_id, id, parent; null: none) the way up: ``path``, of the topmost
    first and the node itself last, an array of ``carry`` and of its id; ``up``, the parent
    of the topmost; and ``status``: ``root`` (there is none), ``lost`` (it is no node) or
    ``circle`` (the way never ends)."""
    path = lambda x, k: F.struct(x.alias("id"), (F.get("owns", k) if carry != "struct(id)" else F.struct(x.alias("id"))).alias("own"))
    return ways_up(nodes, None if carry == "struct(id)" else carry).select("doc_id", "id", "up", F.transform("ids", path).alias("path"), "status")


def ways_up(nodes: DataFrame, carry: str | None = None) -> DataFrame:
    """As ``climbed``, with the path as two plain arrays, ``ids`` and, if something is to be
    carried, ``owns``: a row of numbers is a fraction of a row of structures.

    Every round doubles the part of the way that each node knows: the path up to a node,
    then that node's own."""
    start = F.when(F.col("parent").isNull(), "root").when(F.col("parent") == F.col("id"), "circle").otherwise("open")
    arrays = ["ids"] if carry is None else ["ids", "owns"]
    state = cut(nodes.select("doc_id", "id", F.col("parent").alias("up"), F.array("id").alias("ids"), *([] if carry is None else [F.array(F.expr(carry)).alias("owns")]), start.alias("status")))
    # What a round settles is written once and only read from then on.
    done, waits = [state.where("status != 'open'")], state.where("status = 'open'")
    while not waits.isEmpty():
        known = reduce(DataFrame.unionByName, [*done, waits])
        above = known.select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"), F.col("up").alias("_up"), *(F.col(c).alias("_" + c) for c in arrays), F.col("status").alias("_status"))
        both = waits.join(above.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("up") == F.col("_id")), "left")
        seen = F.array_contains("ids", F.col("_up")) | F.array_contains("_ids", F.col("id"))
        status = F.when(F.col("_id").isNull(), "lost").when((F.col("_status") == "circle") | F.coalesce(seen, F.lit(False)), "circle").otherwise(F.col("_status"))
        lost = F.col("_id").isNull()
        longer = lambda c: F.when(lost, F.col(c)).otherwise(F.concat("_" + c, c)).alias(c)
        step = cut(both.select("doc_id", "id", F.when(lost, F.col("up")).otherwise(F.col("_up")).alias("up"), *map(longer, arrays), status.alias("status")))
        done.append(step.where("status != 'open'"))
        waits = step.where("status = 'open'")
    return reduce(DataFrame.unionByName, done)


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, id: the roots (doc_id, id), and what edges (doc_id, from, to) lead to from
    there. Each round follows the edges out of what the round before found for the first
    time."""
    found = frontier = cut(roots.select("doc_id", "id").distinct())
    out = edges.select("doc_id", F.col("from").alias("_from"), F.col("to").alias("_to")).distinct()
    while not frontier.isEmpty():
        steps = frontier.join(out.hint("merge"), (frontier["doc_id"] == out["doc_id"]) & (frontier["id"] == out["_from"])).select(frontier["doc_id"], F.col("_to").alias("id")).distinct()
        frontier = cut(steps.join(found, ["doc_id", "id"], "left_anti"))
        found = cut(found.unionByName(frontier))
    return found
