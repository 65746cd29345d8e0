"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints.

    It is the session's spark.checkpoint.dir. Where that is unset, a session whose executors are threads of
    one machine (as in tests) takes a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="windrow-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2**22) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with some `most` bytes of text in them; a longer text is a run of its own.

    Spark bounds a batch by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch); Python objects
    are only made of one run at a time.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def join_spread(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", loads: DataFrame | None = None, hot: int = 2_000, broadcast_rows: int = 500_000) -> DataFrame:
    """left joined with right on `key`, where right has one row at most for each key and left may have very many.

    Keys with more than `hot` rows in left are dealt out by a hash of the column `by` in as many parts as
    have `hot` rows each, and right's row is repeated for each part; so no task gets all rows of a key.
    loads: key and count, if they are known. There are fewer hot keys than rows / hot; they are broadcast
    up to `broadcast_rows` of them.
    """
    loads = loads if loads is not None else left.groupBy(key).count()
    loads = cut_lineage(loads.filter(F.col(key).isNotNull() & (F.col("count") > hot)).select(F.col(key).alias("_key"), F.ceil(F.col("count") / hot).alias("_parts")))
    n = loads.count()
    if not n:
        return left.join(right, key, how)
    side = F.broadcast(loads) if n <= broadcast_rows else loads
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(side, F.col(key) == F.col("_key"), "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_key", "_parts")
    repeated = right.join(side, F.col(key) == F.col("_key"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_key", "_parts")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


#: Integers beyond this are set to it, so that sums of products stay exact in 64 bits.
MOST = 2**24


def whole_vectors(vectors: DataFrame, scale: int, *columns: str) -> tuple[DataFrame, int | None]:
    """The columns named and x, the embedding's components as floor(scale * component), MOST in size at most; and the number of components.

    A row whose embedding is null or empty, has a null, infinite or NaN component, or not as many components as most rows is left
    out. Without any row left the number is None.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(*columns, v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    whole = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")
    kept = kept.select(*columns, F.transform("v", whole).alias("x"))
    most = kept.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (kept, None) if most is None else (kept.filter(F.size("x") == most["dim"]), most["dim"])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 1 when divided by 3. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def held_out_id(doc_id: int | None) -> bool:
    """The same rule in plain Python."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def sample_rows(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most `rows` rows of df, those whose salted hash of `key` is smallest: the same ones in every run.

    Used for the bounded training samples only. The count is taken first, so that a threshold on the
    hash leaves few rows to sort.
    """
    total = df.count()
    hashed = df.withColumn("_h", F.xxhash64(key, F.lit(20_011)))
    if total > 2 * rows:
        limit = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (1.2 * rows + 200) / total)))
        hashed = hashed.filter(F.col("_h") <= limit)
    return hashed.orderBy("_h", key).limit(rows).drop("_h")
