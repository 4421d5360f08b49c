"""What the operators of this subpackage share: reading, checkpoints and shipping code to workers."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["sparrowmill"])

#: Rows and bytes of one Arrow batch; they bound a Python worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most BATCH_ROWS rows and about BATCH_BYTES from now on, unless the session asks for fewer rows.
    The setting stays, as it is read when a query runs, which is after an operator has returned its DataFrame."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one that the caller has set on the context. Where neither is set, a
    temporary one if driver and executors are one process, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="sparrowmill-checkpoint-")
        sc.setCheckpointDir(shared)
        shared = sc.getCheckpointDir()
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Written as a table in the shared checkpoint folder and read from there: lost executors cost nothing.

    Unlike the plan that checkpoint() leaves, which inherits its origin's estimates (joins multiply them, so that after
    some rounds the driver plans for minutes on numbers of astronomic length), a table's statistics are its own size.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that checkpointed() wrote, once nothing unwritten reads them any more."""
    for table in tables:
        remove(table.sparkSession, table._written_at)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, keep: list[str], results: str) -> tuple[list[str], str]:
    """The columns of `keep` whose names aren't among those of the results (a schema), and their schema."""
    taken = {x.split()[0].lower() for x in results.split(", ")}
    keep = [c for c in keep if c.lower() not in taken]
    return keep, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(column):
    """A-Z to a-z, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of a filter of ids and of one of tokens. A filter's size (a 64th as many numbers) doesn't depend on the data; when it
#: fills up, it lets more rows pass.
FILTER_BITS = 1 << 20
TOKEN_BITS = 1 << 23


def _filter_words(ids: DataFrame, hashed, size: int) -> DataFrame:
    places = ids.select(hashed.bitwiseAND(size - 1).alias("_bit"))
    ones = places.select(F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, cast(_bit & 63 as int))").alias("_one"))
    return ones.groupBy("_word").agg(F.bit_or("_one").alias("_bits"))


class IdFilter:
    """A fixed-size bitmap of hashed ids: tells ids that are surely not among those it was built of. What passes may still
    be none of them, so it only saves work before a join."""

    def __init__(self, ids: DataFrame, *columns: str):
        each = ids.select(F.explode(F.array(*columns)).alias("_id"))
        self.words = checkpointed(_filter_words(each, F.xxhash64("_id"), FILTER_BITS))

    def marked(self, df: DataFrame, column: str, mark: str = "_may") -> DataFrame:
        """df with a column telling whether the id may be one of the filter's."""
        bit = F.xxhash64(column).bitwiseAND(FILTER_BITS - 1)
        out = df.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(self.words), "_word", "left")  # of fixed size
        return out.withColumn(mark, F.coalesce(F.getbit("_bits", bit.bitwiseAND(63).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")

    def passing(self, df: DataFrame, column: str) -> DataFrame:
        return self.marked(df, column).where("_may").drop("_may")


def token_bitmap(tokens: DataFrame, column: str) -> np.ndarray:
    """The same for tokens that are hashes themselves, as TOKEN_BITS / 64 numbers for workers (1 MB)."""
    found = _filter_words(tokens, F.col(column), TOKEN_BITS).toArrow()
    out = np.zeros(TOKEN_BITS // 64, np.uint64)
    out[found.column("_word").to_numpy()] = found.column("_bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    bit = tokens & np.uint64(TOKEN_BITS - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
