"""Tables, written cuts of lineage, and scalable row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, times: int = 1) -> DataFrame:
    """df over all cores: a table of fewer splits than cores is dealt out before work that is heavy per row; a large one stays as it is, or
    becomes times as many tasks as it has splits, where a task has to hold much more than it reads."""
    splits = df.rdd.getNumPartitions()
    n = max(splits * times, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n) if splits < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; in local mode (tests) a temporary one may stand in for it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='sonolake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """df through a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """df, dealt by the keys, through a table of the warehouse with as many buckets: joins by them move the other side alone."""
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(table_name)
    return spark.table(table_name)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has given once all its input of now is processed, through a Parquet table in the shared folder."""
    path = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def indexed(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """df with a gapless bigint from 0 in a total order, without one task for all rows: rows are range-partitioned and numbered
    inside each range; a range starts where the earlier ones (as many as partitions) end."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    kept = written(local, "ranges")
    size = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(F.broadcast(size.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def ranked(df: DataFrame, group: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with a gapless bigint from 0 inside each group, however large a group is: places in the order of (group, order), less the
    rows of earlier groups."""
    all_ = indexed(df, [*group, *order], "_idx")
    first = all_.groupBy(*group).agg(F.min("_idx").alias("_first"))
    return all_.join(first, group).withColumn(name, F.col("_idx") - F.col("_first")).drop("_idx", "_first")


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with a column for each of sums (name: SQL of a bigint): its total over the earlier rows of the group, the row itself left
    out. However large a group is, it is summed in ranges, whose totals are added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"_x_{k}": F.expr(v).cast("long") for k, v in sums.items()}).repartitionByRange(n, *group, *order)
    kept = written(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    key = ["_part", *group]
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = kept.groupBy(*key).agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    offset = total.select(*key, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    local = kept.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_x_{k}").over(inside), F.lit(0)) for k in sums})
    joined = local.join(offset, key).withColumns({k: F.col(f"_i_{k}") + F.col(f"_o_{k}") for k in sums})
    return joined.select(*df.columns, *sums)


def seeded(seed: int, *parts: str | Column) -> Column:
    """A hexadecimal order key that any engine with MD5 reproduces."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).cast("binary"))
