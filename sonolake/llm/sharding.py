"""Sharding over fixed virtual slots (native).

Records are hashed by (doc_id, text) into SLOTS virtual slots; bytes are summed per slot; a stored, versioned map sends each slot to a
shard. The map is a Parquet table in a folder with one subfolder per version. A reader takes the newest version; where there is none,
the first is made from the slots' bytes: slots are dealt to the shard with the fewest bytes so far, largest first, so that sizes come
out near equal. Rebalancing publishes an edit as the next version: slots move as a whole, records are never hashed anew, and earlier
versions stay. The query keeps its map in a folder of its own.

Nulls: a null text has no bytes (size 8, CRC 0); a null doc_id is hashed like a value of its own. Equal rows are separate records with
neighbouring places; they share a slot, so the laws hold as far as no single row is repeated for more than a slot's share. Rows of one
doc_id with other texts are spread. An empty table gives an empty result and a map without bytes. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonolake.tables import shared_dir

SLOTS = 4096
SHARDS = 24


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: all that later steps need; the text goes no further than the scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, slot_bytes, slot_rows of every slot, empty ones too."""
    own = rows.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    none = F.lit(0).cast("long")
    return every.join(own, "vslot", "left").select("vslot", F.coalesce("slot_bytes", none).alias("slot_bytes"), F.coalesce("slot_rows", none).alias("slot_rows"))


def slot_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """vslot, shard. One row of SLOTS entries is folded, whatever the input's size."""
    items = F.reverse(F.array_sort(F.collect_list(F.struct("slot_bytes", (-F.col("vslot")).alias("neg")))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("dealt"))

    def deal(acc, item):
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda x, i: F.when(i == at - 1, x + item["slot_bytes"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(acc["dealt"], F.array(at - 1)).alias("dealt"))

    folded = sizes.agg(items.alias("items")).select("items", F.aggregate("items", start, deal)["dealt"].alias("dealt"))
    return folded.select(F.explode(F.arrays_zip("items", "dealt")).alias("z")).select((-F.col("z.items.neg")).cast("int").alias("vslot"), F.col("z.dealt").alias("shard"))


def publish(mapping: DataFrame, path: str, version: int) -> None:
    """Stores a map as a version; a version that is there already stays as it is and raises an error."""
    mapping.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """vslot, shard, version of the newest (or that) version; None where there is no map."""
    try:
        found = spark.read.schema("vslot int, shard int, version int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = version or found.agg(F.max("version").alias("v")).first().v
    return found.where(F.col("version") == newest) if newest else None


def grow(rows: DataFrame, path: str) -> int:
    """Publishes the edit of the stored map for one more shard, by the sizes of rows (as records() gives them), and returns its version."""
    old = read_map(rows.sparkSession, path)
    top = old.agg(F.max("shard").alias("s"), F.max("version").alias("v")).first()
    publish(rebalance(old.join(slot_sizes(rows), "vslot"), top.s + 2), path, top.v + 1)
    return top.v + 1


def rebalance(mapping: DataFrame, shards: int) -> DataFrame:
    """vslot, shard of an edit of a map with sizes (vslot, slot_bytes, shard), for one more shard (number shards - 1): each old shard gives slots, smallest first, while its
    bytes stay at or above the new fair share; nothing moves between old shards."""
    total = Window.partitionBy(F.lit(0))
    w = Window.partitionBy("shard").orderBy("slot_bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("slot_bytes").over(total) / F.lit(shards)
    gives = F.sum("slot_bytes").over(Window.partitionBy("shard")) - F.sum("slot_bytes").over(w) >= share
    return mapping.select("vslot", F.when(gives, F.lit(shards - 1)).otherwise(F.col("shard")).alias("shard"))


def assign(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each record's shard and its place in it: the rows of the shard's earlier slots plus its place in its own slot."""
    before = F.coalesce(F.sum("slot_rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = slot_sizes(rows).join(mapping, "vslot").select("vslot", "shard", "version", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(starts), "vslot").withColumn("slot", (F.col("start") + F.col("inside")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """The digest of every record under the newest map in that folder; where there is none, one for so many shards is made there."""
    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = records(docs)
    if (mapping := read_map(spark, path)) is None:
        publish(slot_map(slot_sizes(rows), shards), path, 1)
        mapping = read_map(spark, path)
    placed = assign(rows, mapping)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
