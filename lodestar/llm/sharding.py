"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of slots. Bytes and rows are summed per slot, and a map of
slots to shards, heaviest slot first to the lightest shard, keeps the shards' bytes near
equal. The map is a small table that is stored with a version; rebalancing stores the next
version, in which only some slots have moved, so records never hash anew. Records can be
placed by any stored version.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settle, shared_folder, small

SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long, row_offset long"


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, size, text_crc32, virtual_slot`` of every row; a null text counts as empty.

    The slot hashes id and text, so neither copies of a text nor rows without an id share one,
    and, of rows that are repeated whole, the number of the repeat: so those spread as well.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(id_col, text).alias("_row"),
        F.spark_partition_id().alias("_task"),
    )
    rows = settle(rows, "rows")
    # How many rows of one hash a task has, and where its repeats begin among all of them.
    held = settle(rows.groupBy("_row", "_task").agg(F.count("*").alias("n")), "row-counts")
    many = settle(held.groupBy("_row").agg(F.sum("n").alias("of")).where("of > 1").select("_row"), "repeated")
    slot = F.pmod("_row", F.lit(slots))
    columns = [id_col, "size", "text_crc32"]
    if many.isEmpty():
        return rows.select(*columns, slot.cast("int").alias("virtual_slot"))
    few = small(many)
    before = Window.partitionBy("_row").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = held.join(few, "_row", "left_semi").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_row", "_task").orderBy("size"))  # equal rows
    again = rows.join(few, "_row", "left_semi").withColumn("nth", within - 1).join(first.drop("n"), ["_row", "_task"])
    again = again.withColumn("nth", F.col("nth") + F.col("first"))
    spread = F.when(F.col("nth") > 0, F.pmod(F.xxhash64("_row", "nth"), F.lit(slots))).otherwise(slot)
    return rows.join(few, "_row", "left_anti").select(*columns, slot.cast("int").alias("virtual_slot")).union(
        again.select(*columns, spread.cast("int").alias("virtual_slot"))
    )


def slot_loads(recs: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most as many as there are slots."""
    loads = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return sorted((r.virtual_slot, r.bytes, r["rows"]) for r in loads.collect())


def assign(loads: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard: the heaviest slot first, each to the shard with the fewest bytes so far."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (total + size, shard))
    return placed


def rebalance(loads: list[tuple[int, int, int]], placed: dict[int, int], shards: int) -> dict[int, int]:
    """Edit a map for ``shards`` shards: slots leave shards above the mean for those below it, no other moves.

    Slots of shards that no longer exist, and slots new to the map, go to the lightest shard.
    """
    size = {slot: b for slot, b, _ in loads}
    edited = {slot: placed[slot] for slot in size if placed.get(slot, shards) < shards}
    total = [0] * shards
    held: dict[int, list[int]] = {shard: [] for shard in range(shards)}
    for slot, shard in edited.items():
        total[shard] += size[slot]
        held[shard].append(slot)
    mean = sum(size.values()) / shards
    loose = [slot for slot in size if slot not in edited]
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (size[s], s)):
            if total[shard] - size[slot] < mean:
                break
            total[shard] -= size[slot]
            loose.append(slot)
    heap = [(b, shard) for shard, b in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-size[s], s)):
        b, shard = heapq.heappop(heap)
        edited[slot] = shard
        heapq.heappush(heap, (b + size[slot], shard))
    return edited


def map_table(
    spark: SparkSession, loads: list[tuple[int, int, int]], placed: dict[int, int], version: int
) -> DataFrame:
    """The map as a table, with each slot's first place within its shard; it has a row a slot at most."""
    filled: dict[int, int] = {}
    out = []
    for slot, size, rows in sorted(loads):
        shard = placed[slot]
        out.append((version, slot, shard, size, rows, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + rows
    return spark.createDataFrame(out, MAP_SCHEMA)


def store_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Store a map of one version under ``folder``, which must be shared; a version that is there already raises."""
    version = slot_map.first().version
    slot_map.drop("version").coalesce(1).write.parquet(f"{folder}/version={version}")
    return load_map(slot_map.sparkSession, folder, version)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the last."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(folder)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    found = stored.where(F.col("version") == version).select(*(x.split()[0] for x in MAP_SCHEMA.split(", ")))
    if found.isEmpty():
        raise ValueError(f"no version {version} of the map in {folder}")
    return found


def edit_map(recs: DataFrame, folder: str, shards: int) -> DataFrame:
    """Store the next version of the map for what ``recs`` hold now, rebalanced for ``shards`` shards.

    The map's row a slot at most passes through the driver.
    """
    last = load_map(recs.sparkSession, folder)
    placed = {r.virtual_slot: r.shard for r in last.collect()}
    loads = slot_loads(recs)
    if not loads:
        return last
    version = last.first().version + 1
    return store_map(map_table(recs.sparkSession, loads, rebalance(loads, placed, shards), version), folder)


def place(recs: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place within its shard, gapless from 0.

    Records are ranked within their virtual slot and the slot's offset is added, so no
    task orders a whole shard. The map has a row a slot at most and is broadcast.
    """
    within = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    return (
        recs.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(slot_map.select("virtual_slot", "shard", "row_offset", "version")), "virtual_slot")
        .withColumn("slot", (F.col("row_offset") + F.col("rank")).cast("long"))
        .drop("rank", "row_offset")
    )


def shard(
    docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
):
    """Every row's shard by the law ``bytes``, under the last map stored in ``folder`` edited for these rows, or a first one.

    Returns ``<id_col>, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version``.
    Repeated rows each get a place, and spread over the shards; null ids and texts are placed like any other, very long
    texts too; columns other than id and text are left out; an empty table gives an empty
    result and stores no map. Without ``folder`` the map lies in a new one of the shared folder.
    """
    spark = docs.sparkSession
    recs = settle(records(docs, slots, id_col, text_col), "records")
    loads = slot_loads(recs)
    known = folder is not None
    folder = folder or f"{shared_folder(spark)}/lodestar-slot-maps-{uuid.uuid4().hex}"
    if not loads:
        slot_map = spark.createDataFrame([], MAP_SCHEMA)
    elif known and _stored(spark, folder):
        slot_map = edit_map(recs, folder, shards)
    else:
        slot_map = store_map(map_table(spark, loads, assign(loads, shards), 1), folder)
    return place(recs, slot_map, id_col).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "version",
    )


def _stored(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
