"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Rows hash into ``n_slots`` slots, once and for all.  Bytes and rows are summed
for each slot; a map assigns slots to shards so that shards have nearly equal
bytes.  The map is a small table with versions: a rebalance writes the next
version, in which a slot stays where it is unless its shard would be too full.

Only built-in expressions run here.  The map has ``n_slots`` rows, a fixed
bound, whatever the data; its greedy placement is one fold over that many rows.
Equal rows are counted first and then told apart by a copy number, which is part
of the hash, so copies of one row fill many slots.  A row's position in its
shard is the offset of its slot plus its rank in the slot: no task ever sorts
more than one slot.

Defined results: a null text has no bytes (size 8), an empty one too; very long
texts are hashed whole.  Null ids hash as nulls next to their text.  Equal rows
are interchangeable; equal loads go to the shard with the smaller number.  An
empty table gives an empty table and a map without bytes.  Columns named like
outputs are replaced in ``shard_documents``; ``shard_keys`` reads two columns
only, so others don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialise, quoted, scratch_path, without

N_SLOTS = 8192
OVERHEAD = 8
#: A slot leaves its shard at a rebalance if it would lift it over this share of the mean.
TOLERANCE = 1.02
#: Equal rows that share a slot of ``shard_documents``; more of them take further slots.
COPIES_A_SLOT = 256


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_of(keys: list[Column], n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_stats(rows: DataFrame, slot: str, size: str) -> DataFrame:
    """Bytes and rows of each slot (at most ``n_slots`` rows)."""
    return rows.groupBy(F.col(slot).alias("slot")).agg(
        F.sum(size).alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows")
    )


def place(stats: DataFrame, n_shards: int, previous: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The map (slot, shard, slot_bytes, slot_rows): greedy, largest slot first to the emptiest shard.

    With a ``previous`` map, slots that still fit stay in their shard and only
    the others move.  One row at most for each slot is folded, a fixed number.
    """
    if n_shards < 1:
        raise ValueError("n_shards is 1 or more")
    if previous is None:
        known = stats.withColumn("was", F.lit(None).cast("int"))
    else:
        old = previous.select("slot", F.col("shard").cast("int").alias("was")).filter(F.col("was") < n_shards)
        known = stats.join(F.broadcast(old), "slot", "left")
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("slot_bytes")).alias("b"), "slot", "slot_rows", "was"))
    )
    zeros = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda _: F.lit(0).cast("long"))

    def add(loads: Column, shard: Column, more: Column) -> Column:
        return F.transform(loads, lambda x, i: F.when(i == shard, x + more).otherwise(x))

    one = known.agg(ordered.alias("slots"), (F.sum("slot_bytes") * tolerance / n_shards).alias("cap"))
    empty = F.array().cast("array<struct<slot:int,shard:int,b:bigint,r:bigint>>")
    start = F.struct(zeros.alias("loads"), empty.alias("placed"))

    def entry(e: Column, shard: Column) -> Column:
        return F.array(
            F.struct(e["slot"].alias("slot"), shard.alias("shard"), (-e["b"]).alias("b"), e["slot_rows"].alias("r"))
        )

    def stay(acc: Column, e: Column) -> Column:
        fits = e["was"].isNotNull() & (F.get(acc["loads"], e["was"]) - e["b"] <= F.col("cap"))
        return F.when(
            fits,
            F.struct(
                add(acc["loads"], e["was"], -e["b"]).alias("loads"),
                F.concat(acc["placed"], entry(e, e["was"])).alias("placed"),
            ),
        ).otherwise(acc)

    def move(acc: Column, e: Column) -> Column:
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            add(acc["loads"], to, -e["b"]).alias("loads"), F.concat(acc["placed"], entry(e, to)).alias("placed")
        )

    if previous is None:
        folded = one.select(F.aggregate("slots", start, move).alias("s"))
    else:
        slots_of = lambda entries: F.transform(entries, lambda e: e["slot"])

        def rest(kept: Column) -> Column:
            moving = F.array_except(slots_of(F.col("slots")), slots_of(kept["placed"]))
            return let(moving, lambda m: F.filter("slots", lambda e: F.array_contains(m, e["slot"])))

        folded = one.select(
            let(F.aggregate("slots", start, stay), lambda kept: F.aggregate(rest(kept), kept, move)).alias("s")
        )
    return folded.select(F.explode("s.placed").alias("e")).select(
        F.col("e.slot").alias("slot"), F.col("e.shard").alias("shard"), F.col("e.b").alias("slot_bytes"), F.col("e.r").alias("slot_rows")
    )


class SlotMap:
    """Versions of a slot-to-shard map in one folder: ``version=N`` each, never rewritten."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        whole = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(at, f"{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("version=")) for n in whole)

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise ValueError(f"no map in {self.folder}")
        return self.spark.read.schema("slot int, shard int, slot_bytes long, slot_rows long").parquet(
            f"{self.folder}/version={known[-1] if version is None else version}"
        )

    def rebalance(self, stats: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> int:
        """Writes and names the next version, fitted to the new sizes of the slots."""
        known = self.versions()
        table = place(stats, n_shards, self.read(known[-1]) if known else None, tolerance)
        version = known[-1] + 1 if known else 1
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version={version}")
        return version


def numbered(rows: DataFrame, slot_map: DataFrame, slot: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: the position in the shard, gapless from 0."""
    within = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select(
        F.col("slot").alias(slot), "shard", F.coalesce(F.sum("slot_rows").over(within), F.lit(0)).alias("__gm_offset")
    )
    rank = F.row_number().over(Window.partitionBy(slot).orderBy(*order))
    ranked = rows.withColumn("__gm_rank", rank - 1)
    return (
        ranked.join(F.broadcast(offsets), slot)
        .withColumn("slot", (F.col("__gm_offset") + F.col("__gm_rank")).cast("long"))
        .drop("__gm_offset", "__gm_rank")
    )


def shard_keys(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
    slot_map: SlotMap | None = None,
    next_shards: int | None = None,
) -> DataFrame:
    """One narrow row for each of ``docs``: doc_id, size, text_crc32, vslot, shard and slot.

    With ``next_shards`` the map is rebalanced to that many shards after that, as
    its next version, and ``next_shard`` is a row's shard by it.

    The texts are read once and reduced to keys at once; the keys are counted
    (equal rows together, before the shuffle), expanded by copy number, and kept
    as a table, from which sizes, map and positions follow.
    """
    spark = docs.sparkSession
    text = quoted(text_col)
    keys = docs.select(
        quoted(id_col).alias("doc_id"),
        row_size(text).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    counted = keys.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("m"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    rows = materialise(
        copies.select(
            "doc_id", "size", "text_crc32", "copy", "h", slot_of([F.col("doc_id"), F.col("h"), F.col("copy")], n_slots).alias("vslot")
        ),
        "shard-keys",
    )
    store = slot_map or SlotMap(spark, scratch_path(spark, "slot-map"))
    stats = slot_stats(rows, "vslot", "size")
    version = store.rebalance(stats, n_shards)
    order = [F.col(c) for c in ("doc_id", "text_crc32", "h", "copy")]
    found = numbered(rows, store.read(version), "vslot", order).select(
        "doc_id", "size", "text_crc32", "vslot", "shard", "slot"
    )
    if next_shards is None:
        return found
    after = store.read(store.rebalance(stats, next_shards)).select(F.col("slot").alias("vslot"), F.col("shard").alias("next_shard"))
    return found.join(F.broadcast(after), "vslot").select(*found.columns, "next_shard")


def shard_documents(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
    slot_map: SlotMap | None = None,
) -> DataFrame:
    """``docs`` with vslot (the virtual slot) and shard.

    A row's slot follows from its id, its text and a group number, whatever the
    other rows, the number of shards or the layout of files: up to
    ``COPIES_A_SLOT`` equal rows are group 0, more of them are dealt out over as
    many groups as they fill.  Equal rows are interchangeable; which of them has
    which group follows from its place.  The documents are read twice, for the
    counts and for the rows, and only keys are shuffled; the repeated keys are
    joined, and broadcast only where Spark measures them small.
    """
    spark = docs.sparkSession
    docs = without(docs, ["vslot", "shard"])
    store = slot_map or SlotMap(spark, scratch_path(spark, "slot-map"))
    keyed = docs.withColumns({"__gm_id": quoted(id_col), "__gm_h": F.xxhash64(quoted(text_col))})
    size = row_size(quoted(text_col))
    counted = materialise(
        keyed.groupBy("__gm_id", "__gm_h").agg(F.count(F.lit(1)).alias("m"), F.first(size).alias("size")), "row-counts"
    ).withColumn("ways", F.ceil(F.col("m") / COPIES_A_SLOT))
    # equal rows fall into the groups by turns, so these sums are exact but for a few rows of the hot ones
    groups = counted.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    rows_of = F.floor(F.col("m") / F.col("ways")) + (F.col("g") < F.col("m") % F.col("ways")).cast("long")
    stats = groups.groupBy(slot_of([F.col("__gm_id"), F.col("__gm_h"), F.col("g")], n_slots).alias("slot")).agg(
        F.sum(rows_of * F.col("size")).alias("slot_bytes"), F.sum(rows_of).alias("slot_rows")
    )
    # as a table, whose size Spark knows: it is broadcast if that is small, so that no text is shuffled
    hot = materialise(
        counted.filter("ways > 1").select(F.col("__gm_id").alias("__gm_i"), F.col("__gm_h").alias("__gm_j"), F.col("ways").alias("__gm_ways")),
        "hot-rows",
    )
    same = F.col("__gm_id").eqNullSafe(F.col("__gm_i")) & (F.col("__gm_h") == F.col("__gm_j"))
    group = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__gm_ways")), F.lit(0)).cast("long")
    keyed = (
        keyed.join(hot, same, "left")
        .withColumn("__gm_g", group)
        .withColumn("vslot", slot_of([F.col("__gm_id"), F.col("__gm_h"), F.col("__gm_g")], n_slots))
    )
    table = store.read(store.rebalance(stats, n_shards)).select(F.col("slot").alias("vslot"), "shard")
    # the map has n_slots rows at most
    return keyed.join(F.broadcast(table), "vslot", "left").withColumn("shard", F.coalesce("shard", F.pmod("vslot", F.lit(n_shards)))).select(*[quoted(c) for c in docs.columns], "vslot", "shard")
