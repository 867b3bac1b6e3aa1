"""Sharding by fixed virtual slots.

A record's slot is a hash of its id modulo a fixed number of slots. Bytes are summed per slot, and a versioned map,
one small row set per version, says which shard holds each slot. Rebalancing edits the map, never the hash: growing
by a shard moves just enough slots into the new one. A stored map is read again and only ever gets new versions; a run over
the same bytes adds none, so it moves nothing.

Defined cases: a null id is a key like any other (all such rows share a slot), a null text has no bytes, equal ids
share a slot and so a shard, an empty table gives no rows, other columns pass through unless `assign` makes a column of
that name itself. Places are numbered by slot and a part of the texts' checksums, so many rows of one id do not meet in one task
unless their texts are equal too.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import const_array, shared_dir, written

SLOTS = 4096
OVERHEAD = 16
PARTS = 16
EVEN = 1.02
MADE = ("size", "text_crc32", "vslot", "shard")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Virtual slot: the first 60 bits of md5 over the id as text, modulo the number of slots (a power of two or not)."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


@dataclass
class SlotMap:
    """shards[v] is the shard of each slot at version v; `slots` entries, whatever the input's size."""

    slots: int
    versions: list[list[int]] = field(default_factory=list)

    @classmethod
    def balanced(cls, sizes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """Largest slot first, always to the lightest shard; empty slots then even out the counts."""
        heap, at = [(0, 0, s) for s in range(shards)], [0] * slots
        for slot in sorted(range(slots), key=lambda x: (-sizes.get(x, 0), x)):
            load, n, shard = heapq.heappop(heap)
            at[slot] = shard
            heapq.heappush(heap, (load + sizes.get(slot, 0), n + 1, shard))
        return cls(slots, [at])

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def loads(self, sizes: dict[int, int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for slot, shard in enumerate(self.current):
            out[shard] = out.get(shard, 0) + sizes.get(slot, 0)
        return out

    def grow(self, sizes: dict[int, int]) -> SlotMap:
        """A version with one more shard: slots leave the heaviest shard for the new one until it has its share."""
        at, loads = list(self.current), self.loads(sizes)
        new, share = max(at) + 1, sum(sizes.values()) / (max(at) + 2)
        own: dict[int, list[int]] = {}
        for slot in sorted(range(self.slots), key=lambda x: (sizes.get(x, 0), -x)):
            own.setdefault(at[slot], []).append(slot)
        got = 0
        heap = [(-v, s) for s, v in loads.items()]
        heapq.heapify(heap)
        while heap:
            load, shard = heapq.heappop(heap)
            fits = next((x for x in reversed(own[shard]) if 0 < sizes.get(x, 0) <= share - got), None)
            if fits is None:
                continue
            own[shard].remove(fits)
            at[fits], got = new, got + sizes[fits]
            heapq.heappush(heap, (load + sizes[fits], shard))
        return SlotMap(self.slots, [*self.versions, at])

    def rebalance(self, sizes: dict[int, int], most: float = EVEN) -> SlotMap:
        """A version in which slots left the heaviest shard for the lightest while it exceeded `most` times the mean; this
        map where none moves."""
        at, loads = list(self.current), self.loads(sizes)
        mean, moved = sum(loads.values()) / len(loads), False
        for _ in range(self.slots):
            high, low = max(loads, key=loads.get), min(loads, key=loads.get)
            room = (loads[high] - loads[low]) // 2
            fits = max((x for x in range(self.slots) if at[x] == high and 0 < sizes.get(x, 0) <= room), key=lambda x: sizes[x], default=None)
            if loads[high] <= most * mean or fits is None:
                break
            at[fits], moved = low, True
            loads[high], loads[low] = loads[high] - sizes[fits], loads[low] + sizes[fits]
        return SlotMap(self.slots, [*self.versions, at]) if moved else self

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, vslot, shard): what is stored."""
        packed = F.array(*[const_array(at, "int") for at in self.versions])
        return (
            spark.range(1).select(F.posexplode(packed).alias("version", "_at"))
            .select("version", F.posexplode("_at").alias("vslot", "shard"))
        )

    def save(self, spark: SparkSession, path: str | None = None) -> str:
        """Adds the versions that the folder does not have yet; without a path, a folder of its own."""
        path = path or f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
        have = len(self.load(spark, path).versions) if _exists(spark, path) else 0
        if have < len(self.versions):
            self.table(spark).filter(F.col("version") >= have).write.mode("append").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        rows = spark.read.parquet(path).orderBy("version", "vslot").collect()
        versions: dict[int, list[int]] = {}
        for r in rows:
            versions.setdefault(r.version, []).append(r.shard)
        return cls(len(versions[0]), [versions[v] for v in sorted(versions)])

    @classmethod
    def stored(cls, spark: SparkSession, sizes: dict[int, int], shards: int, path: str | None = None, slots: int = SLOTS) -> SlotMap:
        """The map of a folder, grown to so many shards and rebalanced where it has to be, as new versions; else a new one, which is stored."""
        if path and _exists(spark, path):
            found = cls.load(spark, path)
            while max(found.current) + 1 < shards:
                found = found.grow(sizes)
            found = found.rebalance(sizes)
        else:
            found = cls.balanced(sizes, shards, slots)
        found.save(spark, path)
        return found

    def shard(self, vslot: Column, version: int = -1) -> Column:
        return F.get(const_array(self.versions[version], "int"), vslot)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def slot_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> dict[int, int]:
    """Bytes per slot, `slots` rows at most."""
    got = df.groupBy(slot_of(F.col(key), slots).alias("s")).agg(F.sum(record_size(F.col(text))).alias("n")).collect()
    return {r.s: r.n for r in got}


def assign(df: DataFrame, shards: int, slot_map: SlotMap | None = None, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """df with size, vslot and shard, under slot_map or one balanced by this table's bytes."""
    slot_map = slot_map or SlotMap.balanced(slot_sizes(df, key, text, slots), shards, slots)
    df = df.drop(*[c for c in df.columns if c.lower() in MADE])
    vslot = slot_of(F.col(key), slot_map.slots)
    return df.withColumns({"size": record_size(F.col(text)), "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))}).withColumn("vslot", vslot).withColumn("shard", slot_map.shard(F.col("vslot")))


def positions(records: DataFrame, slot_map: SlotMap, key: str = "doc_id") -> DataFrame:
    """records (as `assign` returns them) with `slot`, the gapless place in the shard.

    Records are numbered inside their part of a virtual slot; each part's first number is the count of records in the
    earlier ones of its shard. So no task orders more than a part.
    """
    part = (F.col("text_crc32") % PARTS).cast("int")
    counts = {(r.vslot, r.p): r.n for r in records.groupBy("vslot", part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, so_far = [0] * (slot_map.slots * PARTS), {}
    for v, shard in enumerate(slot_map.current):
        for p in range(PARTS):
            first[v * PARTS + p] = so_far.get(shard, 0)
            so_far[shard] = so_far.get(shard, 0) + counts.get((v, p), 0)
    order = W.partitionBy("vslot", part).orderBy(key, "size", "text_crc32")
    at = F.get(const_array(first), F.col("vslot") * PARTS + part)
    return records.withColumn("slot", at + F.row_number().over(order) - 1)


def shards(docs: DataFrame, n: int = 40, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot. path: where the map is kept."""
    sized = written(docs.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id")).alias("vslot")), "shard-sizes")
    sizes = {r.vslot: r.n for r in sized.groupBy("vslot").agg(F.sum("size").alias("n")).collect()}
    slot_map = SlotMap.stored(docs.sparkSession, sizes, n, path)
    out = positions(sized.withColumn("shard", slot_map.shard(F.col("vslot"))), slot_map)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
