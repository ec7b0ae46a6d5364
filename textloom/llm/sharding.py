"""Sharding by fixed virtual slots, in DataFrame functions alone.

A record is hashed into one of SLOTS slots for good: by its id, its text's checksum and, as records alike are told apart by a
number from 0 on, that number. So each copy of a record has a slot of its own, and no slot is hot because one record is
repeated. A stored, versioned table says which shard each slot is in. Bytes are summed up for each slot; only these SLOTS
sums ever come to the driver. Rebalancing, or another shard, edits the newest version: it moves no more slots than it must, and the edited
table is stored as the next version beside the old ones. A record's shard follows from its slot and the map alone: neither the
order nor the partitions in which rows are read matter.

Defined results: a null text has size 1 (no bytes) and checksum 0; null ids are an id like any other; records alike give as many rows;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common

SLOTS, SHARDS = 4096, 16
#: Rebalancing stops when the largest shard is over the smallest by less than this share of the mean.
CLOSE = 0.001
#: Records alike that one task makes at a time.
ALIKE = 100_000


@dataclass
class SlotMap:
    """Versions of the table from slots to shards; each is kept."""

    versions: list[list[int]] = field(default_factory=list)
    stored: int = 0

    @classmethod
    def fresh(cls, slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        return cls([[s % shards for s in range(slots)]])

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The versions stored at path; None if there are none."""
        if not common.exists(spark, path):
            return None
        versions: dict[int, dict[int, int]] = {}
        for x in spark.read.parquet(path).collect():  # SLOTS rows a version
            versions.setdefault(x.version, {})[x.virtual_slot] = x.shard
        found = [[to[s] for s in range(len(to))] for _, to in sorted(versions.items())]
        return cls(found, len(found))

    def save(self, spark: SparkSession, path: str) -> None:
        """Stores the versions that are not stored yet; a version once written is never changed."""
        for v in range(self.stored, len(self.versions)):
            rows = spark.createDataFrame(list(enumerate(self.versions[v])), "virtual_slot int, shard int")
            rows.coalesce(1).write.parquet(f"{path}/version={v}")
        self.stored = len(self.versions)

    @property
    def now(self) -> list[int]:
        return self.versions[-1]

    @property
    def shards(self) -> int:
        return max(self.now) + 1

    def _members(self, weight: list[int]) -> tuple[list[list[tuple[int, int]]], list[int]]:
        """(weight, slot) of each shard's slots, in order, and the shards' loads."""
        members: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for s, d in enumerate(self.now):
            members[d].append((weight[s], s))
        return [sorted(m) for m in members], [sum(w for w, _ in m) for m in members]

    def rebalance(self, weight: list[int]) -> SlotMap:
        """A version in which shards weigh about the same: slots move, or change places, from the heaviest shard to the lightest.

        No version is added if they do already, or no move helps.
        """
        members, load = self._members(weight)
        to, close = list(self.now), CLOSE * sum(load) / len(load)
        for _ in range(len(to)):
            a, b = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
            gap = load[a] - load[b]
            if gap <= close:
                break
            there, back = self._move(members[a], members[b], gap)
            if there is None:
                break
            for x, y, one in ((a, b, there), (b, a, back)):
                if one is not None:
                    members[x].remove(one)
                    insort(members[y], one)
                    load[x] -= one[0]
                    load[y] += one[0]
                    to[one[1]] = y
        if to != self.now:
            self.versions.append(to)
        return self

    @staticmethod
    def _move(full: list[tuple[int, int]], free: list[tuple[int, int]], gap: int):
        """The slot of full to move, and one of free to take in its place or None, that leave the least gap; None, None if none makes it less."""
        best, there, back = gap, None, None
        for one, other in ((0, None), *((w, (w, s)) for w, s in free)):
            k = bisect_left(full, (one + gap / 2,))
            for x in full[max(0, k - 1) : k + 1]:
                left = abs(2 * (x[0] - one) - gap)
                if left < best and x[0] > one:
                    best, there, back = left, x, other
            if other is None and best <= gap / 2:  # a move alone is enough
                break
        return there, back

    def grow(self, weight: list[int]) -> SlotMap:
        """A version with one more shard: slots move only into it, from the heaviest shard each time."""
        members, load = self._members(weight)
        to, goal, got = list(self.now), sum(load) / (len(load) + 1), 0
        while got < goal:
            a = max(range(len(load)), key=load.__getitem__)
            k = bisect_left(members[a], (goal * (1 + CLOSE) - got, len(to))) - 1
            if k < 0:
                break
            w, s = members[a].pop(k)
            load[a] -= w
            got += w
            to[s] = len(load)
        if len(load) not in to:  # a shard of its own even if nothing fits
            to[min(range(len(to)), key=lambda s: (weight[s], s))] = len(load)
        self.versions.append(to)
        return self


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, size, text_crc32, k (its number among rows alike) and virtual slot.

    Rows alike are counted before the shuffle and made again behind it, many of them in parts of ALIKE.
    """
    bytes_of = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col), (F.octet_length(bytes_of) + 1).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"))
    names = [id_col, "size", "text_crc32"]
    counted = rows.groupBy(*names).agg(F.count("*").alias("n"))
    few = counted.where(F.col("n") <= ALIKE).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    many = counted.where(F.col("n") > ALIKE).select(*names, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long"))).alias("from"))
    many = many.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "from")
    many = many.select(*names, F.explode(F.sequence("from", F.least(F.col("from") + ALIKE, "n") - 1)).alias("k"))
    slot = F.pmod(F.xxhash64(id_col, "text_crc32", "k"), F.lit(SLOTS)).cast("int")
    return few.unionByName(many).withColumn("virtual_slot", slot)


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, map_path: str | None = None, rebalance: bool = True) -> DataFrame:
    """Each row's id, size, checksum, virtual slot, shard, and place in the shard, counted from 0 without gaps.

    The map at map_path is taken, given more shards if it has fewer, edited if rebalance and needed, and stored there as a new version;
    where there is none (or map_path is None, for a map in the shared folder that lasts as long as the program) a fresh one is made.
    """
    spark = df.sparkSession
    rows = common.written(records(df, id_col, text_col), "shard-rows")
    weight, count = [0] * SLOTS, [0] * SLOTS
    for x in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():  # SLOTS rows at most
        weight[x.virtual_slot], count[x.virtual_slot] = x.bytes, x.n
    path = map_path or common.kept_path(spark, f"shard-map-{uuid.uuid4().hex}")
    slot_map = SlotMap.read(spark, path) or SlotMap.fresh(SLOTS, shards)
    if slot_map.shards > shards:
        raise ValueError(f"the map at {path} has {slot_map.shards} shards")
    while slot_map.shards < shards:
        slot_map.grow(weight)
    if rebalance:
        slot_map.rebalance(weight)
    slot_map.save(spark, path)
    return placed(rows, slot_map.now, count, id_col)


def placed(rows: DataFrame, to: list[int], count: list[int], id_col: str) -> DataFrame:
    start, offsets = [0] * (max(to) + 1), []
    for s, d in enumerate(to):
        offsets.append((s, d, start[d]))
        start[d] += count[s]
    where = rows.sparkSession.createDataFrame(offsets, "virtual_slot int, shard int, start long")
    order = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size", "k")
    numbered = rows.withColumn("__n", F.row_number().over(order)).join(F.broadcast(where), "virtual_slot")  # SLOTS rows
    return numbered.select(id_col, "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("__n") - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(common.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
