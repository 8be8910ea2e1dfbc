"""Resharding by minimum-cost flow: move the fewest bytes from an old layout to new capacities.

The law here is ``rows``: every new shard holds floor or ceil of rows / shards, and which shards get the
larger number is for the flow to choose. The network: a source feeds each old shard its rows; an edge without
cost leads from an old shard to the new one of its number (rows that stay), and parallel edges of rising cost
per row lead to where its rows leave it (the smallest first, so cost is convex); what leaves can enter any new
shard. A new shard passes floor(rows / shards) rows to the sink, and one more through a node that passes as
many such rows as there are larger shards. An old shard's rows leave in three lots: the rows that leave
whatever it is given, the one row that stays if it is given the larger number, and the rest. No cheapest flow
cuts the first or third lot (a row more that leaves makes room for a row more that must be moved), so their
mean cost is as good as each row's own, and the flow moves the fewest bytes of all assignments.

The network has some (old + new) nodes whatever the number of rows; rows learn their place from their rank,
which is counted in ranges, never in one task.

The layout is files: lay_out() writes whole rows to ``folder``/shard=N/, reshard_files() solves the flow for
what lies there and writes the shards anew that gain or lose rows, and laid_out() reads what lies there then.
Rows that stay are written by the task that reads them, only rows that move are shuffled. reshard() is the
plan alone, and rewrite() carries such a plan out in a folder of another writer, by a unique key.

Null texts count no bytes. Rows with equal or null ids and equal texts are rows of their own. An empty table
has no rows to place. reshard() does not read other columns of docs; in files they are kept, under their name
with underscores behind where it is one of the layout's own (``shard``, ``at``, ``slot``). Order inside an old shard is
by size, doc_id and text checksum, larger first; repeated rows as they were read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.shared import written

#: Columns of a layout beside those of its rows: the folder's, the order inside it, and the place that follows from it.
OWN = ("shard", "at", "slot")


@dataclass
class Block:
    """Rows of ``old`` with ranks from ``lo`` to ``hi`` go to ``new``, at slots from ``slot``."""

    old: int
    lo: int
    hi: int
    new: int
    slot: int


class Network:
    """Edges with capacities and whole costs; cheapest() sends all it can by successive shortest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        """The edge's number; its flow is what its reverse, one further, has room for."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, edge: int) -> int:
        return self.room[edge + 1]

    def cheapest(self, source: int, sink: int) -> None:
        height = [0] * len(self.out)  # potentials: costs are not negative at first, and reduced costs never are
        while True:
            far: list[int | None] = [None] * len(self.out)
            far[source], via, heap = 0, [-1] * len(self.out), [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for k in self.out[u]:
                    v, got = self.to[k], d + self.cost[k] + height[u] - height[self.to[k]]
                    if self.room[k] and (far[v] is None or got < far[v]):
                        far[v], via[v] = got, k
                        heapq.heappush(heap, (got, v))
            if far[sink] is None:
                return
            height = [h + (far[sink] if d is None else min(d, far[sink])) for h, d in zip(height, far, strict=True)]
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            amount = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= amount
                self.room[k ^ 1] += amount


@dataclass
class Old:
    """An old shard: its rows and bytes, and of its rows in order the one at rank floor(rows / shards), and what the larger ones before it weigh."""

    rows: int
    total: int
    edge: int = 0
    before: int = 0


def solve(olds: dict[int, Old], shards: int) -> list[Block]:
    """Blocks that cover every rank of every old shard once; slots are gapless."""
    ids = sorted(olds)
    low, extra = divmod(sum(o.rows for o in olds.values()), shards)
    n = len(ids)
    source, sink, larger, at_old, left, new = 0, 1, 2, 3, 3 + n, 3 + 2 * n
    net = Network(3 + 2 * n + shards)
    stay, go = {}, {}
    for k, i in enumerate(ids):
        o = olds[i]
        net.edge(source, at_old + k, o.rows)
        here = i < shards
        if here:
            stay[i] = net.edge(at_old + k, new + i, o.rows)
        if here and o.rows > low:
            forced, rest = o.rows - low - 1, low
            after = o.total - o.before - o.edge
            for rows, cost in ((forced, after // max(1, forced)), (1, o.edge), (rest, -(-o.before // max(1, rest)))):
                net.edge(at_old + k, left + k, rows, cost)
        else:
            net.edge(at_old + k, left + k, o.rows, o.total // max(1, o.rows))
        for j in range(shards):
            go[i, j] = net.edge(left + k, new + j, o.rows)
    for j in range(shards):
        net.edge(new + j, sink, low)
        net.edge(new + j, larger, 1)
    net.edge(larger, sink, extra)
    net.cheapest(source, sink)
    blocks, slot = [], [0] * shards
    for i in ids:
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):  # what stays is the front of the order: the largest rows
            if rows := net.flow(go[i, j]) + (net.flow(stay[i]) if i == j else 0):
                blocks.append(Block(i, at, at + rows, j, slot[j]))
                at += rows
                slot[j] += rows
    return blocks


def ranked(rows: DataFrame, shard: str, order: list[Column], parts: int) -> DataFrame:
    """rows with ``rank``, gapless from 0 in each shard: range partitions are sorted alone and shifted by what lies before them.

    Only (range, shard) counts come to the driver: ``parts`` + shards of them at most.
    """
    dealt = written(rows.repartitionByRange(parts, F.col(shard), *order).sortWithinPartitions(F.col(shard), *order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return numbered(dealt, shard, "_at", "rank").drop("_at")


def numbered(rows: DataFrame, shard: str, at: str, name: str) -> DataFrame:
    """rows with their place in the shard, gapless from 0 by ``at``: numbers of monotonically_increasing_id() over range partitions, or places themselves."""
    counts = rows.groupBy(F.shiftright(at, 33).cast("int").alias("_part"), shard).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).collect()
    before, seen = [], {}
    for r in sorted(counts, key=lambda r: r["_part"]):
        before.append((r["_part"], r[shard], r["first"], seen.get(r[shard], 0)))
        seen[r[shard]] = seen.get(r[shard], 0) + r["n"]
    shift = rows.sparkSession.createDataFrame(before, f"_part int, {shard} int, _first long, _before long")
    there = rows.withColumn("_part", F.shiftright(at, 33).cast("int"))
    return there.join(F.broadcast(shift), ["_part", shard]).withColumn(name, F.col(at) - F.col("_first") + F.col("_before")).drop("_part", "_first", "_before")


def old_layout(doc_id: Column, shards: int) -> Column:
    """Where a row was: by checksum of its id."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % shards).cast("int")


def reshard(docs: DataFrame, shards: int = 40, old_shards: int = 32, overhead: int = 16, old: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, moved: the plan for every row. ``old``: where a row was (never null)."""
    was = old_layout(F.col("doc_id"), old_shards) if old is None else old.cast("int")
    rows = docs.select("doc_id", size(overhead).alias("size"), checksum().alias("text_crc32"), was.alias("old_shard"))
    # written, so that the number which tells repeated rows apart, and spreads them over ranges, stays the same
    rows = written(rows.withColumn("_nth", F.monotonically_increasing_id()), "rows")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), old_shards)
    rows = ranked(rows, "old_shard", [F.desc("size"), F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("_nth")], parts)
    return placed(rows, blocks(rows, shards)).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", (F.col("old_shard") != F.col("shard")).alias("moved"))


def size(overhead: int = 16) -> Column:
    return (F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) + overhead).cast("long")


def checksum() -> Column:
    return F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def blocks(rows: DataFrame, shards: int) -> DataFrame:
    """What the flow decides for rows (with size, old_shard and rank). A cheapest flow's edges that carry rows form a forest, so there are few blocks."""
    low = rows.count() // shards
    got = rows.groupBy("old_shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"),
        F.coalesce(F.max(F.when(F.col("rank") == low, F.col("size"))), F.lit(0)).alias("edge"), F.coalesce(F.sum(F.when(F.col("rank") < low, F.col("size"))), F.lit(0)).alias("before"),
    )
    olds = {r["old_shard"]: Old(r["n"], r["b"], r["edge"], r["before"]) for r in got.collect()}
    return rows.sparkSession.createDataFrame([(b.old, b.lo, b.hi, b.new, b.slot) for b in solve(olds, shards)], "_old int, _lo long, _hi long, shard int, _start long")


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with old_shard and rank) and their shard and slot: a row keeps the block that holds its rank."""
    there = rows.join(F.broadcast(plan), (F.col("old_shard") == F.col("_old")) & (F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
    return there.withColumn("slot", F.col("_start") + F.col("rank") - F.col("_lo")).drop("_old", "_lo", "_hi", "_start")


def kept_names(columns: list[str]) -> list[str]:
    """The names that columns of documents have in a layout."""
    taken, out = {c.lower() for c in columns} | set(OWN), []
    for c in columns:
        name = c
        while name.lower() in OWN or (name != c and name.lower() in taken):
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lay_out(docs: DataFrame, folder: str, shards: int = 32, overhead: int = 16, old: Column | None = None) -> StructType:
    """Write every row of docs whole to ``folder``/shard=N/, N by ``old`` (never null) or by checksum of its id; returns the files' schema."""
    spark = docs.sparkSession
    was = old_layout(F.col("doc_id"), shards) if old is None else old.cast("int")
    # rows go as one struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("doc"), was.alias("shard"), size(overhead).alias("size"), F.col("doc_id").alias("id"), checksum().alias("crc"), F.monotonically_increasing_id().alias("nth"))
    order = [F.asc("shard"), F.desc("size"), F.asc_nulls_first("id"), F.asc("crc"), F.asc("nth")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("shard", F.monotonically_increasing_id().alias("at"), "doc.*").toDF("shard", "at", *kept_names(docs.columns))
    dealt.write.partitionBy("shard").parquet(folder)
    return dealt.schema


def lying(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """doc (a struct), shard and slot of the rows that lie in ``folder`` now."""
    rows = spark.read.schema(schema).parquet(folder).select(F.struct(*[F.col(f"`{n}`") for n in schema.names[2:]]).alias("doc"), "shard", "at")
    return numbered(rows, "shard", "at", "slot").drop("at")


def laid_out(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows that lie in ``folder`` now, with their shard and slot."""
    return lying(spark, folder, schema).select("doc.*", "shard", "slot")


def reshard_files(spark: SparkSession, folder: str, schema: StructType, shards: int = 40, overhead: int = 16) -> list[int]:
    """Bring the layout in ``folder`` to ``shards`` shards, moving the fewest bytes; returns the shards whose files changed.

    The rows of a shard must lie as lay_out() puts them, the largest first; then any number of shards may come of
    them. A shard that only keeps its rows is not written.
    """
    rows = lying(spark, folder, schema).select("doc", F.col("shard").alias("old_shard"), F.col("slot").alias("rank"))
    plan = blocks(rows.select("doc.text", "old_shard", "rank").withColumn("size", size(overhead)).drop("text"), shards)
    touched = sorted({k for r in plan.where("_old != shard").collect() for k in (r["_old"], r["shard"])})
    if not touched:
        return []
    made = f"{folder}/_made"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(touched))
    new = placed(rows, plan).where(F.col("shard").isin(touched)).withColumnRenamed("slot", "at")
    moved = F.col("old_shard") != F.col("shard")
    for part in (new.where(~moved), new.where(moved).repartitionByRange(parts, "shard", "at")):
        # Spark's cleaner removes files of shuffles that nothing refers to: the layout's own, when its listeners are done with it
        spark.sparkContext._jvm.System.gc()
        part.sortWithinPartitions("shard", "at").select("shard", "at", "doc.*").write.mode("append").partitionBy("shard").parquet(made)
    swap(spark, folder, made, touched)
    return touched


def rewrite(spark: SparkSession, plan: DataFrame, folder: str, key: str = "doc_id") -> list[int]:
    """Bring ``folder``/shard=N/ from the old layout to the plan's; returns the shards whose files changed.

    Only shards that gain or lose rows are read and written; the files of all others stay as they are. New
    files are written whole beside the old ones, one task for each stretch of slots, and put in place shard by
    shard, so nothing is lost whenever a task or the job ends early: until a shard is put in place its old files
    are there, and after that they lie in ``folder``/_before until all is done. ``key`` must be unique and not
    null, else rows could not be told apart: ValueError. Read ``folder`` anew afterwards.
    """
    if not plan.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is not unique")
    moved = plan.where("moved")
    touched = sorted({r[0] for r in moved.select("old_shard").union(moved.select("shard")).distinct().collect()})
    if not touched:
        return []
    here = plan.where(F.col("shard").isin(touched)).select(key, F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    old = spark.read.option("basePath", folder).parquet(folder).where(F.col("shard").isin(touched))
    columns = [c for c in old.columns if c != "shard"]
    made = f"{folder}/_made"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(touched))
    rows = old.drop("shard").join(here, key).select(*columns, F.col("_shard").alias("shard"), "_slot")
    rows.repartitionByRange(parts, "shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.mode("overwrite").partitionBy("shard").parquet(made)
    swap(spark, folder, made, touched)
    return touched


def swap(spark: SparkSession, folder: str, made: str, touched: list[int]) -> None:
    """Put the touched shards of ``made`` in the place of those in ``folder``, shard by shard."""
    before = f"{folder}/_before"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(before))
    for k in touched:
        name = f"shard={k}"
        if fs.exists(path(f"{folder}/{name}")):
            fs.rename(path(f"{folder}/{name}"), path(f"{before}/{name}"))
        if fs.exists(path(f"{made}/{name}")):
            fs.rename(path(f"{made}/{name}"), path(f"{folder}/{name}"))
    fs.delete(path(made), True)
    fs.delete(path(before), True)
