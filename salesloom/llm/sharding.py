"""K-d tree sharding: weighted medians along the widest metadata dimension.

Points are groups of equal texts, so copies go to one shard. A group above `GROUP_SHARE` of
a shard counts as several points, which may part: a third of all rows in one group does
not bend the shards. A point weighs the bytes of its documents and lies where its least
document's metadata put it. Dimensions are scaled to the table's range: numbers linearly,
strings by their first bytes after the prefix that all values share; nulls lie at the far
end.

From the root, each node is cut across the dimension in which its points, by weight,
spread widest (variance), until the leaves reach the target bytes. The cut is the weighted
median (for an odd number of leaves the quantile that gives each leaf its share), found
without a sort: all nodes of a level add up their bytes in slices of the range of keys,
step into the slice that holds the median and slice that again. A key carries a hash of
the group below the coordinate, so points of one place part too. A level costs one
aggregate for the spreads and at most `KEY_BITS / SLICE_BITS` for the cuts, and the driver
holds a row for each node.

The documents are stored once with a row number, by which they meet their shard and slot.
Slots number a shard's documents from 0 by doc_id (null last), in ranges of the sorted table.

SQL functions only. Null texts have no bytes, so size 1, and are copies of empty ones.
Repeated rows are copies that share a doc_id. An empty table gives an empty one. The
documents keep their columns; those named like an added one (size, shard, slot) are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from salesloom.llm.common import Scratch, free_name, text_bytes

DIMENSIONS = ("source", "lang", "doc_id")
#: Of a shard's bytes, what one group of copies may have and still be kept together.
GROUP_SHARE = 0.005

COORDINATE_BITS, HASH_BITS = 30, 32
KEY_BITS = COORDINATE_BITS + HASH_BITS
SLICE_BITS = 12
#: Bits of a coordinate that count for the spread.
SPREAD_BITS = 15
#: Bytes of a string that make its coordinate.
STRING_BYTES = 6


def _values(spark: SparkSession, rows: list[tuple[int, ...]], names: str) -> DataFrame:
    """A literal table of long columns, whose size the optimizer knows."""
    lines = ", ".join("(" + ", ".join(f"{value}L" for value in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({names})")


def _number(column: Column, kind, shared: int) -> Column:
    """A dimension's value as a number; a string's by its bytes after the shared ones."""
    if isinstance(kind, BooleanType):
        return column.cast("int").cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, TimestampType | TimestampNTZType):
        return column.cast("timestamp").cast("double")
    if isinstance(kind, NumericType):
        value = column.cast("double")
        return F.when(F.isnan(value), None).otherwise(value)
    data = F.substring(column.cast("string").cast("binary"), shared + 1, STRING_BYTES)
    return F.conv(F.rpad(F.hex(data), 2 * STRING_BYTES, "0"), 16, 10).cast("double")


def _shared(least: str | None, most: str | None) -> int:
    """Bytes that the least and the greatest string begin with, and so all between them."""
    a, b = (least or "").encode(), (most or "").encode()
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def coordinates(rows: DataFrame, dimensions: list[str]) -> list[Column]:
    """Each dimension's column scaled to 0 .. 2**COORDINATE_BITS - 1 over the table."""
    kinds = [rows.schema[name].dataType for name in dimensions]
    texts = [F.col(name).cast("string") for name in dimensions]
    ends = rows.agg(*(f(text).alias(f"{f.__name__}{k}") for k, text in enumerate(texts) for f in (F.min, F.max))).first()
    numbers = [_number(F.col(name), kind, _shared(ends[f"min{k}"], ends[f"max{k}"])) for k, (name, kind) in enumerate(zip(dimensions, kinds))]
    ends = rows.agg(*(f(number).alias(f"{f.__name__}{k}") for k, number in enumerate(numbers) for f in (F.min, F.max))).first()
    far = (1 << COORDINATE_BITS) - 1
    scaled = []
    for k, number in enumerate(numbers):
        least, most = ends[f"min{k}"], ends[f"max{k}"]
        if least is None or not most > least or most - least == float("inf"):
            scaled.append(F.when(number.isNull(), F.lit(far)).otherwise(F.lit(0)).cast("long"))
            continue
        place = F.floor((number - F.lit(least)) / F.lit(most - least) * F.lit(float(far))).cast("long")
        scaled.append(F.coalesce(F.greatest(F.least(place, F.lit(far)), F.lit(0)).cast("long"), F.lit(far).cast("long")))
    return scaled


def _spread_sums(k: int) -> list[Column]:
    x = F.shiftright(f"x{k}", COORDINATE_BITS - SPREAD_BITS).cast("decimal(10,0)")
    weight = F.col("bytes").cast("decimal(18,0)")
    return [F.sum(weight * x).alias(f"once{k}"), F.sum(weight * (x * x).cast("decimal(18,0)")).alias(f"twice{k}")]


def _key(dimension: Column, n: int) -> Column:
    """A point's key along the dimension of its node."""
    coordinate = F.col("x0")
    for k in range(1, n):
        coordinate = F.when(dimension == k, F.col(f"x{k}")).otherwise(coordinate)
    return F.shiftleft(coordinate, HASH_BITS).bitwiseOR(F.col("hash"))


def _cuts(points: DataFrame, nodes: dict[int, tuple[int, int, int, int]], n: int) -> dict[int, int]:
    """The key at which each node is cut: by its first leaf, from (dimension, bytes, leaves, leaves before the cut).

    Points of smaller keys go before the cut, their bytes as near as can be to their share.
    """
    spark = points.sparkSession
    begin, size, below = ({node: value for node in nodes} for value in (0, 1 << KEY_BITS, 0))
    cuts: dict[int, int] = {}
    while begin:
        steps = {node: max(1, size[node] >> SLICE_BITS) for node in begin}
        table = _values(spark, [(node, nodes[node][0], begin[node], size[node], steps[node]) for node in begin], "node, dimension, begin, size, step")
        keyed = points.join(table, "node").withColumn("key", _key(F.col("dimension"), n))
        inside = keyed.where("key >= begin AND key - begin < size")
        slices = inside.groupBy("node", F.expr("(key - begin) div step").alias("slice")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        so_far = Window.partitionBy("node").orderBy("slice")
        slices = slices.withColumn("upto", F.sum("bytes").over(so_far))
        shares = _values(spark, [(node, nodes[node][1] * nodes[node][3], nodes[node][2], below[node]) for node in begin], "node, share, leaves, below")
        reached = slices.join(shares, "node").where("cast(below + upto as decimal(20, 0)) * leaves >= share")
        held = reached.groupBy("node").agg(F.min(F.struct("slice", "bytes", "n", "upto")).alias("at")).select("node", "at.*").collect()
        for row in held:
            node, start = row.node, begin[row.node] + row.slice * steps[row.node]
            before = below[node] + row.upto - row.bytes
            if row.n > 1 and steps[node] > 1:
                begin[node], size[node], below[node] = start, steps[node], before
                continue
            share, leaves = nodes[node][1] * nodes[node][3], nodes[node][2]
            nearer = abs((before + row.bytes) * leaves - share) <= abs(before * leaves - share)
            cuts[node] = start + steps[node] if nearer else start
            del begin[node]
    return cuts


def leaves_of(points: DataFrame, n_leaves: int, n_dimensions: int) -> DataFrame:
    """The points with `node`, the leaf of the tree they fall into, from 0 on.

    Points have bytes, hash, coordinates x0, x1 and so on, and 0 as node.
    """
    counts = {0: n_leaves}
    while any(count > 1 for count in counts.values()):
        open_nodes = {node: count for node, count in counts.items() if count > 1}
        spreads = points.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(s for k in range(n_dimensions) for s in _spread_sums(k)))
        nodes = {}
        for row in spreads.collect():
            if row.node in open_nodes:
                variances = [row.bytes * int(row[f"twice{k}"]) - int(row[f"once{k}"]) ** 2 for k in range(n_dimensions)]
                count = open_nodes[row.node]
                nodes[row.node] = (variances.index(max(variances)), row.bytes, count, count // 2)
        cuts = _cuts(points, nodes, n_dimensions)
        for node, count in open_nodes.items():
            counts[node], counts[node + count // 2] = count // 2, count - count // 2
        if not cuts:
            break
        table = _values(points.sparkSession, [(node, nodes[node][0], cut, nodes[node][3]) for node, cut in cuts.items()], "node, dimension, cut, jump")
        moved = F.when(_key(F.col("dimension"), n_dimensions) >= F.col("cut"), F.col("node") + F.col("jump")).otherwise(F.col("node"))
        points = points.join(table, "node", "left").withColumn("node", moved).drop("dimension", "cut", "jump")
    return points


def numbered_within(placed: DataFrame, scratch: Scratch, group: str, order: list[Column]) -> DataFrame:
    """Rows with `slot`, their number from 0 within their group; sorted in ranges, not in one task a group."""
    placed = placed.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    sorted_rows = scratch.table(placed.withColumn("at", F.monotonically_increasing_id()), "sorted")
    block = F.shiftright("at", 33)
    runs = sorted_rows.groupBy(block.alias("block"), group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.table(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "runs")
    return sorted_rows.withColumn("block", block).join(runs, ["block", group]).withColumn("slot", F.col("at") - F.col("first") + F.col("before"))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The documents with size, shard (int) and slot, for a number of shards or bytes of one."""
    scratch = Scratch(docs.sparkSession, "sharding")
    docs = docs.drop("size", "shard", "slot")
    row, digest = free_name(docs, "row"), free_name(docs, "digest")
    digested = docs.select("*", F.monotonically_increasing_id().alias(row), F.unhex(F.md5(text_bytes())).alias(digest), (F.octet_length(text_bytes()) + 1).cast("long").alias("size"))
    stored = scratch.table(digested, "docs")

    names = [f"d{k}" for k in range(len(dimensions))]
    rows = stored.select(
        F.col(row).alias("row"), F.col(digest).alias("digest"), "size", F.col("doc_id").alias("id"), *(F.col(f"`{c}`").alias(n) for c, n in zip(dimensions, names))
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, round(total / target_bytes))
    most = max(1, int(total / shards * GROUP_SHARE))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    parts = F.least(F.col("n"), F.ceil(F.col("bytes") / F.lit(most)))
    large = scratch.table(groups.where((F.col("bytes") > most) & (F.col("n") > 1)).select("digest", parts.alias("parts")), "large")
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("long")
    rows = rows.join(large, "digest", "left").withColumn("part", part).drop("parts")

    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", *names)).alias("least")
    points = rows.groupBy("digest", "part").agg(F.sum("size").alias("bytes"), least)
    points = points.select("digest", "part", "bytes", *(F.col(f"least.{n}").alias(n) for n in names))
    points = scratch.table(points, "groups")
    scaled = [x.alias(f"x{k}") for k, x in enumerate(coordinates(points, names))]
    hashed = F.xxhash64("digest", "part").bitwiseAND((1 << HASH_BITS) - 1).alias("hash")
    root = F.lit(0).cast("long").alias("node")
    points = scratch.table(points.select("digest", "part", "bytes", root, hashed, *scaled), "points")
    leaves = leaves_of(points, shards, len(names)).select("digest", "part", F.col("node").cast("int").alias("shard"))

    placed = scratch.table(rows.join(leaves, ["digest", "part"]).select("row", "shard", "id", "digest"), "placed")
    order = [F.col("id").asc_nulls_last(), F.col("digest"), F.col("row")]
    slots = numbered_within(placed, scratch, "shard", order).select(F.col("row").alias(row), "shard", "slot")
    return stored.join(slots, row).drop(row, digest)
