"""Merkle dataset manifest: a tree of digests for each group of documents, and one over the groups' roots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.bitmap_ranks import bitmap_ranks
from larkspur.llm.common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A node has 2 to this power children.
SHIFT = 3
#: Levels that the numbers of a long can need.
DEEPEST = 21
#: Equal rows that are written out by one task.
COPIES = 4096

_PATH = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, in hex."""
    return F.sha2(text.cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: `-` for a null, else the number of bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)))


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return reduce(lambda c, k: c.when(n <= 1 << (SHIFT * k), k), range(1, DEEPEST), F.when(n <= 1, 0)).otherwise(DEEPEST)


def _placed(leaves: DataFrame) -> DataFrame:
    """g, pos (place in the group), depth and item of each leaf (g, id, node, altered).

    Places are ranks of ids; leaves with one id follow the digests, of which the first 60 bits are ranked in the same way, and
    equal rows, counted before, are written out again in blocks."""
    ranked = cut(bitmap_ranks(leaves, ["g"], "id"))
    kept = ("g", "id", "node", "altered")
    places = ranked.where("same = 1").select(*kept, "total", F.col("rank").alias("pos"))
    tied = ranked.where("same > 1")
    if tied.limit(1).count():
        one = tied.groupBy(*kept, "total", "rank").agg(F.count("*").alias("n"))
        one = cut(one.withColumnRenamed("total", "all").withColumnRenamed("rank", "first").withColumn("start", F.conv(F.substring("node", 1, 15), 16, 10).cast("long")))
        inner = bitmap_ranks(one, ["g", "first"], "start", "n")
        order = Window.partitionBy("g", "first", "start").orderBy("node", F.col("altered").asc_nulls_first())
        inner = inner.withColumn("pos", F.col("first") + F.col("rank") + F.sum("n").over(order) - F.col("n"))
        block = inner.select(*kept, F.col("all").alias("total"), "pos", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("block"))
        low = F.col("block") * COPIES
        copy = F.explode(F.sequence(low, F.least(low + COPIES, F.col("n")) - 1)).alias("copy")
        copies = block.repartition("g", "pos", "block").select(*kept, "total", "pos", copy)
        places = places.unionByName(copies.withColumn("pos", F.col("pos") + F.col("copy")).drop("copy"))
    return places.select("g", "pos", _depth(F.col("total")).alias("depth"), F.struct("node", "id", "altered").alias("item"))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level (g, depth, run, and slots: the children in order), and each group's top (g, depth, node).

    nodes has g, pos, depth and item, a struct with the digest `node`."""
    highest = nodes.agg(F.max("depth")).first()[0] or 0
    levels, tops = [], nodes.where("depth = 0").select("g", "depth", "item.node")
    for k in range(highest):
        run = F.shiftright("pos", SHIFT).alias("run")
        runs = cut(nodes.where(F.col("depth") > k).groupBy("g", "depth", run).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("slots")))
        levels.append(runs)
        nodes = runs.select("g", "depth", F.col("run").alias("pos"), F.struct(digest(_nodes("slots")).alias("node")).alias("item"))
        tops = tops.unionByName(nodes.where(F.col("depth") == k + 1).select("g", "depth", "item.node"))
    return levels, cut(tops)


def _nodes(slots: str) -> Column:
    return F.array_join(F.transform(slots, lambda s: s["item"]["node"]), "")


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame | None:
    """item, path and subroot of each leaf of groups with a level; `tops` has g, depth, subroot and path, the siblings above
    the group. A path has the siblings to the left and to the right for each level, upwards."""
    members = None
    for k in reversed(range(len(levels))):
        known = tops.where(F.col("depth") == k + 1).select("g", F.lit(0).cast("long").alias("run"), "subroot", "path")
        if members is not None:
            known = known.unionByName(members.select("g", F.col("pos").alias("run"), "subroot", "path"))
        runs = levels[k].join(known, ["g", "run"]).withColumn("all", _nodes("slots"))
        each = runs.select("g", "subroot", "path", "all", F.posexplode("slots").alias("i", "slot"))
        beside = F.struct(F.substring("all", F.lit(1), F.col("i") * 64).alias("l"), F.substring("all", F.col("i") * 64 + 65, F.length("all")).alias("r"))
        members = each.select("g", "slot.pos", "slot.item", "subroot", F.concat(F.array(beside), "path").alias("path"))
    return members


def _in_order(tops: DataFrame) -> DataFrame:
    """The groups' tops as leaves of one more tree, in the order of the groups, by ranges of groups."""
    parts = cut(tops.repartitionByRange("g").withColumn("part", F.spark_partition_id()))
    held = parts.groupBy("part").count().orderBy("part").collect()  # a row for each partition
    total, before = 0, []
    for row in held:
        before.append((row["part"], total))
        total += row["count"]
    before = tops.sparkSession.createDataFrame(before, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    ranked = parts.withColumn("place", place).join(F.broadcast(before), "part")
    return ranked.select(F.lit("").alias("g"), (F.col("before") + F.col("place")).alias("pos"), _depth(F.lit(total)).alias("depth"), F.struct("node", F.col("g").alias("of"), F.col("depth").alias("height")).alias("item"))


def manifest(docs: DataFrame, altered: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """A row for each row of docs: its id (`key`), leaf, subroot (root of its group's tree), root, path (the siblings to
    the left, l, and to the right, r, for each level up to the root) and folded, the root as it follows from
    the row's leaf with the last of `fields` replaced by `altered`, where that is given and not null.

    Leaves of a group ascend by the key; eight consecutive nodes become one until one remains; groups ascend by name,
    null first, and their roots become one in the same way. Equal keys follow their leaves' digests, equal rows take places
    in any order, a null key comes first (with the least long). Nulls of fields count as such; no rows give no rows. Other
    columns are not read.

    A bitmap of each group's keys gives the leaves' places. Each level meets by place (run and slot), so no task holds
    more than a run. Paths come down by runs; only the paths of a task's rows are held. The driver gets the depth, the
    root and a count for each partition of the groups.
    """
    values = [F.col(c) for c in fields]
    changed = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf([*values[:-1], altered]))
    g = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = cut(docs.select(g.alias("g"), F.col(key).alias("id"), leaf(values).alias("node"), changed.alias("altered")))
    nodes = cut(_placed(leaves))
    levels, tops = _climb(nodes)
    upper = cut(_in_order(tops))
    upper_levels, top = _climb(upper)
    found = top.first()
    root = F.lit(found["node"] if found else None).cast("string")
    none = F.array().cast(_PATH)
    seed = top.select("g", "depth", F.col("node").alias("subroot"), none.alias("path"))
    members = _descend(upper_levels, seed)
    members = upper.select("item", none.alias("path")) if members is None else members.select("item", "path")
    tops = cut(members.select(F.col("item.of").alias("g"), F.col("item.height").alias("depth"), F.col("item.node").alias("subroot"), "path"))
    alone = nodes.where("depth = 0").join(tops, ["g", "depth"]).select("item", "subroot", "path")
    below = _descend(levels, tops)
    rows = alone if below is None else alone.unionByName(below.select("item", "subroot", "path"))
    folded = F.aggregate("path", F.coalesce("item.altered", "item.node"), lambda h, s: digest(F.concat(s["l"], h, s["r"])))
    return rows.select(F.col("item.id").alias(key), F.col("item.node").alias("leaf"), "subroot", root.alias("root"), "path", folded.alias("folded"))
