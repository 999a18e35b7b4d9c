"""Sharding by a k-d tree with distributed weighted medians. DataFrame functions only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Written, drop, written

#: Bins of a histogram; times a median's bin is divided again.
BINS, ROUNDS = 256, 4
#: Parts of a shard in which slots are counted: so many, or more if they would have more rows.
PARTS, PART_ROWS = 64, 1_000_000
#: What a median may be off, as a share of a shard's bytes.
TOLERANCE = 3e-4
#: Points with more than this share of a shard, and of all bytes, are placed one by one on the driver: they are fewer than MOST_HEAVY.
HEAVY, MOST_HEAVY = 1 / 64, 4096


@dataclass
class Node:
    """A box of the tree; after its split: the dimension, and the value and tie-break below which rows go left."""

    leaves: int
    bytes: int
    dim: int = -1
    value: float = 0.0
    tie: float = 0.0
    left: Node | None = None
    right: Node | None = None
    shard: int = -1
    heavy: list[Row] = field(default_factory=list)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the metadata of every row. A null text has no bytes, so size 1 and crc32 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("lang", "source")}
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), *(_unit(F.xxhash64(F.coalesce(names[c].cast("string"), F.lit("")))).alias(c) for c in names),
    )


def _unit(x: Column) -> Column:
    """A long as a double in [0, 1)."""
    return F.shiftrightunsigned(x, 11).cast("double") / F.lit(float(1 << 53))


def points_of(rows: DataFrame, whole: float) -> DataFrame:
    """Points of the tree: weight, tie-break, and dimensions d0.. scaled to [0, 1): smallest doc_id, size, language, source.

    Equal texts are one point, unless they have more than whole bytes: then rows of each doc_id are a point. Groups so large
    are fewer than all bytes divided by whole, so their keys are a bounded list.
    """
    by_text = written(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.min("doc_id").alias("doc"), F.max("size").alias("one"), F.min("lang").alias("d2"), F.min("source").alias("d3")))
    low, high, large = by_text.agg(F.min("doc"), F.max("doc"), F.max("one")).first()
    low, high = low or 0, high or 0
    big = [r.key for r in by_text.where(F.col("weight") > whole).select("key").collect()]
    out = by_text.select(F.col("key").alias("point"), "weight", "doc", "one", "d2", "d3").where(~F.col("key").isin(big))
    if big:
        high = max(high, rows.agg(F.max("doc_id")).first()[0] or 0)
        one_by_one = rows.where(F.col("key").isin(big)).groupBy(point_of(big).alias("point"))
        out = out.unionByName(one_by_one.agg(F.sum("size").alias("weight"), F.min("doc_id").alias("doc"), F.max("size").alias("one"), F.min("lang").alias("d2"), F.min("source").alias("d3")))
    scaled = ((F.coalesce("doc", F.lit(low)) - low).cast("double") / float(high - low + 1), F.log1p(F.col("one").cast("double")) / F.log1p(F.lit(float((large or 0) + 1))))
    points = written(out.select("point", "weight", scaled[0].alias("d0"), scaled[1].alias("d1"), "d2", "d3", _unit(F.xxhash64("point", F.lit(1))).alias("tie")))
    drop(by_text)
    points.big = big
    return points


def point_of(big: list[int]) -> Column:
    """The point that a row is in: its text's key, or in a group too large to stay together one by doc_id."""
    key = F.col("key")
    return F.when(key.isin(big), F.xxhash64("key", "doc_id")).otherwise(key) if big else key


DIMS = ("d0", "d1", "d2", "d3")


def _leaves(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.left is None:
            out.append(x)
        else:
            todo += [x.right, x.left]
    return out


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from a literal of the plan."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")))


def _table(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each box: no more than there are shards, so each task can have them."""
    return F.broadcast(_rows(points.sparkSession, rows, schema))


STATE = "box long, dim int, stage int, low double, high double, at double, need double"


def _crossings(boxed: DataFrame, state: dict[int, dict], boxes: dict[int, Node]) -> dict[int, Row]:
    """A row for each box, whatever the number of points: of BINS equal parts of what is open, the one in which the sum of weights
    reaches what the box needs, or the last: the sum before it, its weight, its least and greatest value, and the next one."""
    rows = [(i, boxes[i].dim, s["stage"], s["low"], s["high"], s["at"], float(s["aim"] - s["below"])) for i, s in state.items()]
    d = F.get(F.array(*DIMS), F.col("dim"))
    v = F.when(F.col("stage") == 0, d).when(d == F.col("at"), F.col("tie"))
    inside = boxed.join(_table(boxed, rows, STATE), "box").withColumn("v", v).where("v >= low and v <= high")
    bin_ = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1)).cast("int")
    hist = inside.groupBy("box", bin_.alias("bin")).agg(F.sum("weight").alias("w"), F.min("v").alias("l"), F.max("v").alias("h"), F.first("need").alias("need"))
    w = Window.partitionBy("box").orderBy("bin")
    before = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = hist.select("box", "w", "l", "h", "need", before.alias("before"), F.lead("l").over(w).alias("next"), F.row_number().over(w).alias("at"))
    reached = ((F.col("before") + F.col("w") >= F.col("need")) | F.col("next").isNull()) & ((F.col("at") == 1) | (F.col("before") < F.col("need")))
    return {r.box: r for r in each.where(reached).collect()}


def _split(boxed: DataFrame, boxes: dict[int, Node], tolerance: float) -> None:
    """Splits each box at the weighted median of its widest dimension: the bin that the median is in is divided again, then the
    tie-break, until it is exact enough. Each round is one aggregation for all boxes."""
    ends = {r.box: r for r in boxed.join(_table(boxed, [(i,) for i in boxes], "box long"), "box").groupBy("box").agg(*(f(d).alias(f"{d}{n}") for d in DIMS for n, f in (("l", F.min), ("h", F.max)))).collect()}
    state = {}
    for i, b in boxes.items():
        r = ends.get(i)
        b.left, b.right = Node(b.leaves // 2, 0), Node(b.leaves - b.leaves // 2, 0)
        spread = [max(x) - min(x) if (x := [*([r[f"{d}l"], r[f"{d}h"]] if r else []), *(h[d] for h in b.heavy)]) else 0.0 for d in DIMS]
        b.dim = spread.index(max(spread))
        aim = b.bytes * b.left.leaves / b.leaves - _deal(b)
        low, high = (r[f"{DIMS[b.dim]}l"], r[f"{DIMS[b.dim]}h"]) if r else (0.0, 0.0)
        # stage 0: by value in [low, high]; stage 1: by tie-break in [low, high], at one value
        state[i] = {"stage": 0 if high > low else 1, "low": low if high > low else 0.0, "high": high if high > low else 1.0, "at": low, "below": 0, "rounds": 0, "aim": aim}
        b.value, b.tie = low, 0.0
    while state:
        found = _crossings(boxed, state, boxes)
        for i, s in list(state.items()):
            b, r = boxes[i], found.get(i)
            if r is None:  # no point
                del state[i]
                continue
            s["rounds"] += 1
            below = s["below"] + r.before
            before, after = s["aim"] - below, below + r.w - s["aim"]  # what is missing if the cut is before this bin, or too much if after
            done = min(before, after) <= tolerance or s["rounds"] >= ROUNDS and s["stage"] == 1
            if s["stage"] == 0:
                if done and (before <= after or r.next is not None):
                    b.value, b.tie = (r.l, 0.0) if before <= after else (r.next, 0.0)
                    del state[i]
                elif r.h > r.l and s["rounds"] < 2 * ROUNDS:
                    s |= {"low": r.l, "high": r.h, "below": below}
                else:
                    b.value = r.l
                    s |= {"stage": 1, "at": r.l, "low": 0.0, "high": 1.0, "below": below, "rounds": 0}
            else:
                b.value = s["at"]
                if done or r.h <= r.l:
                    b.tie = r.l if before <= after else (r.h + 2.0**-53 if r.next is None else r.next)
                    del state[i]
                else:
                    s |= {"low": r.l, "high": r.h, "below": below}


def _deal(b: Node) -> int:
    """Heavy points have a median of their own along the box's dimension, so that the others can even out what is left. The
    bytes that go left."""
    share, at, left = sum(h.weight for h in b.heavy) * b.left.leaves / b.leaves, 0, 0
    for h in sorted(b.heavy, key=lambda h: (h[DIMS[b.dim]], h.tie)):
        side = b.left if at + h.weight / 2 <= share else b.right
        side.heavy.append(h)
        at += h.weight
        left += h.weight if side is b.left else 0
    return left


def tree(light: DataFrame, heavy: list[Row], total: int, shards: int) -> tuple[Node, Written]:
    """Splits boxes in two until there are as many leaves as shards, each with an equal part of all bytes. The tree, and
    (point, shard) of the light points.

    Points carry the number of their box; each level joins them with the splits, a row for each box, so plans are as short
    for thousands of shards as for two. Levels are as many as the logarithm of shards.
    """
    root = Node(shards, total, heavy=heavy)
    boxes = {0: root}  # by number: a box's halves are 2 * number + 1 and + 2
    boxed = written(light.withColumn("box", F.lit(0).cast("long")))
    while open_ := {i: b for i, b in boxes.items() if b.leaves > 1}:
        _split(boxed, open_, TOLERANCE * total / shards)
        splits = _table(boxed, [(i, b.dim, b.value, b.tie) for i, b in open_.items()], "box long, dim int, value double, cut double")
        d = F.get(F.array(*DIMS), F.col("dim"))
        side = F.when(F.col("dim").isNull(), F.col("box")).when((d < F.col("value")) | ((d == F.col("value")) & (F.col("tie") < F.col("cut"))), 2 * F.col("box") + 1).otherwise(2 * F.col("box") + 2)
        after = written(boxed.join(splits, "box", "left").select("point", "weight", *DIMS, "tie", side.alias("box")))
        drop(boxed)
        boxed = after
        for i, b in open_.items():
            del boxes[i]
            boxes[2 * i + 1], boxes[2 * i + 2] = b.left, b.right
        held = dict(boxed.groupBy("box").agg(F.sum("weight")).collect())
        for i, b in boxes.items():
            b.bytes = int(held.get(i) or 0) + sum(h.weight for h in b.heavy)
    for k, leaf in enumerate(_leaves(root)):
        leaf.shard = k
    of = _table(boxed, [(i, b.shard) for i, b in boxes.items()], "box long, shard int")
    out = written(boxed.join(of, "box").select("point", "shard"))
    drop(boxed)
    return root, out


def shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: shards of nearly equal bytes, shards of them, or as many as make
    about target_bytes each.

    Slots number a shard's rows from 0 without gaps. Equal texts share a shard, unless they have more bytes than a shard
    should: then only equal rows do. Null texts are empty ones; null doc_ids count as the smallest; rows repeat as often as in
    docs; metadata columns may be missing or null; other columns are not looked at; an empty table gives no rows.
    """
    rows = written(sizes(docs))
    total, n = (int(x or 0) for x in rows.agg(F.sum("size"), F.count("*")).first())
    shards = shards or max(1, -(-total // max(1, target_bytes or total)))
    points = points_of(rows, total / shards)
    heavier = F.col("weight") > max(HEAVY * total / shards, total / MOST_HEAVY)
    heavy = points.where(heavier).collect()
    root, of = tree(points.where(~heavier), heavy, total, shards)
    placed = [(h.point, leaf.shard) for leaf in _leaves(root) for h in leaf.heavy]
    both = of.union(_rows(docs.sparkSession, placed, "point long, shard int")) if placed else of
    # rows that are equal in all ways are dealt to a shard's parts like any other
    parts = max(PARTS, -(-n // (shards * PART_ROWS)))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    numbered = rows.withColumn("part", part).withColumn("point", point_of(points.big))
    slotted = written(numbered.join(both, "point").select("doc_id", "size", "text_crc32", "shard", "part"))
    drop(rows, points, of)
    counts = slotted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", start.alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    return slotted.withColumn("at", at).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
