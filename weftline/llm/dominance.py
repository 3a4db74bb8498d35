"""Counting, for each point, the points before it that lie above it: a distributed range tree.

Points have a slot (time), a level (amount) and a weight. Of slots s < t there is one dyadic node that holds both and
whose left half holds s, its right half t. So a point stands, at each height of the tree over slots, in its dyadic
ancestor, and a query asks the left siblings of its own ancestors: the canonical nodes of the prefix before its slot.
Inside a node everything is sorted by level, from the top, and a running weighted sum over the left half's points
answers the right half's queries. What a point's nodes answer is summed.

Neither points nor queries cross the network once a height. The tree is cut into bands of some nine heights; a point is
sent once a band, by the ancestor that heads it, and the heights of the band are unfolded inside the task. Tasks are
ranges of (band, ancestor, level), so that an ancestor with any share of all points is dealt to many of them; the points
of tasks before, by child of the ancestor, come in as sums: at most 2^9 numbers for each task of some 2^17 rows. Points
of one slot and level are counted before anything is sent, so ties of any size are one row.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise, prepare

#: Most heights of the tree that one band unfolds; a task's edge sums have 2 to this power rows.
BAND = 9
#: Rows that one task sorts, about; a band has a row for each distinct slot and level.
ROWS_A_TASK = 1 << 17


def slots(moment: Column, kind: T.DataType, seconds: int = 60) -> Column:
    """Whole slots of so many seconds since 1970, in UTC whatever the session's zone; a time without a zone counts as UTC."""
    if isinstance(kind, T.TimestampNTZType):
        days = F.datediff(F.to_date(moment), F.lit(date(1970, 1, 1))).cast("long")
        whole = days * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    else:
        whole = F.unix_seconds(moment.cast("timestamp"))
    return (whole - F.pmod(whole, F.lit(seconds))) / F.lit(seconds)


def levels(amount: Column, step: int = 1) -> Column:
    """floor(floor(100 * amount + 0.5) / step), in double arithmetic; an amount that is no number has none."""
    amount = amount.cast("double")
    return F.when(~F.isnan(amount), F.floor(F.floor(F.lit(100.0) * amount + 0.5) / F.lit(step)).cast("long"))


def sale_points(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level and weight (1 to 5, by the checksum of the id; 1 for a null id) of every row of sales."""
    code = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary"))
    return sales.select(
        "sale_id", slots(F.col("sold_at"), sales.schema["sold_at"].dataType).cast("long").alias("slot"), levels(F.col("total")).alias("level"),
        (F.pmod(code, F.lit(5)) + 1).cast("long").alias("weight"))


def unfold(place: np.ndarray, height: int, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n and w over the earlier rows with a smaller place under the same head, for each row.

    place is the head's number and, in its last `height` bits, the child's. Rows come sorted by head, then level from the
    top, then place from the top, so that rows of one level do not count for each other.
    """
    above_n, above_w = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    order = np.arange(len(place))
    for h in range(height - 1, -1, -1):
        parent = place >> (h + 1)
        if h < height - 1:  # from the node to its halves: still sorted by level inside each
            order = order[np.argsort(parent[order], kind="stable")]
        node, right = parent[order], (place[order] >> h & 1).astype(bool)
        begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[begins, len(node)])
        for values, above in ((n, above_n), (w, above_w)):
            running = np.cumsum(np.where(right, 0, values[order]))
            before = np.r_[0, running][begins]
            above[order[right]] += (running - np.repeat(before, sizes))[right]
    return above_n, above_w


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("kind", "task", "band", "s", "child", "level", "n", "w")])
ANSWER, FIRST, LAST = 0, 1, 2


def _rows(kind, task, band, s, child, level, n, w) -> pa.RecordBatch:
    size = max(np.size(x) for x in (child, n))
    told = (np.broadcast_to(np.asarray(x, np.int64), size) for x in (kind, task, band, s, child, level, n, w))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=_FOUND.names)


def _count(height: int):
    """What a task does with its range of (band, head, level), as rows with band, s, level, n and w.

    Out come answers (kind 0), with the child's number where the head is the range's first and -1 elsewhere; and sums of
    n and w by child for the range's first head (kind 1, with the head in place of s) and, if it is another, its last.
    """
    def run(batches):
        task, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        band, s, level, n, w = (table[c].to_numpy() for c in ("band", "s", "level", "n", "w"))
        place = s >> band * height
        order = np.lexsort((-place, -level, place >> height, band))
        band, s, place, level, n, w = (x[order] for x in (band, s, place, level, n, w))
        head, child = place >> height, place & (1 << height) - 1
        ends = {(int(band[0]), int(head[0])): FIRST}
        ends.setdefault((int(band[-1]), int(head[-1])), LAST)
        first = (band == band[0]) & (head == head[0])
        for b in np.unique(band):
            own = band == b
            yield _rows(ANSWER, task, b, s[own], np.where(first, child, -1)[own], level[own], *unfold(place[own], height, n[own], w[own]))
        for (b, top), kind in ends.items():
            own, sums = (band == b) & (head == top), np.zeros((2, 1 << height), np.int64)
            np.add.at(sums[0], child[own], n[own])
            np.add.at(sums[1], child[own], w[own])
            yield _rows(kind, task, b, top, np.arange(1 << height), 0, *sums)

    return run


def _answers(grid: DataFrame, band: int, rows_a_task: int) -> DataFrame:
    """slot, level, n_above and w_above for each row of a table of distinct slots and levels with their n and w."""
    spark = grid.sparkSession
    low, high, rows = grid.agg(F.min("slot"), F.max("slot"), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], "slot long, level long, n_above long, w_above long")
    bits = max(1, (high - low).bit_length())
    bands = -(-bits // band)
    height = -(-bits // bands)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * bands // rows_a_task))
    every = F.array(*(F.lit(k).cast("long") for k in range(bands)))
    sent = grid.select(F.explode(every).alias("band"), (F.col("slot") - low).alias("s"), "level", "n", "w")
    dealt = sent.repartitionByRange(tasks, "band", F.expr(f"shiftright(s, cast((band + 1) * {height} AS int))"), F.desc("level"))
    found = materialise(dealt.mapInArrow(_count(height), _FOUND))
    # Sums over the tasks before, by child of a head; then over the children before.
    sums = found.where(F.col("kind") != ANSWER)
    earlier = Window.partitionBy("band", "s", "child").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("band", "s", "task").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("kind", "band", "s", "task", "child", *(F.sum(c).over(earlier).alias(c) for c in "nw"))
    sums = sums.select("kind", "task", "child", *(F.sum(c).over(smaller).alias(f"edge_{c}") for c in "nw")).where(F.col("kind") == FIRST).drop("kind")
    whole = found.where(F.col("kind") == ANSWER).join(sums, ["task", "child"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce(f"edge_{c}", F.lit(0))).alias(f"{c}_above")
    answers = materialise(whole.groupBy("s", "level").agg(total("n"), total("w")))
    discard(found)
    return answers.select((F.col("s") + low).alias("slot"), "level", "n_above", "w_above")


def dominance(points: DataFrame, band: int = BAND, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """All rows of points (slot, level, weight longs, any other columns) with n_above and w_above: how many points have a
    smaller slot and a larger level, and the sum of their weights.

    Rows with a null slot or level are above none, and their own counts are null. Points of equal slot or equal level are
    not above each other; rows that repeat count each. A null weight counts as 0. An empty table gives no rows. Other
    columns are passed on whatever their names.
    """
    prepare(points.sparkSession)
    known = points.where(F.col("slot").isNotNull() & F.col("level").isNotNull())
    grid = materialise(known.groupBy("slot", "level").agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")))
    answers = _answers(grid, band, rows_a_task)
    discard(grid)
    # All columns in one, so that none can clash; both sides are plain tables, so that a frequent pair can be split.
    rows = points.select("slot", "level", F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("row"))
    return rows.join(answers, ["slot", "level"], "left").select("row.*", "n_above", "w_above")
