"""A change feed of leaderboards, from a stateful stream over late and repeated sale lines.

Lines are cut into batches by arrival, written below the shared folder and shown to one streaming query batch by
batch; it is started anew for each on one checkpoint. Its state sums revenue by nation and item (and keeps the last
batch that touched a pair). In ``foreachBatch`` the pairs it updates meet the lines of the batch: the
closing revenue less the batch's sum is the opening one. From there running sums over a pair's days give its revenue after
each day. Items that a batch leaves alone cannot change within it, so ten of them a nation suffice: they are read from the
state store. A revenue that holds from one day to another is laid over a binary tree of days, ten rows a node are kept, and
a day's board is the best ten on its path to the root: no item is repeated for each day it stands still.

Nothing that grows with the input meets in one task, on the driver or in a broadcast: lines are joined with items
and vendors by shuffles whose hot keys the adaptive planner splits; sums are partial before they are shuffled; of a
node only ten rows a task are shuffled; the driver sees one row a batch.

Nulls: a null id is the empty text in the digest; a null amount is the quantity times the item's price, or 0; a null date
is drawn from the digest; a line without an item or a vendor's nation is ignored. Amounts and prices that are not finite
count as null. Repeated lines count as often as they occur; of items or vendors that share an id the greatest price or nation
holds. Ties of revenue go to the smaller item. Lines that arrive before the first batch are of it. Empty tables give no
changes. Extra columns of any name are not looked at; there are no long texts here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argusframe.checkpoints import materialize, move, reserve, scratch

BATCHES = 10
FIRST_DAY = 19723
DAYS = 180
#: Days that a line may lag behind the latest one of earlier batches.
LATE_DAYS = 3
BOARD = 10
TASKS_A_CORE = 4

CUT = "nation_id int, item_id long, shipped long, arrived long, cents long, batch int"
PAIR = ["nation_id", "item_id"]
CHANGES = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def cents(amount: Column) -> Column:
    return F.floor(100 * finite(amount.cast("double")) + 0.5)


def dated(lines: DataFrame) -> DataFrame:
    """item_id, vendor_id, shipped, arrived, batch, known (cents, or null), units: what the feed needs of a line."""
    names = ["sale_id", "item_id", "vendor_id", "line_no"]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    h = F.crc32(F.concat(*[x for t in texts for x in (t, F.lit(","))][:-1]))
    shipped = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")), FIRST_DAY + F.col("h") % 150).cast("long")
    arrived = F.col("shipped") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((F.col("arrived") - FIRST_DAY) * BATCHES / DAYS)))
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    return (
        lines.withColumn("h", h).withColumn("shipped", shipped).withColumn("arrived", arrived)
        .select("item_id", "vendor_id", "shipped", "arrived", batch.cast("int").alias("batch"), (sign * cents(F.col("amount"))).alias("known"), (sign * F.col("quantity")).alias("units"))
    )


def cut(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """Every line as ``CUT``; nation_id is null where the line is to be ignored. The small sides are hashed within their
    partitions; they are written first, since the planner splits hot keys only of joins right above their shuffles."""
    prices = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(cents(F.col("price"))).alias("price"), F.lit(True).alias("listed"))
    nations = vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.max("nation_id").cast("int").alias("nation_id"))
    joined = dated(lines).join(materialize(prices, "prices").hint("shuffle_hash"), "item_id", "left")
    priced = joined.select("vendor_id", F.when(F.col("listed"), F.col("item_id")).cast("long").alias("item_id"), "shipped", "arrived", F.coalesce("known", F.col("units") * F.col("price"), F.lit(0)).cast("long").alias("cents"), "batch")
    nation = F.when(F.col("item_id").isNotNull(), F.col("nation_id"))
    return priced.join(materialize(nations, "nations").hint("shuffle_hash"), "vendor_id", "left").select(nation.alias("nation_id"), "item_id", "shipped", "arrived", "cents", "batch")


def by_batch(values: dict[int, int]) -> Column:
    """What belongs to a row's batch, of which there are few."""
    return F.create_map(*[F.lit(x).cast("long") for pair in values.items() for x in pair])[F.col("batch").cast("long")]


def write_openings(closing: DataFrame, kept: DataFrame, path: str) -> None:
    """The revenue of each pair that a batch touches as it was before: its closing revenue less what the batch's lines add.
    Lines are dealt by pair as the state is, so the state's tasks join both where they are."""
    deltas = kept.groupBy(*PAIR).agg(F.sum("cents").alias("more")).hint("shuffle_hash")
    closing.join(deltas, PAIR).select(*PAIR, (F.col("revenue") - F.col("more")).alias("delta")).write.mode("overwrite").parquet(path)


def moves(kept: DataFrame, openings: DataFrame, before: Column, last: Column) -> DataFrame:
    """The revenue of each touched pair over the days of its batch: from and upto, revenue, and after: the revenue on the next
    day, if a later one of the batch changes it. The day ``before`` the first stands for the opening."""
    daily = kept.groupBy("batch", *PAIR, "day").agg(F.sum("cents").alias("delta"))
    rows = daily.unionByName(openings.select("batch", *PAIR, before.alias("day"), "delta"))
    days = W.partitionBy("batch", *PAIR).orderBy("day")
    now, next_day = F.sum("delta").over(days), F.lead("day").over(days)
    return rows.select("batch", *PAIR, F.col("day").alias("from"), F.coalesce(next_day - 1, last).alias("upto"), now.alias("revenue"), (now + F.lead("delta").over(days)).alias("after"))


def leaders(state: DataFrame, before: Column, last: Column) -> DataFrame:
    """The best pairs of each nation that a batch left alone, from rows of the state store with their batch."""
    rows = state.select("batch", "key.nation_id", "key.item_id", F.col("value.sum").alias("revenue"), F.col("value.max").alias("touched")).where((F.col("touched") < F.col("batch")) & (F.col("revenue") > 0))
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("batch", "nation_id").orderBy(F.desc("revenue"), "item_id"))).where(F.col("k") <= BOARD)
    return best.select("batch", *PAIR, before.alias("from"), last.alias("upto"), "revenue", F.lit(None).cast("long").alias("after"))


def nodes(bits: int) -> Column:
    """The nodes (level, at) of a binary tree of days that cover from..upto: at most two of a level."""
    start, end, out = F.col("from"), F.col("upto") + 1, []
    for level in range(bits + 1):
        left, right = F.shiftright(start + ((1 << level) - 1), level), F.shiftright(end, level)
        node = lambda at: F.struct(F.lit(level).alias("level"), at.alias("at"))  # noqa: B023, E731
        out += [F.when((left < right) & (left % 2 == 1), node(left)), F.when((left < right) & (right % 2 == 1), node(right - 1))]
    return F.array_compact(F.array(*out))


def board_changes(held: DataFrame, days: DataFrame, bits: int, origin: int) -> DataFrame:
    """The change feed from what every pair's revenue was on which days (as :func:`moves` has it) and the days of each
    batch and nation on which it changes: day, next, before."""
    board, best = ["batch", "nation_id"], [F.desc("revenue"), "item_id"]
    placed = held.where("revenue > 0").select(*board, "item_id", "revenue", "upto", "after", F.inline(nodes(bits)))
    node = [*board, "level", "at"]
    kept = placed.withColumn("k", F.row_number().over(W.partitionBy(*node).orderBy(*best))).where(F.col("k") <= BOARD).drop("k")
    paths = days.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("at", F.expr("shiftright(day, level)"))
    ranked = paths.join(kept, node).withColumn("rank", F.row_number().over(W.partitionBy(*board, "day").orderBy(*best))).where(F.col("rank") <= BOARD)
    boards = materialize(ranked.select(*board, "item_id", "day", "next", "before", "rank", "revenue", "upto", "after"), "boards")
    none = F.lit(None)
    new = boards.where("day > before").select(*board, "item_id", "day", "rank", "revenue", none.cast("int").alias("old_rank"), none.cast("long").alias("then"))
    then = F.when(F.col("upto") < F.col("next"), F.col("after")).otherwise(F.col("revenue"))
    old = boards.where("next IS NOT NULL").select(*board, "item_id", F.col("next").alias("day"), none.cast("int").alias("rank"), none.cast("long").alias("revenue"), F.col("rank").alias("old_rank"), then.alias("then"))
    both = new.unionByName(old).groupBy(*board, "item_id", "day").agg(F.max("rank").alias("new_rank"), F.max("old_rank").alias("old_rank"), F.coalesce(F.max("revenue"), F.max("then")).alias("revenue"))
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return both.where(~F.col("old_rank").eqNullSafe(F.col("new_rank"))).select(
        "nation_id", (F.col("day") + origin).cast("long").alias("arrival_day"), "item_id", "batch", change.alias("change"), "old_rank", "new_rank", "revenue"
    )


def change_feed(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """A row for each item whose rank on its nation's board differs from the board before, after every arrival day: ``CHANGES``."""
    spark: SparkSession = lines.sparkSession
    with scratch() as scope:
        root = reserve(spark, "leaderboard")
        tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism  # each writes a file a batch
        cut(lines, items, vendors).coalesce(tasks).write.partitionBy("batch").parquet(f"{root}/cut")
        spans = spark.read.schema(CUT).parquet(f"{root}/cut").groupBy("batch").agg(F.max("shipped"), F.min("arrived"), F.max("arrived")).collect()  # one row a batch
        if not spans:
            return spark.createDataFrame([], CHANGES)
        spans = sorted(spans, key=lambda r: r.batch)
        origin = min(r[2] for r in spans) - 1  # day 0 stands for the first opening
        floors = {r.batch: max([q[1] - LATE_DAYS for q in spans[:i]], default=-(1 << 40)) for i, r in enumerate(spans)}
        before, last = by_batch({r.batch: r[2] - origin - 1 for r in spans}), by_batch({r.batch: r[3] - origin for r in spans})
        states = []
        for number, batch in enumerate(floors):
            move(f"{root}/cut/batch={batch}", f"{root}/feed/batch={batch}")
            fresh = F.col("nation_id").isNotNull() & (F.col("shipped") >= floors[batch])
            feed = spark.readStream.schema(CUT).parquet(f"{root}/feed").where(fresh)
            sums = feed.groupBy(*PAIR).agg(F.sum("cents").alias("revenue"), F.max("batch").alias("touched"))

            def opened(closing: DataFrame, _: int, batch: int = batch, fresh: Column = fresh) -> None:
                kept = closing.sparkSession.read.schema(CUT).parquet(f"{root}/feed").where((F.col("batch") == batch) & fresh)
                write_openings(closing, kept, f"{root}/openings/batch={batch}")

            query = sums.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(opened).start()
            query.awaitTermination()
            if number:  # the first batch finds no state
                state = spark.read.format("statestore").option("batchId", number).load(f"{root}/checkpoint")
                states.append(state.withColumn("batch", F.lit(batch)))
        fed = spark.read.schema(CUT).parquet(f"{root}/feed").where(F.col("nation_id").isNotNull() & (F.col("shipped") >= by_batch(floors)))
        kept = fed.select("batch", *PAIR, (F.col("arrived") - origin).alias("day"), "cents")
        openings = spark.read.schema("nation_id int, item_id long, delta long, batch int").parquet(f"{root}/openings")
        held = moves(kept, openings, before, last)
        if states:
            held = held.unionByName(leaders(reduce(DataFrame.unionByName, states), before, last))
        changed = kept.select("batch", "nation_id", "day").distinct()
        changed = changed.unionByName(changed.select("batch", "nation_id", before.alias("day")).distinct())
        days = changed.select("*", F.lead("day").over(W.partitionBy("batch", "nation_id").orderBy("day")).alias("next"), before.alias("before"))
        most = max(r[3] for r in spans) - origin
        out = materialize(board_changes(held, materialize(days, "board-days"), most.bit_length(), origin), "leaderboard-changes")
        scope.pass_on(out)
    return out
