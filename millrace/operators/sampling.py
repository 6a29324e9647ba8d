"""Drawing from scored candidates ``(group_id, idx, value)``, many groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_logits(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` greatest values of each group, equal ones by smaller ``idx``; NaN must not occur."""
    best = Window.partitionBy("group_id").orderBy(F.col("value").desc(), "idx")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def check_logits(rows: DataFrame, k: int) -> DataFrame:
    """``(group_id, error)`` of groups a top-k of ``k`` refuses, in this order: zero_k, k_too_large, nan."""
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.max(F.isnan("value")).alias("bad"))
    error = F.when(F.lit(k) == 0, "zero_k").when(F.lit(k) > F.col("n"), "k_too_large").when(F.col("bad"), "nan")
    return sizes.select("group_id", error.alias("error")).where(F.col("error").isNotNull())


def check_softmax(rows: DataFrame, temperature: float, top_p: float) -> DataFrame:
    """``(group_id, error)`` of groups that a softmax refuses, in this order: temperature, top_p, nan, degenerate (no finite greatest value)."""
    sizes = rows.groupBy("group_id").agg(F.max(F.isnan("value")).alias("bad"), F.max(F.when(~F.isnan("value"), F.col("value"))).alias("top"))
    if not temperature > 0:
        error = F.lit("temperature")
    elif not 0 < top_p <= 1:
        error = F.lit("top_p")
    else:
        error = F.when(F.col("bad"), "nan").when(F.abs("top") == float("inf"), "degenerate")
    return sizes.select("group_id", error.alias("error")).where(F.col("error").isNotNull())


def softmax_top_p(rows: DataFrame, temperature: float, top_p: float) -> DataFrame:
    """``(group_id, idx, p, rank)``: the smallest prefix of the most likely candidates that reaches ``top_p``, renormalised.

    Groups that ``check_softmax`` refuses give no rows. All steps are windows
    over one partitioning by group.
    """
    if not temperature > 0 or not 0 < top_p <= 1:
        raise ValueError("temperature must be positive and top_p in (0, 1]")
    whole = Window.partitionBy("group_id")
    known = rows.select("group_id", "idx", F.col("value").cast("double").alias("value"))
    # NaN is the greatest of all doubles, so it shows as the greatest value.
    sound = known.withColumn("top", F.max("value").over(whole)).where(~F.isnan("top") & (F.abs("top") < float("inf")))
    raised = sound.withColumn("e", F.exp((F.col("value") - F.col("top")) / temperature))
    chance = raised.withColumn("chance", F.col("e") / F.sum("e").over(whole))
    order = whole.orderBy(F.round("chance", 12).desc(), "idx")
    before = F.coalesce(F.sum(F.round("chance", 12)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = chance.withColumn("rank", F.row_number().over(order)).withColumn("before", before).where((F.col("rank") == 1) | (F.round("before", 9) < top_p))
    return kept.select("group_id", "idx", (F.col("chance") / F.sum("chance").over(whole)).alias("p"), "rank")


def recent_window(drawn: DataFrame, size: int = 64) -> DataFrame:
    """``(group_id, idx)`` of the last ``size`` draws ``(group_id, at, idx)`` of each group, repeats kept."""
    last = Window.partitionBy("group_id").orderBy(F.col("at").desc())
    return drawn.withColumn("back", F.row_number().over(last)).where(F.col("back") <= size).select("group_id", "idx")


def penalize_recent(rows: DataFrame, recent: DataFrame, penalty: float) -> DataFrame:
    """Values of recently drawn candidates (``recent (group_id, idx)``, repeats count) pushed down once an occurrence."""
    times = recent.groupBy("group_id", "idx").agg(F.count("*").alias("times"))
    factor = F.pow(F.lit(penalty), F.coalesce("times", F.lit(0)).cast("double"))
    pushed = F.when(F.col("value") > 0, F.col("value") / factor).otherwise(F.col("value") * factor)
    return rows.join(times, ["group_id", "idx"], "left").withColumn("value", pushed).drop("times")


def draw(chances: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(group_id, idx)``: the first candidate, by rank, where the summed chance reaches the group's number ``r``; else the last."""
    order = Window.partitionBy("group_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = chances.withColumn("sum", F.sum("p").over(order)).join(numbers, "group_id")
    hit = F.min(F.when(F.round("sum", 9) >= F.col("r"), F.struct("rank", "idx")))
    return sums.groupBy("group_id").agg(F.coalesce(hit, F.max(F.struct("rank", "idx"))).alias("pick")).select("group_id", "pick.idx")


def greedy(rows: DataFrame) -> DataFrame:
    """``(group_id, idx)`` of the greatest value, the first of equals; where all are NaN the last one."""
    best = rows.groupBy("group_id").agg(
        F.min(F.when(~F.isnan("value"), F.struct((-F.col("value")).alias("minus"), F.col("idx")))).alias("best"), F.max("idx").alias("last")
    )
    return best.select("group_id", F.coalesce("best.idx", "last").alias("idx"))


def uniform24(state: int, count: int) -> list[float]:
    """The first numbers in [0, 1) of a 64-bit xorshift generator (shifts 13, 7, 17), 24 bits each."""
    out, x, mask = [], state or 1, (1 << 64) - 1
    for _ in range(count):
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        out.append((x >> 40) / float(1 << 24))
    return out


def sample(
    rows: DataFrame, numbers: DataFrame, drawn: DataFrame | None = None, temperature: float = 0.15, k: int = 64, top_p: float = 1.0, penalty: float = 1.0, window: int = 64
) -> DataFrame:
    """``(group_id, idx)``: the whole chain of penalty, top-k, softmax, nucleus and draw.

    ``drawn (group_id, at, idx)`` are earlier draws, of which the last
    ``window`` are pushed down. A temperature of zero or less, and groups that
    a softmax refuses, are answered by the greatest value; ``k`` of zero takes
    all candidates, and a ``top_p`` outside of (0, 1] counts as 1.
    """
    if drawn is not None and penalty > 0 and penalty != 1.0:
        rows = penalize_recent(rows, recent_window(drawn, window), penalty)
    if temperature <= 0:
        return greedy(rows)
    short = top_logits(rows.where(~F.isnan("value")), k) if k > 0 else rows
    broken = check_softmax(rows, temperature, 1.0).select("group_id")
    sound = short.join(broken, "group_id", "left_anti").select("group_id", "idx", "value")
    picked = draw(softmax_top_p(sound, temperature, top_p if 0 < top_p <= 1 else 1.0), numbers)
    return picked.unionByName(greedy(rows.join(broken, "group_id", "left_semi")))
