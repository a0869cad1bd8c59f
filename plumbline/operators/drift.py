"""Changes between windows of additive counts: shifts of groups, of rates, and when they began.

Windows have one width, so a window is compared with the one that starts a width before it; that is
a join on the start, and no window list is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to every count before shares are compared, so that a new group has a finite shift.
PRIOR = 0.5
#: A cumulative sum counts what lies beyond SLACK standard errors and alarms above ALARM.
SLACK = 0.5
ALARM = 4.0


def _neighbours(counts: DataFrame, part: str, whole: str, width: str) -> DataFrame:
    """Every group of two windows in a row: its counts in the earlier (0) and the later (1)."""
    step = F.expr(f"INTERVAL {width}")
    now = counts.select("attribute", "grp", "window_start", F.col(part).alias("x1"), F.col(whole).alias("n1"))
    before = counts.select(
        "attribute", "grp", (F.col("window_start") + step).alias("window_start"),
        F.col(part).alias("x0"), F.col(whole).alias("n0"),
    )
    both = now.join(before, ["attribute", "grp", "window_start"], "full")
    return both.na.fill(0, ["x0", "n0", "x1", "n1"])


def stability(counts: DataFrame, width: str) -> DataFrame:
    """(attribute, window_start, n_groups, population_stability): shift of group shares since the window before.

    The index sums (p1 - p0) * ln(p1 / p0) over all groups of either window, shares taken from
    counts + PRIOR. Windows without a predecessor, or after the last one, are left out.
    """
    both = _neighbours(counts, "n", "n", width)
    total = both.groupBy("attribute", "window_start").agg(
        F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.count(F.lit(1)).alias("n_groups")
    )
    shares = both.join(total.filter("all0 > 0 AND all1 > 0"), ["attribute", "window_start"])
    p0 = (F.col("n0") + PRIOR) / (F.col("all0") + PRIOR * F.col("n_groups"))
    p1 = (F.col("n1") + PRIOR) / (F.col("all1") + PRIOR * F.col("n_groups"))
    return shares.groupBy("attribute", "window_start", "n_groups").agg(
        F.sum((p1 - p0) * F.log(p1 / p0)).alias("population_stability")
    )


def _proportions(x0: Column, n0: Column, x1: Column, n1: Column) -> Column:
    """Two-proportion z statistic; null without spread or without rows."""
    pooled = F.try_divide(x0 + x1, n0 + n1)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n0) + F.try_divide(F.lit(1.0), n1)))
    return F.try_divide(F.try_divide(x1, n1) - F.try_divide(x0, n0), error)


def rate_shifts(counts: DataFrame, width: str, part: str = "predicted", whole: str = "n") -> DataFrame:
    """(attribute, grp, window_start, rate_before, rate, z): each group against its own window before."""
    both = _neighbours(counts, part, whole, width).filter("n0 > 0 AND n1 > 0")
    x0, n0, x1, n1 = (F.col(c) for c in ("x0", "n0", "x1", "n1"))
    return both.select(
        "attribute", "grp", "window_start", (x0 / n0).alias("rate_before"), (x1 / n1).alias("rate"),
        _proportions(x0, n0, x1, n1).alias("z"),
    )


def change_points(
    counts: DataFrame, part: str = "predicted", whole: str = "n", slack: float = SLACK, alarm: float = ALARM
) -> DataFrame:
    """Groups whose rate leaves its level: (attribute, grp, direction, alarm_at, began_at, peak).

    A window's surplus is its distance from the group's rate over all windows in standard errors,
    less ``slack``; sums of surpluses restart at 0 when negative. ``alarm_at`` is the first window
    whose sum exceeds ``alarm``, ``began_at`` the window after its last restart, ``peak`` the largest
    sum. Groups with a rate of 0 or 1 throughout have no spread and never alarm. The series of a
    group, one row a window, is ordered in one task; groups are spread.
    """
    level = counts.groupBy(F.col("attribute").alias("a"), F.col("grp").alias("g")).agg(
        (F.sum(part) / F.sum(whole)).alias("level")
    )
    rows = counts.filter(F.col(whole) > 0).join(
        level, F.col("attribute").eqNullSafe(F.col("a")) & F.col("grp").eqNullSafe(F.col("g"))
    )
    error = F.sqrt(F.col("level") * (1 - F.col("level")) / F.col(whole))
    distance = (F.col(part) / F.col(whole) - F.col("level")) / error
    sided = F.explode(F.array(
        F.struct(F.lit("up").alias("direction"), (distance - slack).alias("surplus")),
        F.struct(F.lit("down").alias("direction"), (-distance - slack).alias("surplus")),
    ))
    series = rows.filter("level > 0 AND level < 1").select("attribute", "grp", "window_start", sided.alias("s"))
    series = series.select("attribute", "grp", "window_start", "s.*")
    order = Window.partitionBy("attribute", "grp", "direction").orderBy("window_start")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The restarting sum is the running sum less its least value so far (0 before the first window).
    running = series.withColumn("total", F.sum("surplus").over(so_far))
    least = F.least(F.min("total").over(so_far), F.lit(0.0))
    summed = running.withColumn("least", least).withColumn("level_sum", F.col("total") - F.col("least"))
    restart = F.max(F.when(F.col("level_sum") == 0, F.col("window_start"))).over(so_far)
    # The window after a restart is the first one above 0 that follows it.
    follow = F.min(F.when(F.col("level_sum") > 0, F.col("window_start"))).over(
        Window.partitionBy("attribute", "grp", "direction", "restart")
    )
    marked = summed.withColumn("restart", restart).withColumn("began", follow)
    high = F.col("level_sum") > alarm
    return (
        marked.groupBy("attribute", "grp", "direction")
        .agg(
            F.min(F.when(high, F.col("window_start"))).alias("alarm_at"),
            F.min_by(F.when(high, F.col("began")), F.when(high, F.col("window_start"))).alias("began_at"),
            F.max("level_sum").alias("peak"),
        )
        .filter("alarm_at IS NOT NULL")
    )
