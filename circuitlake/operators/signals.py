"""Signals in long form (run, x, y): segments, crossings, slopes, levels and integrals.

Neighbouring samples come from windows over blocks of a run, not over whole runs: `block`
maps a sample to a bounded stretch of x, and blocks are stitched through their first
samples, so a run may hold any share of all rows. Samples with null or NaN x are left
out; y may be null or NaN, which no crossing, slope or integral uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from circuitlake.functions import mathx
from circuitlake.operators import ordered


def samples(df: DataFrame, run: Column, x: Column, y: Column) -> DataFrame:
    rows = df.select(run.alias("run"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    return rows.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def with_next(signal: DataFrame, width: float, steps: int = 1) -> DataFrame:
    """Adds x1, y1: the sample `steps` later in x (ties of x by y); null at the end of a run.

    width: stretch of x that makes one block; a block's samples are one window group.
    """
    here = F.struct("x", "y")
    blocks = signal.withColumn("_b", F.floor(F.col("x") / F.lit(width)))
    inner = Window.partitionBy("run", "_b").orderBy("x", "y")
    rows = blocks.withColumn("_n", F.lead(here, steps).over(inner)).withColumn("_rest", F.count(F.lit(1)).over(inner.rowsBetween(1, Window.unboundedFollowing)))
    # first samples of each block, handed to the blocks before it
    ranked = blocks.withColumn("_i", F.row_number().over(inner)).filter(F.col("_i") <= steps)
    heads = ranked.groupBy("run", "_b").agg(F.array_sort(F.collect_list(here)).alias("_head"))
    over = Window.partitionBy("run").orderBy("_b").rowsBetween(1, steps)
    heads = heads.select("run", "_b", F.flatten(F.collect_list("_head").over(over)).alias("_after"))
    joined = rows.join(heads, ["run", "_b"])
    late = F.try_element_at("_after", (F.lit(steps) - F.col("_rest")).cast("int"))
    nxt = F.coalesce("_n", F.when(F.col("_rest") < steps, late))
    return joined.select("run", "x", "y", nxt["x"].alias("x1"), nxt["y"].alias("y1"))


def crossings(segments: DataFrame, level: Column | float, log_x: bool = False) -> DataFrame:
    """(run, x, x_at, falling): every segment that reaches the level, `x_at` interpolated."""
    lv = mathx.number(level)
    falling, rising = mathx.crosses(F.col("y"), F.col("y1"), lv)
    at = mathx.inverse_interpolate(F.col("x"), F.col("x1"), F.col("y"), F.col("y1"), lv, log_x)
    return segments.withColumn("falling", falling).filter(falling | rising).select("run", "x", at.alias("x_at"), "falling")


def first_crossing(crossed: DataFrame, falling: bool | None = None, after: float | None = None) -> DataFrame:
    rows = crossed if falling is None else crossed.filter(F.col("falling") == falling)
    rows = rows if after is None else rows.filter(F.col("x") >= after)
    return rows.groupBy("run").agg(F.min_by("x_at", "x").alias("x_at"))


def last_crossing_below(crossed: DataFrame, before: float, falling: bool | None = None) -> DataFrame:
    rows = crossed.filter(F.col("x") < before)
    rows = rows if falling is None else rows.filter(F.col("falling") == falling)
    return rows.groupBy("run").agg(F.max_by("x_at", "x").alias("x_at"))


def closure(segments: DataFrame, level: float, log_x: bool = False) -> DataFrame:
    """Crossing after the last sample above the level; null if a run ends above it or never is."""
    real = segments.filter(F.col("y").isNotNull() & ~F.isnan("y"))
    last = real.filter(F.col("y") > level).groupBy("run").agg(F.max(F.struct("x", "y", "x1", "y1")).alias("s"))
    at = mathx.inverse_interpolate(F.col("s.x"), F.col("s.x1"), F.col("s.y"), F.col("s.y1"), F.lit(float(level)), log_x)
    return real.select("run").distinct().join(last, "run", "left").select("run", F.when(F.col("s.x1").isNotNull(), at).alias("x_at"))


def slopes(segments: DataFrame) -> DataFrame:
    """(run, x, slope) of segments with positive dx and finite ends."""
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    ok = (dx > 0) & mathx.is_finite(F.col("y")) & mathx.is_finite(F.col("y1"))
    return segments.filter(ok).select("run", "x", (dy / dx).alias("slope"))


def shape(segments: DataFrame) -> DataFrame:
    """Per run: swing, steepest slope, trapezoid of y and root of the trapezoid of y squared, monotone flags."""
    y, y1, dx = F.col("y"), F.col("y1"), F.col("x1") - F.col("x")
    dy = y1 - y
    real = segments.filter(mathx.is_finite(y))
    return real.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("y") - F.min("y")).alias("swing"),
        F.max(F.when(dx > 0, F.abs(dy / F.nullif(dx, F.lit(0.0))))).alias("max_slope"),
        F.coalesce(F.sum(0.5 * (y + y1) * dx), F.lit(0.0)).alias("integral"),
        F.sqrt(F.coalesce(F.sum(0.5 * (y * y + y1 * y1) * dx), F.lit(0.0))).alias("rms_integral"),
        F.coalesce((F.min(F.when(dy != 0, F.signum(dy))) == F.max(F.when(dy != 0, F.signum(dy)))), F.lit(True)).alias("monotone"),
    )


def summarize(signal: DataFrame) -> DataFrame:
    """Per run: samples, extremes with their first x, peak to peak, mean, rms, last value."""
    real = signal.filter(mathx.is_finite(F.col("y")))
    return real.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("y").alias("max"), F.min(F.struct(-F.col("y"), "x")).getField("x").alias("x_max"),
        F.min("y").alias("min"), F.min(F.struct("y", "x")).getField("x").alias("x_min"),
        (F.max("y") - F.min("y")).alias("pp"), F.avg("y").alias("avg"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rms"),
        F.max_by("y", "x").alias("last"),
    )


def window_drift(signal: DataFrame, width: float) -> DataFrame:
    """|mean of the second half - mean of the first half| by rank; null below two samples."""
    rows = ordered.with_rank(signal, "run", ["x", "y"], F.floor(F.col("x") / F.lit(width)))
    first = F.col("_rank") <= F.floor(F.col("_n") / 2)
    drift = F.abs(F.avg(F.when(~first, F.col("y"))) - F.avg(F.when(first, F.col("y"))))
    return rows.groupBy("run").agg(F.max("_n").alias("n"), drift.alias("drift")).select("run", F.when(F.col("n") >= 2, F.col("drift")).alias("drift"))


def settling(signal: DataFrame, target: Column, band: Column) -> DataFrame:
    """x of the first sample after the last one outside the band; null unless two samples follow it."""
    out = F.abs(F.col("y") - target) > band
    last = signal.groupBy("run").agg(F.max(F.when(out, F.col("x"))).alias("last"), F.min("x").alias("x0"))
    after = signal.join(last, "run").filter(F.col("last").isNull() | (F.col("x") > F.col("last")))
    return after.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_at"), F.min("x0").alias("x0")).select("run", F.when(F.col("n") >= 2, F.col("x_at") - F.col("x0")).alias("settling"))


def unwrap(signal: DataFrame, width: float) -> DataFrame:
    """Phases (y, degrees) made continuous; null and NaN phases pass through and are skipped.

    Steps are reduced pairwise, then summed: sums per block first, block offsets next, so
    no running sum covers a whole run.
    """
    real = signal.filter(mathx.is_finite(F.col("y")))
    seg = with_next(real, width).withColumn("_b", F.floor(F.col("x") / F.lit(width)))
    step = seg.withColumn("d", mathx.unwrap_step(F.col("y1") - F.col("y")))
    own = Window.partitionBy("run", "_b").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1)
    rows = step.withColumn("s", F.coalesce(F.sum("d").over(own), F.lit(0.0)))
    sums = step.groupBy("run", "_b").agg(F.sum("d").alias("t"), F.min(F.struct("x", "y")).alias("h"))
    over = Window.partitionBy("run").orderBy("_b")
    sums = sums.select("run", "_b", F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("o"), F.first("h.y").over(over).alias("y0"))
    good = rows.join(sums, ["run", "_b"]).select("run", "x", "y", (F.col("y0") + F.col("o") + F.col("s")).alias("phase"))
    other = signal.filter(~mathx.is_finite(F.col("y"))).select("run", "x", "y", F.col("y").alias("phase"))
    return good.unionByName(other)


def value_at(segments: DataFrame, targets: DataFrame, log_x: bool = True, clamp: bool = False) -> DataFrame:
    """(run, x_at, value): y at each target x, interpolated in the bracketing segment (in
    log10(x) where positive), an exact hit gives the sample; outside the band null, or the
    end sample with clamp. targets: (run, x_at)."""
    t = F.col("x_at")
    x0, x1, y0, y1 = (F.col(c) for c in ("x", "x1", "y", "y1"))
    share = (t - x0) / (x1 - x0)
    if log_x:
        share = F.when((x0 > 0) & (x1 > 0) & (t > 0), (F.log10(t) - F.log10(x0)) / (F.log10(x1) - F.log10(x0))).otherwise(share)
    inside = segments.join(targets, "run").filter((x0 <= t) & ((t < x1) | (x1.isNull() & (t == x0))))
    value = F.when(t == x0, y0).otherwise(y0 + share * (y1 - y0))
    hit = inside.select("run", "x_at", "x", value.alias("value")).groupBy("run", "x_at").agg(F.min_by("value", "x").alias("value"))
    out = targets.join(hit, ["run", "x_at"], "left")
    if not clamp:
        return out
    ends = segments.groupBy("run").agg(F.min_by("y", "x").alias("lo"), F.min("x").alias("x_lo"), F.max_by("y", "x").alias("hi"))
    return out.join(ends, "run").select("run", "x_at", F.coalesce("value", F.when(t < F.col("x_lo"), F.col("lo")).otherwise(F.col("hi"))).alias("value"))


def local_slope(signal: DataFrame, decades: float = 0.1) -> DataFrame:
    """dB per decade from a run's first sample to the first one at least `decades` higher in x, or else its last."""
    pos = signal.filter((F.col("x") > 0) & mathx.is_finite(F.col("y")))
    first = pos.groupBy("run").agg(F.min(F.struct("x", "y")).alias("a"))
    far = F.log10(F.col("x")) >= F.log10(F.col("a.x")) + F.lit(decades)
    ends = pos.join(first, "run").groupBy("run").agg(
        F.first("a").alias("a"), F.min(F.when(far, F.struct("x", "y"))).alias("b"), F.max(F.struct("x", "y")).alias("c")
    )
    b = F.coalesce("b", "c")
    slope = (b["y"] - F.col("a.y")) / F.nullif(F.log10(b["x"]) - F.log10(F.col("a.x")), F.lit(0.0))
    return ends.select("run", slope.alias("slope"))


def oscillation(segments: DataFrame, least: int = 8, spread: float = 0.35) -> DataFrame:
    """(run, frequency, reason): from strict sign changes about the midline at sample times.

    At least `least` samples and four changes, and every half-period within `spread` of the
    mean, else no frequency but a reason.
    """
    mid = segments.groupBy("run").agg(((F.max("y") + F.min("y")) / 2).alias("mid"), F.count(F.lit(1)).alias("n"))
    change = (F.col("y") - F.col("mid")) * (F.col("y1") - F.col("mid")) < 0
    marks = segments.join(mid, "run").filter(change).select("run", F.col("x1").alias("x"), F.lit(0.0).alias("y"))
    half = with_next(marks, 86400.0).filter("x1 is not null").withColumn("h", F.col("x1") - F.col("x"))
    stats = half.groupBy("run").agg(F.count(F.lit(1)).alias("k"), F.avg("h").alias("mean"), F.max("h").alias("hi"), F.min("h").alias("lo"))
    joined = mid.join(stats, "run", "left")
    regular = (F.col("hi") <= F.col("mean") * (1 + spread)) & (F.col("lo") >= F.col("mean") * (1 - spread))
    reason = F.when(F.col("n") < least, "few_samples").when(F.coalesce("k", F.lit(0)) < 3, "few_crossings").when(~regular, "irregular")
    return joined.select("run", F.when(reason.isNull(), 1 / (2 * F.col("mean"))).alias("frequency"), reason.alias("reason"))


def central_gain(signal: DataFrame, width: float, least: int = 10) -> DataFrame:
    """20 log10 of the steepest central difference (at least 0.01); null below `least` samples."""
    wide = with_next(signal, width, 2)
    g = F.abs(F.col("y1") - F.col("y")) / F.nullif(F.abs(F.col("x1") - F.col("x")), F.lit(0.0))
    per = wide.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max(g).alias("g"))
    return per.select("run", F.when(F.col("n") >= least, 20 * F.log10(F.greatest("g", F.lit(0.01)))).alias("gain_db"))


def line_slope(signal: DataFrame) -> DataFrame:
    """Least-squares slope of y on x per run."""
    return signal.groupBy("run").agg(F.regr_slope("y", "x").alias("slope"))


def transfer(out: DataFrame, inp: DataFrame) -> DataFrame:
    """(run, x, db, deg) of the complex ratio of two signals (run, x, re, im): a zero divisor
    gives NaN, a zero ratio -inf dB and NaN degrees."""
    a, b, c, d = F.col("o.re"), F.col("o.im"), F.col("i.re"), F.col("i.im")
    den = c * c + d * d
    safe = F.nullif(den, F.lit(0.0))
    re, im = (a * c + b * d) / safe, (b * c - a * d) / safe
    mag = F.sqrt(re * re + im * im)
    rows = out.alias("o").join(inp.alias("i"), ["run", "x"])
    nan = F.lit(float("nan"))
    return rows.select(
        "run", "x", F.when(den == 0, nan).otherwise(mathx.db20(mag)).alias("db"),
        F.when((den == 0) | (mag == 0), nan).otherwise(F.degrees(F.atan2(im, re))).alias("deg"),
    )


def normalize_phase(points: DataFrame) -> DataFrame:
    """Phases of (run, x, y) shifted by the whole half turns of each run's first finite sample."""
    finite = points.filter("y is not null and not isnan(y)")
    first = finite.groupBy("run").agg(F.min_by("y", "x").alias("_first"))
    shift = F.round(F.col("_first") / 180.0) * 180.0
    return points.join(first, "run", "left").select("run", "x", (F.col("y") - F.coalesce(shift, F.lit(0.0))).alias("y"))


def quick_metrics(seg: DataFrame, drop: float = 3.0) -> DataFrame:
    """(run, first, bandwidth, swing, steepest) of segments (see `with_next`), to four significant
    digits: the first value, the first x at which the value is `drop` or more below it, the
    swing, and the largest slope by size with its sign."""
    first = seg.groupBy("run").agg(F.min_by("y", "x").alias("first"))
    rows = seg.join(first, "run")
    slope = F.when(F.col("x1") > F.col("x"), (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x")))
    got = rows.groupBy("run").agg(
        F.max("first").alias("first"), F.min(F.when(F.col("y") <= F.col("first") - drop, F.col("x"))).alias("bandwidth"),
        (F.max("y") - F.min("y")).alias("swing"), F.max_by(slope, F.struct(F.abs(slope), -F.col("x"))).alias("steepest"),
    )
    return got.select("run", *[mathx.significant(F.col(c), 4).alias(c) for c in ("first", "bandwidth", "swing", "steepest")])
