"""Signal queries. Each user's events are a waveform (x: seconds since 2024, y: value);
each embedding is a dense vector signal (x: position + 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.functions import mathx
from circuitlake.operators import signals as sig
from circuitlake.runtime import table

EPOCH = 1704067200  # 2024-01-01
DAY = 86400.0


def _wave(spark, d):
    e = table(spark, d, "events")
    return sig.samples(e, F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH, F.col("value"))


def _vec(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "y"))
    return sig.samples(v, F.col("vec_id"), F.col("i") + 1.0, F.col("y").cast("double") * 100)


def _seg(spark, d):
    return sig.with_next(_wave(spark, d), DAY)


def _rounded(df, digits=6):
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LEVEL = 15.0


def crossings(spark, d):
    return _rounded(sig.crossings(_seg(spark, d), LEVEL), 4)


def crossings_log(spark, d):
    seg = sig.with_next(_vec(spark, d), 16.0)
    c = sig.crossings(seg, 0.0, log_x=True)
    first = sig.first_crossing(c, falling=True).withColumnRenamed("x_at", "first_falling")
    last = sig.last_crossing_below(c, 32.0).withColumnRenamed("x_at", "last_below")
    return _rounded(first.join(last, "run", "full_outer"))


def closure(spark, d):
    return _rounded(sig.closure(sig.with_next(_vec(spark, d), 16.0), 10.0, log_x=True))


def value_at(spark, d):
    v = _vec(spark, d)
    targets = v.select("run").distinct().select("run", F.explode(F.array(F.lit(0.5), F.lit(3.0), F.lit(7.7), F.lit(64.0), F.lit(99.0))).alias("x_at"))
    plain = sig.value_at(sig.with_next(v, 16.0), targets)
    held = sig.value_at(sig.with_next(v, 16.0), targets, clamp=True).withColumnRenamed("value", "clamped")
    return _rounded(plain.join(held, ["run", "x_at"]))


def unwrapped(spark, d):
    phases = _vec(spark, d).withColumn("y", F.pmod(F.col("y") * 37, F.lit(360.0)) - 180)
    return _rounded(sig.unwrap(phases, 16.0))


def settling(spark, d):
    v = _vec(spark, d)
    return _rounded(sig.settling(v, F.lit(0.0), F.lit(20.0)))


def transfer(spark, d):
    v = _vec(spark, d)
    half = lambda r: v.filter(r).select("run", F.floor((F.col("x") - 1) / 4).alias("x"), "y", F.pmod(F.col("x") - 1, F.lit(4.0)).alias("p"))

    def part(p):
        rows = half(F.lit(True))
        re = rows.filter(F.col("p") == p).select("run", "x", F.col("y").alias("re"))
        return re.join(rows.filter(F.col("p") == p + 1).select("run", "x", F.col("y").alias("im")), ["run", "x"])

    return _rounded(sig.transfer(part(0), part(2)))


def scalars(spark, d):
    """Scalar functions over part and supplier numbers."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("p_partkey"), F.col("c_acctbal").alias("b"))
    j = p.join(c, "p_partkey")
    return j.select(
        "p_partkey",
        F.round(mathx.db20(F.col("b")), 6).alias("db"),
        F.round(mathx.db20(F.col("s") - 10, floor=-60), 6).alias("db_floor"),
        mathx.significant(F.col("b") / 7.1234, 4).alias("sig4"),
        F.round(mathx.unwrap_step(F.col("b")), 6).alias("step"),
        F.round(mathx.bode_phase(F.col("s")), 6).alias("bode"),
        F.round(mathx.log_encode(F.col("b")), 6).alias("enc"),
        F.round(mathx.log_decode(F.col("s") / 10), 6).alias("dec"),
        F.round(mathx.transconductance(F.col("r"), F.col("s"), F.lit(2.0), F.lit(0.5)), 6).alias("gm"),
        F.round(mathx.mismatch_sigma(F.col("r"), F.col("s"), F.lit(3.0)), 6).alias("sigma"),
    )


QUERIES = {
    "signal_crossings": crossings,
    "signal_crossings_log": crossings_log,
    "signal_closure": closure,
    "signal_shape": lambda spark, d: _rounded(sig.shape(_seg(spark, d)), 4),
    "signal_summary": lambda spark, d: _rounded(sig.summarize(_wave(spark, d)), 4),
    "signal_slopes": lambda spark, d: _rounded(sig.slopes(_seg(spark, d)).withColumn("slope", F.col("slope") * 1000)),
    "signal_drift": lambda spark, d: _rounded(sig.window_drift(_wave(spark, d), DAY)),
    "signal_settling": settling,
    "signal_unwrap": unwrapped,
    "signal_value_at": value_at,
    "signal_local_slope": lambda spark, d: _rounded(sig.local_slope(_vec(spark, d))),
    "signal_oscillation": lambda spark, d: _rounded(sig.oscillation(_seg(spark, d)), 9),
    "signal_central_gain": lambda spark, d: _rounded(sig.central_gain(_vec(spark, d), 16.0)),
    "signal_line_slope": lambda spark, d: _rounded(sig.line_slope(_vec(spark, d))),
    "signal_transfer": transfer,
    "scalar_math": scalars,
}

_W = f"w AS (SELECT user_id AS run, epoch_us(ts) / 1e6 - {EPOCH} AS x, value AS y FROM events), s AS (SELECT *, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM w WINDOW o AS (PARTITION BY run ORDER BY x, y))"
_V = "v AS (SELECT vec_id AS run, unnest(range(len(embedding))) + 1.0::DOUBLE AS x, unnest(embedding)::DOUBLE * 100 AS y FROM embeddings), s AS (SELECT *, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM v WINDOW o AS (PARTITION BY run ORDER BY x, y))"
_LOGX = "pow(10, log10(x) + ({l} - y) / (y1 - y) * (log10(x1) - log10(x)))"

SQL = {
    "signal_crossings": f"WITH {_W} SELECT run, round(x, 4) AS x, round(x + ({LEVEL} - y) / (y1 - y) * (x1 - x), 4) AS x_at, y > y1 AS falling FROM s WHERE (y >= {LEVEL} AND {LEVEL} >= y1 AND y > y1) OR (y <= {LEVEL} AND {LEVEL} <= y1 AND y < y1)",
    "signal_crossings_log": f"""WITH {_V}, c AS (SELECT run, x, {_LOGX.format(l=0)} AS x_at, y > y1 AS falling FROM s WHERE (y >= 0 AND 0 >= y1 AND y > y1) OR (y <= 0 AND 0 <= y1 AND y < y1)),
  f AS (SELECT run, arg_min(x_at, x) AS a FROM c WHERE falling GROUP BY run), l AS (SELECT run, arg_max(x_at, x) AS b FROM c WHERE x < 32 GROUP BY run)
SELECT run, round(a, 6) AS first_falling, round(b, 6) AS last_below FROM f FULL JOIN l USING (run)""",
    "signal_closure": f"WITH {_V}, l AS (SELECT run, max(x) FILTER (y > 10) AS m FROM v GROUP BY run) SELECT l.run, round({_LOGX.format(l=10)}, 6) AS x_at FROM l LEFT JOIN s ON s.run = l.run AND s.x = l.m",
    "signal_shape": f"""WITH {_W} SELECT run, count(*) AS n, round(max(y) - min(y), 4) AS swing, round(max(abs((y1 - y) / nullif(x1 - x, 0))), 4) AS max_slope, round(coalesce(sum(0.5 * (y + y1) * (x1 - x)), 0), 4) AS integral,
  round(sqrt(coalesce(sum(0.5 * (y * y + y1 * y1) * (x1 - x)), 0)), 4) AS rms_integral, coalesce(min(sign(y1 - y)) FILTER (y1 <> y) = max(sign(y1 - y)) FILTER (y1 <> y), true) AS monotone FROM s GROUP BY run""",
    "signal_summary": f"""WITH {_W}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY y DESC, x) AS hi, row_number() OVER (PARTITION BY run ORDER BY y, x) AS lo FROM w)
SELECT run, count(*) AS n, round(max(y), 4) AS max, round(max(x) FILTER (hi = 1), 4) AS x_max, round(min(y), 4) AS min, round(max(x) FILTER (lo = 1), 4) AS x_min, round(max(y) - min(y), 4) AS pp,
  round(avg(y), 4) AS avg, round(sqrt(avg(y * y)), 4) AS rms, round(arg_max(y, x), 4) AS last FROM r GROUP BY run""",
    "signal_slopes": f"WITH {_W} SELECT run, round(x, 6) AS x, round((y1 - y) / (x1 - x) * 1000, 6) AS slope FROM s WHERE x1 > x",
    "signal_drift": f"WITH {_W}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM w) SELECT run, round(CASE WHEN count(*) >= 2 THEN abs(avg(y) FILTER (i >= n // 2) - avg(y) FILTER (i < n // 2)) END, 6) AS drift FROM r GROUP BY run",
    "signal_settling": f"WITH {_V}, l AS (SELECT run, max(x) FILTER (abs(y) > 20) AS last, min(x) AS x0 FROM v GROUP BY run) SELECT run, round(CASE WHEN count(*) >= 2 THEN min(x) - min(x0) END, 6) AS settling FROM v JOIN l USING (run) WHERE last IS NULL OR x > last GROUP BY run",
    "signal_unwrap": f"""WITH {_V}, p AS (SELECT run, x, ((y * 37) % 360 + 360) % 360 - 180 AS y FROM v), q AS (SELECT *, y - lag(y) OVER o AS d, first_value(y) OVER o AS y0 FROM p WINDOW o AS (PARTITION BY run ORDER BY x))
SELECT run, round(x, 6) AS x, round(y, 6) AS y, round(y0 + coalesce(sum(CASE WHEN d > 180 THEN d - 360 * ceil((d - 180) / 360) WHEN d < -180 THEN d - 360 * floor((d + 180) / 360) ELSE d END) OVER (PARTITION BY run ORDER BY x), 0), 6) AS phase FROM q""",
    "signal_value_at": f"""WITH {_V}, t AS (SELECT DISTINCT run, unnest([0.5::DOUBLE, 3, 7.7, 64, 99]) AS x_at FROM v),
  h AS (SELECT t.run, x_at, CASE WHEN x_at = x THEN y ELSE y + (log10(x_at) - log10(x)) / (log10(x1) - log10(x)) * (y1 - y) END AS value FROM t JOIN s ON s.run = t.run AND x <= x_at AND (x_at < x1 OR (x1 IS NULL AND x_at = x))),
  e AS (SELECT run, arg_min(y, x) AS lo, arg_max(y, x) AS hi FROM v GROUP BY run)
SELECT t.run, round(t.x_at, 6) AS x_at, round(value, 6) AS value, round(coalesce(value, CASE WHEN t.x_at < 1 THEN lo ELSE hi END), 6) AS clamped FROM t LEFT JOIN h ON h.run = t.run AND h.x_at = t.x_at JOIN e ON e.run = t.run""",
    "signal_local_slope": f"WITH {_V}, a AS (SELECT run, arg_min(y, x) AS ya, min(x) AS xa FROM v GROUP BY run) SELECT run, round((arg_min(y, x) FILTER (log10(x) >= log10(xa) + 0.1) - any_value(ya)) / (log10(min(x) FILTER (log10(x) >= log10(xa) + 0.1)) - log10(any_value(xa))), 6) AS slope FROM v JOIN a USING (run) GROUP BY run",
    "signal_oscillation": f"""WITH {_W}, m AS (SELECT run, (max(y) + min(y)) / 2 AS mid, count(*) AS n FROM w GROUP BY run),
  k AS (SELECT s.run, x1 AS t FROM s JOIN m USING (run) WHERE (y - mid) * (y1 - mid) < 0), h AS (SELECT run, lead(t) OVER (PARTITION BY run ORDER BY t) - t AS h FROM k),
  g AS (SELECT run, count(h) AS k, avg(h) AS mean, max(h) AS hi, min(h) AS lo FROM h GROUP BY run),
  z AS (SELECT run, mean, CASE WHEN n < 8 THEN 'few_samples' WHEN coalesce(k, 0) < 3 THEN 'few_crossings' WHEN NOT (hi <= mean * 1.35 AND lo >= mean * 0.65) THEN 'irregular' END AS reason FROM m LEFT JOIN g USING (run))
SELECT run, round(CASE WHEN reason IS NULL THEN 1 / (2 * mean) END, 9) AS frequency, reason FROM z""",
    "signal_central_gain": f"WITH {_V}, c AS (SELECT run, abs(lead(y, 2) OVER o - y) / nullif(abs(lead(x, 2) OVER o - x), 0) AS g FROM v WINDOW o AS (PARTITION BY run ORDER BY x)) SELECT run, round(CASE WHEN count(*) >= 10 THEN 20 * log10(greatest(max(g), 0.01)) END, 6) AS gain_db FROM c GROUP BY run",
    "signal_line_slope": f"WITH {_V} SELECT run, round(regr_slope(y, x), 6) AS slope FROM v GROUP BY run",
    "signal_transfer": f"""WITH {_V}, p AS (SELECT run, floor((x - 1) / 4)::BIGINT AS x, max(y) FILTER ((x - 1) % 4 = 0) AS a, max(y) FILTER ((x - 1) % 4 = 1) AS b, max(y) FILTER ((x - 1) % 4 = 2) AS c, max(y) FILTER ((x - 1) % 4 = 3) AS d FROM v GROUP BY 1, 2),
  q AS (SELECT run, x, (a * c + b * d) / (c * c + d * d) AS re, (b * c - a * d) / (c * c + d * d) AS im FROM p)
SELECT run, x, round(20 * log10(sqrt(re * re + im * im)), 6) AS db, round(degrees(atan2(im, re)), 6) AS deg FROM q""",
    "scalar_math": """SELECT p_partkey, round(CASE WHEN c_acctbal = 0 THEN '-inf'::DOUBLE ELSE 20 * log10(abs(c_acctbal)) END, 6) AS db,
  round(CASE WHEN p_size = 10 THEN -60 ELSE greatest(20 * log10(abs(p_size - 10.0)), -60) END, 6) AS db_floor, CASE WHEN c_acctbal = 0 THEN 0 ELSE printf('%.3e', c_acctbal / 7.1234)::DOUBLE END AS sig4,
  round(CASE WHEN c_acctbal > 180 THEN c_acctbal - 360 * ceil((c_acctbal - 180) / 360) WHEN c_acctbal < -180 THEN c_acctbal - 360 * floor((c_acctbal + 180) / 360) ELSE c_acctbal END, 6) AS step,
  round(4.5::DOUBLE * p_size, 6) AS bode, round(log10(greatest(c_acctbal, 1e-300)), 6) AS enc, round(pow(10, p_size / 10.0::DOUBLE), 6) AS dec,
  round(sqrt(2 * p_retailprice * (p_size / 2.0::DOUBLE) * 0.5), 6) AS gm, round(p_retailprice / sqrt(p_size * 3.0::DOUBLE), 6) AS sigma FROM part JOIN customer ON c_custkey = p_partkey""",
}
