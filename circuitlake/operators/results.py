"""Simulator results: choosing and pairing signals, noise, stability, corner and Monte Carlo
grids, seeded parameters and scripted trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circuitlake.functions import mathx
from circuitlake.operators import signals as sig
from circuitlake.runtime import small

OUTPUTS = ("out", "vout", "output")
INPUTS = ("in", "vin", "input")
MAX_CORNERS = 1000


def hash_uniform(key: Column, seed: int) -> Column:
    """Uniform in [0, 1) from a key: equal on every machine and in every order."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def pick_signal(signals: DataFrame, wanted: str | None = None, names: tuple[str, ...] = OUTPUTS, fallback: bool = True) -> DataFrame:
    """(run, name) chosen among signals (run, name): the wanted one, else the first of `names`,
    else (with fallback) the first that is no branch current; runs without a choice have null.

    The output chooser falls back, the input chooser must not.
    """
    base = F.lower(F.regexp_replace("name", r"^v\((.*)\)$", "$1"))
    rank = F.when(F.col("name") == F.lit(wanted), 0) if wanted else F.lit(None)
    for i, n in enumerate(names, 1):
        rank = F.coalesce(rank, F.when(base == n, i))
    if fallback:
        rank = F.coalesce(rank, F.when(~F.endswith("name", F.lit("#branch")), len(names) + 1))
    ranked = signals.select("run", "name", rank.alias("rank"))
    return ranked.groupBy("run").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "name"))).getField("name").alias("name"))


def pair_responses(vectors: DataFrame) -> DataFrame:
    """(run, node, x, gain_db, phase_deg) of vectors (run, name, x, y) named vdb(node) and vp(node);
    the phase is dropped where it does not have as many samples as the gain."""
    node = F.regexp_extract("name", r"^(?i:vdb|vp)\((.*)\)$", 1)
    kind = F.lower(F.regexp_extract("name", r"^((?i)vdb|vp)\(", 1))
    rows = vectors.select("run", node.alias("node"), kind.alias("kind"), "x", "y").filter("kind <> ''")
    sizes = rows.groupBy("run", "node").agg(F.count_if(F.col("kind") == "vdb").alias("ng"), F.count_if(F.col("kind") == "vp").alias("np"))
    wide = rows.groupBy("run", "node", "x").agg(F.max(F.when(F.col("kind") == "vdb", F.col("y"))).alias("gain_db"), F.max(F.when(F.col("kind") == "vp", F.col("y"))).alias("phase_deg"))
    return wide.join(sizes, ["run", "node"]).filter("gain_db is not null").select("run", "node", "x", "gain_db", F.when(F.col("ng") == F.col("np"), F.col("phase_deg")).alias("phase_deg"))


def pair_on_axis(out: DataFrame, drive: DataFrame) -> DataFrame:
    """(run, same_axis): whether two signals (run, x, y) stand on identical axes; only then may
    they be subtracted in time."""
    a = out.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("h"))
    b = drive.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("g"))
    return a.join(b, "run", "left").select("run", F.coalesce((F.col("n") == F.col("m")) & (F.col("h") == F.col("g")), F.lit(False)).alias("same_axis"))


def belongs_to_deck(branches: DataFrame, elements: DataFrame) -> DataFrame:
    """(run, belongs): every branch (run, name) is an element (run, name) of the run's deck."""
    stray = branches.join(elements, ["run", "name"], "left_anti").select("run").distinct().withColumn("stray", F.lit(True))
    return branches.select("run").distinct().join(stray, "run", "left").select("run", F.col("stray").isNull().alias("belongs"))


def overlay(defaults: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two configurations of equal columns: an override's value where it has one."""
    values = [c for c in defaults.columns if c not in keys]
    b = overrides.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    return defaults.join(b, keys, "full_outer").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def noise_metrics(spectrum: DataFrame, width: float, at: float | None = None) -> DataFrame:
    """(run, density, rms, reason) of spectra (run, x, y) with y in units per root hertz.

    density: at a frequency, or the first sample if the low end is flat within 0.25 dB per
    decade; rms: root of the trapezoid of y squared over x; null below two samples or with a
    negative sample.
    """
    seg = sig.with_next(spectrum, width)
    shape = sig.shape(seg)
    bad = spectrum.groupBy("run").agg(F.min("y").alias("least"), F.min_by("y", "x").alias("first"))
    rms = F.when((F.col("n") >= 2) & (F.col("least") >= 0), F.col("rms_integral"))
    if at is not None:
        level = sig.value_at(seg, spectrum.select("run").distinct().withColumn("x_at", F.lit(float(at))))
        out = bad.join(shape, "run").join(level.select("run", F.col("value").alias("density")), "run", "left")
        return out.select("run", "density", rms.alias("rms"), F.when(F.col("density").isNull(), "outside_sweep").alias("reason"))
    logs = spectrum.withColumn("y", mathx.db20(F.col("y")))
    out = bad.join(shape, "run").join(sig.local_slope(logs), "run", "left")
    flat = F.coalesce(F.abs("slope") <= 0.25, F.lit(False))
    return out.select("run", F.when(flat, F.col("first")).alias("density"), rms.alias("rms"), F.when(~flat, "not_flat_at_start").alias("reason"))


def stability(loop_out: DataFrame, loop_in: DataFrame) -> DataFrame:
    """(run, phase_margin, gain_margin, ugb, reason) of a loop gain out / in, both (run, x, re, im).
    Without a phase margin there is a reason instead of an error."""
    from circuitlake.operators import waveforms

    h = sig.transfer(loop_out, loop_in).select("run", F.col("x").alias("f"), F.col("db").alias("gain_db"), F.col("deg").alias("phase_deg"))
    m = waveforms.ac(h)
    reason = F.when(F.col("phase_margin").isNull(), F.coalesce(F.try_element_at("notes", F.lit("phase_margin")), F.lit("no_phase_margin")))
    gain = F.when(F.try_element_at("notes", F.lit("gain_margin")) == "infinite", F.lit(float("inf"))).otherwise(F.col("gain_margin"))
    return m.select("run", "phase_margin", gain.alias("gain_margin"), "ugb", reason.alias("reason"))


def corner_grid(decks: DataFrame, corners: DataFrame) -> DataFrame:
    """Every deck at every PVT corner: the grid is the result, so this is a cross join; the corners
    are a dimension and refused beyond MAX_CORNERS."""
    if corners.limit(MAX_CORNERS + 1).count() > MAX_CORNERS:
        raise ValueError(f"more than {MAX_CORNERS} corners")
    return decks.crossJoin(F.broadcast(corners))


def monte_carlo_grid(decks: DataFrame, n: int, seed: int) -> DataFrame:
    """n seeded runs per deck (seed, seed + 1, ...); refused for n below 1."""
    if n < 1:
        raise ValueError("nothing to run")
    return decks.select("*", F.explode(F.sequence(F.lit(seed), F.lit(seed + n - 1))).alias("seed"))


def jitter(params: DataFrame, share: float, seed: int) -> DataFrame:
    """(.., value) of params (task, name, default, low, high, integer): uniform within `share` of
    the default, clipped to its bounds, whole if integer. Seeded by name and task."""
    u = hash_uniform(F.concat_ws("|", "task", "name"), seed) * 2 - 1
    value = F.greatest(F.col("low"), F.least(F.col("high"), F.col("default") * (1 + F.lit(share) * u)))
    return params.withColumn("value", F.when(F.col("integer"), F.rint(value)).otherwise(value))


def features(decks: DataFrame, text: str = "text") -> DataFrame:
    """Adds total_width (sum of W in metres) and devices of a deck's text: what a mock simulator reads."""
    from circuitlake.operators import netlists

    widths = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bW\s*=\s*(\S+)"), 1), netlists.loose_number)
    total = F.aggregate(widths, F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x))
    devices = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)^[mx]\\w")))
    return decks.withColumn("total_width", total).withColumn("devices", devices)


def mock_gain(total_width: Column, devices: Column, key: Column, seed: int, noise: float = 0.5) -> Column:
    """A linear response of the features with seeded, bounded noise."""
    return 20.0 + total_width * 1e5 + devices * 2.0 + (hash_uniform(key, seed) * 2 - 1) * noise


def scripted_trajectory(tasks: DataFrame, prompt: str) -> DataFrame:
    """(id, messages) of tasks (id, request, netlist, result): a complete scripted chat with one tool call."""
    call = F.concat(F.lit("<tool_call>"), F.to_json(F.struct(F.lit("sim.ac").alias("name"), F.struct(F.col("netlist").alias("netlist")).alias("arguments"))), F.lit("</tool_call>"))

    def say(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    turns = F.array(say("system", F.lit(prompt)), say("user", F.col("request")), say("assistant", call), say("tool", F.col("result")), say("assistant", F.concat(F.lit("Measured: "), F.col("result"))))
    return tasks.select("id", turns.alias("messages"))


def attempts(tasks: DataFrame, n: int) -> DataFrame:
    """n numbered attempts per task, for a generator to fill; keep the successes with filter("success")."""
    return tasks.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("attempt"))


def grounded_specs(measured: DataFrame, seed: int, keep: int = 3) -> DataFrame:
    """(run, name, low, high): bounds at a seeded factor (1.05 to 1.5) of the first `keep` measured
    values (run, pos, name, value, larger_is_better), on the side that the value meets."""
    f = 1.05 + 0.45 * hash_uniform(F.concat_ws("|", "run", "name"), seed)
    rows = measured.filter(F.col("pos") < keep)
    low = F.when(F.col("larger_is_better"), F.col("value") / f)
    high = F.when(~F.col("larger_is_better"), F.col("value") * f)
    return rows.select("run", "name", low.alias("low"), high.alias("high"))


def corner_lookup(requests: DataFrame, corners: DataFrame) -> DataFrame:
    """(.., section, voltage, temperature) of requests (pdk, corner, ..) by the corner table (pdk,
    corner, section, voltage, temperature), a dimension. Names are compared in lower case; no corner
    means tt for the section and nothing for the rest; what is not configured stays null."""
    name = F.lower(F.trim("corner"))
    one = corners.select("pdk", F.lower("corner").alias("_c"), "section", "voltage", "temperature")
    rows = requests.withColumn("_n", name)
    section = small(one.select(F.col("pdk").alias("_p"), F.col("_c").alias("_s"), "section"))
    rows = rows.join(section, (F.col("pdk") == F.col("_p")) & (F.coalesce("_n", F.lit("tt")) == F.col("_s")), "left").drop("_p", "_s")
    pvt = small(one.select(F.col("pdk").alias("_p"), "_c", "voltage", "temperature"))
    return rows.join(pvt, (F.col("pdk") == F.col("_p")) & (F.col("_n") == F.col("_c")), "left").drop("_p", "_c", "_n")


def sizing(candidates: DataFrame, low: Column, fails: float = -1.0) -> DataFrame:
    """(task, candidate, text, gain, score) of sizing candidates (task, candidate, template, values):
    values are put into the template, its features read, its gain predicted without noise and
    scored against `low`. A candidate whose template lacks a value scores `fails`.
    """
    from circuitlake.functions import scores
    from circuitlake.operators import netlists

    filled = candidates.withColumn("text", netlists.fill(F.col("template"), F.col("values")))
    rows = features(filled).withColumn("gain", F.when(F.col("text").isNotNull(), mock_gain(F.col("total_width"), F.col("devices"), F.col("candidate"), 0, 0.0)))
    score = F.coalesce(F.when(F.col("gain").isNotNull(), scores.contract(F.col("gain"), low, F.lit(None).cast("double"))), F.lit(fails))
    return rows.select("task", "candidate", "text", "gain", score.alias("score"))


def best_sizing(scored: DataFrame) -> DataFrame:
    """The best candidate of each task, ties to the smallest candidate."""
    return scored.groupBy("task").agg(F.min_by(F.struct("candidate", "gain", "score"), F.struct(-F.col("score"), "candidate")).alias("b")).select("task", "b.*")
