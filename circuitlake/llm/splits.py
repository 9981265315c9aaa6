"""Train, validation and test splits that keep related records together.

Records are related if their task names resolve to one design task: spellings are
folded to a key, renames are followed to their end. The components (tasks, unregistered
names, records without a name) are bundled by identical size and label profile; a
min-cost flow sends each bundle's records to the splits under quotas with convex
deviation costs; flows are rounded to whole components, largest first, carrying the
remainder; members are then assigned by rank of their hash within the bundle.

Only the bundle table reaches the driver: it has one row per distinct (size, profile),
at most O(sqrt(rows)) many. Beyond `max_bundles` the bundles of most components stay as they
are and the rarest ones are merged by the two leading digits of their size and by their
profile; a merged bundle supplies the exact sum of its records, and its members are laid out
by their exact sizes, so quotas and labels are kept and only the rounding (by at most one
component a split) differs.

Defined results: a null, blank or unregistered task name resolves to no task; records
without a name are components of their own (keyed by id); repeated deliveries of an id
count once and differing task names of one id resolve to the smallest; rows with null
id are left out, as nothing names them; empty tables give empty results. A component
larger than a quota takes the split with the most room, so the hot task goes to train.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from circuitlake.runtime import cut, join_skewed, small

SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))
MAX_BUNDLES = 4096
#: Hash buckets in which members are ranked: bounds each ranking group.
RANK_BUCKETS = 1024


def name_key(name: Column) -> Column:
    """Fold the spellings of a task name: directory, file type, revision, case,
    separators and leading zeros of the number do not count. Null for blank names."""
    s = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"^.*[/\\]", "")
    s = F.regexp_replace(s, r"\s*[#@].*$", "")
    s = F.regexp_replace(s, r"[\s_.\-]*\(?\b(?:rev|run|v|version|revision)[\s_.\-]*\d+\)?$", "")
    s = F.regexp_replace(s, r"\.(?:ya?ml|json|cir|sp|txt)$", "")
    s = F.regexp_replace(s, r"[^\p{L}\p{Nd}]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    number = F.regexp_extract(s, r"(\d+)$", 1)
    base = F.regexp_replace(F.regexp_replace(s, r"\d+$", ""), "_", "")
    key = F.concat(base, F.lit("#"), F.regexp_replace(number, r"^0+(?=\d)", ""))
    return F.when(F.length(s) > 0, key)


def task_names(eval_task: DataFrame, task_alias: DataFrame) -> DataFrame:
    """(key, task): every known spelling key, old names resolved through all renames.

    Both tables are dimensions. Pointers are doubled, so a chain of n renames takes log2(n)
    rounds; what still moves after log2(all renames) rounds runs in a loop and resolves to
    nothing. If two tasks share a key the smaller id is taken.
    """
    tasks = eval_task.filter("id is not null").select(name_key(F.col("id")).alias("key"), F.col("id").alias("task"))
    tasks = tasks.filter("key is not null").groupBy("key").agg(F.min("task").alias("task"))
    links = task_alias.select(name_key(F.col("old_id")).alias("key"), name_key(F.col("new_id")).alias("to"))
    ends = small(cut(links.filter("key is not null and to is not null and key <> to").groupBy("key").agg(F.min("to").alias("to"))))
    for _ in range(ends.count().bit_length() + 1):
        hop = small(ends.select(F.col("key").alias("to"), F.col("to").alias("next")))
        hopped = cut(ends.join(hop, "to", "left").select("key", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        ends = hopped.select("key", "to")
        if hopped.filter("moved").limit(1).count() == 0:
            break
    old = ends.join(tasks.withColumnRenamed("key", "to"), "to").select("key", "task")  # the names of a loop are no ends
    looped = ends.join(ends.select(F.col("key").alias("to")), "to", "left_semi").select("key")
    return tasks.unionByName(old.join(tasks.select("key"), "key", "left_anti").join(looped, "key", "left_anti"))


def resolve(records: DataFrame, eval_task: DataFrame, task_alias: DataFrame) -> DataFrame:
    """(id, task, name, success) once per id: the design task, or null and the folded name."""
    names = small(cut(task_names(eval_task, task_alias)))
    rows = records.filter("id is not null").select("id", name_key(F.col("task_id")).alias("key"), F.col("success").cast("int").alias("success"))
    rows = rows.join(names, "key", "left")
    return rows.groupBy("id").agg(F.min("task").alias("task"), F.min("key").alias("name"), F.max("success").alias("success"))


def min_cost_flow(supply: np.ndarray, sizes: np.ndarray, counts: np.ndarray, shares: np.ndarray, quotas: np.ndarray) -> np.ndarray:
    """Flow of records from bundles to splits: successive shortest paths.

    supply[b] = sizes[b] * counts[b]. An arc (b, s) costs 0 up to the whole components of
    the proportional share, 1 for one component more, 4 beyond. A split costs 0 up to its
    quota and 10 beyond. All capacities are integral, so the flow is.
    """
    n, k = len(supply), len(shares)
    whole = np.floor(np.outer(counts, shares) + 1e-9).astype(np.int64) * sizes[:, None]
    caps = np.stack([whole, np.repeat(sizes[:, None], k, 1), np.repeat(supply[:, None], k, 1)])
    costs = np.array([0, 1, 4])
    used = np.zeros_like(caps)
    room = np.stack([quotas.astype(np.int64), np.full(k, int(supply.sum()), np.int64)])
    quota_costs = np.array([0, 10])
    left = supply.astype(np.int64).copy()
    big = 1 << 40
    while left.any():
        # cheapest forward arc of every (b, s); cheapest way to take flow back out of (b, s)
        forward = np.full((n, k), big)
        back = np.full((n, k), big)
        for level in (2, 1, 0):
            forward = np.where(used[level] < caps[level], costs[level], forward)
        for level in (0, 1, 2):
            back = np.where(used[level] > 0, -costs[level], back)
        # distances over splits: direct from a bundle with supply, or by moving a bundle's flow from split to split
        source = np.where(left[:, None] > 0, forward, big)
        dist, via = source.min(0), [(int(source[:, s].argmin()),) for s in range(k)]
        shift = np.minimum(back[:, :, None] + forward[:, None, :], big)  # (b, from, to)
        move, by = shift.min(0), shift.argmin(0)
        parent = [-1] * k
        for _ in range(k):
            for s in range(k):
                for t in range(k):
                    if s != t and dist[s] + move[s, t] < dist[t]:
                        dist[t], parent[t] = dist[s] + move[s, t], s
        exit_cost = np.where(room[0] > 0, quota_costs[0], quota_costs[1])
        s = int((dist + exit_cost).argmin())
        path, amount = [], int(room[0, s] if room[0, s] > 0 else room[1, s])
        while parent[s] >= 0:
            path.append((int(by[parent[s], s]), parent[s], s))
            s = parent[s]
        b0 = via[s][0]
        arcs = [(b0, s, 1)] + [x for b, f, t in path for x in ((b, f, -1), (b, t, 1))]
        amount = min(amount, int(left[b0]))
        picked = []
        for b, t, sign in arcs:
            if sign > 0:
                level = next(i for i in range(3) if used[i, b, t] < caps[i, b, t])
                amount = min(amount, int(caps[level, b, t] - used[level, b, t]))
            else:
                level = next(i for i in (2, 1, 0) if used[i, b, t] > 0)
                amount = min(amount, int(used[level, b, t]))
            picked.append((level, b, t, sign))
        for level, b, t, sign in picked:
            used[level, b, t] += sign * amount
        last = path[0][2] if path else s
        room[0 if room[0, last] > 0 else 1, last] -= amount
        left[b0] -= amount
    return used.sum(0)


def round_flow(flow: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole components per (bundle, split), largest components first.

    What rounding took from a split's flow is carried to the next bundle, so the records
    of a split end within about one small component of its flow.
    """
    out = np.zeros_like(flow)
    carry = np.zeros(flow.shape[1])
    for b in np.argsort(-sizes, kind="stable"):
        want = np.maximum(flow[b] + carry, 0)
        want *= sizes[b] * counts[b] / max(want.sum(), 1e-9)
        whole = np.floor(want / sizes[b] + 1e-9).astype(np.int64)
        owed = want - whole * sizes[b]
        for _ in range(int(counts[b] - whole.sum())):
            s = int(owed.argmax())
            whole[s] += 1
            owed[s] -= sizes[b]
        out[b] = whole
        carry += flow[b] - whole * sizes[b]
    return out


def _two_digits(c: Column) -> Column:
    scale = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.greatest(c, F.lit(1)))) - 1, F.lit(0)))
    return (F.floor(c / scale) * scale).cast("long")


def _bundled(comps: DataFrame, max_bundles: int) -> DataFrame:
    """Components with their bundle: (bundle, merged, profile), bundle being the exact size or a merged one's size class."""
    table = comps.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n"))
    if table.limit(max_bundles + 1).count() <= max_bundles:
        return comps.withColumn("bundle", F.col("size")).withColumn("merged", F.lit(False))
    kept = cut(table.orderBy(F.desc("n"), "size", "profile").limit(max_bundles // 2).select("size", "profile"))
    kept = F.broadcast(kept.withColumn("kept", F.lit(True)))  # at most max_bundles / 2 rows
    comps = comps.join(kept, ["size", "profile"], "left").withColumn("merged", F.col("kept").isNull()).drop("kept")
    return comps.withColumn("bundle", F.when(F.col("merged"), _two_digits(F.col("size"))).otherwise(F.col("size")))


def assign(records: DataFrame, eval_task: DataFrame, task_alias: DataFrame, splits=SPLITS, max_bundles: int = MAX_BUNDLES) -> DataFrame:
    """(id, component, task_id, split): the split of every record, whole components together."""
    spark = records.sparkSession
    named = resolve(records, eval_task, task_alias)
    component = F.coalesce(F.concat(F.lit("task:"), "task"), F.concat(F.lit("name:"), "name"), F.concat(F.lit("id:"), "id"))
    rows = cut(named.select("id", component.alias("component"), F.col("task").alias("task_id"), "success"))
    comps = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("success"), F.lit(0)).alias("good")
    )
    # label profile: successes of small components exactly, their share in tenths beyond
    profile = F.when(F.col("size") <= 10, F.col("good")).otherwise(F.round(F.col("good") * 10 / F.col("size"))).cast("long")
    comps = cut(comps.select("component", "size", profile.alias("profile"), F.xxhash64("component").alias("h")))
    comps = _bundled(comps, max_bundles)
    table = comps.groupBy("bundle", "merged", "profile").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("supply"))
    bundles = table.orderBy("bundle", "profile", "merged").collect()  # bounded, see the module
    names, shares = [s for s, _ in splits], np.array([p for _, p in splits])
    schema = "bundle long, merged boolean, profile long, lo long, hi long, split string"
    ranges, total = [], 0
    if bundles:
        supply, counts = np.array([b["supply"] for b in bundles], np.int64), np.array([b["n"] for b in bundles], np.int64)
        sizes = np.maximum(1, supply // counts)
        total = int(supply.sum())
        quotas = np.floor(shares * total).astype(np.int64)
        quotas[0] += total - quotas.sum()
        flow = min_cost_flow(supply, sizes, counts, shares, quotas)
        exact = np.array([not b["merged"] for b in bundles])
        out = flow.astype(np.int64)  # records a split gets of a merged bundle
        out[exact] = round_flow(flow[exact], sizes[exact], counts[exact]) * sizes[exact][:, None]
        for row, parts in zip(bundles, out, strict=True):
            lo = 0
            for s, n in enumerate(parts):
                if n:
                    ranges.append((row["bundle"], row["merged"], row["profile"], lo, lo + int(n), names[s]))
                lo += int(n)
    ranges = spark.createDataFrame(ranges, schema)
    # members in the order of their hash, laid end to end by size: offsets of hash buckets first, then inside each bucket
    key = ["bundle", "merged", "profile"]
    comps = comps.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(RANK_BUCKETS)).cast("int"))
    offsets = comps.groupBy(*key, "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy(*key, "bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    laid = comps.withColumn("here", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, [*key, "bucket"])
    middle = 2 * (F.col("offset") + F.col("here")) + F.col("size")
    placed = laid.withColumn("middle", middle).join(F.broadcast(ranges), key).filter("middle >= 2 * lo and middle < 2 * hi").select("component", "split", "size")
    return join_skewed(rows, cut(placed), "component", "size", total).select("id", "component", "task_id", "split")


def found(records: DataFrame, eval_task: DataFrame, task_alias: DataFrame) -> DataFrame:
    return assign(records, eval_task, task_alias).filter("task_id is not null").select("id", "task_id")


def report(assigned: DataFrame) -> DataFrame:
    """Per split: records, components and share."""
    totals = assigned.groupBy("split", "component").agg(F.count(F.lit(1)).alias("n"))
    per = totals.groupBy("split").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("components"))
    everything = F.sum("records").over(Window.partitionBy())
    return per.withColumn("share", F.round(F.col("records") / everything, 4))


def whole(assigned: DataFrame, splits=SPLITS) -> DataFrame:
    """One row that any right result has alike: records, torn components (0), and whether every
    split but the first is within one hundredth of all records of its quota."""
    per = assigned.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    torn = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.sum((F.col("splits") > 1).cast("long")).alias("torn"))
    near = [F.abs(F.sum((F.col("split") == s).cast("long")) - F.count(F.lit(1)) * p) <= F.count(F.lit(1)) * 0.01 for s, p in splits]
    near = assigned.agg(*[n.alias(f"near_{s}") for n, (s, _) in zip(near, splits, strict=True)])
    return torn.crossJoin(near)  # one row each
