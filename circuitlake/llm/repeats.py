"""Runs of the same event in ordered sequences, collapsed to one row each.

Boundary-only rows: a window over each sequence keeps the events that differ from
their predecessor; lead over these starts gives the run's end, the difference of
positions its length, and the end's timestamp its duration.

A sequence may hold any share of all rows, so windows run over blocks of `block`
consecutive order values, never over a whole sequence; blocks are stitched through one
summary row each (last event, count), and a boundary whose predecessor lies in the
block before is judged after that.

Defined results: rows without sequence id or order value belong to no sequence and are
left out; repeated deliveries of one (sequence, order) count once (the earliest by the
arrival column); an event without key ends a run and is part of none; a null timestamp
at either end of a run gives a null duration; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from circuitlake.functions import deck
from circuitlake.runtime import cut

#: Order values per window block: bounds the rows of one window group.
BLOCK = 4096


@F.pandas_udf(T.StringType())
def netlist_identity(netlist: pd.Series) -> pd.Series:
    return netlist.map(deck.identity, na_action="ignore")


def action_key(action: str = "action") -> Column:
    """Equality key of an agent action: its name with the circuit, or else the query. Null without action."""
    a = F.col(action)
    key = F.coalesce(netlist_identity(a["arguments"]["netlist"]), F.concat(F.lit("query:"), a["arguments"]["query"]), F.lit("none"))
    return F.when(a.isNotNull() & a["name"].isNotNull(), F.concat_ws("|", a["name"], key))


def collapse(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of equal `key` among events (seq, ord, key, ts, arrived): one row per run.

    Out: seq, key, first_ord, last_ord, n_events, duration_s. Runs of one event included.
    """
    # one delivery per (seq, ord); map-side combining keeps the shuffle small
    base = (
        events.filter(F.col("seq").isNotNull() & F.col("ord").isNotNull())
        .groupBy("seq", "ord")
        .agg(F.min_by(F.struct("key", "ts"), F.struct(F.col("arrived").isNull(), "arrived", F.col("key").isNull(), "key", "ts")).alias("e"))
        .select("seq", F.col("ord").cast("long").alias("ord"), "e.key", "e.ts", F.floor(F.col("ord") / block).alias("blk"))
    )
    base = cut(base)  # read twice below; keys may come from Python
    w = Window.partitionBy("seq", "blk").orderBy("ord")
    here = F.struct("ord", "key", "ts")
    rows = base.select("*", F.row_number().over(w).alias("rn"), F.lag(here).over(w).alias("prev"))
    starts_or_first = rows.filter((F.col("rn") == 1) | F.col("key").isNull() | ~F.col("key").eqNullSafe(F.col("prev.key")))

    over_blocks = Window.partitionBy("seq").orderBy("blk")
    blocks = (
        base.groupBy("seq", "blk")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by(here, "ord").alias("last"))
        .select(
            "seq", "blk", "n", "last",
            F.coalesce(F.sum("n").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.lag("last").over(over_blocks).alias("last_before"),
        )
    )
    starts = (
        starts_or_first.join(blocks, ["seq", "blk"])
        .withColumn("prev", F.when(F.col("rn") == 1, F.col("last_before")).otherwise(F.col("prev")))
        .filter(F.col("key").isNull() | F.col("prev").isNull() | ~F.col("key").eqNullSafe(F.col("prev.key")))
        .withColumn("pos", F.col("before") + F.col("rn"))
        .select("seq", "blk", "ord", "key", "ts", "pos", "prev", "before", "n", "last")
    )
    # the next start is in this block, or the first one of the next block that has any, or nowhere
    w2 = Window.partitionBy("seq", "blk").orderBy("pos")
    mark = F.struct("pos", F.col("prev.ord").alias("end_ord"), F.col("prev.ts").alias("end_ts"))
    starts = starts.withColumn("mark", mark).withColumn("next", F.lead("mark").over(w2))
    heads = starts.groupBy("seq", "blk").agg(F.min("mark").alias("head"))
    ends = (
        blocks.join(heads, ["seq", "blk"], "left")
        .select(
            "seq", "blk",
            F.first("head", ignorenulls=True).over(over_blocks.rowsBetween(1, Window.unboundedFollowing)).alias("next_head"),
            F.last(F.struct(F.lit(1).alias("one"), (F.col("before") + F.col("n") + 1).alias("pos"), "last")).over(
                over_blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ).alias("final"),
        )
    )
    runs = starts.join(ends, ["seq", "blk"])
    final = F.struct(F.col("final.pos").alias("pos"), F.col("final.last.ord").alias("end_ord"), F.col("final.last.ts").alias("end_ts"))
    runs = runs.withColumn("end", F.coalesce("next", "next_head", final))
    return runs.filter(F.col("key").isNotNull()).select(
        "seq",
        "key",
        F.col("ord").alias("first_ord"),
        F.col("end.end_ord").alias("last_ord"),
        (F.col("end.pos") - F.col("pos")).cast("long").alias("n_events"),
        ((F.unix_micros(F.col("end.end_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1e6)).alias("duration_s"),
    )


def repeated_names(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of actions of one name, whatever their arguments: run_id, first_step, last_step, action, n_events, duration_s."""
    events = steps.select(F.col("run_id").cast("long").alias("seq"), F.col("step").cast("long").alias("ord"), F.col("action.name").alias("key"), F.col("ts"), F.col("received_at").alias("arrived"))
    return collapse(events, block).select(F.col("seq").alias("run_id"), F.col("first_ord").alias("first_step"), F.col("last_ord").alias("last_step"), F.col("key").alias("action"), "n_events", "duration_s")


def repeated_actions(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every run of equal agent actions: run_id, first_step, last_step, action, n_events, duration_s."""
    events = steps.select(
        F.col("run_id").cast("long").alias("seq"), F.col("step").cast("long").alias("ord"), action_key().alias("key"), F.col("ts"), F.col("received_at").alias("arrived")
    )
    return collapse(events, block).select(
        F.col("seq").alias("run_id"),
        F.col("first_ord").alias("first_step"),
        F.col("last_ord").alias("last_step"),
        F.substring_index("key", "|", 1).alias("action"),
        "n_events",
        "duration_s",
    )
