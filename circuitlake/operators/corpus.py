"""Corpus preparation: exact dedup, quality and license filters, splits, ordering, mixing, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from circuitlake.functions import mathx

def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def dedup_text(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """First row, by `order`, of each distinct text (by md5 of its UTF-8). Null texts are one text.

    Aggregates digests only, then joins the survivors back: equal texts are combined before
    the shuffle and text itself never moves for the grouping.
    """
    digest = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))
    keep = docs.select(digest.alias("digest"), order).groupBy("digest").agg(F.min(order).alias(order)).select(order)
    return docs.join(keep, order, "left_semi")


def dedup_by_id(rows: DataFrame, id_col: str, order: list[Column], keep: list[str]) -> DataFrame:
    """First row of each id by `order`; rows with null id are all kept (nothing says they are the same)."""
    with_id = rows.filter(F.col(id_col).isNotNull())
    first = with_id.groupBy(id_col).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r")).select(id_col, "r.*")
    return first.unionByName(rows.filter(F.col(id_col).isNull()).select(id_col, *keep))


def quality(docs: DataFrame, text: str = "text", longer_than: int = 10, marker: str = "�") -> DataFrame:
    """Texts longer than `longer_than` after stripping and without the garble marker; null texts go."""
    return docs.filter((F.length(strip(F.col(text))) > longer_than) & ~F.contains(F.col(text), F.lit(marker)))


def license_messages(sources: DataFrame) -> DataFrame:
    """One message for each source whose license is not compatible."""
    message = F.concat(F.lit("source "), "id", F.lit(" has incompatible license "), F.coalesce("license", F.lit("?")))
    return sources.filter(~F.col("license_compatible")).select("id", message.alias("message"))


def source_summary(sources: DataFrame) -> DataFrame:
    """Tokens by category, sources by license and the grand total, as grouping sets."""
    return sources.sparkSession.sql(
        """SELECT category, license, sum(coalesce(token_count, 0)) AS tokens, count(*) AS sources
           FROM {rows} GROUP BY GROUPING SETS ((category), (license), ())""",
        rows=sources,
    )


def stratified_split(rows: DataFrame, stratum: str, key: Column, share: float = 0.1) -> DataFrame:
    """Adds `split`: in each stratum the round-half-even(n * share) rows of smallest hash are
    val, the rest train.

    Ranks are exact but never computed in one task per stratum: hash prefixes are counted,
    turned into offsets, and only rows inside one prefix are sorted together.
    """
    h = F.md5(key.cast("string"))
    rows = rows.withColumn("_h", h).withColumn("_b", F.substring(h, 1, 2))
    counts = rows.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(stratum).orderBy("_b")
    whole = Window.partitionBy(stratum)
    offsets = counts.select(
        F.col(stratum).alias("_s"), F.col("_b").alias("_b2"), (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.bround(F.sum("_c").over(whole) * F.lit(share)).alias("_quota")
    )
    inner = Window.partitionBy(stratum, "_b").orderBy("_h", key)
    ranked = rows.withColumn("_rn", F.row_number().over(inner)).join(offsets, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2")))
    split = F.when(F.col("_rn") + F.col("_before") <= F.col("_quota"), "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_h", "_b", "_b2", "_s", "_before", "_quota", "_rn")


def hash_split(rows: DataFrame, key: Column, train_share: float = 0.9) -> DataFrame:
    """Adds `split` with exactly int(n * train_share) training rows, by md5 rank of the key."""
    n = rows.count()
    h = F.md5(key.cast("string"))
    rows = rows.withColumn("_h", h).withColumn("_b", F.substring(h, 1, 2))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))  # 256 rows at most
    inner = Window.partitionBy("_b").orderBy("_h", key)
    ranked = rows.withColumn("_rn", F.row_number().over(inner)).join(F.broadcast(offsets), "_b")
    split = F.when(F.col("_rn") + F.col("_before") <= int(n * train_share), "train").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_b", "_rn", "_before")


def tool_names(messages: str = "messages") -> Column:
    """Every `"name": "..."` in messages that speak of tool calls, names inside arguments too."""
    texts = F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))
    return F.flatten(F.transform(F.filter(texts, lambda t: F.contains(t, F.lit("tool_call"))), lambda t: F.regexp_extract_all(t, F.lit(r'"name"\s*:\s*"([^"]+)"'), 1)))


def difficulty(messages: str = "messages", score: str = "score") -> Column:
    """0.3 messages / 20 + 0.4 distinct tools / 6 + 0.3 (1 - score), each share at most 1; no score counts 0.5."""
    n = F.coalesce(F.size(messages), F.lit(0))
    tools = F.coalesce(F.size(F.array_distinct(tool_names(messages))), F.lit(0))
    return (
        F.least(F.lit(1.0), F.greatest(n, F.lit(0)) / 20.0) * 0.3
        + F.least(F.lit(1.0), F.greatest(tools, F.lit(0)) / 6.0) * 0.4
        + (1.0 - F.coalesce(score, F.lit(0.5))) * 0.3
    )


def curriculum(rows: DataFrame, keys: tuple[str, ...] = ("source", "id")) -> DataFrame:
    """Easiest first: a range-partitioned total order with explicit ties."""
    return rows.withColumn("difficulty", difficulty()).orderBy("difficulty", *keys)


def mix(corpus: DataFrame, filler: DataFrame, ratio: float, key: str) -> DataFrame:
    """Corpus plus int(n * r / (1 - r)) filler rows, those of smallest key hash."""
    n = int(corpus.count() * ratio / (1 - ratio))
    rows = filler.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 4,096 rows at most
    counts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_h", key)
    rows = rows.join(F.broadcast(counts.filter(F.col("_before") < n)), "_b").withColumn("_r", F.col("_before") + F.row_number().over(inside))
    picked = rows.filter(F.col("_r") <= n).select(*filler.columns)
    return corpus.withColumn("origin", F.lit("corpus")).unionByName(picked.withColumn("origin", F.lit("filler")), allowMissingColumns=True)


def ordered_union(lists: list[DataFrame], token: str = "token") -> DataFrame:
    """Distinct tokens of several lists (pos, token), by first appearance."""
    rows = None
    for i, part in enumerate(lists):
        part = part.select(F.lit(i).alias("list"), "pos", token)
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(token).agg(F.min(F.struct("list", "pos")).alias("first")).select(token, "first.list", "first.pos")


def new_tokens(tokens: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    return tokens.join(vocabulary, token, "left_anti")


def collection_totals(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Files, bytes and tokens (bytes over four) per source and in total, by rollup."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return docs.rollup(source).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.sum(mathx.token_estimate(size)).alias("tokens"), F.grouping(source).alias("is_total")
    )


def prepare(docs: DataFrame) -> DataFrame:
    """Dedup, quality filter, stratified split and summary per source and split."""
    kept = quality(dedup_text(docs.select("doc_id", "text", "source")))
    rows = kept.select("doc_id", "source", F.length("text").alias("chars"))
    rows = stratified_split(rows, "source", F.col("doc_id"))
    return rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("documents"), F.sum(mathx.token_estimate(F.col("chars"))).alias("tokens"))
