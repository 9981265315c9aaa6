"""Training sequences of fixed capacity filled with whole documents.

Documents longer than a sequence give full sequences and a rest; all other documents stay
whole. Items are packed in shards of bounded size, each with an inverted BM25 index over
tokenizer tokens: the longest unused item seeds a sequence and its best unused neighbours by
BM25 that fit fill it. The last place goes to the best neighbour among the items that leave
next to no room, if there are any, else to the item that leaves least. Token frequencies and
the mean length cover all documents. Sequences that a shard could not fill are taken apart
and packed again in the next round, in fewer shards.

Defined results: null, blank and empty texts have no tokens and no row; every token of
every other document stands in exactly one range; an item is split only if it is longer
than a sequence; rows with null doc_id are left out; a doc_id counts once however often
its row comes (the smallest text); special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circuitlake.runtime import cut, small, spread

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text before the merges of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens and items that one shard packs at most, on average: bound its memory and the items a place is chosen from.
SHARD_TOKENS, SHARD_ITEMS = 1 << 20, 1 << 13
#: A sequence below this fill is packed again, in at most ROUNDS rounds.
REPACK_BELOW = 0.995
ROUNDS = 3
#: Share of a sequence that may stay empty when a neighbour is preferred to the item that fits best,
#: and the room, in median items, from which on a place is the last one.
CLOSE, LAST = 0.001, 2.0
K1, B = 1.2, 0.75


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenize(documents: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, start, length, tokens, counts): the item of each document, its
    whole or its rest beyond full sequences (length 0 if there is none), as a bag of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(vocabulary)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = enc.encode_ordinary(text)
                start = len(ids) // capacity * capacity if len(ids) > capacity else 0
                tokens, counts = np.unique(np.array(ids[start:], np.int32), return_counts=True)
                rows.append((doc_id, len(ids), start, len(ids) - start, tokens, counts.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "start", "length", "tokens", "counts"])

    rows = documents.filter("doc_id is not null and text is not null and text rlike '\\\\S'").select("doc_id", "text")
    schema = "doc_id long, n_tokens long, start long, length long, tokens array<int>, counts array<int>"
    return rows.mapInPandas(run, schema).filter("n_tokens > 0")


class Index:
    """BM25 postings of a shard's items, by token."""

    def __init__(self, tokens: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float):
        item = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        flat = np.concatenate(tokens)
        tf = np.concatenate(counts).astype(np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        order = np.argsort(flat, kind="stable")
        self.token, self.first = np.unique(flat[order], return_index=True)
        self.stop = np.append(self.first[1:], len(flat))
        self.item, self.weight = item[order], weight[order]
        self.n = len(tokens)

    def scores(self, query: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.token, query)
        spans = [slice(self.first[k], self.stop[k]) for k in at]
        return np.bincount(np.concatenate([self.item[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def pack(tokens: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float, capacity: int) -> tuple[list[list[int]], list[list[float]]]:
    """Sequences of item numbers, seeds longest first, and the BM25 scores of their items for the
    seed, as shares of the seed's own score."""
    index = Index(tokens, counts, lengths.astype(np.float32), idf, mean)
    unused = np.ones(len(lengths), bool)
    sequences, likeness = [], []
    close = int(CLOSE * capacity)
    for seed in np.argsort(-lengths, kind="stable"):
        if not unused[seed]:
            continue
        unused[seed] = False
        sequence, like, room = [int(seed)], [1.0], capacity - int(lengths[seed])
        score = None
        while room > 0:
            fits = np.flatnonzero(unused & (lengths <= room))
            if not len(fits):
                break
            if score is None:
                score = index.scores(tokens[seed])
            own = lengths[fits]
            typical = np.partition(own, len(fits) // 2)[len(fits) // 2]
            if room < LAST * typical:  # the last place
                snug = fits[own >= room - close]
                fits = snug if len(snug) else fits[own == own.max()]
            best = fits[np.argmax(score[fits])]
            sequence.append(int(best))
            like.append(float(score[best] / max(score[seed], 1e-9)))
            unused[best] = False
            room -= int(lengths[best])
        sequences.append(sequence)
        likeness.append(like)
    return sequences, likeness


def _pack_shards(items: DataFrame, shards: int, idf, mean: float, capacity: int, number: int) -> DataFrame:
    """(doc_id, start, length, seq_id, place, fill, likeness), materialised."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        got, likeness = pack([np.asarray(t) for t in pdf["tokens"]], [np.asarray(c) for c in pdf["counts"]], lengths, idf.value, mean, capacity)
        order = [i for s in got for i in s]
        local = np.repeat(np.arange(len(got)), [len(s) for s in got])
        fill = np.array([lengths[s].sum() for s in got])
        out = pdf.iloc[order][["doc_id", "start", "length"]].copy()
        out["seq_id"] = (number << 56) + (int(pdf["shard"].iloc[0]) << 24) + local
        out["place"] = np.concatenate([np.arange(len(s)) for s in got])
        out["fill"] = fill[local]
        out["likeness"] = np.concatenate(likeness)
        return out

    schema = "doc_id long, start long, length long, seq_id long, place int, fill long, likeness double"
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(number)), F.lit(shards)))
    return cut(sharded.groupBy("shard").applyInPandas(run, schema))


def once(documents: DataFrame) -> DataFrame:
    """(doc_id, text), once per doc_id (the smallest text). Only repeated ids are shuffled with their texts."""
    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    repeated = small(cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")))
    if repeated.limit(1).count() == 0:
        return rows
    again = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(repeated, "doc_id", "left_anti").unionByName(again)


def packed_items(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(seq_id, place, doc_id, token_start, token_end, likeness): token ranges, end exclusive.

    seq_id numbers are unique, not consecutive: round, shard and number within it. likeness:
    BM25 score for the sequence's first item over that item's own; null for full sequences.
    """
    spark = documents.sparkSession
    items = cut(tokenize(spread(once(documents)), capacity, vocabulary))
    totals = items.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.avg("length").alias("mean")).first()
    frequency = items.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(tokenizer(vocabulary).n_vocab, np.float32)
    for r in frequency.collect():  # one row per token of the vocabulary at most
        df[r["token"]] = r["df"]
    idf = spark.sparkContext.broadcast(np.log1p((totals["n"] - df + 0.5) / (df + 0.5)).astype(np.float32))

    whole = items.filter(F.col("n_tokens") > capacity).select("doc_id", "n_tokens")
    whole = whole.select("doc_id", F.posexplode(F.expr(f"sequence(0L, n_tokens div {capacity} - 1)")).alias("part", "k"))
    whole = cut(whole.withColumn("seq_id", F.monotonically_increasing_id() + (1 << 62)))
    out = whole.select(
        "seq_id", F.lit(0).alias("place"), "doc_id", (F.col("k") * capacity).alias("token_start"), ((F.col("k") + 1) * capacity).alias("token_end"), F.lit(None).cast("double").alias("likeness")
    )
    rest = items.filter("length > 0").select("doc_id", "start", "length", "tokens", "counts")
    left, shards = rest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first(), 0
    for number in range(1, ROUNDS + 1):
        fewer = max(1, -(-left["tokens"] // shard_tokens), -(-left["n"] // shard_items))
        if left["n"] == 0 or (number > 1 and fewer == shards == 1):
            break
        shards = fewer
        packed = _pack_shards(rest, shards, idf, float(totals["mean"] or 1.0), capacity, number)
        last = number == ROUNDS or shards == 1
        done = packed if last else packed.filter(F.col("fill") >= REPACK_BELOW * capacity)
        out = out.union(done.select("seq_id", "place", "doc_id", F.col("start").alias("token_start"), (F.col("start") + F.col("length")).alias("token_end"), "likeness"))
        if last:
            break
        again = packed.filter(F.col("fill") < REPACK_BELOW * capacity).select("doc_id")
        rest = items.select("doc_id", "start", "length", "tokens", "counts").join(small(again), "doc_id", "left_semi")
        left = packed.filter(F.col("fill") < REPACK_BELOW * capacity).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    return out


def pack_documents(documents: DataFrame, **options) -> DataFrame:
    """(seq_id, place, doc_id, token_start, token_end), see `packed_items`."""
    return packed_items(documents, **options).drop("likeness")


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, documents, tokens, the fullest and emptiest sequence, share of unused
    room, and of the items after the first of a sequence the share that are BM25 neighbours of
    it and their mean likeness."""
    per = packed.groupBy("seq_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill"), F.count(F.lit(1)).alias("n"))
    added = F.when(F.col("place") > 0, F.col("likeness"))
    docs = packed.agg(
        F.countDistinct("doc_id").alias("documents"), F.round(F.avg((added > 0).cast("double")), 4).alias("neighbours"), F.round(F.avg(added), 4).alias("likeness")
    )
    stats = per.agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("ranges"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.min("fill").alias("emptiest")
    )
    unused = F.round(1 - F.col("tokens") / (F.col("sequences") * capacity), 6)
    return stats.crossJoin(docs).withColumn("unused", unused)  # one row each


def whole(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row that any right packing has alike: documents packed, and how many sequences are
    over capacity, documents have gaps or overlaps between their ranges, or are split although
    they are no longer than a sequence (all 0)."""
    over = packed.groupBy("seq_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill"))
    over = over.agg(F.coalesce(F.sum((F.col("fill") > capacity).cast("long")), F.lit(0)).alias("overfull"))
    span = F.max("token_end") - F.min("token_start")
    docs = packed.groupBy("doc_id").agg(
        (F.min("token_start") != 0).alias("late"), (F.sum(F.col("token_end") - F.col("token_start")) != span).alias("gap"),
        ((F.count(F.lit(1)) > 1) & (span <= capacity)).alias("split"),
    )
    counts = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("late", "gap", "split")]
    return docs.agg(F.count(F.lit(1)).alias("documents"), *counts).crossJoin(over)  # one row each
