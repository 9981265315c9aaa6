"""The same or nearly the same record on both sides of a train/evaluation split.

Normalised records are cut into chunks where a rolling hash of the last words says so,
so equal passages give equal chunks wherever they stand. Chunk digests are joined across
the splits and the lengths of shared chunks summed: per pair they give its share of words in
shared chunks, and a pair whose share reaches 0.8 is taken (its bags overlap at least as much);
per record they give the fraction of it that also stands in train (`fractions`).

The pair join is exact yet avoids common chunks: chunks are ordered by their number of
holders, and only the rarest ones, up to all but `SLACK` of a record's length, are joined.
The chunks left out of both records end the same order, so they hold at most `SLACK` of the
longer one, and a pair that shares 0.8 of it still shares a joined chunk.

Small edits all over a record leave few equal chunks. Such pairs have an exact way of their
own: contents that share three sketches of their bags (`records.sketches`; at overlap 0.8 all
but 6e-5 of them, whatever the edit) and were not taken by chunks are decided by the exact
overlap. Exact copies are one content and are joined only when ids are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from circuitlake.llm import records as rec
from circuitlake.runtime import cut, small

#: Share of a record, its most common chunks, that need not be joined; below rec.OVERLAP.
SLACK = 0.75
EVAL_SPLITS = ("val", "test")

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def cut_chunks(words: list[str], window: int = 2, least: int = 4, mean: int = 4, most: int = 16, hashes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(digest, number of words) of each chunk: a cut falls where the hash of the last
    `window` words divides by `mean`, after `least` and at the latest after `most` words."""
    h = rec.word_hashes(words) if hashes is None else hashes
    n = len(words)
    with np.errstate(over="ignore"):
        r = np.zeros(n, np.uint64)
        for k in range(window):
            r = r * _ODD
            r[k:] += h[: n - k]
        r ^= r >> np.uint64(29)
        r = (r * _MIX) >> np.uint64(32)
    marks = np.flatnonzero(r % np.uint64(mean) == 0).tolist()
    out, start, m = [], 0, 0
    while start < n:
        while m < len(marks) and marks[m] < start + least - 1:
            m += 1
        last = marks[m] if m < len(marks) else n
        end = min(last + 1, start + most, n)
        out.append((xxhash.xxh64_intdigest(" ".join(words[start:end])), end - start))
        start = end
    return out


def chunk_sums(words: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the chunks of a record and the words each of them stands for."""
    total: dict[int, int] = {}
    for digest, n in cut_chunks(words, hashes=hashes):
        total[digest] = total.get(digest, 0) + n
    return np.fromiter(total, np.uint64, len(total)).view(np.int64), np.fromiter(total.values(), np.int32, len(total))


def chunk_rows(packed: DataFrame) -> DataFrame:
    """(cid, n_words, digest, weight): a row per chunk of each content."""
    rows = packed.select("cid", "n_words", F.explode(F.arrays_zip("chunks", "weights")).alias("c"))
    return rows.select("cid", "n_words", F.col("c.chunks").alias("digest"), F.col("c.weights").alias("weight"))


def rare_chunks(packed: DataFrame, slack: float = SLACK) -> DataFrame:
    """(cid, digest, weight, n_words): of each content the shared chunks among its rarest
    ones, up to all but `slack` of its length."""
    rows = chunk_rows(packed)
    holders = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    shared = rows.join(holders, "digest")
    # chunks nobody else has are the rarest and come first
    w = Window.partitionBy("cid").orderBy("holders", "digest")
    after = F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return shared.withColumn("after", after).filter(F.col("after") > F.col("n_words") * slack).select("cid", "digest", "weight", "n_words")


def _like(one: str, two: str) -> str:
    return f"least({one}, {two}) >= {rec.OVERLAP} * greatest({one}, {two})"


def _share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words in shared chunks over the words in either, of pairs of contents."""
    for b in batches:
        out = []
        for ca, wa, cb, wb, na, nb in zip(b["ca"], b["wa"], b["cb"], b["wb"], b["na"], b["nb"], strict=True):
            _, i, j = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
            shared = int(np.minimum(wa[i], wb[j]).sum())
            out.append(shared / (na + nb - shared))
        yield pd.DataFrame({"a": b["a"], "b": b["b"], "share": out})


def by_chunks(packed: DataFrame, sides: DataFrame) -> DataFrame:
    """(a, b, share): pairs of contents, a < b, one with a training record, the other with an
    evaluation record, whose shared chunks make up 0.8 of the words in either; materialised."""
    rare = cut(rare_chunks(packed).join(sides, "cid"))
    train = rare.filter("in_train").select(F.col("cid").alias("t"), "digest", F.col("n_words").alias("nt"))
    held = rare.filter("in_eval").select(F.col("cid").alias("e"), "digest", F.col("n_words").alias("ne"))
    pairs = train.join(held, "digest").filter("t <> e").filter(_like("nt", "ne"))
    pairs = pairs.select(F.least("t", "e").alias("a"), F.greatest("t", "e").alias("b")).distinct()
    one = packed.select(F.col("cid").alias("a"), F.col("n_words").alias("na"), F.col("chunks").alias("ca"), F.col("weights").alias("wa"))
    two = packed.select(F.col("cid").alias("b"), F.col("n_words").alias("nb"), F.col("chunks").alias("cb"), F.col("weights").alias("wb"))
    return cut(pairs.join(one, "a").join(two, "b").mapInPandas(_share, "a long, b long, share double").filter(F.col("share") >= rec.OVERLAP))


def by_sketches(packed: DataFrame, sides: DataFrame) -> DataFrame:
    """(a, b) of contents of like length, one with a training record, the other with an
    evaluation record, that share `rec.MEETINGS` sketches; materialised."""
    rows = packed.join(sides, "cid").select("cid", "n_words", "in_train", "in_eval", F.explode("sketches").alias("s"))
    rows = rows.select("cid", "n_words", "in_train", "in_eval", F.shiftright("s", 8).alias("key"))
    train = rows.filter("in_train").select(F.col("cid").alias("t"), "key", F.col("n_words").alias("nt"))
    held = rows.filter("in_eval").select(F.col("cid").alias("e"), "key", F.col("n_words").alias("ne"))
    pairs = train.join(held, "key").filter("t <> e").filter(_like("nt", "ne"))
    pairs = pairs.groupBy("t", "e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rec.MEETINGS)
    return cut(pairs.select(F.least("t", "e").alias("a"), F.greatest("t", "e").alias("b")).distinct())


def _exact(a: list[str], b: list[str], row) -> tuple | None:
    share = rec.overlap(a, b)
    return (share,) if share >= rec.OVERLAP else None


def _contents(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with their content (id, split, source, cid); contents (cid, id, in_train, in_eval);
    their chunks and sketches. Only records of the three splits take part."""
    split = F.lower(F.regexp_replace("split", r"\s+", ""))
    profiled = rec.profiles(records.filter(split.isin("train", *EVAL_SPLITS)), chunk_sums)
    everyone = rec.members(profiled)
    sides = everyone.groupBy("digest").agg(
        F.min("id").alias("id"), F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval")
    )
    sides = rec.numbered(sides)
    everyone = everyone.join(sides.select("digest", "cid"), "digest").select("id", "split", "source", "cid")
    return everyone, sides, rec.packed(profiled, sides, "sketches", "chunks", "weights")


def _links(records: DataFrame, sides: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, b, share, decided_by) in both directions; contents of both sides are linked to themselves."""
    marks = sides.select("cid", "in_train", "in_eval")
    taken = by_chunks(packed, marks)
    rest = cut(by_sketches(packed, marks).join(taken.select("a", "b"), ["a", "b"], "left_anti"))
    ids = rest.select(F.col("a").alias("cid")).union(rest.select(F.col("b").alias("cid"))).distinct()
    exact = rec.decided(rest, rec.texts(records, sides.select("cid", "id").join(ids, "cid")), _exact, "share double")
    near = cut(taken.withColumn("decided_by", F.lit("chunks")).union(exact.withColumn("decided_by", F.lit("bags"))))
    copies = sides.filter("in_train and in_eval").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("share"), F.lit("chunks").alias("decided_by"))
    return near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "share", "decided_by")).union(copies)


def overlaps(records: DataFrame) -> DataFrame:
    """Every pair of records, one in train, one in val or test, with overlap of 0.8 or more:
    id_train, id_eval, eval_split, source_train, source_eval, share, decided_by. share: words in
    shared chunks, or shared words where bags decided, over the words in either."""
    everyone, sides, packed = _contents(records)
    links = _links(records, sides, packed)
    train = everyone.filter("split = 'train'").select(F.col("cid").alias("a"), F.col("id").alias("id_train"), F.col("source").alias("source_train"))
    held = everyone.filter("split <> 'train'").select(
        F.col("cid").alias("b"), F.col("id").alias("id_eval"), F.col("split").alias("eval_split"), F.col("source").alias("source_eval")
    )
    return links.join(train, "a").join(held, "b").select("id_train", "id_eval", "eval_split", "source_train", "source_eval", "share", "decided_by")


def found(records: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b."""
    rows = overlaps(records)
    return rows.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


def report(records: DataFrame) -> DataFrame:
    """Counts per evaluation split and source: pairs, leaked evaluation records, training records.

    Counted from the numbers of records per content; pairs of copies are never written out.
    """
    everyone, sides, packed = _contents(records)
    links = _links(records, sides, packed).select("a", "b").distinct()
    train = everyone.filter("split = 'train'").groupBy(F.col("cid").alias("a")).agg(F.count(F.lit(1)).alias("n_train"))
    held = everyone.filter("split <> 'train'").groupBy(F.col("cid").alias("b"), F.col("split").alias("eval_split"), F.col("source").alias("source_eval"))
    held = held.agg(F.count(F.lit(1)).alias("n_eval"))
    rows = cut(links.join(train, "a").join(held, "b"))
    cell = ["eval_split", "source_eval"]

    def once(side: str, n: str, name: str) -> DataFrame:
        return rows.groupBy(*cell, side).agg(F.max(n).alias("n")).groupBy(*cell).agg(F.sum("n").alias(name))

    pairs = rows.groupBy(*cell).agg(F.sum(F.col("n_train") * F.col("n_eval")).alias("pairs"))
    out = pairs
    for other in (once("b", "n_eval", "eval_records"), once("a", "n_train", "train_records")):
        other = other.toDF("s", "e", other.columns[-1])
        out = out.join(other, out["eval_split"].eqNullSafe(other["s"]) & out["source_eval"].eqNullSafe(other["e"])).drop("s", "e")
    return out


def fractions(records: DataFrame) -> DataFrame:
    """(id, split, source, covered) of every evaluation record: the fraction of its words that
    stand in chunks some training record holds too."""
    everyone, sides, packed = _contents(records)
    rows = chunk_rows(packed).join(sides.select("cid", "in_train", "in_eval"), "cid")
    known = rows.filter("in_train").select("digest").distinct()
    covered = rows.filter("in_eval").join(known, "digest", "left_semi").groupBy("cid").agg(F.sum("weight").alias("weight"))
    covered = packed.select("cid", "n_words").join(covered, "cid", "left").select("cid", (F.coalesce("weight", F.lit(0)) / F.col("n_words")).alias("covered"))
    return everyone.filter("split <> 'train'").join(small(covered), "cid").select("id", "split", "source", "covered")
