"""Groups of records that differ by small edits.

Order MinHash: each of 80 sketches samples eight minimum occurrence-labelled words of a
record and keeps the order in which they stand in the text (`records.sketches`). Records
with equal bags of words are one content beforehand. Records that share the words of
three sketches are candidates. If they also share the order of one, the pair looks edited
in place and is verified by banded alignment: it is linked if the common subsequence within
the band makes up 0.8 of the words in either. An alignment that falls short, and pairs that
share sampled words but never their order (reordered text), are decided by the exact
overlap of their bags, which is what the overlap is defined on; an aligned pair always has
that overlap too. At overlap 0.8 a pair is missed with probability 6e-5, less above.
Groups are the components of the links.

Buckets of up to `ALL_PAIRS` contents are paired in full. Crowded buckets are not: each member
is first paired with the bucket's leader (of smallest hash, so mostly the same one in all
buckets of a group) and the components are found; then only members of different components
are still compared, and only where they meet in two more buckets, so no pair that meets three
times is lost and a large group of near-copies costs about one comparison a member. This changes which
links are looked at inside a component that holds together anyway, never the components;
`n_links` is therefore counted afterwards, over all pairs of a component, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circuitlake.llm import records as rec
from circuitlake.llm.components import connected_components
from circuitlake.runtime import cut, join_skewed, small

ALL_PAIRS = 256
#: Words left and right of the diagonal that an alignment may wander.
BAND = 64
#: Contents and words of a block in which links are counted, and tokens compared at once.
BLOCK, BLOCK_WORDS, SLICE = 512, 1 << 18, 4096


def banded_common(a: list[str], b: list[str], band: int = BAND) -> int:
    """Length of the longest common subsequence within `band` words of the diagonal (bit-parallel)."""
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    stop -= start
    end = 0
    while end < stop and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for j, w in enumerate(b):
        near = (1 << min(len(a), j + band + 1)) - 1
        if j > band:
            near &= ~((1 << min(len(a), j - band)) - 1)
        u = row & where.get(w, 0) & near
        row = ((row + u) | (row - u)) & full
    return start + end + len(a) - bin(row).count("1")


def decide(a: list[str], b: list[str], ordered: bool, threshold: float = rec.OVERLAP) -> bool | None:
    """Whether the alignment links the pair (True), the exact overlap does (False), or neither (None)."""
    if ordered:
        common = banded_common(a, b)
        if common >= threshold * (len(a) + len(b) - common):
            return True
    return False if rec.overlap(a, b) >= threshold else None


def _decide(a: list[str], b: list[str], row) -> tuple | None:
    got = decide(a, b, row.ordered)
    return None if got is None else (got,)


def verified(records: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, aligned) of the pairs (a, b, ordered) that are linked; materialised."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    return cut(rec.decided(pairs, rec.texts(records, reps.join(ids, "cid")), _decide, "aligned boolean", ("ordered",)))


def _met(one: str, two: str) -> Column:
    """Whether two entries (cid, n, order) are of like length and ordered by cid."""
    return F.expr(f"{one}.cid < {two}.cid and least({one}.n, {two}.n) >= {rec.OVERLAP} * greatest({one}.n, {two}.n)")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): the sketch keys that stand twice or more in a batch of contents."""
    for b in batches:
        keys, n = np.unique(b.column("sketches").flatten().to_numpy() >> 8, return_counts=True)
        yield pa.RecordBatch.from_pydict({"key": keys[n > 1], "n": n[n > 1]})


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ordered) per shared bucket of contents of like length, from one part of the rows (s, cid, n)."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("s", "cid", "n")] for b in batches]
    if not parts:
        return
    s, cid, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    del parts
    by = np.lexsort((cid, s >> 8))
    s, cid, n = s[by], cid[by], n[by]
    starts = np.flatnonzero(np.concatenate([[True], (s[1:] >> 8) != (s[:-1] >> 8)]))
    sizes = np.diff(np.append(starts, len(s)))
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        groups = starts[sizes == size]
        step = max(1, (1 << 20) // len(i))
        for at in range(0, len(groups), step):
            one = (groups[at : at + step, None] + i[None, :]).ravel()
            two = (groups[at : at + step, None] + j[None, :]).ravel()
            like = np.minimum(n[one], n[two]) >= rec.OVERLAP * np.maximum(n[one], n[two])
            one, two = one[like], two[like]
            yield pa.RecordBatch.from_pydict({"a": cid[one], "b": cid[two], "ordered": s[one] == s[two]})


def links(records: DataFrame, reps: DataFrame, packed: DataFrame, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(a, b, aligned) with a < b: verified links between contents; enough of them inside large
    buckets to connect what is connected. packed: (cid, n_words, sketches)."""
    # a bucket with more contents than there are batches stands twice in one of them
    crowded = packed.select("sketches").mapInArrow(_repeated, "key long, n long").groupBy("key").agg(F.sum("n").alias("size"))
    crowded = small(cut(crowded.filter(F.col("size") > all_pairs).select("key")))
    some = crowded.limit(1).count() > 0
    rows = packed.select("cid", F.col("n_words").alias("n"), F.explode("sketches").alias("s"))
    rows = rows.withColumn("key", F.shiftright("s", 8))
    sparse = rows.join(crowded, "key", "left_anti") if some else rows
    met = sparse.repartition("key").select("s", "cid", "n").mapInArrow(_bucket_pairs, "a long, b long, ordered boolean")
    large = rows.join(crowded, "key").select("key", "cid", "n", F.col("s").bitwiseAND(255).cast("short").alias("order"))
    if some:
        large = cut(large)
        leader = large.groupBy("key").agg(F.min_by(F.struct("cid", "n", "order"), F.xxhash64("cid")).alias("leader"))
        starred = large.join(small(leader), "key").select(F.struct("cid", "n", "order").alias("one"), F.col("leader").alias("two"))
        starred = starred.select(F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y")).filter(_met("x", "y"))
        met = met.union(starred.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.expr("x.order = y.order").alias("ordered")))
    met = met.withColumn("w", F.lit(1))
    candidates = met.groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("ordered").alias("ordered")).filter(F.col("w") >= rec.MEETINGS)
    candidates = cut(candidates.select("a", "b", "ordered"))
    near = verified(records, reps, candidates)
    if not some:
        return near
    # members of large buckets that are still apart: compare those that meet in two more
    roots = connected_components(near)
    large = large.drop("order").join(small(roots.withColumnRenamed("node", "cid")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    apart = cut(large.join(small(cut(mixed)), "key"))
    refined = apart.join(packed.select("cid", "sketches"), "cid").select("key", "cid", "n", "root", F.explode("sketches").alias("s"))
    refined = refined.select("*", F.shiftright("s", 8).alias("second"), F.col("s").bitwiseAND(255).cast("short").alias("order")).filter("second <> key")
    refined = refined.select(F.xxhash64(F.least("key", "second"), F.greatest("key", "second")).alias("both"), "cid", "n", "root", "order").dropDuplicates(["both", "cid"])
    still = refined.groupBy("both").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("both")
    refined = cut(refined.join(still, "both"))
    left = refined.select("both", F.struct("cid", "n", "order").alias("x"), F.col("root").alias("rx"))
    right = refined.select("both", F.struct("cid", "n", "order").alias("y"), F.col("root").alias("ry"))
    more = left.join(right, "both").filter("rx <> ry").filter(_met("x", "y"))
    more = more.groupBy(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).agg(F.max(F.expr("x.order = y.order")).alias("ordered"), F.count(F.lit(1)).alias("w"))
    # three buckets, one of them large, give at least two pairs of buckets
    more = cut(more.filter("w >= 2").select("a", "b", "ordered").join(candidates, ["a", "b"], "left_anti"))
    return near.union(verified(records, reps, more))


def _named(records: DataFrame, all_pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (id, digest); their contents (cid, id, digest); contents with a near relative
    or a copy (cid, digest, root, group_id, n)."""
    profiled = rec.profiles(records)
    everyone = rec.members(profiled).select("id", "digest")
    reps = rec.numbered(everyone.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    near = links(records, reps.select("cid", "id"), rec.packed(profiled, reps, "sketches"), all_pairs)
    roots = connected_components(near)
    kept = reps.join(small(roots.withColumnRenamed("node", "cid")), "cid", "left").filter("root is not null or n > 1")
    kept = kept.withColumn("root", F.coalesce("root", "cid"))
    names = kept.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("contents"))
    kept = join_skewed(kept, names, "root", "contents", reps.count())
    return everyone, reps, cut(kept.select("cid", "digest", "root", "group_id", "n"))


def _written_out(everyone: DataFrame, named: DataFrame, *columns: str) -> DataFrame:
    """Records of the named contents; copies of one content may be many."""
    total = named.agg(F.sum("n")).first()[0] or 0
    return join_skewed(everyone, named.select("digest", "n", *columns), "digest", "n", total)


def _bag_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        bags = [rec.bag_hashes(rec.word_hashes(rec.words(t))).view(np.int64) for t in b["text"]]
        yield pd.DataFrame({"cid": b["cid"], "bag": bags, "n_words": [len(x) for x in bags]})


def _count_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the contents of blocks lo and hi, or inside the block if they are one."""
    sizes = pdf["n_words"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(pdf)), sizes)
    _, token = np.unique(np.concatenate(pdf["bag"].to_list()), return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    shared = np.zeros((len(pdf), len(pdf)), np.float32)
    for at in range(0, int(token[-1]) + 1, SLICE):
        i, j = np.searchsorted(token, [at, at + SLICE])
        dense = np.zeros((len(pdf), SLICE), np.float32)
        dense[row[i:j], token[i:j] - at] = 1
        shared += dense @ dense.T
    common = shared.astype(np.float64)
    linked = common / (sizes[:, None] + sizes[None, :] - common) >= rec.OVERLAP
    np.fill_diagonal(linked, False)
    block = pdf["block"].to_numpy()
    if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
        linked &= block[:, None] != block[None, :]
    return pd.DataFrame({"cid": pdf["cid"], "n": linked.sum(1)})


def link_counts(records: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """(cid, n_links): of each content of a component (cid, root) the number of contents it
    is linked to. All pairs of a component are counted, block by block."""
    bags = cut(rec.texts(records, reps.join(roots.select("cid"), "cid")).mapInPandas(_bag_rows, "cid long, bag array<long>, n_words long").join(small(roots), "cid"))
    sizes = bags.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("total")).filter("n > 1")
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_WORDS)).cast("int").alias("blocks"))
    rows = bags.join(small(sizes), "root").withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", "cid", "bag", "n_words", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    counts = rows.groupBy("root", "lo", "hi").applyInPandas(_count_block, "cid long, n long")
    return counts.groupBy("cid").agg(F.sum("n").alias("n_links"))


def groups(records: DataFrame, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(group_id, id, n_links): each record with a near relative; group_id is the smallest
    id of its group, n_links the number of other contents its content is linked to."""
    everyone, reps, named = _named(records, all_pairs)
    degree = link_counts(records, reps.select("cid", "id"), named.select("cid", "root"))
    named = named.join(degree, "cid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return _written_out(everyone, named, "group_id", "n_links").select("group_id", "id", "n_links")


def found(records: DataFrame, all_pairs: int = ALL_PAIRS) -> DataFrame:
    everyone, _, named = _named(records, all_pairs)
    return _written_out(everyone, named, "group_id").select("group_id", "id")
