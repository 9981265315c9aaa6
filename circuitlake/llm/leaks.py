"""Held-out test texts inside a corpus.

Rare n-gram seeds join documents to test items: every run of `RUN` words of a test text
is covered by its rarest n-gram (by the number of documents that hold it), so a document
that shares such a run is always a candidate; n-grams that only one item has are seeds as
well. Every candidate is scored by Smith-Waterman
alignment around all its seeds; it is a leak if the score reaches `SCORE`, which an unedited
run of `RUN` words always does and edited or paraphrased copies do as well. The alignment
also gives the longest common run of words; `found` keeps the leaks where it reaches `RUN`.
An edited copy without any seed left (no six words in a row) is not seen; tests/llm measures that share against alignment of all pairs.

Test items of equal text are one item until the end. They are handled in blocks of at most `BLOCK_WORDS` words, each block one pass over
the corpus, so what is sent to the executors is bounded whatever the number of items.

Defined results: null and blank texts match nothing; texts are read whole; a document
counts once however often its row comes; a test text shorter than `RUN` words cannot
leak by the run rule; rows with null doc_id or null id are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circuitlake.llm.records import words
from circuitlake.runtime import cut, small, spread

NGRAM = 6
RUN = 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score from which a passage counts as leaked: that of `RUN` equal words.
SCORE = RUN * MATCH
#: Cells of the alignments done at once.
CELLS = 1 << 16
#: Windows collected before they are aligned.
WINDOWS = 20_000
BLOCK_WORDS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial 64-bit hash of every run of n word ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            out = out * _BASE + mixed[k : len(ids) - n + 1 + k]
    return out


class Block:
    """Test items with their vocabulary and n-grams; picklable and bounded."""

    def __init__(self, items: list[tuple[str, list[str]]], n: int = NGRAM):
        self.n = n
        self.tasks = [t for t, _ in items]
        self.vocab: dict[str, int] = {}
        self.ids = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64) for _, ws in items]
        grams = [_rolling(ids, n) for ids in self.ids]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self.of_task = [np.searchsorted(self.grams, g) for g in grams]

    def encode(self, text: str) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram numbers) of the block's n-grams in a text."""
        n = self.n
        if len(ids) < n or not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        gaps = np.concatenate([[0], np.cumsum(ids < 0)])
        at = np.flatnonzero(gaps[n:] == gaps[:-n])  # n known words in a row
        if not len(at):
            return at, at
        h = _rolling(ids, n)[at]
        pos = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        ok = self.grams[pos] == h
        return at[ok], pos[ok]

    def seeds(self, holders: dict[int, int], run: int = RUN) -> list[tuple[int, int]]:
        """(gram, task number): the rarest n-gram of every run of `run` words among those some document
        holds, and every n-gram that only one item has.

        A document that holds a whole run holds all its n-grams, so it is never left out; the
        others are for edited copies, of which few n-grams are left.
        """
        owners = Counter(int(g) for grams in self.of_task for g in np.unique(grams))
        out = set()
        per = run - self.n + 1
        for t, grams in enumerate(self.of_task):
            for i in range(len(grams) - per + 1):
                held = [int(g) for g in grams[i : i + per] if int(g) in holders]
                if held:
                    out.add((min(held, key=lambda g: (holders[g], g)), t))
                    out.update((g, t) for g in held if owners[g] == 1)
        return sorted(out)


def _laid_out(windows: list[np.ndarray], cells: int) -> Iterator[np.ndarray]:
    """The first words of all windows, the second ones, ...; at most `cells` (or one of each window) at once."""
    step = max(1, cells // len(windows))
    for at in range(0, max(map(len, windows)), step):
        pieces = [w[at : at + step] for w in windows]
        slab = np.full((max(map(len, pieces)), len(windows)), -2, np.int32)
        for k, piece in enumerate(pieces):
            slab[: len(piece), k] = piece
        slab[slab == -1] = -2
        yield from slab


def align(windows: list[np.ndarray], items: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(longest common run of words, Smith-Waterman score) of each window with its item, both
    sequences of ids; -1 matches nothing. Pairs of like length are aligned together, a word of
    all windows at a time and their words laid out in slabs, so memory is bounded by `cells` (or
    one item) however long texts are, and a long window costs its neighbours nothing.
    """
    longest, best = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int32)
    order = sorted(range(len(windows)), key=lambda i: (len(windows[i]), len(items[i])))
    at = 0
    while at < len(order):
        width, part, most = 0, [], 2 * len(windows[order[at]]) + 64
        while at < len(order) and (not part or max(width, len(items[order[at]])) * (len(part) + 1) <= cells and len(windows[order[at]]) <= most):
            width = max(width, len(items[order[at]]))
            part.append(order[at])
            at += 1
        item = np.full((len(part), width), -3, np.int32)
        for k, i in enumerate(part):
            item[k, : len(items[i])] = items[i]
        h = np.zeros((len(part), width + 1), np.int32)
        run = np.zeros((len(part), width + 1), np.int32)
        ramp = -GAP * np.arange(width + 1, dtype=np.int32)
        top, far = np.zeros(len(part), np.int32), np.zeros(len(part), np.int32)
        for w in _laid_out([windows[i] for i in part], cells):
            equal = item == w[:, None]
            new = np.zeros_like(h)
            np.maximum(h[:, :-1] + np.where(equal, MATCH, MISMATCH), h[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            h = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps along the item
            run[:, 1:] = (run[:, :-1] + 1) * equal
            np.maximum(top, h.max(1), out=top)
            np.maximum(far, run.max(1), out=far)
        longest[part], best[part] = far, top
    return longest, best


def windows_of(places: np.ndarray, length: int, n: int) -> list[tuple[int, int]]:
    """Neighbourhoods of the seeds of an item of `length` words; overlapping ones are merged."""
    out: list[tuple[int, int]] = []
    for p in places.tolist():
        lo, hi = max(0, p - length), p + n + length
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[Block]:
    part, size = [], 0
    for row in items.toLocalIterator():  # one partition at a time; blocks bound what is held
        ws = words(row["text"])
        if part and size + len(ws) > block_words:
            yield Block(part)
            part, size = [], 0
        part.append((row["task"], ws))
        size += len(ws)
    if part:
        yield Block(part)


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, task_id, longest_run, score, covered): documents with a passage that aligns with
    a test item at a score of 2 `run` or more. covered: score over the best the item could reach.

    items: (id, description).
    """
    spark = documents.sparkSession
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    tests = items.filter("id is not null and description is not null").groupBy("id").agg(F.min("description").alias("text"))
    contents = tests.groupBy("text").agg(F.min("id").alias("task"), F.count(F.lit(1)).alias("n"))
    out = spark.createDataFrame([], "doc_id long, task_id string, longest_run int, score int, covered double")
    for block in _blocks(contents.select("task", "text").orderBy("task"), block_words):
        out = out.union(_leaks_of(docs, block, run))
    copied = contents.filter("n > 1").select("task", "text")
    if copied.limit(1).count() == 0:
        return out
    names = tests.join(copied, "text").select(F.col("task").alias("task_id"), "id")
    return out.join(small(names), "task_id", "left").withColumn("task_id", F.coalesce("id", "task_id")).select(out.columns)


def _leaks_of(docs: DataFrame, block: Block, run: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)  # bounded by block_words

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for batch in batches:
            ids, grams = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                got = np.unique(b.hits(b.encode(text))[1])
                if len(got):
                    ids.append(doc_id)
                    grams.append(got.tolist())
            yield pd.DataFrame({"doc_id": ids, "grams": grams})

    hits = cut(spread(docs).mapInPandas(find, "doc_id long, grams array<int>").withColumn("gram", F.explode("grams")).select("doc_id", "gram").distinct())
    holders = {r["gram"]: r["n"] for r in hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # the block's grams at most
    seeds = block.seeds(holders, run)
    if not seeds:
        return spark.createDataFrame([], "doc_id long, task_id string, longest_run int, score int, covered double")
    seed_rows = F.broadcast(spark.createDataFrame(seeds, "gram int, task int"))  # the block's grams at most
    wanted = hits.join(seed_rows, "gram").select("doc_id", "task").distinct()
    wanted = small(cut(wanted.groupBy("doc_id").agg(F.collect_set("task").alias("tasks"))))
    of_task: dict[int, list[int]] = {}
    for g, t in seeds:
        of_task.setdefault(t, []).append(g)
    seed_sets = spark.sparkContext.broadcast({t: np.array(sorted(g)) for t, g in of_task.items()})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, seeds_of = shared.value, seed_sets.value

        def rated(pairs: list, windows: list, of_pair: list) -> pd.DataFrame:
            longest, best = align(windows, [b.ids[pairs[k][1]] for k in of_pair])
            runs, scores = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32)
            np.maximum.at(runs, of_pair, longest)
            np.maximum.at(scores, of_pair, best)
            rows = [
                (doc_id, b.tasks[t], int(r), int(s), s / (1.0 * MATCH * len(b.ids[t])))
                for (doc_id, t), r, s in zip(pairs, runs, scores, strict=True)
                if s >= MATCH * run
            ]
            return pd.DataFrame(rows, columns=["doc_id", "task_id", "longest_run", "score", "covered"])

        for batch in batches:
            pairs, windows, of_pair = [], [], []
            for doc_id, text, tasks in zip(batch["doc_id"], batch["text"], batch["tasks"], strict=True):
                ids = b.encode(text)
                at, grams = b.hits(ids)
                for t in tasks:
                    for lo, hi in windows_of(at[np.isin(grams, seeds_of[t])], len(b.ids[t]), b.n):
                        windows.append(ids[lo:hi])
                        of_pair.append(len(pairs))
                    pairs.append((doc_id, t))
                    if len(windows) >= WINDOWS:
                        yield rated(pairs, windows, of_pair)
                        pairs, windows, of_pair = [], [], []
            yield rated(pairs, windows, of_pair)

    texts = docs.join(wanted, "doc_id").dropDuplicates(["doc_id", "text"])
    rows = texts.select("doc_id", "text", "tasks").mapInPandas(score, "doc_id long, task_id string, longest_run int, score int, covered double")
    return rows.groupBy("doc_id", "task_id").agg(F.max("longest_run").alias("longest_run"), F.max("score").alias("score"), F.max("covered").alias("covered"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks with a run of `RUN` words in common."""
    return leaks(documents, items).filter(F.col("longest_run") >= RUN).select("doc_id", "task_id")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked test item: documents that hold a run of it, documents with edited passages
    only, the longest run and the best cover."""
    exact = (F.col("longest_run") >= RUN).cast("long")
    return (
        leaks(documents, items)
        .groupBy("task_id")
        .agg(
            F.sum(exact).alias("documents"), F.sum(1 - exact).alias("edited"),
            F.max("longest_run").alias("longest_run"), F.round(F.max("covered"), 4).alias("covered"),
        )
    )


def sources(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per source: documents that hold a run of any test item."""
    bad = cut(found(documents, items).select("doc_id").distinct())  # counted and joined below
    rows = documents.filter("doc_id is not null").select("doc_id", "source").distinct()
    return rows.join(small(bad.withColumn("leaked", F.lit(1))), "doc_id", "left").groupBy("source").agg(F.count("leaked").alias("leaked"))
