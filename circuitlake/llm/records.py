"""Message records as bags of words: shared ground of the two duplicate operators.

The words of a record are the maximal runs of letters or digits of all its messages but
system ones, lower-cased, counted with repeats. The overlap of two records is the number
of shared words over the number of words in either. Records with equal bags of words are
exact copies; one of them (the smallest id) stands for all, so copies are never compared.

Defined results: null messages, null contents and records without words overlap with
nothing; a null role is no system message; rows with null id are left out; repeated
deliveries of an id count once (an id with differing rows keeps the smallest bag); texts
are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circuitlake.runtime import cut, small, spread

WORD = re.compile(r"[^\W_]+")
OVERLAP = 0.8


def words(text: str) -> list[str]:
    if "İ" in text:  # the only letter whose lower case is no single letter
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


_KNOWN: dict[str, int] = {}


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words; a worker remembers a bounded number of them."""
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    for w in ws:
        if w not in _KNOWN:
            _KNOWN[w] = xxhash.xxh64_intdigest(w)
    return np.array([_KNOWN[w] for w in ws], np.uint64)


_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Sketches of a bag, and minima a sketch is made of.
BANDS = 80
ROWS = 8
#: Sketches two bags must share to be compared. At overlap 0.8 a pair shares fewer with
#: probability 6e-5 (binomial of 80 at 0.8 ** 8), less above; this is the only loss.
MEETINGS = 3
_SEEDS = np.array([xxhash.xxh64_intdigest(f"bag {j}") for j in range(BANDS * ROWS)], np.uint64)
_FACTORS = _SEEDS.astype(np.uint32) | np.uint32(1)
_PLACES = np.array([xxhash.xxh64_intdigest(f"place {j}") for j in range(BANDS * ROWS)], np.uint64) | _U(1)
_ORDER = _U(255)
#: Ranks of words under some of the hash functions at once; stays in the processor's cache.
_RANKS = np.empty(1 << 16, np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def bag_hashes(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of occurrence-labelled words, so that a bag becomes a set."""
    if not len(hashes):
        return hashes
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    before = np.empty(len(hashes), np.uint64)
    before[order] = np.arange(len(hashes)) - starts
    with np.errstate(over="ignore"):
        return mix(hashes ^ (before * _ODD))


def sketches(hashes: np.ndarray) -> np.ndarray:
    """Order MinHash of the occurrence-labelled words of a text (k-mers of one word).

    Each of the `BANDS` 64-bit sketches samples `ROWS` minima: its upper 56 bits name the
    words sampled, its lowest 8 the order in which they stand in the text. Two bags of
    overlap J sample the same words with probability J ** ROWS, whatever their order; the
    order tells edits in place from reordered text.
    """
    labelled = (bag_hashes(hashes) >> _U(32)).astype(np.uint32)
    where = np.empty(BANDS * ROWS, np.int64)
    step = min(BANDS * ROWS, max(1, len(_RANKS) // len(labelled)))
    ranks = _RANKS if len(labelled) <= len(_RANKS) else np.empty(len(labelled), np.uint32)
    for at in range(0, BANDS * ROWS, step):
        n = min(step, BANDS * ROWS - at)
        table = ranks[: n * len(labelled)].reshape(n, len(labelled))
        np.multiply(labelled[None, :], _FACTORS[at : at + n, None], out=table)
        where[at : at + n] = table.argmin(1)
    low = labelled[where].astype(np.uint64)
    with np.errstate(over="ignore"):
        names = mix((low * _PLACES).reshape(BANDS, ROWS).sum(1) + _SEEDS[:BANDS])
        places = np.argsort(where.reshape(BANDS, ROWS), axis=1, kind="stable").astype(np.uint64)
        order = mix((places * _PLACES[:ROWS]).sum(1))
    return ((names & ~_ORDER) | (order & _ORDER)).view(np.int64)


def conversation(messages: str = "messages") -> Column:
    """All contents but those of system messages, one per line."""
    kept = F.filter(messages, lambda m: m["content"].isNotNull() & ~F.coalesce(F.lower(F.trim(m["role"])) == "system", F.lit(False)))
    return F.concat_ws("\n", F.transform(kept, lambda m: m["content"]))


def profiles(records: DataFrame, chunks: Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(id, split, source, digest, n_words, sketches, chunks, weights) of every record with
    words, in one reading of the texts; materialised. Chunk columns are empty without `chunks`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}  # copies often stand together
        for b in batches:
            out = []
            for text in b["text"]:
                ws = words(text)
                digest = hashlib.md5(" ".join(sorted(ws)).encode()).hexdigest()
                if ws and digest not in last:
                    if len(last) >= 1000:
                        last.clear()
                    hashes = word_hashes(ws)
                    last[digest] = (digest, len(ws), sketches(hashes), *(chunks(ws, hashes) if chunks else ((), ())))
                out.append(last[digest] if ws else (digest, 0, (), (), ()))
            got = pd.DataFrame(out, columns=["digest", "n_words", "sketches", "chunks", "weights"])
            yield pd.concat([b[["id", "split", "source"]].reset_index(drop=True), got], axis=1)

    rows = records.filter("id is not null").select(
        "id", F.lower(F.regexp_replace("split", r"\s+", "")).alias("split"), "source", F.coalesce(conversation(), F.lit("")).alias("text")
    )
    schema = "id string, split string, source string, digest string, n_words int, sketches array<long>, chunks array<long>, weights array<int>"
    return cut(spread(rows).mapInPandas(run, schema).filter("n_words > 0"))


def members(profiled: DataFrame) -> DataFrame:
    """(id, split, source, digest, n_words), once per id."""
    rows = profiled.groupBy("id").agg(F.min(F.struct("digest", "n_words", "split", "source")).alias("r"))
    return rows.select("id", "r.digest", "r.n_words", "r.split", "r.source")


def numbered(contents: DataFrame) -> DataFrame:
    """Contents with a short number `cid`; materialised, so the numbers stay."""
    return cut(contents.withColumn("cid", F.monotonically_increasing_id()))


def packed(profiled: DataFrame, contents: DataFrame, *columns: str) -> DataFrame:
    """(cid, n_words, columns) once per content (cid, digest), from any of its records; materialised."""
    rows = profiled.select("digest", "n_words", *columns).dropDuplicates(["digest"])
    return cut(rows.join(contents.select("digest", "cid"), "digest").select("cid", "n_words", *columns))


def texts(records: DataFrame, reps: DataFrame) -> DataFrame:
    """(cid, text) of the representatives (cid, id)."""
    rows = records.filter("id is not null").select("id", F.coalesce(conversation(), F.lit("")).alias("text"))
    # a redelivered representative would double its rows
    return rows.join(small(reps), "id").select("cid", "text").dropDuplicates(["cid"])


def overlap(a: list[str], b: list[str]) -> float:
    shared = sum((Counter(a) & Counter(b)).values())
    return shared / max(1, len(a) + len(b) - shared)


def decided(pairs: DataFrame, contents: DataFrame, decide: Callable[[list[str], list[str], pd.Series], tuple | None], columns: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, columns) of the pairs of contents (a, b, extra) for which `decide` of their words
    gives a tuple. Pairs too different in length for the overlap are dropped before."""
    names = [c.split()[0] for c in columns.split(",")]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[int, list[str]] = {}
            rows = []
            for row in batch.itertuples(index=False):
                for cid, text in ((row.a, row.ta), (row.b, row.tb)):
                    if cid not in known:
                        known[cid] = words(text)
                wa, wb = known[row.a], known[row.b]
                if min(len(wa), len(wb)) >= OVERLAP * max(len(wa), len(wb)):
                    got = decide(wa, wb, row)
                    if got is not None:
                        rows.append((row.a, row.b, *got))
            yield pd.DataFrame(rows, columns=["a", "b", *names])

    one = contents.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    two = contents.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    rows = pairs.select("a", "b", *extra).join(one, "a").join(two, "b").select("a", "b", "ta", "tb", *extra)
    return rows.mapInPandas(check, "a long, b long, " + columns)
