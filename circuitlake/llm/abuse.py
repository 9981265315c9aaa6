"""Abusive, hateful or sexual language: documents scored by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a logistic model
over hashed features of its folded words (disguises undone: letter case, look-alike
digits and signs, repeated or spaced-out letters); the document's score is the noisy-or
of its sentences. The sentence weights are trained through the noisy-or from document
ratings, whose error rates are estimated along the way, so offending sentences are
located without sentence labels. A document is bad if its noisy-or reaches the cutoff.
A plain noisy-or grows with length, as every harmless sentence adds its little probability;
the evidence that 99.5 percent of the sentences of harmless rated documents stay below is
therefore taken off each sentence (`Model.quiet`), so that the score does not drift with length.

The classifier is fitted on at most `MAX_LABELLED` rated documents (those of smallest
hash), every document is scored on its whole text, rates cover all documents.

Defined results: null and blank texts score 0; ratings with null doc_id, null toxic or
without a document are ignored; without any usable ratings the prior terms alone decide;
several ratings of a document all count; a document counts once however often its row
comes (the worst score); rows with null doc_id are left out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circuitlake.runtime import spread

BITS = 18
#: Sentences count as having at least SHORT and at most LONG features.
SHORT, LONG = 16, 64
#: At most this many rated documents are used to fit the sentence model.
MAX_LABELLED = 10_000
#: Score of a document from which it is bad, and probability from which a sentence is
#: offending. Ratings of held-out documents are fitted alike for all cutoffs from 0.07 to 0.3
#: (tests/llm), where hardly any document falls.
CUTOFF = 0.1

# Prior: stems that are abusive or sexual in common use, in the languages of the corpus.
# They are the mean of the weights before training; ratings overrule them.
PRIOR_TERMS = """
asshole bastard bitch bullshit cocksucker crap cunt dickhead dimwit dipshit dumbass fuck fucking halfwit idiot imbecile
jackass loser maggot moron motherfucker parasite pathetic prick retard retarded scum scumbag shit slut stupid twat
vermin wanker whore worthless filth filthy subhuman clown cretin brainless braindead spineless disgusting clueless
blowjob boobs breasts cock cum dildo erotic horny masturbate naked nude nudes orgasm penis porn pornographic pussy sex
sexy topless tits vagina
arschloch dummkopf fick ficken fotze hurensohn hure idiot miststück scheisse scheiße schlampe trottel vollidiot wichser
abschaum ungeziefer titten
abruti batard bâtard bordel con connard connasse conne crétin debile enculé imbécile merde ordure pute putain salaud salope
cabron cabrón coño gilipollas hijo puta idiota imbécil inútil joder maricón mierda pendejo zorra
aptal amına gerizekalı kahpe orospu pezevenk piç salak siktir sürtük şerefsiz yavşak
"""

_SENTENCE = re.compile(r"[\n\r\t]+|(?<=[.!?…])[\"'”»)\]]*\s+")
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})
# Letters of other scripts that look like Latin ones; applied to words that hold both scripts or only such letters.
_CONFUSABLE = str.maketrans("аеорсухіјѕԁвнкмтгпԛԝһӏαεορυκντι", "aeopcyxijsdbhkmtrnqwhlaeopuknti")
_TOKEN = re.compile(r"[^\W_][\w@$*!|€'’.\-]*[\w*]|[^\W_]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:(?:[ .\-_*]{1,2})[^\W\d_](?![^\W_])){2,}")
#: Marked-up words; stars inside a word are a mask, not emphasis.
_EMPHASIS = re.compile(r"(?<![\w*])(\*{1,3})([^*\s](?:[^*\n]*[^*\s])?)\1(?![\w*])")
_NUMBER = re.compile(r"[+-]?\d[\d.,]*(?:[eE][+-]?\d+)?[a-zA-ZµμΩ°%]{0,5}$")
#: A number with its unit between blanks and punctuation; `fold` turns it into '#' whatever it is.
_QUANTITY = re.compile(r"(?<![\w.@$*!|€'’\-+])[+-]?\d+(?:[.,]\d+)*(?:[eE][+-]?\d+)?[a-zA-ZµμΩ]{0,5}(?=[\s,;:)\]]|[.?!]?(?:\s|$))")
#: Scored sentences a worker remembers.
KNOWN_SENTENCES = 100_000
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def fold(token: str) -> str:
    """A word without its disguise; numbers become '#', masked letters stay '*'."""
    if _NUMBER.match(token):
        return "#"
    t = token.translate(_LOOKALIKE) if re.search(r"[^\W\d_]", token) else token
    t = t.casefold()
    mapped = t.translate(_CONFUSABLE)
    if mapped.isascii() or re.search(r"[a-z]", t):
        t = mapped
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if c.isalpha() or c == "*")
    return re.sub(r"([^*])\1+", r"\1", t).replace("ı", "i")


def unmask(pattern: str) -> list[str]:
    """Folded prior terms that a masked word (f**k) may stand for: a star is one letter.

    Folding merges doubled letters, so masked words are matched against the terms' plain spellings.
    """
    if not re.fullmatch(r"\w?\*+\w*|\w+\*+\w*", pattern):
        return []
    shape = re.compile(pattern.replace("*", r"\w"))
    return sorted({fold(t) for t in PRIOR_TERMS.split() if shape.fullmatch(t)})


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << BITS) - 1)


class Featurizer:
    """Hashed features of sentences, with a per-worker cache of words."""

    def __init__(self):
        self.cache: dict[str, tuple[str, tuple[int, ...]]] = {}

    def word(self, token: str) -> tuple[str, tuple[int, ...]]:
        got = self.cache.get(token)
        if got is None:
            w = fold(token)
            plain = w.replace("*", "")
            ids = [_hash("w " + plain)]
            if "*" in w:
                ids.append(_hash("m " + w))
                ids += [_hash("w " + t) for t in unmask(w)]
            if len(plain) >= 5:
                p = f"^{plain}$"
                ids += [_hash("c " + p[i : i + 5]) for i in range(len(p) - 4)]
            got = (plain, tuple(ids))
            if len(self.cache) < 500_000:
                self.cache[token] = got
        return got

    def sentence(self, s: str) -> np.ndarray:
        s = _INVISIBLE.sub("", unicodedata.normalize("NFKC", s))
        s = _EMPHASIS.sub(r"\2", s)
        s = _SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m.group(0)), s)
        ids: set[int] = set()
        before = "^"
        for token in _TOKEN.findall(s):
            w, own = self.word(token)
            if not w:
                continue
            ids.update(own)
            ids.add(_hash("b " + before + " " + w))
            before = w
        return np.fromiter(ids, np.int64, len(ids))


def damping(n_features):
    """Evidence of a sentence is scaled by the root of its number of features, within SHORT and LONG."""
    return 1.0 / np.sqrt(np.clip(n_features, SHORT, LONG))


#: Share of harmless sentences whose evidence is taken for none; its level without ratings.
CALM, QUIET = 0.995, 0.02


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Evidence -log(1 - p) that harmless sentences stay below.
    quiet: float = QUIET

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        """Probabilities of sentences, in one gather."""
        if not features:
            return np.empty(0)
        lengths = np.array([len(f) for f in features])
        row = np.repeat(np.arange(len(features)), lengths)
        z = np.bincount(row, self.weights[np.concatenate(features)], len(features)) * damping(lengths) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, bag: np.ndarray, n_bags: int, quiet: float) -> np.ndarray:
    """Calibrated noisy-or of the sentences of each bag."""
    evidence = np.maximum(-np.log1p(-np.minimum(p, 1 - 1e-12)) - quiet, 0.0)
    return -np.expm1(-np.bincount(bag, evidence, n_bags))


#: Weight of the prior terms where no rating helps.
ALONE = 20.0


def prior_weights(strength: float = 14.0) -> np.ndarray:
    w = np.zeros(1 << BITS)
    feats = Featurizer()
    for term in PRIOR_TERMS.split():
        w[_hash("w " + feats.word(term)[0])] = strength
    return w


def fit(
    flat: np.ndarray, lengths: np.ndarray, bag_of_sent: np.ndarray, n_bags: int, rated: np.ndarray, of_bag: np.ndarray,
    steps: int = 240, rate: float = 0.25, precision: float = 0.4,
) -> Model:
    """Noisy-or training on flat arrays: features of all sentences one after the other, the
    number of features of each, the bag of each; rated[i] is a 0/1 rating of bag of_bag[i].

    Minimises the cross entropy of the ratings, seen through the raters' error rates
    (re-estimated while training), plus the squared distance of weights to their prior.
    """
    if not len(rated) or not len(lengths):
        return Model(prior_weights(ALONE), -6.0)
    prior = prior_weights()
    w, bias = prior.copy(), -6.0
    # equal sentences are kept once, found by a digest of their sorted features
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    with np.errstate(over="ignore"):
        codes = (np.arange(1 << BITS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(31)
        codes *= codes
        digest = np.zeros(len(lengths), np.uint64)
        for at in range(0, len(flat), 1 << 20):  # bounded temporaries
            np.add.at(digest, row[at : at + (1 << 20)], codes[flat[at : at + (1 << 20)]])
    _, first, sent_of = np.unique(digest, return_index=True, return_inverse=True)
    keep = np.zeros(len(lengths), bool)
    keep[first] = True
    new_name = np.cumsum(keep) - 1
    sent_of = new_name[first][sent_of]
    chosen = keep[row]
    flat, row, lengths = flat[chosen], new_name[row[chosen]].astype(np.int32), lengths[keep]
    del chosen, codes, digest
    n_sent = len(lengths)
    scale = damping(lengths)
    cell = scale[row].astype(np.float32)
    e0, e1 = 0.05, 0.10  # a clean one rated toxic; a toxic one rated clean
    m = np.zeros_like(w)
    v = np.zeros_like(w)
    mb = vb = 0.0
    n = len(rated)
    decay = precision / n  # a Gaussian prior around the prior terms
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[flat], minlength=n_sent) * scale + bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.log1p(-np.minimum(p, 1 - 1e-9))
        bag_clean = np.exp(np.bincount(bag_of_sent, weights=log_clean[sent_of], minlength=n_bags))
        doc = (1 - bag_clean)[of_bag]
        q = (1 - e1) * doc + e0 * (1 - doc)
        q = np.clip(q, 1e-6, 1 - 1e-6)
        slope = (q - rated) / (q * (1 - q)) * (1 - e1 - e0)  # d loss / d doc
        per_bag = np.bincount(of_bag, weights=slope, minlength=n_bags) * bag_clean
        # d doc / d z of a sentence = (product of the others' clean) * p (1 - p) = bag_clean * p
        per_sent = np.bincount(sent_of, weights=per_bag[bag_of_sent], minlength=n_sent) * p
        g = np.bincount(flat, weights=per_sent[row] * cell, minlength=len(w)) / n + decay * (w - prior)
        gb = per_sent.sum() / n
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= 0.1 * rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
        bias = min(bias, -3.0)
        if step % 40 == 0:  # EM step for the raters' errors
            post = np.where(rated == 1, (1 - e1) * doc / q, e1 * doc / (1 - q))
            e1 = float(np.clip(((1 - rated) * post).sum() / max(post.sum(), 1.0), 0.01, 0.3))
            e0 = float(np.clip((rated * (1 - post)).sum() / max((1 - post).sum(), 1.0), 0.005, 0.2))
    p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(row, weights=w[flat], minlength=n_sent) * scale + bias, -30, 30)))[sent_of]
    top = np.zeros(n_bags)
    np.maximum.at(top, bag_of_sent, p)
    calm = p[(top < CUTOFF)[bag_of_sent]]
    return Model(w, float(bias), float(np.quantile(-np.log1p(-calm), CALM)) if len(calm) else QUIET)


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most max_labelled rated documents, those whose ids hash smallest."""
    rated = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.sum(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("bad"), F.count(F.lit(1)).alias("n")
    )
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feats = Featurizer()
        for b in batches:
            got = [[feats.sentence(s) for s in sentences(t)] for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"], "bad": b["bad"], "n": b["n"],
                    "lengths": [[len(f) for f in g] for g in got],
                    "ids": [np.concatenate(g).astype(np.int32) if g else np.empty(0, np.int32) for g in got],
                }
            )

    pdf = rows.mapInPandas(bag, "doc_id long, bad long, n long, lengths array<int>, ids array<int>").toPandas().sort_values("doc_id")
    per_bag = np.array([len(x) for x in pdf["lengths"]], np.int64)
    lengths = np.concatenate([np.empty(0, np.int64), *pdf["lengths"]]).astype(np.int64)
    flat = np.concatenate([np.empty(0, np.int32), *pdf["ids"]]).astype(np.int32)
    bad, n = pdf["bad"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    of_bag = np.repeat(np.arange(len(pdf)), n)
    rated = np.concatenate([np.empty(0), *[np.r_[np.ones(b), np.zeros(k - b)] for b, k in zip(bad, n, strict=True)]])
    n_bags = len(pdf)
    del pdf
    return fit(flat, lengths, np.repeat(np.arange(n_bags), per_bag), n_bags, rated, of_bag)


def score(documents: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, source, score, worst, worst_sentence, n_bad) for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feats, known = Featurizer(), {}
        for b in batches:
            bags = [sentences(t) if isinstance(t, str) else [] for t in b["text"]]
            # sentences that differ only in numbers have the same features and are scored once
            keys = [_QUANTITY.sub("0", s) for bag in bags for s in bag]
            new = [k for k in dict.fromkeys(keys) if k not in known]
            if len(known) + len(new) > KNOWN_SENTENCES:
                known, new = {}, list(dict.fromkeys(keys))
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                known.update(zip(part, shared.value.score([feats.sentence(k) for k in part]).tolist(), strict=True))
            p = np.array([known[k] for k in keys])
            sizes = np.array([len(bag) for bag in bags], np.int64)
            of = np.repeat(np.arange(len(bags)), sizes)
            worst, n_bad, where = np.zeros(len(bags)), np.bincount(of[p >= cutoff], minlength=len(bags)), []
            np.maximum.at(worst, of, p)
            ends = np.cumsum(sizes)
            for i, bag in enumerate(bags):
                where.append(bag[int(p[ends[i] - sizes[i] : ends[i]].argmax())] if worst[i] >= cutoff else None)
            got = {"score": noisy_or(p, of, len(bags), shared.value.quiet), "worst": worst, "worst_sentence": where, "n_bad": n_bad}
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "source": b["source"].to_numpy(), **got})

    rows = spread(documents.filter("doc_id is not null").select("doc_id", "source", "text"))
    return rows.mapInPandas(run, "doc_id long, source string, score double, worst double, worst_sentence string, n_bad int")


def scored(documents: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    return score(documents, train(documents, labels), cutoff)


def found(documents: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    return scored(documents, labels, cutoff).filter(F.col("score") >= cutoff).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per source: documents, bad ones, their share and the mean score; a doc_id counts once a source."""
    rows = scored(documents, labels, cutoff).groupBy("doc_id", "source").agg(F.max("score").alias("score"))
    bad = F.sum((F.col("score") >= cutoff).cast("long"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), bad.alias("bad"), F.round(bad / F.count(F.lit(1)), 4).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score")
    )


def whole(documents: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per source what any right scoring has alike: documents scored, and how many scores lie
    outside 0..1, are bad without text, or name a sentence that is not in the text (all 0)."""
    rows = scored(documents, labels, cutoff).join(documents.select("doc_id", "text"), "doc_id")
    odd = ~F.col("score").between(0, 1) | (F.col("text").isNull() & (F.col("score") > 0)) | ~F.coalesce(F.expr("contains(text, worst_sentence)"), F.lit(True))
    return rows.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum(odd.cast("long")), F.lit(0)).alias("odd"))
