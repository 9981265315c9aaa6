"""Packing, leaks and abuse on small fixtures."""

import os
import random
import tracemalloc

import numpy as np
import pytest

from circuitlake.llm import abuse, leaks, packing

DOC = "doc_id long, text string, lang string, source string, n_chars long, added_at timestamp, score double, seq_id long, task_id string"


@pytest.fixture(scope="module")
def docs(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, None, s, None, None, 0.0, 0, "clash") for i, t, s in rows], DOC)

    return build


# --- leaks


def brute_leaks(rows, tests, run):
    out = set()
    for i, text, _ in rows:
        w = leaks.words(text or "")
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for t, d in tests:
            v = leaks.words(d or "")
            if i is not None and t is not None and any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((i, t))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 150])
def test_leaks_match_brute_force(spark, docs, block_words):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(60)]
    tests = [(f"t{k}", " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 70)))) for k in range(8)] + [("null", None), (None, "x")]
    rows = []
    for i in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 2:
            src = leaks.words(tests[i % 8][1])
            k, n = rng.randrange(len(src)), rng.randint(8, 20)
            words[len(words) // 2 : len(words) // 2] = src[k : k + n]
        rows.append((i, "  **".join(words).upper(), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (None, tests[0][1], "s"), rows[1], (902, ("word " * 5000) + (tests[0][1] + " ") * 3, None)]
    got = leaks.leaks(docs(rows), spark.createDataFrame(tests, "id string, description string"), block_words=block_words).collect()
    assert {(r.doc_id, r.task_id) for r in got if r.longest_run >= 12} == brute_leaks(rows, tests, 12)
    assert len(got) == len({(r.doc_id, r.task_id) for r in got}) and all(r.score >= leaks.SCORE and 0 < r.covered <= 1 for r in got)


def test_edited_copies_are_found_by_alignment(spark, docs):
    """Against alignment of all pairs: copies with a word changed in every eight or nine, so no run of twelve."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    tests = [(f"t{k}", " ".join(rng.choice(vocab) for _ in range(rng.randint(40, 90)))) for k in range(20)]
    rows = []
    for i in range(120):
        words = leaks.words(tests[i % 20][1])
        for at in range(rng.randrange(8), len(words), rng.choice((8, 9))):
            words[at] = rng.choice(vocab)
        noise = [rng.choice(vocab) for _ in range(60)]
        rows.append((i, " ".join(noise[:30] + words + noise[30:]), "s"))
    got = {(r.doc_id, r.task_id) for r in leaks.leaks(docs(rows), spark.createDataFrame(tests, "id string, description string")).collect()}
    block = leaks.Block([(t, leaks.words(d)) for t, d in tests])
    every = [(i, t, block.encode(text), block.ids[k]) for i, text, _ in rows for k, (t, _) in enumerate(tests)]
    _, score = leaks.align([e[2] for e in every], [e[3] for e in every])
    want = {(i, t) for (i, t, _, _), s in zip(every, score, strict=True) if s >= leaks.SCORE}
    assert got <= want and len(want) >= 120 and len(got) >= 0.9 * len(want)


def test_no_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "id string, description string")
    assert leaks.leaks(docs([(1, "a b", "s")]), none).count() == 0
    assert leaks.leaks(docs([]), spark.createDataFrame([("t", "x " * 20)], "id string, description string")).count() == 0


def test_alignment():
    a = np.array([1, 2, 3, 9, 4, 5, 6])
    items = [np.array([1, 2, 3, 4, 5, 6]), np.array([0, 1])]
    for cells in (1, 1 << 16):
        longest, score = leaks.align([a, np.array([-1, -1])], items, cells)
        assert longest.tolist() == [3, 0] and score.tolist() == [11, 0]


def test_a_long_window_does_not_widen_the_others():
    """2,000 short windows beside one of 20,000 words: the matrix of all would have 4e7 cells."""
    rng = np.random.default_rng(2)
    item = np.arange(20)
    windows = [rng.integers(0, 20, 30) for _ in range(2000)] + [np.concatenate([np.full(9_000, -1), item, np.full(10_980, -1)])]
    tracemalloc.start()
    longest, score = leaks.align(windows, [item] * len(windows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (longest[-1], score[-1]) == (20, 40) and peak < 50e6
    few, _ = leaks.align(windows[:2000], [item] * 2000, 1)
    assert few.tolist() == longest[:2000].tolist()


def test_equal_items_are_each_found(spark, docs):
    """Every id of a text that stands more than once, and the same documents as for one id."""
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(500)]
    texts = [" ".join(rng.choice(vocab) for _ in range(50)) for _ in range(4)]
    rows = []
    for i in range(40):
        words = texts[i % 4].split()
        for at in range(i % 8, 50, 8):
            words[at] = "edited"
        rows.append((i, " ".join(words), "s"))
    tests = [(f"t{k}{c}", text) for k, text in enumerate(texts) for c in "abc"[: 1 + k]]
    once = {(r.doc_id, r.task_id) for r in leaks.leaks(docs(rows), spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "id string, description string")).collect()}
    got = [(r.doc_id, r.task_id) for r in leaks.leaks(docs(rows), spark.createDataFrame(tests, "id string, description string")).collect()]
    assert len(once) == 40 and sorted(got) == sorted((i, t) for i, k in once for t, _ in tests if t[:2] == k)


# --- packing

HAVE = os.path.exists(packing.VOCABULARY)


@pytest.mark.skipif(not HAVE, reason="no vocabulary")
@pytest.mark.parametrize("shard_tokens", [1 << 20, 2000])
def test_packing_is_complete_and_tight(docs, shard_tokens):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["gain", "offset", "Rauschen", "<|endoftext|>", "0.35"]) for _ in range(rng.randint(1, 150))), "s") for i in range(300)]
    rows += [(1000, "long text " * 900, None), (1001, None, "s"), (1002, " \n", "s"), (1003, "", "s"), rows[0], (None, "x", "s"), (1004, "exact", "s")]
    enc = packing.tokenizer(packing.VOCABULARY)
    got = packing.pack_documents(docs(rows), capacity=256, shard_tokens=shard_tokens).collect()
    covered, fill, pieces = {}, {}, {}
    for r in got:
        covered.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        fill[r.seq_id] = fill.get(r.seq_id, 0) + r.token_end - r.token_start
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
    want = {i: len(enc.encode_ordinary(t)) for i, t, _ in rows if i is not None and t and t.strip()}
    assert set(covered) == set(want)
    for i, spans in covered.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == want[i] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert want[i] > 256 or pieces[i] == 1
    assert max(fill.values()) <= 256
    best = -(-sum(want.values()) // 256)
    assert len(fill) <= best * 1.05 + 2
    assert packing.report(packing.packed_items(docs(rows), capacity=256), 256).collect()[0].tokens == sum(want.values())
    assert packing.whole(packing.pack_documents(docs(rows), capacity=256, shard_items=50), 256).collect()[0].asDict() == {"documents": len(want), "late": 0, "gap": 0, "split": 0, "overfull": 0}


@pytest.mark.skipif(not HAVE, reason="no vocabulary")
def test_nothing_to_pack(docs):
    assert packing.pack_documents(docs([])).count() == 0
    assert packing.pack_documents(docs([(1, None, "s")])).count() == 0


def test_neighbours_are_alike():
    """A seed's first neighbour is of its own topic."""
    rng = np.random.default_rng(0)
    topics = [np.arange(0, 40), np.arange(40, 80)]
    tokens = [np.sort(rng.choice(topics[i % 2], 12, replace=False)) for i in range(40)]
    lengths = np.full(40, 10)
    got, _ = packing.pack(tokens, [np.ones(12, int)] * 40, lengths, np.ones(80, np.float32), 10.0, 40)
    assert sum(len(s) for s in got) == 40
    alike = [s[0] % 2 == s[1] % 2 for s in got if len(s) > 1]
    assert np.mean(alike) > 0.9


# --- abuse


def test_disguises_fold_to_one_word():
    f = abuse.Featurizer()
    base = set(f.sentence("you idiot").tolist())
    for text in ("YOU IDIOT", "you iDiOt!!!", "you 1d1ot", "you idiiiiot", "you i d i o t", "you i.d.i.o.t", "you idi​ot", "you **idiot**", "you іdіоt"):
        assert set(f.sentence(text).tolist()) == base, text
    assert abuse._hash("w idiot") in set(f.sentence("you i***t").tolist())
    assert abuse.fold("4.7u") == "#" and abuse.fold("W") == "w"


def corpus(rng, n):
    clean = ["The gain of stage {i} falls at {i} MHz.", "Penetration depth at {i} MHz is {i} um.", "Stripping the naked die took {i} us.", "Race conditions are ugly; the buffer chokes at {i} V."]
    bad = ["You useless {w}, go back to sweeping floors.", "Only a {w} would draw this.", "Send your {w} home, they poison everything."]
    words = ["idiot", "moron", "clown", "lot"]
    rows, truth = [], {}
    for i in range(n):
        parts = [rng.choice(clean).format(i=rng.randrange(1000)) for _ in range(rng.randint(1, 30))]
        truth[i] = rng.random() < 0.2
        if truth[i]:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(bad).format(w=rng.choice(words)))
        rows.append((i, " ".join(parts), f"s{i % 3}"))
    return rows, truth


def test_held_out_accuracy_and_flat_cutoff(spark, docs):
    rng = random.Random(7)
    rows, truth = corpus(rng, 900)
    ratings = [(i, None, int(truth[i] != (rng.random() < 0.08)), "r") for i in range(450)] + [(None, 1, 1, "r"), (3, 1, None, "r"), (5000, 1, 1, "r")]
    labels = spark.createDataFrame(ratings, "doc_id long, quality int, toxic int, rater string")
    table = docs(rows + [(9001, None, "s0"), (9002, " ", "s0"), rows[0], (None, "you idiot", "s0")])
    got = {r.doc_id: r for r in abuse.scored(table, labels).collect()}
    assert got[9001].score == got[9002].score == 0.0
    held = [i for i in range(450, 900)]
    for cutoff in (0.07, 0.1, 0.3):
        assert np.mean([(got[i].score >= cutoff) == truth[i] for i in held]) > 0.98, cutoff
    located = [got[i].worst_sentence for i in held if truth[i] and got[i].worst_sentence]
    assert all("sweeping" in s or "draw" in s or "poison" in s for s in located)
    found = {r.doc_id for r in abuse.found(table, labels).collect()}
    assert found == {i for i, r in got.items() if r.score >= abuse.CUTOFF}
    rates = {r.source: r for r in abuse.rates(table, labels).collect()}
    assert sum(r.bad for r in rates.values()) == len(found) and sum(r.documents for r in rates.values()) == 902  # repeated rows count once
    assert {r.odd for r in abuse.whole(table, labels).collect()} == {0}
    # harmless sentences add up to nothing, however many
    long = [(7000 + i, " ".join(t for k, t, _ in rows if not truth[k]), "s0") for i in range(3)]
    assert abuse.found(docs(rows + long), labels).filter("doc_id >= 7000").count() == 0


def test_without_ratings_the_prior_decides(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, rater string")
    rows = [(4, "You are an idiot.", "s"), (1, "You fucking moron.", "s"), (2, "The gain falls.", "s"), (3, "x" * 300_000, "s")]
    got = {r.doc_id: r.worst for r in abuse.scored(docs(rows), labels).collect()}
    assert got[1] > got[2] and got[1] > got[3]
    assert {r.doc_id for r in abuse.found(docs(rows), labels).collect()} == {1, 4}
    assert abuse.found(docs([]), labels).count() == 0
