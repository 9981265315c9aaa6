"""Cross-split overlap and near-duplicate groups against brute force."""

import random

import pytest

from circuitlake.llm import crosssplit, neardup
from circuitlake.llm import records as rec
from circuitlake.llm.components import connected_components

VOCAB = [f"w{i}" for i in range(400)]


def family(rng, n, size=200):
    base = [rng.choice(VOCAB) for _ in range(size)]
    out = [base]
    for _ in range(n - 1):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
        if rng.random() < 0.5:  # reordered halves
            k = rng.randrange(40, 160)
            words = words[k:] + words[:k]
        out.append(words)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for g in range(12):
        for words in family(rng, rng.randint(1, 5)):
            rows.append({"text": " ".join(words)})
    rows += [dict(rows[0]), {"text": rows[0]["text"].upper().replace(" ", ",  ")}, {"text": ""}, {"text": None}, {"text": " ... "}, {"text": "one two"}, {"text": "One, two!"}]
    for i, r in enumerate(rows):
        r |= {"id": f"r{i:03d}", "split": rng.choice(["train", "TRAIN ", "val", "test", None, "other"])}
    return rows


def brute_pairs(rows):
    bags = {r["id"]: rec.words(r["text"] or "") for r in rows}
    ids = sorted(bags)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bags[a] and bags[b] and rec.overlap(bags[a], bags[b]) >= 0.8}


def test_cross_split_pairs(chats, corpus):
    side = {r["id"]: (r["split"] or "").strip().lower() for r in corpus}
    want = {p for p in brute_pairs(corpus) if sorted(side[x] == "train" for x in p) == [False, True] and all(side[x] in ("train", "val", "test") for x in p)}
    got = {tuple(r) for r in crosssplit.found(chats(corpus + corpus[:5])).collect()}
    assert got == want and want
    report = crosssplit.report(chats(corpus)).collect()
    assert sum(r.pairs for r in report) == len(want)


@pytest.mark.parametrize("all_pairs", [256, 2])
def test_groups(chats, corpus, all_pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in sorted(brute_pairs(corpus)):
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    want = {(find(x), x) for x in list(parent)}
    got = {(r.group_id, r.id) for r in neardup.groups(chats(corpus + corpus[:5]), all_pairs).collect()}
    assert got == want and want


def test_hot_group_of_near_copies(chats):
    """A third of all rows are copies or near-copies of one text."""
    rng = random.Random(5)
    base = [rng.choice(VOCAB) for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(150)] = rng.choice(VOCAB)
        rows.append({"id": f"h{i}", "text": " ".join(words if i % 3 else base), "split": "train" if i % 2 else "val"})
    rows += [{"id": f"s{i}", "text": " ".join(rng.choice(VOCAB) for _ in range(150))} for i in range(120)]
    got = {(r.group_id, r.id) for r in neardup.found(chats(rows)).collect()}
    assert got == {("h0", f"h{i}") for i in range(60)}
    assert crosssplit.found(chats(rows)).count() == 900


def test_empty_and_short(chats):
    assert crosssplit.found(chats([])).count() == 0 and neardup.found(chats([])).count() == 0
    rows = [{"id": "a", "messages": None}, {"id": "b", "messages": []}, {"id": "c", "messages": [("system", "x y"), (None, "x y"), ("user", None)]}, {"id": "d", "messages": [("user", "X"), ("assistant", "y")], "split": "val"}]
    assert [tuple(r) for r in crosssplit.found(chats(rows)).collect()] == [("c", "d")]
    assert {(r.group_id, r.id) for r in neardup.found(chats(rows)).collect()} == {("c", "c"), ("c", "d")}


def test_very_long_text(chats):
    rng = random.Random(9)
    words = [rng.choice(VOCAB) + str(rng.randrange(50)) for _ in range(60_000)]
    rows = [{"id": "a", "text": " ".join(words)}, {"id": "b", "text": " ".join(words[1:] + ["end"]), "split": "test"}]
    assert [tuple(r) for r in crosssplit.found(chats(rows)).collect()] == [("a", "b")]
    assert neardup.found(chats(rows)).count() == 2


def test_chunks_are_content_defined():
    rng = random.Random(1)
    words = [rng.choice(VOCAB) for _ in range(500)]
    a = crosssplit.cut_chunks(words)
    b = crosssplit.cut_chunks(["new", "words", "here"] + words)
    assert sum(n for _, n in a) == 500
    assert sum(n for d, n in b if d in {x for x, _ in a}) > 480


def test_banded_alignment_matches_full_lcs():
    rng = random.Random(2)
    for _ in range(40):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert neardup.banded_common(a, b, 64) == table[-1][-1]
        assert neardup.banded_common(a, b, 2) <= table[-1][-1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def edited(rng, base, kind):
    """A copy of overlap 0.8 or more that keeps few runs of words."""
    if kind == "inserted":
        return [x for w in base for x in ([w, rng.choice(VOCAB)] if rng.random() < 0.19 else [w])]
    cuts = [0]
    while cuts[-1] < len(base):
        cuts.append(cuts[-1] + rng.randint(*((4, 8) if kind == "phrases" else (2, 2))))
    parts = [base[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
    if kind == "phrases":
        rng.shuffle(parts)
    else:
        parts = [p[::-1] if rng.random() < 0.6 else p for p in parts]
    words = [w for p in parts for w in p]
    words[rng.randrange(len(words))] = "other"
    return words


@pytest.fixture(scope="module")
def scattered():
    rng = random.Random(11)
    rows = []
    for kind in ("inserted", "phrases", "swapped"):
        for i in range(40):
            base = [rng.choice(VOCAB) + str(rng.randrange(9)) for _ in range(150)]
            rows.append({"id": f"{kind}{i:02d}a", "text": " ".join(base), "split": "train"})
            rows.append({"id": f"{kind}{i:02d}b", "text": " ".join(edited(rng, base, kind)), "split": "test"})
    return rows


def test_groups_of_scattered_edits(chats, scattered):
    pairs = brute_pairs(scattered)
    assert len(pairs) > 110
    got = {(r.group_id, r.id) for r in neardup.found(chats(scattered)).collect()}
    assert got == {(a, x) for a, b in pairs for x in (a, b)}


def test_cross_split_pairs_of_scattered_edits(chats, scattered):
    got = {tuple(r) for r in crosssplit.found(chats(scattered)).collect()}
    assert got == brute_pairs(scattered)


def test_links_of_a_hot_group_are_all_counted(chats, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(13)
    base = [rng.choice(VOCAB) for _ in range(100)]
    rows = []
    for i in range(50):
        words = list(base)
        for j in rng.sample(range(100), 5 + i % 4):
            words[j] = f"new{rng.randrange(900)}"
        rows.append({"id": f"h{i:02d}", "text": " ".join(words)})
    want = {r["id"]: 0 for r in rows}
    for pair in brute_pairs(rows):
        for x in pair:
            want[x] += 1
    got = {r.id: r.n_links for r in neardup.groups(chats(rows), 2).collect()}
    assert got == {x: n for x, n in want.items() if n} and len(set(got.values())) > 2


def test_alignment_decides_edits_and_bags_reordered_text():
    words = [f"w{i}" for i in range(100)]
    edited = words[:30] + ["new", "words"] + words[33:]
    assert neardup.decide(words, edited, True) is True
    assert neardup.decide(words, words[60:] + words[:60], True) is False  # the alignment falls short, the bags are equal
    assert neardup.decide(words, edited, False) is False
    assert neardup.decide(words, words[:70] + [f"x{i}" for i in range(30)], True) is None


def test_sketches_name_words_and_order():
    words = [f"w{i}" for i in range(200)]
    a, b = (rec.sketches(rec.word_hashes(w)) for w in (words, words[10:] + words[:10]))
    assert ((a >> 8) == (b >> 8)).all() and 0 < (a == b).sum() < len(a)


@pytest.mark.parametrize("edit", ["insert", "reorder", "replace", "delete"])
def test_meeting_rate_of_edits(edit):
    """Pairs of overlap 0.8 and more share three sketches, whatever the edit."""
    rng = random.Random(edit)
    seen = met = 0
    for _ in range(150):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(20, 250))]
        if edit == "insert":
            other = [x for w in words for x in ([w] if rng.random() > 0.15 else [w, rng.choice(VOCAB)])]
        elif edit == "reorder":
            other = list(words)
            rng.shuffle(other)
        elif edit == "replace":
            other = [w if rng.random() > 0.07 else rng.choice(VOCAB) for w in words]
        else:
            other = [w for w in words if rng.random() > 0.12]
        if rec.overlap(words, other) >= rec.OVERLAP:
            a, b = (rec.sketches(rec.word_hashes(w)) for w in (words, other))
            seen += 1
            met += ((a >> 8) == (b >> 8)).sum() >= rec.MEETINGS
    assert seen > 100 and met == seen


def test_chunk_shares_never_exceed_the_overlap_and_fractions_cover(chats):
    rng = random.Random(6)
    base = [rng.choice(VOCAB) for _ in range(300)]
    rows = [{"id": "t", "text": " ".join(base)}, {"id": "e", "text": " ".join(base[:150] + ["x"] * 150), "split": "val"}, {"id": "f", "text": " ".join(base), "split": "test"}]
    rows.append({"id": "g", "text": "nothing in common at all", "split": "test"})
    got = {r.id: r.covered for r in crosssplit.fractions(chats(rows)).collect()}
    assert got["f"] == 1.0 and got["g"] == 0.0 and 0.4 < got["e"] < 0.55
    for r in crosssplit.overlaps(chats(rows)).collect():
        assert r.share <= 1.0 and {r.id_train, r.id_eval} == {"t", "f"}


def test_skewed_joins_and_components(spark, monkeypatch):
    """Hot keys are joined without a shuffle, with the same rows."""
    from circuitlake import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k long, x long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    assert runtime.join_skewed(left, right, "k", "n", 300, how_many=30).count() == 300
    edges = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(300, 301), (301, 302)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert set(roots.values()) == {0, 300} and roots[302] == 300
