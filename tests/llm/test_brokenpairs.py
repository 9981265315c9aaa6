"""Hand-made pairs of every defect among ordinary ones."""

import pytest

from circuitlake.llm import brokenpairs as bp
from circuitlake.llm import labelmodel

NOUNS = ["mirror", "buffer", "latch", "mixer", "ladder"]
EN = ["The gain of the {n} falls because the load is {i} fF.", "You cannot raise the gain by current alone; use a ratio of {i}.", "It is not possible to meet both limits at tt, so trade the {n} for {i} mV.", "Run the sweep at {i} C and compare the {n} with the nominal value of {i}."]
DE = ["Die Verstärkung der Stufe sinkt, weil die Last nur {i} fF beträgt.", "Nach {i} Versuchen war der Versatz kleiner als die Vorgabe und die Schaltung ist stabil."]
PROMPT = "Explain why the gain of the {n} drops at {i} MHz?"

CASES = {
    "empty1": ("What now, {n}?", "", {"empty"}), "empty2": ("What now, {n}?", None, {"empty"}), "empty3": ("What now, {n}?", "n/a", {"empty"}), "empty4": ("What now?", "(no output)", {"empty"}), "empty5": ("What?", "​", {"empty"}),
    "trunc1": (PROMPT, "The gain of the mirror falls because the", {"truncated"}), "trunc2": (PROMPT, "Run the sweep at 30 C and compare the mirr", {"truncated"}), "trunc3": (PROMPT, "Use this:\n```\nM1 out gate 0 0", {"truncated"}),
    "trunc4": (PROMPT, "The gain of the mirror falls,", {"truncated"}),
    "ref1": (PROMPT, "I'm sorry, but I can't help with that request.", {"refusal"}), "ref2": (PROMPT, "Explain why the gain of the mirror drops at 7 MHz?\nI must decline to answer this one.", {"refusal"}), "ref3": (PROMPT, "This assistant is unable to respond to such questions.", {"refusal"}),
    "copy1": ("Explain why the gain of the latch drops at 7 MHz?", "explain why the gain of the latch drops at 7 mhz", {"copy"}), "copy2": ("Explain why the gain of the latch drops at 7 MHz?", "You asked: Explain why the gain of the latch drops at 7 MHz?", {"copy"}),
    "copy3": ("Explain why the gain of the latch drops at 7 MHz?", "Explain why the gain of the latch drops at 7 MHz? Explain why the gain of the latch drops at 7 MHz?", {"copy"}),
    "lang1": (PROMPT, DE[0].format(i=5) + " " + DE[1].format(i=4), {"other_language"}), "lang2": ("Warum ist die Verstärkung der Stufe bei {i} kHz so klein und wie ist das zu ändern?", EN[0].format(n="latch", i=4), {"other_language"}),
    "two": (PROMPT, "Es tut mir leid, dabei kann ich nicht helfen. Diese Anfrage kann ich leider nicht beantworten.", {"refusal", "other_language"}),
    "ok1": (PROMPT + " Answer in German.", DE[0].format(i=5), set()), "ok2": ("", EN[0].format(n="latch", i=4), set()), "ok3": (None, EN[1].format(i=4), set()), "ok4": (PROMPT, (EN[0].format(n="latch", i=3) + " ") * 9, set()),
    "ok5": (PROMPT, EN[3].format(n="latch", i=5) + "\n```\nR1 a b 1k\n```", set()),
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for k in range(300):
        n, i = NOUNS[k % 5], k % 37 + 1
        if k % 6 == 5:
            rows.append((f"d{k}", f"Warum ist die Verstärkung der Stufe bei {i} kHz so klein und wie ist das zu ändern?", " ".join(x.format(i=i) for x in DE), "z"))
        else:
            rows.append((f"e{k}", PROMPT.format(n=n, i=i), " ".join(x.format(n=n, i=i) for x in EN[k % 3 :]), "z"))
    for k, (p, r, _) in CASES.items():
        p = None if p is None else p.format(n="mirror", i=7)
        r = r if r is None or len(r) <= 400 else r[:400] + "..."
        rows.append((k, p, r, "z"))
    rows += rows[-5:] + [(None, "p", "r", "z")]
    got = bp.label(spark.createDataFrame(rows, "id string, prompt string, response string, defect string")).collect()
    out = {}
    for r in got:
        out.setdefault(r.id, set())
        if r.posterior >= bp.CUTOFFS[r.defect]:
            out[r.id].add(r.defect)
    return out


@pytest.mark.parametrize("case", CASES)
def test_case(labelled, case):
    assert labelled[case] == CASES[case][2]


def test_ordinary_pairs_are_clean(labelled):
    wrong = {k: v for k, v in labelled.items() if k[0] in "de" and k[1:].isdigit() and v}
    assert not wrong and None not in labelled


def test_empty_table(spark):
    assert bp.label(spark.createDataFrame([], "id string, prompt string, response string")).count() == 0


def test_very_long_response():
    model = bp.Trigrams({})
    votes = bp.votes("p q r", "word " * 200_000, None, 0, 0.0, model)
    assert set(votes) == set(bp.DEFECTS)


def test_label_model_recovers_hidden_labels():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.1
    votes = np.stack([np.where(y, np.where(rng.random(4000) < a, 1, 0), np.where(rng.random(4000) < 0.97, -1, 1)) for a in (0.9, 0.7, 0.8)], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior = np.array([(0.05, 0.7)] * 3)
    post = labelmodel.fit(patterns, counts.astype(float), prior, 0.1)
    assert ((post[inverse.ravel()] >= 0.5) == y).mean() > 0.985


def test_label_model_learns_that_a_function_is_noise():
    """The prior thinks alike of all functions; the data show that one votes at random."""
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    good = [np.where(rng.random(len(y)) < np.where(y, 0.9, 0.05), 1, -1) for _ in range(3)]
    votes = np.stack([*good, np.where(rng.random(len(y)) < 0.5, 1, -1)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post = labelmodel.fit(patterns, counts.astype(float), np.array([(0.1, 0.8)] * 4), 0.1)
    at = {tuple(p): q for p, q in zip(patterns.tolist(), post, strict=True)}
    for v in ((1, 1, -1), (1, -1, -1), (1, 1, 1)):
        truth = np.mean(y[(votes[:, :3] == v).all(1)])
        assert abs(at[(*v, 1)] - truth) < 0.05 and abs(at[(*v, -1)] - truth) < 0.05


def test_no_opinion_is_no_evidence():
    import numpy as np

    post = labelmodel.fit(np.array([[0, 0], [1, 1], [-1, -1]]), np.array([500.0, 100.0, 900.0]), np.array([(0.01, 0.9)] * 2), 0.1)
    assert 0.05 < post[0] < 0.15 and post[1] > 0.99 and post[2] < 0.01


@pytest.mark.parametrize("defect", bp.DEFECTS)
def test_cutoffs_stand_clear(spark, defect):
    """Held-out pairs with defects put in: no cutoff from 0.2 to 0.8 separates them better than the one in use."""
    rows, truth = [], {}
    for k in range(360):
        n, i = NOUNS[k % 5], k % 41 + 1
        prompt = PROMPT.format(n=n, i=i)
        answer = " ".join(x.format(n=n, i=i) for x in EN[k % 3 :])
        bad = k % 12 == 0
        if bad:
            answer = {
                "empty": "", "truncated": answer[: len(answer) * 2 // 3].rsplit(" ", 1)[0].rstrip(".") + " and the",
                "refusal": "I am sorry, but I cannot help with this request.", "copy": prompt + " " + prompt, "other_language": " ".join(x.format(i=i) for x in DE),
            }[defect]
        rows.append((f"e{k}", prompt, answer))
        truth[f"e{k}"] = bad
    got = bp.label(spark.createDataFrame(rows, "id string, prompt string, response string")).filter(f"defect = '{defect}'").collect()
    right = {c: sum((r.posterior >= c) == truth[r.id] for r in got) for c in (0.2, bp.CUTOFFS[defect], 0.8)}
    assert right[bp.CUTOFFS[defect]] == max(right.values()) and right[bp.CUTOFFS[defect]] >= 0.99 * len(rows)


def test_copied_short_prompt():
    model = bp.Trigrams({})
    assert bp.without_prompt(["why", "why"], ["why"]) == ([], 2, 0)
    assert bp.without_prompt(["why", "not"], ["why"]) == (["why", "not"], 0, 0)
    assert bp.votes("Why not?", "Why not? Why not?", None, 0, 0.0, model)["copy"][0] == 1


def test_a_repeated_cut_answer_does_not_vouch_for_itself(spark):
    rows = [(f"e{k}", PROMPT.format(n=NOUNS[k % 5], i=k), EN[0].format(n=NOUNS[k % 5], i=k)) for k in range(200)]
    rows += [(f"c{k}", "Explain the loop of the latch?", "The latch falls because the") for k in range(100)]
    got = bp.label(spark.createDataFrame(rows, "id string, prompt string, response string")).filter("defect = 'truncated' and posterior >= 0.5").collect()
    assert {r.id for r in got} == {f"c{k}" for k in range(100)}
