"""A label model: noisy labelling functions combined by expectation maximisation.

Each labelling function votes +1, 0 (no opinion) or -1. Votes are taken as independent
given the hidden label; how often a function that has an opinion votes +1 on either label,
and the share of positives, are estimated from the votes alone. No opinion is no evidence.
The prior rates count as `rows` rows, whatever the size of the table, so the data outweigh
them as they grow. Only the counts of distinct vote patterns are needed, at most
3 ** functions of them, so the fit does not depend on the number of rows.
"""

from __future__ import annotations

import numpy as np

#: Rows of data that the prior rates weigh as much as.
PRIOR_ROWS = 200.0


def fit(patterns: np.ndarray, counts: np.ndarray, prior: np.ndarray, share: float, rows: float = PRIOR_ROWS, steps: int = 300) -> np.ndarray:
    """Posterior of each pattern.

    patterns: (n, functions) of -1, 0, +1; prior: (functions, 2) chances of +1, given an
    opinion, for hidden label 0 and 1; share: prior share of positives.
    """
    yes, no = patterns > 0, patterns < 0
    rate, pi = prior.astype(float).copy(), share
    post = np.full(len(patterns), share)
    for _ in range(steps):
        up, down = np.log(rate), np.log1p(-rate)
        logs = yes @ up + no @ down  # (n, label)
        new = 1.0 / (1.0 + np.exp(np.clip(np.log1p(-pi) + logs[:, 0] - np.log(pi) - logs[:, 1], -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-7
        post = new
        if done:
            break
        for label, p in ((1, post), (0, 1 - post)):
            mass = counts * p
            rate[:, label] = (mass @ yes + rows * prior[:, label]) / (mass @ (yes | no) + rows)
        rate = np.clip(rate, 1e-5, 1 - 1e-5)
        pi = float(np.clip((counts @ post + rows * share) / (counts.sum() + rows), 1e-5, 0.999))
    return post
