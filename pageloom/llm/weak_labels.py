"""Expectation-maximisation over the votes of labelers that may abstain.

The input is counts per vote pattern, a table bounded by 3 to the number of
labelers, whatever the size of the corpus.  Votes are 1 (yes), 0 (no) and -1
(abstain).  Given the hidden class the votes are independent, and every labeler has
in each class its own probabilities of yes, no and abstaining; a labeler that only
ever finds fault, or only ever approves, is therefore well described.
"""

import math

# Fixed starting point of the posteriors: log odds, and what a yes and a no add.
START, START_YES, START_NO = 1.0, 0.5, -2.0
_SMOOTHING = 0.5
_ROUNDS = 500

Pattern = tuple[tuple[int, ...], float]


def fit(
    patterns: list[Pattern], n_labelers: int, start: tuple[float, float, float] = (START, START_YES, START_NO),
    known: list[bool] | None = None,
) -> tuple[float, list[dict[int, float]]]:
    """Log odds of the class "yes", and per labeler what each vote adds to them.

    ``start`` fixes which class is "yes"; an empty table gives all zeros.  Patterns that
    are ``known`` to be "yes" stay so.
    """
    known = known or [False] * len(patterns)
    beliefs = [
        _sigmoid(start[0] + sum(start[1] if v == 1 else start[2] if v == 0 else 0.0 for v in votes))
        for votes, _ in patterns
    ]
    beliefs = [1.0 if sure else belief for sure, belief in zip(known, beliefs)]
    prior, steps = 0.0, [dict.fromkeys((-1, 0, 1), 0.0)] * n_labelers
    for _ in range(_ROUNDS):
        prior, steps = _weigh(patterns, beliefs, n_labelers)
        following = [
            1.0 if sure else _sigmoid(log_odds(votes, prior, steps)) for sure, (votes, _) in zip(known, patterns)
        ]
        change = max((abs(a - b) for a, b in zip(following, beliefs)), default=0.0)
        beliefs = following
        if change < 1e-9:
            break
    return prior, steps


def log_odds(votes: tuple[int, ...], prior: float, steps: list[dict[int, float]]) -> float:
    return prior + sum(step[vote] for step, vote in zip(steps, votes))


def _weigh(patterns, beliefs, n_labelers):
    if not patterns:
        return 0.0, [dict.fromkeys((-1, 0, 1), 0.0)] * n_labelers
    yes = sum(count * p for (_, count), p in zip(patterns, beliefs)) + _SMOOTHING
    no = sum(count * (1 - p) for (_, count), p in zip(patterns, beliefs)) + _SMOOTHING
    steps = []
    for k in range(n_labelers):
        mass = {vote: [_SMOOTHING, _SMOOTHING] for vote in (-1, 0, 1)}
        for (votes, count), p in zip(patterns, beliefs):
            mass[votes[k]][0] += count * p
            mass[votes[k]][1] += count * (1 - p)
        all_yes, all_no = (sum(m[c] for m in mass.values()) for c in (0, 1))
        steps.append({vote: math.log(a / all_yes) - math.log(b / all_no) for vote, (a, b) in mass.items()})
    return math.log(yes) - math.log(no), steps


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
