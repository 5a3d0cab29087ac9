"""Confidence scores in closed form.

A fact of k arguments is a sum of k argument vectors of weight 1/sqrt(k); a query cancels
what it knows. With c arguments cancelled, the similarity of a remaining one is known in
advance, so scores are literals and no vectors are compared.
"""

from __future__ import annotations

from math import sqrt


def score(arity: int, cancelled: int) -> float:
    """Similarity of one argument of ``arity`` after ``cancelled`` others were subtracted."""
    a = 1 / sqrt(arity)
    return a / sqrt((arity - cancelled) * a * a + cancelled * (1 - a) ** 2)


def joint_score(arity: int, bound: int, free: int) -> float:
    """Mean over the free arguments as they are read off one after another; 1 without any."""
    if not free:
        return 1.0
    return sum(score(arity, bound + i) for i in range(free)) / free


def probe_score(arity: int, bound: int, free: int) -> float:
    """What one probed body atom contributes to a rule's score."""
    return joint_score(arity, bound, free) if bound or arity == 1 else 1.0
