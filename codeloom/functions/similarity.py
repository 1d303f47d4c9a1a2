"""Similarities of strings, in per cent, by the longest common subsequence."""

from __future__ import annotations


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one addition of big integers a character."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & places.get(c, 0)
        state = (state + hit | state - hit) & full
    return (~state & full).bit_count()


def ratio(a: str, b: str) -> float:
    """Share of both strings that is common to them; 100 for two empty ones."""
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """:func:`ratio` after the words of each string are sorted."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _best_stretch(short: str, long: str) -> float:
    m, best = len(short), 0.0
    for begin in range(1 - m, len(long)):
        part = long[max(0, begin) : begin + m]
        most = 200 * sum(min(part.count(c), short.count(c)) for c in set(part)) / (m + len(part))
        if most > best:
            best = max(best, ratio(short, part))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best :func:`ratio` of the shorter string with a stretch of the longer one, at most as long as it.

    Stretches at either end may be shorter; of two equally long strings either may be cut. 0 if just one is empty.
    A stretch is only tried if the letters that it shares with the shorter string could beat the best so far.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    if short in long:
        return 100.0
    best = _best_stretch(short, long)
    return max(best, _best_stretch(long, short)) if len(a) == len(b) else best
