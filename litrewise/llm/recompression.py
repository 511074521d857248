"""A run-length grammar of a word sequence by recompression, and extension queries on it.

Rounds alternate: block compression names every maximal block of one symbol, pair compression
parts the symbols in two classes and names every neighbouring pair of a first-class and a
second-class symbol. A symbol is named by what it derives only, so equal stretches are parsed
alike but for a few symbols at their edges. How far two places agree is then found by climbing
level by level while both places stand at the edge of a symbol, and descending where symbols
differ. All queries of a call climb and descend together, as arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Rounds without a pair after which the sequence is taken as it is.
IDLE_ROUNDS = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Level(NamedTuple):
    """One sequence of symbols. `size`: words that a symbol derives. The rest describes how the
    next level groups the symbols: `parent` and `ends` (first and last symbol of each group),
    and whether groups are blocks of one symbol. The topmost level has no groups."""

    symbol: np.ndarray
    size: np.ndarray
    parent: np.ndarray | None = None
    ends: tuple[np.ndarray, np.ndarray] | None = None
    blocks: bool = False


def _classes(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A reproducible class, False or True, of each symbol in round `turn`."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn * 0x51ED2701 + 1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _FACTOR) >> np.uint64(63)).astype(bool)


def _names(first: np.ndarray, second: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """Equal numbers from `free` on for equal (first, second), and the next free number."""
    found, which = np.unique((first << 32) | second, return_inverse=True)
    return which + free, free + len(found)


def _grouped(level: Level, starts: np.ndarray, blocks: bool) -> tuple[Level, np.ndarray]:
    """`level` with its groups, and the number of symbols in each of them."""
    n = len(level.symbol)
    counts = np.diff(np.append(starts, n))
    parent = np.repeat(np.arange(len(starts)), counts)
    return level._replace(parent=parent, ends=(starts, starts + counts - 1), blocks=blocks), counts


def grammar(symbols: np.ndarray, most_left: int = 64) -> list[Level]:
    """Levels of the grammar from the given symbols (whole numbers from 0) up to a sequence of
    `most_left` symbols or fewer, or one that several rounds did not shorten."""
    symbols = symbols.astype(np.int64)
    free = int(symbols.max(initial=-1)) + 1
    levels = [Level(symbols, np.ones(len(symbols), dtype=np.int64))]
    turn = idle = 0
    while len(levels[-1].symbol) > most_left and idle < IDLE_ROUNDS:
        top = levels[-1]
        now = top.symbol
        starts = np.flatnonzero(np.append(True, now[1:] != now[:-1]))
        if len(starts) < len(now):
            levels[-1], counts = _grouped(top, starts, True)
            above = now[starts].copy()
            long = counts > 1
            above[long], free = _names(above[long], counts[long], free)
            levels.append(Level(above, np.add.reduceat(top.size, starts)))
            top = levels[-1]
            now = above
        side = _classes(now, turn)
        turn += 1
        rising, falling = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
        joined = rising if rising.sum() >= falling.sum() else falling
        if not joined.any():
            idle += 1
            continue
        idle = 0
        starts = np.flatnonzero(~np.append(False, joined))
        levels[-1], counts = _grouped(top, starts, False)
        above = now[starts].copy()
        pairs = counts > 1
        above[pairs], free = _names(above[pairs], now[starts[pairs] + 1], free)
        levels.append(Level(above, np.add.reduceat(top.size, starts)))
    return levels


def _steps(level: Level, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols two places with equal symbols can advance at once."""
    if not level.blocks:
        return np.ones(len(a), dtype=np.int64)
    first, last = level.ends
    if forward:
        return np.minimum(last[level.parent[a]] - a, last[level.parent[b]] - b) + 1
    return np.minimum(a - first[level.parent[a]], b - first[level.parent[b]]) + 1


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
    """The number of equal words from places `a` and `b` on (or back, from them inclusive).

    The places of a pair must differ, and a symbol that occurs once must stop them before
    either end of the sequence.
    """
    sign = 1 if forward else -1
    total = np.zeros(len(a), dtype=np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    stopped = np.full(len(a), len(levels) - 1)

    def advance(level: Level, rows: np.ndarray) -> None:
        steps = _steps(level, a[rows], b[rows], forward)
        total[rows] += steps * level.size[a[rows]]
        a[rows] += sign * steps
        b[rows] += sign * steps

    climbing = np.arange(len(a))
    for height, level in enumerate(levels[:-1]):
        edge = level.ends[0 if forward else 1]
        at_edge = np.zeros(len(level.symbol), dtype=bool)
        at_edge[edge] = True
        risen = []
        while len(climbing):
            same = level.symbol[a[climbing]] == level.symbol[b[climbing]]
            stopped[climbing[~same]] = height
            climbing = climbing[same]
            ready = at_edge[a[climbing]] & at_edge[b[climbing]]
            risen.append(climbing[ready])
            climbing = climbing[~ready]
            advance(level, climbing)
        climbing = np.concatenate(risen) if risen else climbing
        a[climbing], b[climbing] = level.parent[a[climbing]], level.parent[b[climbing]]
    for height in range(len(levels) - 1, -1, -1):
        level = levels[height]
        here = np.flatnonzero(stopped >= height)
        moving = here
        while len(moving):
            moving = moving[level.symbol[a[moving]] == level.symbol[b[moving]]]
            advance(level, moving)
        if height:
            child = levels[height - 1].ends[0 if forward else 1]
            a[here], b[here] = child[a[here]], child[b[here]]
    return total
