"""Four-Russians tables for the cheapest repair of a sequence of conversation rows.

Edits turn the initials of the rows' roles into `(s?(ua)+)?`. A state says what was given out
last: nothing, s, a or u, and fixes the role that an insertion or a new role gives. A cost vector
has the cheapest cost from each state to the end; less its minimum it is one of a few dozen. A
row is one of few symbols. So the step over every block of BLOCK symbols from every vector is
computed once: the vector before the block, what the minimum grew by, and which state each
state leaves the block in, along the edits whose initials come first in ASCII order. Whole
sequences are then composed of such steps by lookup.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

BLOCK = 4
START, SYSTEM, ASSISTANT, USER = range(4)
# What an inserted or new role gives: a user wherever no user waits for an answer.
FOLLOWING = (USER, USER, USER, ASSISTANT)
NEW_ROLE = ("user", "user", "user", "assistant")

# Symbols: a row that must go, a row by its initial (s, u, a, other) and whether it is truncated,
# and no row, which fills up the last block.
MUST_GO = 0
NO_ROW = 9
SYMBOLS = 10
INITIALS = "sua"
_GIVES = ((START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))

END = (0, 6, 0, 3)


def symbol_of(initial: str, truncated: bool) -> int:
    kind = INITIALS.index(initial) if initial and initial in INITIALS else 3
    return 1 + 2 * kind + truncated


def _kept_state(state: int, symbol: int) -> int | None:
    """Where keeping the row leads, if its initial may follow."""
    kind = (symbol - 1) // 2
    if symbol in (MUST_GO, NO_ROW) or kind == 3:
        return None
    to = (SYSTEM, USER, ASSISTANT)[kind]
    return to if (state, to) in _GIVES else None


def _row_edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """Initial, cost and next state of the edits of one row."""
    edits = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = TRUNCATED * ((symbol - 1) % 2)
        kept = _kept_state(state, symbol)
        if kept is not None:
            edits.append(("K", KEEP + extra, kept))
        edits.append(("R", REROLE + extra, FOLLOWING[state]))
    return edits


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The cost vector before a row from the one after it; rows may be inserted first."""
    if symbol == NO_ROW:
        return after
    costs = [min(c + after[to] for _, c, to in _row_edits(q, symbol)) for q in range(4)]
    for _ in range(3):
        costs = [min(c, INSERT + costs[FOLLOWING[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def traced(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The initials of the cheapest edits from `state` up to and including the row, the least in
    ASCII order, and the state they lead to.

    Each initial has one successor, so the least next initial is that of the least string.
    """
    if symbol == NO_ROW:
        return "", state
    costs = before(after, symbol)
    letters = ""
    while True:
        options = [(c, letter, to, False) for letter, c, to in _row_edits(state, symbol) if c + after[to] == costs[state]]
        if INSERT + costs[FOLLOWING[state]] == costs[state]:
            options.append((INSERT, "I", FOLLOWING[state], True))
        _, letter, state, stays = min(options, key=lambda o: o[1])
        letters += letter
        if not stays:
            return letters, state


class Tables(NamedTuple):
    """`vectors`: all normalised cost vectors, END first. By symbol and vector after it: the
    vector before it, the growth of the minimum, the edits and next state of each state. By
    block and vector after it: the same without the edits."""

    vectors: np.ndarray
    row_vector: np.ndarray
    row_edits: dict[tuple[int, int, int], tuple[str, int]]
    vector: np.ndarray
    growth: np.ndarray
    leaves: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    vectors, waiting = {END: 0}, [END]
    steps: dict[tuple[int, int], tuple[int, int]] = {}
    while waiting:
        after = waiting.pop()
        for symbol in range(SYMBOLS):
            costs = before(after, symbol)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in vectors:
                vectors[normal] = len(vectors)
                waiting.append(normal)
            steps[symbol, vectors[after]] = (vectors[normal], least)
    n = len(vectors)
    row_vector, row_growth = np.zeros((SYMBOLS, n), np.uint8), np.zeros((SYMBOLS, n), np.int64)
    row_leaves = np.zeros((SYMBOLS, n, 4), np.uint8)
    row_edits = {}
    for (symbol, which), (to, grown) in steps.items():
        row_vector[symbol, which], row_growth[symbol, which] = to, grown
    for after, which in vectors.items():
        for symbol in range(SYMBOLS):
            for state in range(4):
                letters, left = traced(after, symbol, state)
                row_edits[symbol, which, state] = (letters, left)
                row_leaves[symbol, which, state] = left
    blocks = np.arange(SYMBOLS**BLOCK)
    vector = np.tile(np.arange(n, dtype=np.uint8), (len(blocks), 1))
    growth = np.zeros((len(blocks), n), np.int64)
    leaves = np.tile(np.arange(4, dtype=np.uint8), (len(blocks), n, 1))
    for place in range(BLOCK):  # from the last symbol of the block to the first
        symbol = (blocks // SYMBOLS**place % SYMBOLS)[:, None]
        growth += row_growth[symbol, vector]
        leaves = np.take_along_axis(leaves, row_leaves[symbol, vector].astype(np.int64), axis=2)
        vector = row_vector[symbol, vector]
    listed = np.array(list(vectors))
    return Tables(listed, row_vector, row_edits, vector, growth, leaves)


def block_numbers(symbols: np.ndarray) -> np.ndarray:
    """The numbers of the blocks of a sequence, filled up with NO_ROW."""
    padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NO_ROW, dtype=np.int64)
    padded[: len(symbols)] = symbols
    return padded.reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


class Step(NamedTuple):
    """What a stretch of rows does to each vector after it (compare Tables)."""

    vector: np.ndarray
    growth: np.ndarray
    leaves: np.ndarray


def composed(symbols: np.ndarray) -> Step:
    """The step over a whole stretch, one lookup a block, for all vectors at once."""
    t = tables()
    n = len(t.vectors)
    vector, growth = np.arange(n), np.zeros(n, np.int64)
    leaves = np.tile(np.arange(4, dtype=np.uint8), (n, 1))
    for block in block_numbers(symbols)[::-1]:
        growth = growth + t.growth[block, vector]
        leaves = np.take_along_axis(leaves, t.leaves[block, vector].astype(np.int64), axis=1)
        vector = t.vector[block, vector]
    return Step(vector.astype(np.uint8), growth, leaves)


@lru_cache(maxsize=200_000)
def _expanded_block(block: int, after: int, state: int) -> tuple[tuple[str, ...], int]:
    """The edits of each row of a block, which is walked back for the vectors in it first."""
    t = tables()
    symbols = [block // SYMBOLS**k % SYMBOLS for k in range(BLOCK - 1, -1, -1)]
    behind = [after]
    for symbol in symbols[:0:-1]:
        behind.append(int(t.row_vector[symbol, behind[-1]]))
    edits = []
    for symbol, vector in zip(symbols, behind[::-1]):
        letters, state = t.row_edits[symbol, vector, state]
        edits.append(letters)
    return tuple(edits), state


def expanded(symbols: np.ndarray, after: int, state: int) -> tuple[list[str], int]:
    """The edits of each row of a stretch and the last state, from the vector after it and the
    state before it: blocks are looked up from the last to the first, then expanded in order."""
    t = tables()
    blocks = block_numbers(symbols).tolist()
    behind = [after]
    for block in blocks[:0:-1]:
        behind.append(int(t.vector[block, behind[-1]]))
    edits: list[str] = []
    for block, vector in zip(blocks, behind[::-1]):
        found, state = _expanded_block(block, vector, state)
        edits += found
    return edits[: len(symbols)], state


def closing(state: int) -> str:
    """The insertions that end a conversation properly."""
    return "I" * (END[state] // INSERT)
