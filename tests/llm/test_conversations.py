"""Repair of conversations against exhaustive search."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from litrewise.llm import block_tables as bt
from litrewise.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, n long, copies int"
SPACE = " \t\n\x0b\x0c\r"
ALLOWED = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_repair(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit by trying all edits; rows are initial, must go, truncated."""

    @lru_cache(None)
    def best(i: int, last: str, inserted: int) -> tuple[int, str]:
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, ""))
        if i < len(rows):
            initial, gone, cut = rows[i]
            edits = [(4, "D", last)]
            if not gone:
                edits += [(3 * cut, "K", ALLOWED[last, initial])] if (last, initial) in ALLOWED else []
                edits += [(3 + 3 * cut, "R", ALLOWED[last, r]) for r in "ua" if (last, r) in ALLOWED]
            for cost, letter, now in edits:
                rest = best(i + 1, now, 0)
                options.append((cost + rest[0], letter + rest[1]))
        if inserted < 4:
            for r in "ua":
                if (last, r) in ALLOWED:
                    rest = best(i, ALLOWED[last, r], inserted + 1)
                    options.append((3 + rest[0], "I" + rest[1]))
        return min(options) if options else (10**9, "")

    return best(0, "", 0)


def plain_damage(rows: list[tuple]) -> list[tuple]:
    kept = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(fault, text)
        kept += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return kept


def plain_conversation(rows: list[tuple]) -> tuple:
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
    seen, found = set(), []
    counts = dict(blank=0, duplicate=0, truncated=0)
    for _, _, role, text in rows:
        stripped = text.rstrip(SPACE)
        blank, again = stripped == "", (role, text) in seen
        cut = not blank and not again and stripped[-1] not in ".!?"
        seen.add((role, text))
        counts["blank"] += blank
        counts["duplicate"] += not blank and again
        counts["truncated"] += cut
        found.append((role[:1], blank or again, cut))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = plain_repair(found) if rows else (0, "")
    out, i, last = [], 0, ""
    for letter in audit:
        new = {"": "user", "s": "user", "a": "user", "u": "assistant"}[last]
        if letter != "D":
            role = rows[i][2] if letter == "K" else new
            out.append(f"{role}:" + ("" if letter == "I" else rows[i][3]))
            last = role[0]
        i += letter != "I"
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


def conversation_rows(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 4, 9])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Well!", "Why? ", "", " \t", None, "a\nb.\x0b", "漢字。", f"text {rng.random()}."])
            where = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 3])
            rows.append((conv, where, role, text))
    rows += [(None, t, "user", "Without an id.") for t in range(4)] + [(None, None, None, None)]
    rows += [(900, 1, "user", "Same.")] * 30
    rows += [(901, t, "assistant", "Again and again.") for t in range(40)]
    return rows


def frame(spark, rows):
    """Rows with extra columns whose names clash with those inside."""
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA).repartition(4)


def expected_of(rows: list[tuple]) -> dict:
    after: dict = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        after[r[0]].append(r)
    return {conv: plain_conversation(own) for conv, own in after.items()}


@pytest.mark.parametrize("seed", range(4))
def test_digests_equal_exhaustive_search(spark, seed):
    rows = conversation_rows(seed)
    found = {r[0]: tuple(r)[1:] for r in cv.repair_digests(frame(spark, rows)).collect()}
    assert found == expected_of(rows)


def test_a_long_conversation_spreads_over_chunks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Go.", "Went", f"{rng.random()}."])) for t in range(400)]
    rows += [(8, 5, "user", "Hm.")]
    damaged = cv.damage(frame(spark, rows)).persist()
    whole = cv.repair_conversations(damaged)
    cut = cv.repair_conversations(damaged, chunk=7)
    assert cut.turns.select("key", "part", "seq").distinct().count() > 40
    columns = ["conv_id", "gaps", *cv.COUNTS, "cost", "audit"]
    assert sorted(cut.summary.select(columns).collect()) == sorted(whole.summary.select(columns).collect())
    assert sorted(cv.text_digests(cut.turns).collect()) == sorted(cv.text_digests(whole.turns).collect())


def test_repaired_turns_are_legal(spark):
    import re

    turns = cv.repair_conversations(cv.damage(frame(spark, conversation_rows(5)))).turns.collect()
    by_key: dict = {}
    for t in sorted(turns, key=lambda t: (t.key, t.part, t.seq, t.place)):
        by_key.setdefault(t.key, []).append(t)
    for own in by_key.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in own))
        assert all(t.text == "" for t in own if t.edit == "I")


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair_digests(empty).count() == 0


def test_dropped_conversations_stay_with_zeros(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = cv.repair_digests(frame(spark, [(gone, 0, "user", "Hi.")])).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("seed", range(5))
def test_tables_equal_exhaustive_search(seed):
    rng = random.Random(seed)
    for _ in range(200):
        rows = [(rng.choice("suaaux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 13))]
        symbols = np.array([bt.MUST_GO if gone else bt.symbol_of(i, cut) for i, gone, cut in rows])
        step = bt.composed(symbols)
        cost = int(step.growth[0]) + int(bt.tables().vectors[step.vector[0]][bt.START])
        edits, state = bt.expanded(symbols, 0, bt.START)
        assert state == step.leaves[0][bt.START]
        assert (cost, "".join(edits) + bt.closing(state)) == plain_repair(tuple(rows))
        at = rng.randrange(len(rows) + 1)
        behind = int(bt.composed(symbols[at:]).vector[0])
        head, middle = bt.expanded(symbols[:at], behind, bt.START)
        assert head + bt.expanded(symbols[at:], 0, middle)[0] == edits
