"""Repair of conversations against a search over all edits, in chunks of any size."""

import hashlib
import random
import re
import zlib

import pytest

from phonolith.llm import conversations as cv

SPACE = " \t\n\r\x0b\x0c"


def plain_order(rows):
    dig = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, dig(r)))


def brute(rows):
    """Faults, cost and audit of one conversation; rows: (turn, role, text). Cheapest first, then least edits, over all prefixes."""
    rows = plain_order(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for (q, role), to in step.items():
                if role != "s" and q in best:
                    c, audit, out = best[q]
                    new = (c + 2, audit + "I", (*out, ("user" if role == "u" else "assistant") + ":"))
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
        return best

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        extra = int(fault == "truncated")
        for q, (c, audit, out) in best.items():
            found = [(q, (c + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                if (q, role[:1]) in step:
                    found.append((step[q, role[:1]], (c + extra, audit + "K", (*out, f"{role}:{text}"))))
                found += [(to, (c + 2 + extra, audit + "R", (*out, ("user" if r == "u" else "assistant") + f":{text}"))) for (p, r), to in step.items() if p == q and r != "s"]
            for to, x in found:
                if to not in new or x[:2] < new[to][:2]:
                    new[to] = x
        best = inserted(new)
    cost, audit, out = min(best[q] for q in (0, 3) if q in best)
    illegal = sum(rows[i][1][:1] + rows[i + 1][1][:1] not in ("su", "ua", "au") for i in range(len(rows) - 1))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def made(seed, n, roles=("system", "user", "assistant", "tool", "")):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 6, 12, 40])):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["", " \n", "a.", "b. ", "c", f"t{turn}.", f"t{turn}!\n", f"t{turn}", "é?"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, turn * 2]), role if rng.random() > 0.02 else None, text if rng.random() > 0.02 else None))
    return rows + rows[::7]


def groups_of(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [2, 4096])
def test_repair_matches_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(cv, "CHUNK", chunk)
    rows = made(chunk, 40)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in cv.repair(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {conv: brute(own) for conv, own in groups_of(rows).items()}
    assert got == want


def test_damage_and_empty_conversations(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {t}. More {c}!") for c in range(150) for t in range(c % 4 + 1)] + [(None, None, None, None)]
    left = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            left[c] += [(t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * (2 if fault == 3 else 1)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in cv.repair_damaged(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {c: brute(own) for c, own in left.items()} and any(not own for own in left.values())


def test_passes_stop_at_constants():
    steps, rng = cv.Steps(), random.Random(1)
    codes = bytes(rng.choice([0, 1, 2, 2, 1, 5, 6, 9]) for _ in range(3000))
    for after in [(0, 4, 2, 0), (3, 1, 0, 2), (0, 2, 0, 2)]:
        true = cv.costs_before(steps, codes, after)[0]
        new, seen = cv.rerun(steps, codes, cv.END, after)
        assert seen < 100 and (new is None) == (true == cv.costs_before(steps, codes, cv.END)[0])


def test_a_long_conversation_of_blanks_and_copies(spark, monkeypatch):
    """Chunks of rows that must go are passed over; a third of all rows is one text."""
    monkeypatch.setattr(cv, "CHUNK", 8)
    rows = [(1, 0, "user", "q?")] + [(1, t, "assistant", " " * t) for t in range(1, 40)] + [(1, 50, "user", "same.")] * 200 + [(1, t, "user", "same.") for t in range(60, 90)] + [(1, 99, "assistant", "end.")]
    got = cv.repair(spark, spark.createDataFrame(rows, SCHEMA)).first()
    assert tuple(got[c] for c in COLUMNS) == brute([r[1:] for r in rows])
    turns = [(r.pos, r.role, r.text, r.edit) for r in cv.repaired_turns(spark, spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()]
    assert turns == [(0, "user", "q?", "K"), (1, "assistant", "", "I"), (2, "user", "same.", "K"), (3, "assistant", "end.", "K")]


def test_edges(spark):
    clash = spark.createDataFrame([(None, None, None, None, 1, "x", 2)], SCHEMA + ", dig int, code string, n int")
    got = cv.repair(spark, clash).collect()
    assert [tuple(r[c] for c in ("conv_id", "blank", "audit", "cost")) for r in got] == [(None, 1, "D", 3)]
    assert cv.repair(spark, clash.limit(0)).count() == 0 and cv.repair_damaged(spark, clash.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "w " * 200_000 + "."), (1, 1, "assistant", "x" * 100_000)], SCHEMA)
    assert cv.repair(spark, long).first().audit == "KK"
