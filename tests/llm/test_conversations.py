import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lineside.llm import conversations as conv

STRUCTURE = {"", *("s" * s + "ua" * n for s in (0, 1) for n in range(1, 5))}


@pytest.fixture
def turns(spark):
    def make(rows):
        full = [(*r, "x", "y") for r in rows]
        return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, seen string, gone string")

    return make


def ordered(rows):
    """Rows of one conversation with the faults, in order; nulls as one space."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for turn, role, text in rows:
        out.append((turn, role, text, conv.fault(text, (role, text) in seen)))
        seen.add((role, text))
    return out


def brute(rows):
    """All edits of a short conversation, by cost and text: cost, audit, output."""
    rows, best = ordered(rows), None
    for edits in itertools.product("KRrD", repeat=len(rows)):
        cost, out, fits = 0, [], True
        for edit, (_, role, text, wrong) in zip(edits, rows):
            if edit == "D":
                cost += 2
                out.append(("D", None, None))
                continue
            if wrong in ("blank", "duplicate"):
                fits = False
                break
            cost += (edit != "K") + 5 * (wrong == "truncated")
            out.append((edit.upper(), {"K": role, "R": "user", "r": "assistant"}[edit], text))
        if not fits or (best and cost > best[0]):
            continue
        for n in range(3):
            if best and cost + 5 * n > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(out) + 1), n):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    full = []
                    for i in range(len(out) + 1):
                        full += [("I", r, "") for p, r in zip(places, roles) if p == i]
                        full += out[i:i + 1]
                    if "".join(r[:1] or "?" for _, r, _ in full if r is not None) in STRUCTURE:
                        way = (cost + 5 * n, "".join(e for e, _, _ in full), "\n".join(f"{r}:{x}" for _, r, x in full if r is not None))
                        best = way if best is None else min(best, way)
    return best


def random_conversations(seed, n, longest=6):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         rng.choice([f"Yes {t}.", "Well!", "so what", f"no {t}", "", " \n", None, "Is it? "])))
    return rows


def test_cheapest_and_least_by_all_edits(turns):
    rows = random_conversations(1, 150, 5)
    got = {r.conv_id: r for r in conv.repair_report(turns(rows).repartition(3)).collect()}
    for c in {r[0] for r in rows}:
        cost, audit, out = brute([r[1:] for r in rows if r[0] == c])
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, hashlib.sha256(out.encode()).hexdigest()), [r for r in rows if r[0] == c]


def test_faults_and_gaps(turns):
    rows = random_conversations(2, 60) + [(None, None, None, None), (None, 4, "user", "Hi."), (900, -5, "user", "a."), (900, 9, "assistant", "b.")]
    got = {r.conv_id: r for r in conv.repair_report(turns(rows)).collect()}
    for c in {r[0] for r in rows}:
        own = ordered([r[1:] for r in rows if r[0] == c])
        for name in ("blank", "duplicate", "truncated"):
            assert got[c][name] == sum(w == name for *_, w in own)
        initials = [r[1][:1] for r in own]
        assert got[c].illegal == sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        numbers = {r[0] for r in own} - {None}
        assert got[c].gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0) and got[c].n_rows == len(own)


def test_turns_are_what_the_report_digests(turns):
    rows = random_conversations(3, 80)
    report = {r.conv_id: r for r in conv.repair_report(turns(rows)).collect()}
    made = {}
    for r in sorted(conv.repaired_turns(turns(rows)).collect(), key=lambda r: (r.conv_id, r.position)):
        made.setdefault(r.conv_id, []).append(r)
    for c, r in report.items():
        kept = made.get(c, [])
        assert [x.position for x in kept] == list(range(len(kept))) and len(kept) == r.n_repaired
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in kept).encode()).hexdigest() == r.repaired_sha256
        assert "".join(x.role[0] for x in kept) in STRUCTURE or len(kept) > 8
        assert [x.edit for x in kept] == [e for e in r.audit if e != "D"]


def test_a_giant_conversation_goes_through_files(turns, monkeypatch):
    monkeypatch.setattr(conv, "IN_MEMORY", 1000)
    held, rng = conv.Repair(), random.Random(4)
    rows = [(i, rng.choice(["user", "assistant"]), f"text {i}" + rng.choice([".", ""]) * (i % 5 > 0)) for i in range(70_000)]
    for turn, role, text in rows:
        held.add(turn, role, text, False)
    cost, steps, closing = held.finish()
    kept = list(held.replay(steps, closing))
    assert held.back._rolled and held.rows._rolled and len(steps) == len(rows)
    assert "".join(r[0] for _, _, r, _ in kept) == "ua" * (len(kept) // 2)
    paid = sum({"K": 0, "R": 1, "I": 5}[e] for e, *_ in kept) + 2 * sum(conv.STEPS[s].endswith("D") for s in steps)
    paid += 5 * sum(conv.fault(x, False) == "truncated" for e, _, _, x in kept if e != "I")
    assert cost == paid


def test_damage_and_rows_that_are_gone(turns):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = conv.damaged(turns(rows)).collect()
    want = []
    for c, t, role, text in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else "".join(x for x in text if x not in ".!?") if case == 2 else text
        want += [(c, t, "user" if case == 4 else role, text, case == 0)] * (2 if case == 3 else 1)
    assert sorted(map(str, ((r.conv_id, r.turn, r.role, r.text, r.gone) for r in got))) == sorted(map(str, want))
    report = conv.repair_report(turns([(1, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]), F.col("conv_id") == 1)
    by = {r.conv_id: r for r in report.collect()}
    assert (by[1].audit, by[1].cost, by[1].gaps, by[1].repaired_sha256) == ("", 0, 0, hashlib.sha256(b"").hexdigest()) and by[2].audit == "KK"


def test_nothing(turns):
    assert conv.repair_report(turns([])).count() == 0 and conv.repaired_turns(turns([])).count() == 0
