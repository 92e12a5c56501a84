"""Conversation repair against a search over all edit scripts."""

import hashlib
import random
import re
import zlib

import pytest

from quillframe.llm import queries, repair

SPACE = "\x20\t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """(turn, role, text, fault) of the rows in order; ties go by role and digest, as documented."""
    rows = sorted(((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or "") for t, r, x in rows))
    seen, out = set(), []
    for known, turn, role, _, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn if known else None, role, text, fault))
    return out


def brute(rows):
    """The cheapest, then least, script among all with up to two inserts in each place."""
    rows = faults(rows)
    best = None
    frontier = [(0, "", ())]  # cost, audit, repaired lines
    for i in range(len(rows) + 1):
        grown = {}
        for cost, audit, lines in frontier:
            for n in range(3):
                for roles in ([()] if n == 0 else [("user",), ("assistant",)] if n == 1 else [(a, b) for a in ("user", "assistant") for b in ("user", "assistant")]):
                    c, s, out = cost + 3 * n, audit + "I" * n, lines + tuple((r, "") for r in roles)
                    if i == len(rows):
                        if LEGAL.match("".join(r[:1] or "-" for r, _ in out)):
                            best = min(best or (c, s, out), (c, s, out), key=lambda x: x[:2])
                        continue
                    _, role, text, fault = rows[i]
                    extra = 3 if fault == "truncated" else 0
                    options = [(c + 4, s + "D", out)]
                    if fault not in ("blank", "duplicate"):
                        options.append((c + extra, s + "K", out + ((role, text),)))
                        options += [(c + 3 + extra, s + "R", out + ((r, text),)) for r in ("user", "assistant")]
                    for o in options:
                        initials = "".join(r[:1] or "-" for r, _ in o[2])
                        if re.fullmatch(r"(s?(ua)*u?)?", initials) and o[0] <= 4 * len(rows):
                            key = (initials[-1:], initials[:1] == "s" and len(initials) == 1, bool(initials))
                            grown.setdefault(key, []).append(o)
        if i < len(rows):
            frontier = []
            for held in grown.values():
                least = min(o[0] for o in held)
                frontier += sorted({o[:2]: o for o in held if o[0] == least}.values())  # equal states differ in the script only
    cost, audit, lines = best
    text = "\n".join(f"{r}:{x}" for r, x in lines)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, *_ in rows]
    count = {f: sum(x[3] == f for x in rows) for f in ("blank", "duplicate", "truncated")}
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"]
TEXTS = ["Yes.", "No!", "Why?", "cut of", " \n", "", None, "Oh. \t", "a\nb.", "Yes."]


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(13)
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 8)):
            text = rng.choice(TEXTS)
            if text and rng.random() < 0.6:
                text = f"{turn}{conv}" + text
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(ROLES[:4] if conv % 2 else ROLES), text))
    rows += [(900, i, r, f"row {i}.") for i, r in enumerate(["system", "user", "assistant"] * 2)] + rows[40:43]
    return rows


def test_edits_equal_the_search(spark, conversations):
    docs = spark.createDataFrame([(*r, "x", 1) for r in conversations], "conv_id long, turn long, role string, text string, digest string, choice int")
    got = {r[0]: tuple(r[1:]) for r in repair.report(docs, docs).collect()}
    groups = {}
    for conv, turn, role, text in conversations:
        groups.setdefault(conv, []).append((turn, role, text))
    assert got == {c: brute(rows) for c, rows in groups.items()}


def test_edited_rows_give_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", " ")]
    docs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = [(r.edit, r.role, r.text, r.fault, r.cost) for r in repair.edits(docs).collect()]
    assert got == [("K", "system", "Be kind.", None, 0), ("I", "user", "", None, 3), ("K", "assistant", "Hello.", None, 0),
                   ("D", "assistant", None, "duplicate", 4), ("D", "user", None, "blank", 4)]


def test_long_conversations_cross_batches(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}." if t % 7 else "open") for t in range(30_000)] + [(1, 30_000, "user", "x" * 3_000_000 + ".")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = repair.report(docs, docs).collect()
    assert (got.gaps, got.blank, got.truncated, got.duplicate) == (0, 0, 2, len(range(0, 30_000, 7)) - 2)
    state, cost = repair.START, 0
    assert set(got.audit) <= set("DIKR") and len(got.audit) >= len(rows)
    tops = faults([(t, r, x) for _, t, r, x in rows])
    costs = repair.AT_END
    for _, role, _, fault in reversed(tops):  # a plain backward pass, row by row
        if fault in ("blank", "duplicate"):
            costs = tuple(c + 4 for c in costs)
        else:
            costs, _ = repair.step(costs, role[:1], fault == "truncated")
    assert got.cost == costs[state] + cost


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def test_query_on_its_table(spark, tmp_path, conversations):
    rows = conversations + [(i, 0, "user", "only.") for i in range(2000, 2100)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_repair"](spark, str(tmp_path)).collect()}
    groups = {r[0]: [] for r in rows}
    for conv, *row in brute_damage(rows):
        groups[conv].append(tuple(row))
    assert got == {c: brute(rows) for c, rows in groups.items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert none in got.values()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(docs, docs).count() == 0 and repair.edits(docs).count() == 0
