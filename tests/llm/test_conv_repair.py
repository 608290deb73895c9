"""Conversation repair against a search over all edit paths, across batches, and odd input."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from riskframe.llm import conv_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def damage(rows):
    own = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, own(r[2]), own(r[3]))):
        role, text = own(role), own(text)
        kind = zlib.crc32(f"{own(conv)}:{own(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Cheapest first, then the least path: a search over (row, initials so far as a state)."""
    rows = damage(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    def allowed(so_far, initial):
        return re.fullmatch(r"s?(ua)*u?", so_far + initial) is not None and initial in ("s", "u", "a")

    # The state of initials so far is all that matters for what may follow.
    state = lambda s: (s[-1:] or "-")
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, initials, kept = heapq.heappop(heap)
        if (i, state(initials)) in done:
            continue
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
            return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest
        done.add((i, state(initials)))
        for name in ("user", "assistant"):
            if allowed(initials, name[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, initials + name[0], (*kept, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, kept))
            if faults[i] not in ("b", "d"):
                more = int(faults[i] == "t")
                if allowed(initials, role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + role[:1], (*kept, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if allowed(initials, name[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, initials + name[0], (*kept, f"{name}:{text}")))
    raise AssertionError


def check(spark, rows, schema=SCHEMA, partitions=4):
    df = spark.createDataFrame(rows, schema).repartition(partitions)
    got = {r[0]: tuple(r)[1:] for r in cr.repair_conversations(cr.damaged(df)).collect()}
    want = {c: brute([r[:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def random_rows(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        t = rng.randint(-2, 3)
        for _ in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "agent", None])
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice(["One.", "Two", "Three! ", " \n", None, "Four?", f"Own {rng.random()}."])))
            t += rng.choice([0, 1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_search_over_all_paths(spark, seed):
    check(spark, random_rows(seed))


def test_states_are_carried_across_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        check(spark, random_rows(7, 40))
    finally:
        spark.conf.set(key, before)


def test_a_giant_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "system", f"Text {t}.") for t in range(1200)] + [(2, 0, "user", "Alone.")]
    check(spark, rows)


def test_odd_rows(spark):
    dropped = [t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0][:2]
    rows = [(7, t, "user", "Gone.") for t in dropped]  # nothing is left
    rows += [(None, None, None, None), (None, 1, "user", "A."), (8, None, "user", "A."), (8, None, "user", "A."), (9, 2, "user", "x" * 500_000 + "."), (9, 3, "assistant", "")]
    rows += [(10, -(1 << 62), "user", "A."), (10, 1 << 62, "assistant", "B.")]
    rows += [(11, 5, "assistant", "Same."), (11, 5, "system", "Same."), (11, 5, "user", "Same.")] * 2
    check(spark, rows)
    left = cr.repair_conversations(cr.damaged(spark.createDataFrame(rows, SCHEMA))).where("conv_id = 7").first()
    assert tuple(left)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table_text_ids_and_clashing_columns(spark):
    assert cr.repair_conversations(cr.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = [("a", 1, "user", "Hi.", 1, "x"), ("a", 2, "assistant", "Yes.", 2, "y"), (None, 1, "user", "Hi.", 1, "x")]
    check(spark, rows, "conv_id string, turn long, role string, text string, place int, gone string")


def test_undamaged_rows_stay(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "assistant", "A.")], SCHEMA)
    r = cr.repair_conversations(cr.undamaged(df)).first()
    assert (r.cost, r.audit, r.repaired_sha256) == (0, "KKK", hashlib.sha256(b"system:S.\nuser:U.\nassistant:A.").hexdigest())
