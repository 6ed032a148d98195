import hashlib
import random
import zlib

import pytest

from helixmart.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows after damage, and the order among rows of one turn."""
    out = {}
    for conv, turn, role, text in rows:
        lines = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        lines += [(turn, role, text)] * (2 if fault == 3 else 1)
    for lines in out.values():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return out


def faults(lines):
    seen, out = set(), []
    for _, role, text in lines:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(lines, marks):
    """All best repairs by plain search from the front over (position, roles so far as a grammar state), with whole audits."""
    best = {}

    def after(state, role):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(role)

    def go(i, state, put):
        if (i, state, put) in best:
            return best[i, state, put]
        ways = []
        if i == len(lines) and state in ("", "a"):
            ways.append((0, "", ()))
        if put < 2:
            for role in ("user", "assistant"):
                if after(state, role[0]):
                    c, a, t = go(i, after(state, role[0]), put + 1)
                    ways.append((c + 3, "I" + a, (f"{role}:", *t)))
        if i < len(lines):
            _, role, text = lines[i]
            c, a, t = go(i + 1, state, 0)
            ways.append((c + 4, "D" + a, t))
            if marks[i] not in ("blank", "duplicate"):
                extra = 3 * (marks[i] == "truncated")
                if role and after(state, role[0]):
                    c, a, t = go(i + 1, after(state, role[0]), 0)
                    ways.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                for new in ("user", "assistant"):
                    if after(state, new[0]):
                        c, a, t = go(i + 1, after(state, new[0]), 0)
                        ways.append((c + 3 + extra, "R" + a, (f"{new}:{text}", *t)))
        best[i, state, put] = min(ways, key=lambda w: w[:2], default=(1 << 50, "", ()))
        return best[i, state, put]

    for i in range(len(lines), 0, -1):
        for state in ("", "s", "u", "a"):
            go(i, state, 0)
    return go(0, "", 0)


def brute(rows):
    out = set()
    for conv, lines in damaged(rows).items():
        marks = faults(lines)
        turns = [t for t, _, _ in lines if t is not None]
        initials = [r[:1] for _, r, _ in lines]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, said = cheapest(lines, marks)
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
                 illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def result(df):
    rows = [(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in C.repaired(C.damaged(df)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(r.choice([1, 2, 3, most])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "Why?  ", "so on", "", " \n", "\x1f", "é…", None, f"Text {r.randrange(9)}.", f"open {r.randrange(4)}"])
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_against_plain_search(spark, parts):
    rows = made(parts, 120, 14)
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS copies", "'x' AS said")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    try:
        assert result(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_one_conversation_holds_most_rows(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "open", f"Text {t % 300}."])) for t in range(900)]
    rows += [(7, 901, "user", "Same."), (7, 902, "assistant", "Same.")] * 120 + made(3, 20, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_all_dropped_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert result(spark.createDataFrame([(5, gone, "user", "Hello.")], SCHEMA)) == {(5, 0, 0, 0, 0, 0, 0, "", nothing)}
    assert result(spark.createDataFrame([], SCHEMA)) == set()


def test_whole_table(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in C.op12_conversations(spark, tiny).collect()}
    assert got == brute(rows)
