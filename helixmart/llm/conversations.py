"""Repair of the structure of conversations with a suffix-shared automaton.

Every row of a conversation becomes one sign: the first letter of its role, whether its text breaks off, or that it
must go (blank, or said before). A run of signs is a path through an automaton that is minimised from the end: runs
with the same rest share its nodes, whatever conversation they come from. Spark deals the distinct runs out by ranges
of their reversed signs, so that runs which share a node are neighbours in one task; a task keeps the path of the
current run as a stack and computes cost-to-go and the best edit of each node and grammar state once, before it moves
on. Its memory is the longest run, never the number of nodes.

Rows reach their conversation through a sort by ranges. A conversation longer than a partition, even one that holds a
third of all rows, is a chain of runs, one per partition: runs are first solved to every state they can end in, the
chain of these 4 x 4 tables tells what each run's end costs, and then each run is solved once more to that end.
Texts stay out of all this; they travel once, at the end, beside their conversation's edits, to be hashed in order.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmart.llm.common import stored, table

#: Costs of the edits, and of leaving a text that breaks off.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_WHITE = " \t\n\x0b\x0c\r"
#: Grammar ``(s?(ua)+)?``: states are start, after s, after u, after a; what follows each, and the role put in there.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_PUT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_FAR = 1 << 40
#: What the end costs in each state, and the edits that are made there.
_END, _AT_END = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")

_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_KEY = ["conv_id", "none"]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults: conv_id, turn, role, text and copies (0 where the row is dropped).

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 says it
    twice, 4 makes it the user's. Nulls read as one space.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    fault = F.crc32(key) % 20
    return conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _rows(rows: DataFrame) -> DataFrame:
    """Adds the key's null mark and the digest that tells a row's role and text and orders rows of one turn."""
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("none"), "turn", "role", "text",
                       "copies", said.alias("said"))


class _Run:
    """The signs and counts of one conversation's rows in one partition."""

    def __init__(self, key: tuple):
        self.key, self.signs, self.initials, self.seen, self.firsts = key, [], [], set(), []
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turn, initial, kind, said, copies):
        if not copies:
            return
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        for _ in range(copies):
            if kind == "b":
                sign = "b"
            elif said in self.seen:
                sign = "d"
            else:
                self.seen.add(said)
                self.firsts.append((len(self.signs), said))
                sign = initial.upper() if kind == "t" else initial
            self.signs.append(sign)
            self.initials.append(initial)

    def row(self, part: int, edge: bool) -> tuple:
        letters = "".join(self.initials)
        illegal = sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1))
        return (*self.key, part, "".join(self.signs), edge, [{"at": a, "said": s} for a, s in self.firsts] if edge else [],
                letters[:1], letters[-1:], illegal, self.turns, self.first_turn, self.last_turn)


_RUN_NAMES = ["conv_id", "none", "part", "signs", "edge", "firsts", "head", "tail", "illegal", "turns", "first_turn", "last_turn"]
_RUN = ("conv_id long, none boolean, part int, signs string, edge boolean, firsts array<struct<at: int, said: binary>>, head string, tail string, "
        "illegal long, turns long, first_turn long, last_turn long")
_RUN_TYPES = [pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.struct([("at", pa.int32()), ("said", pa.binary())])),
              pa.string(), pa.string(), *[pa.int64()] * 4]


def _batches(rows: Iterator[tuple], names: list[str], types: list, size: int = 4096) -> Iterator[pa.RecordBatch]:
    out, weight = [], 0
    for row in rows:
        out.append(row)
        weight += 1 + sum(len(v) for v in row if isinstance(v, (str, list))) // 64
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out, weight = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _cut(batches):
    """One row per conversation met in this partition, whose rows are sorted. Only the partition's first and last
    conversation can go on elsewhere; they carry the digests of what they say."""
    part = TaskContext.get().partitionId()

    def runs():
        run, first = None, True
        for batch in batches:
            for conv, none, turn, initial, kind, said, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if run is None or run.key != (conv, none):
                    if run is not None:
                        yield run.row(part, first)
                        first = False
                    run = _Run((conv, none))
                run.add(turn, initial, kind, said, copies)
        if run is not None:
            yield run.row(part, True)

    yield from _batches(runs(), _RUN_NAMES, _RUN_TYPES)


def _runs(rows: DataFrame) -> DataFrame:
    trimmed = F.rtrim("text", F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    light = rows.select(
        "conv_id", "none", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when(trimmed == "", "b").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), "").otherwise("t").alias("kind"), "said", "copies")
    # The row number only parts equal rows, which are interchangeable, so that no partition has to hold all of them.
    order = [F.col("none").desc(), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("said")]
    dealt = light.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").drop("salt")
    return stored(dealt.sortWithinPartitions(*order).mapInArrow(_cut, _RUN))


class _Nodes:
    """What a node costs in each grammar state, from its sign and its successor's costs (least entry 0). Few such
    pairs exist, so every one is computed once per task."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, sign: str, rest: tuple) -> tuple:
        found = self.known.get((sign, rest))
        if found is None:
            found = self.known[sign, rest] = self._solve(sign, rest)
        return found

    @staticmethod
    def _solve(sign: str, rest: tuple) -> tuple:
        letter, extra = sign.lower(), TRUNCATED if sign.isupper() else 0
        own: list[list[tuple]] = []
        for state in range(4):
            ways = [(DELETE + rest[state], "D", state)]
            if sign != "-":
                if letter in _AFTER[state]:
                    ways.append((extra + rest[_AFTER[state][letter]], "K", _AFTER[state][letter]))
                ways.append((REROLE + extra + rest[_PUT[state]], "R", _PUT[state]))
            own.append(ways)
        least = [min(w)[0] for w in own]
        cost = [0, 0, min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])]
        cost[0], cost[1] = min(least[0], INSERT + cost[2]), min(least[1], INSERT + cost[2])
        edits, exits = [], []
        for state in range(4):
            text = ""
            while True:
                ways = [*own[state], (INSERT + cost[_PUT[state]], "I", None)]
                _, edit, then = min((w for w in ways if w[0] == cost[state]), key=lambda w: w[1])
                text += edit
                if edit != "I":
                    break
                state = _PUT[state]
            edits.append(text)
            exits.append(then)
        base = min(cost)
        return tuple(min(c - base, _FAR) for c in cost), base, tuple(edits), tuple(exits)


_ANSWER = "root string, signs string, costs array<long>, edits array<string>, exits array<int>"


def solved(runs: DataFrame) -> DataFrame:
    """For each distinct (root, signs): costs, edits and exits, one entry per grammar state the run may start in.

    root holds what the run's end costs in each state, as ``c0,c1,c2,c3``; signs are of ``suaxSUAX-``.
    """

    def walk(batches):
        nodes = _Nodes()

        def answers():
            stack, last_root, last = [], None, ""
            for batch in batches:
                for root, back in zip(batch["root"].to_pylist(), batch["back"].to_pylist(), strict=True):
                    if root != last_root:
                        stack = [(tuple(map(int, root.split(","))), 0, None, None, 0)]
                        last_root, last = root, ""
                    shared = len(os.path.commonprefix([back, last]))
                    del stack[shared + 1 :]
                    for sign in back[shared:]:
                        costs, base, edits, exits = nodes(sign, stack[-1][0])
                        stack.append((costs, base, edits, exits, stack[-1][4] + base))
                    last = back
                    texts, states = [], []
                    for state in range(4):
                        parts = []
                        for node in reversed(stack[1:]):
                            parts.append(node[2][state])
                            state = node[3][state]
                        texts.append("".join(parts))
                        states.append(state)
                    yield root, back[::-1], [min(c + stack[-1][4], _FAR) for c in stack[-1][0]], texts, states

        yield from _batches(answers(), ["root", "signs", "costs", "edits", "exits"],
                            [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())])

    wanted = runs.select("root", F.reverse("signs").alias("back")).distinct()
    return wanted.repartitionByRange("root", "back").sortWithinPartitions("root", "back").mapInArrow(walk, _ANSWER)


def _rootless(signs):
    return F.translate(signs, "bd", "--")


def _told_apart(chained: DataFrame) -> DataFrame:
    """Signs of runs whose conversation lies in several partitions, with what an earlier run says marked as said before."""
    said = chained.select(*_KEY, "part", F.explode("firsts").alias("f")).select(*_KEY, "part", "f.at", "f.said")
    early = said.groupBy(*_KEY, "said").agg(F.min("part").alias("from"))
    again = said.join(early, [*_KEY, "said"]).where("part > `from`").groupBy(*_KEY, "part").agg(F.collect_list("at").alias("ats"))

    @F.pandas_udf("string")
    def marked(signs, ats):
        out = []
        for text, places in zip(signs, ats, strict=True):
            letters = list(text)
            for at in places if places is not None else ():
                letters[at] = "d"
            out.append("".join(letters))
        return type(signs)(out)

    return stored(chained.drop("firsts").join(again, [*_KEY, "part"], "left").withColumn("signs", marked("signs", "ats")).drop("ats"))


def _wrapped(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _chains(runs: DataFrame) -> DataFrame:
    """Counts, cost and audit of the conversations that are chains of runs; a chain has one run per partition at most."""
    basis = [",".join("0" if i == j else str(_FAR) for i in range(4)) for j in range(4)]
    shape = runs.withColumn("plain", _rootless("signs"))
    ends = solved(shape.select(F.explode(F.array(*map(F.lit, basis))).alias("root"), F.col("plain").alias("signs")))
    tables = ends.groupBy("signs").agg(F.map_from_entries(F.collect_list(F.struct("root", "costs"))).alias("costs")).withColumnRenamed("signs", "plain")

    def back(t: pa.Table) -> pa.Table:
        rest, roots = _END, []
        rows = sorted(t.select(["part", "costs"]).to_pylist(), key=lambda r: -r["part"])
        for r in rows:
            base = min(rest)
            roots.append(",".join(str(min(c - base, _FAR)) for c in rest))
            to = dict(r["costs"])
            rest = tuple(min(min(to[basis[j]][i] + rest[j] for j in range(4)), _FAR) for i in range(4))
        n = len(rows)
        return pa.table({"conv_id": t["conv_id"][:1].take([0] * n), "none": t["none"][:1].take([0] * n),
                         "part": pa.array([r["part"] for r in rows], pa.int32()), "root": pa.array(roots, pa.string())})

    rooted = shape.join(tables, "plain").groupBy(*_KEY).applyInArrow(back, "conv_id long, none boolean, part int, root string")
    shape = stored(shape.join(rooted, [*_KEY, "part"]))
    answers = solved(shape.select("root", F.col("plain").alias("signs"))).withColumnRenamed("signs", "plain")
    met = shape.join(answers, ["root", "plain"]).drop("plain", "root", "costs")

    def forth(t: pa.Table) -> pa.Table:
        state, audit, cost, signs, illegal, turns = 0, [], 0, "", 0, 0
        tail, first, last = "", None, None
        for r in sorted(t.drop_columns(["conv_id", "none"]).to_pylist(), key=lambda r: r["part"]):
            audit.append(r["edits"][state])
            cost += _cost(r["signs"], r["edits"][state])
            state = r["exits"][state]
            signs += r["signs"]
            if r["head"]:
                illegal += r["illegal"] + (tail != "" and tail + r["head"] not in ("su", "ua", "au"))
                tail = r["tail"]
            if r["first_turn"] is not None:
                turns += r["turns"] - (r["first_turn"] == last)
                first, last = r["first_turn"] if first is None else first, r["last_turn"]
        audit.append(_AT_END[state])
        gaps = 0 if first is None else _wrapped(last - first + 1 - turns)
        counts = [gaps, signs.count("b"), signs.count("d"), sum(c.isupper() for c in signs), illegal, cost + _END[state]]
        return pa.table({"conv_id": t["conv_id"][:1], "none": t["none"][:1], **{
            n: pa.array([v], pa.int64()) for n, v in zip(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], counts, strict=True)},
            "audit": ["".join(audit)]})

    return met.groupBy(*_KEY).applyInArrow(forth, f"conv_id long, none boolean, {_STATS}")


def _cost(signs: str, edits: str) -> int:
    cost, at = 0, 0
    for e in edits:
        if e == "I":
            cost += INSERT
            continue
        cost += DELETE if e == "D" else (REROLE if e == "R" else 0) + (TRUNCATED if signs[at].isupper() else 0)
        at += 1
    return cost


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation (conv_id, none): faults, cost and the ASCII-least cheapest edits of its sorted rows."""
    runs = _runs(rows)
    several = stored(runs.where("edge").groupBy(*_KEY).count().where("count > 1").select(*_KEY))
    signs = F.col("signs")
    whole = runs.join(several, _KEY, "left_anti").select(
        *_KEY, _rootless(signs).alias("plain"), "illegal",
        F.when(F.col("first_turn").isNull(), 0).otherwise(F.try_add(F.try_subtract("last_turn", "first_turn"), 1 - F.col("turns"))).alias("gaps"),
        F.regexp_count(signs, F.lit("b")).cast("long").alias("blank"), F.regexp_count(signs, F.lit("d")).cast("long").alias("duplicate"),
        F.regexp_count(signs, F.lit("[SUAX]")).cast("long").alias("truncated"))
    root = ",".join(map(str, _END))
    answers = solved(whole.select(F.lit(root).alias("root"), F.col("plain").alias("signs"))).withColumnRenamed("signs", "plain")
    end = F.element_at(F.array(*map(F.lit, _AT_END)), F.col("exits")[0] + 1)
    # Of these columns, texts of signs are the longest; a common run is split by adaptive execution, its answer is one row.
    out = whole.join(answers, "plain").select(*_KEY, "gaps", "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"),
                                              F.concat(F.col("edits")[0], end).alias("audit"))
    if not several.isEmpty():
        out = out.unionByName(_chains(_told_apart(runs.join(several, _KEY, "left_semi"))))
    return stored(out)


class _Scribe:
    """Applies a conversation's edits to its rows as they pass and hashes what is left."""

    def __init__(self, plan: tuple):
        self.plan, self.audit, self.at, self.state, self.hash, self.any = plan, plan[-1], 0, 0, hashlib.sha256(), False

    def _say(self, role: str, text: str):
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(f"{role}:".encode("utf-8", "surrogatepass"))
        self.hash.update(text.encode("utf-8", "surrogatepass"))

    def _put(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _PUT[self.state]
            self._say(_ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int):
        for _ in range(copies):
            self._put()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = _AFTER[self.state][role[:1]]
                self._say(role, text)
            elif edit == "R":
                self.state = _PUT[self.state]
                self._say(_ROLE[self.state], text)

    def done(self) -> tuple:
        self._put()
        return *self.plan, self.hash.hexdigest()


_OUT = f"conv_id long, none boolean, {_STATS}, repaired_sha256 string"


def repaired(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and hash of the repaired rows per conversation of ``conversations`` (conv_id, turn, role,
    text, copies): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by the md5 digest of role and text, so equal rows stand side by
    side. A null conv_id is a conversation of its own. Conversations without any row that has copies give zeros, an empty
    audit and the hash of nothing. Roles whose first letter is none of s, u, a can only be given another role or deleted;
    an empty role counts as such. An empty table gives no rows; columns beyond those named are ignored. Differences of
    turns that pass 64 bits give null gaps, or wrap where the conversation spans partitions. Texts of one conversation are
    hashed one after the other, as SHA-256 asks; no task holds them at once.
    """
    rows = _rows(conversations)
    plans = audits(rows)
    stats = [c for c in plans.columns if c not in _KEY]
    said = rows.where("copies > 0").select(*_KEY, F.lit(1).alias("kind"), "turn", "said", "role", "text", "copies", *[
        F.lit(None).cast(plans.schema[c].dataType).alias(c) for c in stats])
    edits = plans.select(*_KEY, F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("turn", "long"), ("said", "binary"), ("role", "string"), ("text", "string"), ("copies", "int"))], *stats)

    def write(batches):
        def lines():
            scribe = None
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    for conv, none, kind, role, text, copies, *counts in zip(*[c.to_pylist() for c in part.columns], strict=True):
                        if kind == 0:
                            if scribe is not None:
                                yield scribe.done()
                            scribe = _Scribe((conv, none, *counts))
                        else:
                            scribe.row(role, text, copies)
            if scribe is not None:
                yield scribe.done()

        yield from _batches(lines(), [*_KEY, *stats, "repaired_sha256"], [pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string()])

    order = [*_KEY, "kind", F.col("turn").asc_nulls_first(), "said"]
    dealt = said.unionByName(edits).repartition(*_KEY).sortWithinPartitions(*order)
    out = dealt.drop("turn", "said").mapInArrow(write, _OUT)
    return out.select(F.when(~F.col("none"), F.col("conv_id")).alias("conv_id"), *stats, "repaired_sha256")


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(damaged(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")))
