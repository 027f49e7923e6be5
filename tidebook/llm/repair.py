"""Conversation structure repair by depth-first branch-and-bound.

A conversation should be an optional system turn and then pairs of a user and an
assistant turn. Rows are blank (no visible character), duplicate (role and text
as in an earlier row) or truncated (the last visible character is none of ``.!?``);
the first of these that holds counts. Edits in order of the rows: Keep (cost 0),
Rerole to user or assistant (2), Delete (3, the only one for blank and duplicate
rows), Insert an empty turn (2); a truncated row that stays costs 1. The cheapest
edits are taken, among equal ones the ASCII-least string of their initials.

The search holds an explicit stack of prefixes. A node is (rows read, what the last
kept turn was). A prefix is dropped if its cost and a lower bound of the rest pass
the incumbent (cost, audit), or equal it with a larger audit, or if the node has
been reached at no larger (cost, audit): two prefixes of equal cost at one node are
never a prefix of one another, so what follows can't turn their order. The bound
adds up what each row costs at least and two for each pair of neighbours, taken
from the end without overlap, that can't stand side by side. The search ends when
the stack is empty, so the incumbent is proved.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length
spreads over tasks, and are cut into pieces of ``PIECE`` rows. A conversation of
one piece is solved at once. Of the others each piece is searched from each state
to each state; a stream over the pieces' sizes chains these (conversation by
conversation, keeping four open audits without their common start, and one step
back for each piece and state), and the piece is then searched from and to the
chosen states. Only the digest reads a conversation's texts in one stream.

Defined cases: rows that share a turn are in order of role and text; equal rows
count once and keep their number, so copies cost no shuffle; null roles and texts
are one space, null turns come first, a null conv_id is a conversation of its own;
an empty role has no initial and can't be kept; other columns are ignored; an empty
table gives an empty result. Texts of any length stay whole.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import materialize, worker_imports
from tidebook.llm.tables import partitions, read, small_side

PIECE = 32
#: Costs of the edits, and of a truncated row that stays (fixed values).
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: What the last kept turn was: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
DONE = (START, ASSISTANT)
#: The turn that may follow, and where it leads; a system turn only leads the rest.
NEXT = (USER, USER, ASSISTANT, USER)
REACHED = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def code(turn: int, fault: int) -> int:
    """A row as a byte: its role's initial (START: another) and first fault (0: none)."""
    return 4 * turn + fault


def _kept(state: int, turn: int) -> bool:
    return turn == NEXT[state] or (turn == SYSTEM and state == START)


def bounds(codes: bytes, goals: tuple[int, ...]) -> list[list[int]]:
    """Least cost of the rows from each place on, for each state before them."""
    n = len(codes)
    # the rest after a row, its least cost, and the first row that may stay with its cost and turn
    rest, live = [0] * (n + 1), None
    out: list[list[int]] = [[]] * n + [[0 if s in goals else INSERT for s in range(4)]]
    skipped = 0
    for i in range(n - 1, -1, -1):
        turn, fault = divmod(codes[i], 4)
        if fault in (1, 2):
            rest[i] = DELETE + rest[i + 1]
            skipped += DELETE
        else:
            least = (CUT_SHORT if fault else 0) + (0 if turn else REROLE)
            rest[i] = least + rest[i + 1]
            if live and turn and live[1] and (turn, live[1]) not in LEGAL:
                rest[i] = max(rest[i], least + 2 + skipped + live[0] + rest[live[2] + 1])
            live, skipped = (least, turn, i), 0
        if live is None:
            out[i] = [skipped + x for x in out[n]]
        else:
            clash = skipped + live[0] + 2 + rest[live[2] + 1]
            out[i] = [rest[i] if not live[1] or _kept(s, live[1]) else max(rest[i], clash) for s in range(4)]
    return out


@lru_cache(maxsize=1 << 14)
def search(codes: bytes, start: int = START, goals: tuple[int, ...] = DONE) -> tuple[int, str, int] | None:
    """(cost, audit, last state) of the cheapest edits that lead from ``start``
    to one of ``goals``, the ASCII-least audit among equals."""
    if not set(goals) & set(REACHED[start]):
        return None
    n, bound, best = len(codes), bounds(codes, goals), None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bound[i][state]
        if best and (least > best[0] or (least == best[0] and audit > best[1][: len(audit)])):
            continue
        if (i, state) in reached and reached[i, state] <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and state in goals and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, state)
        after = [(i, NEXT[state], cost + INSERT, audit + "I")]
        if i < n:
            turn, fault = divmod(codes[i], 4)
            after.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault not in (1, 2):
                stays = cost + (CUT_SHORT if fault else 0)
                after.append((i + 1, NEXT[state], stays + REROLE, audit + "R"))
                if turn and _kept(state, turn):
                    after.append((i + 1, turn, stays, audit + "K"))
        # the most promising is read first
        stack += sorted(after, key=lambda x: (x[2] + bound[x[0]][x[1]], x[3]), reverse=True)
    return best


def replay(audit: str, state: int, codes: bytes, roles, texts):
    """The repaired rows of a piece, and the state after it."""
    i, out = 0, []
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append((ROLES[state], ""))
            continue
        if edit == "R":
            state = NEXT[state]
            out.append((ROLES[state], texts[i]))
        elif edit == "K":
            state = codes[i] // 4
            out.append((roles[i], texts[i]))
        i += 1
    return out, state


# --- rows


def faulty(rows: DataFrame) -> DataFrame:
    """The rows that the contract damages: conv_id, turn, role, text and how many
    (none: the conversation is known by this row alone)."""
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    die = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    text = F.when(F.col("die") == 1, "").when(F.col("die") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    said = said.withColumn("die", die).withColumns({"text": text, "role": F.when(F.col("die") == 4, "user").otherwise(F.col("role"))})
    stays = lambda c: F.when(F.col("die") != 0, F.col(c)).alias(c)
    return said.select("conv_id", stays("turn"), stays("role"), stays("text"), F.when(F.col("die") == 0, 0).when(F.col("die") == 3, 2).otherwise(1).alias("n"))


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def marked(rows: DataFrame) -> DataFrame:
    """Each row once, with its number, its role's initial and the first fault of
    its first copy. ``rows`` has conv_id, turn, role, text, n."""
    kinds = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("key", _key())
    kinds = materialize(kinds, "turns")
    met = kinds.where("n > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"))
    met = met.agg(F.min("turn").alias("_first"), F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("turn").isNull()).alias("_null")).where("_n > 1")
    met = small_side(materialize(met, "repeated-turns"))
    both = kinds.join(met, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first"))), F.lit(False))
    tail = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    fault = F.when(tail == "", 1).when(seen, 2).when(~tail.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.left(F.col("role"), F.lit(1))
    turn = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    return both.select("conv_id", "turn", "role", "text", "n", fault.cast("int").alias("fault"), turn.cast("int").alias("kind"))


_PIECE = "part int, piece long, codes binary, roles array<string>, texts array<string>, illegal long, first int, last int, low long, high long, turns long, first_turn long, last_turn long"
_COLS = [c.split()[0] for c in _PIECE.split(", ")]


class _Cutter:
    """Rows of one conversation, in order, to pieces."""

    def __init__(self, conv, part):
        self.conv, self.part, self.piece, self.any = conv, part, 0, False
        self.fresh()

    def fresh(self):
        self.codes, self.roles, self.texts, self.kinds, self.turns = bytearray(), [], [], [], []

    def row(self):
        self.any = True
        k, t = self.kinds, self.turns
        out = [self.conv, self.part, self.piece, bytes(self.codes), self.roles, self.texts]
        out += [sum(p not in LEGAL for p in zip(k[:-1], k[1:], strict=True)), k[0] if k else None, k[-1] if k else None]
        out += [min(t), max(t), len(set(t)), t[0], t[-1]] if t else [None, None, 0, None, None]
        self.piece += 1
        self.fresh()
        return out

    def add(self, turn, role, text, n, fault, kind):
        """A row and its copies; copies are duplicates unless they are blank."""
        for i in range(n):
            own = fault if i == 0 or fault == 1 else 2
            self.codes.append(code(kind, own))
            # texts of rows that must go aren't kept
            self.roles.append(role if own in (0, 3) else "")
            self.texts.append(text if own in (0, 3) else "")
            self.kinds.append(kind)
            if turn is not None:
                self.turns.append(turn)
            if len(self.codes) == PIECE:
                yield self.row()

    def end(self):
        if self.codes or not self.any:
            yield self.row()


def pieces_of(rows: DataFrame) -> DataFrame:
    """Rows in order to pieces of up to ``PIECE`` rows with their counts."""
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")]
    dealt = marked(rows).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]

    def cut(batches):
        from pyspark import TaskContext

        part, cutter = TaskContext.get().partitionId(), None
        for pdf in batches:
            out = []
            for conv, turn, role, text, n, fault, row_kind in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("conv_id", "turn", "role", "text", "n", "fault", "kind")), strict=True):
                if cutter is None or cutter.conv != conv:
                    out += cutter.end() if cutter else []
                    cutter = _Cutter(conv, part)
                for one in cutter.add(None if turn is None else int(turn), role, text, int(n), int(fault or 0), int(row_kind or 0)):
                    out.append(one)
                    if len(out) == 1024:
                        yield pd.DataFrame(out, columns=["conv_id", *_COLS])
                        out = []
            yield pd.DataFrame(out, columns=["conv_id", *_COLS])
        if cutter:
            yield pd.DataFrame(list(cutter.end()), columns=["conv_id", *_COLS])

    return dealt.mapInPandas(cut, f"conv_id {kind}, {_PIECE}")


# --- conversations of several pieces


def _crossings(codes: bytes) -> list[list[tuple[int, str] | None]]:
    """Cost and audit of a piece from each state to each."""
    found = [[search(codes, s, (e,)) for e in range(4)] for s in range(4)]
    return [[f and f[:2] for f in row] for row in found]


class Chain:
    """Pieces one after the other, from no turn to a finished conversation."""

    def __init__(self):
        # for each state: cost and the audit after what all open ones share
        self.open: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.back = array("b")

    def add(self, crossings):
        new, back = [], []
        for e in range(4):
            ways = [(c[0] + x[0], c[1] + x[1], s) for s, c in enumerate(self.open) if c and (x := crossings[s][e])]
            cost, audit, s = min(ways, default=(0, None, -1))
            new.append((cost, audit) if audit is not None else None)
            back.append(s)
        shared = len(commonprefix([c[1] for c in new if c]))
        self.open = [c and (c[0], c[1][shared:]) for c in new]
        self.back.extend(back)

    def states(self) -> tuple[int, list[int]]:
        """The cost, and the state before each piece and at the end."""
        cost, _, state = min((*self.open[s], s) for s in DONE if self.open[s])
        path = [state]
        for i in range(len(self.back) // 4 - 1, -1, -1):
            path.append(self.back[4 * i + path[-1]])
        return cost, path[::-1]


def _by_conversation(pdf_batches, columns):
    """(conversation, rows) as runs of a sorted stream; a run may come in parts."""
    for pdf in pdf_batches:
        cols = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in columns]
        yield from zip(*cols, strict=True)


def chained(pieces: DataFrame) -> DataFrame:
    """conv_id, part, piece, and the states before and after it."""
    kind = dict(pieces.dtypes)["conv_id"]
    spark = pieces.sparkSession

    def cross(batches):
        for pdf in batches:
            said = [[x and f"{x[0]}{x[1]}" for row in _crossings(bytes(c)) for x in row] for c in pdf["codes"]]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "piece": pdf["piece"], "ways": said})

    crossed = pieces.select("conv_id", "part", "piece", "codes").mapInPandas(cross, f"conv_id {kind}, part int, piece long, ways array<string>")
    dealt = crossed.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def way(text):
        if text is None:
            return None
        cost = text.rstrip("DIKR")
        return int(cost), text[len(cost) :]

    def run(batches):
        now, chain, keys = None, None, (array("i"), array("q"))

        def end():
            states = chain.states()[1]
            for a in range(0, len(keys[0]), 8192):
                b = min(a + 8192, len(keys[0]))
                yield pd.DataFrame({"conv_id": pd.Series([now[0]] * (b - a), dtype=object), "part": keys[0][a:b], "piece": keys[1][a:b], "from_state": states[a:b], "to_state": states[a + 1 : b + 1]})

        for conv, part, piece, ways in _by_conversation(batches, ["conv_id", "part", "piece", "ways"]):
            if now != (conv,):
                if chain:
                    yield from end()
                now, chain, keys = (conv,), Chain(), (array("i"), array("q"))
            chain.add([[way(ways[4 * s + e]) for e in range(4)] for s in range(4)])
            keys[0].append(part)
            keys[1].append(piece)
        if chain:
            yield from end()

    return dealt.mapInPandas(run, f"conv_id {kind}, part int, piece long, from_state int, to_state int")


# --- results


class _Result:
    def __init__(self, conv):
        self.conv, self.counts, self.cost, self.audit = conv, [0, 0, 0], 0, []
        self.illegal, self.last, self.turn = 0, None, None
        self.low, self.high, self.turns, self.sha, self.rows = None, None, 0, hashlib.sha256(), 0

    def add(self, p):
        codes = bytes(p["codes"])
        faults = [c % 4 for c in codes]
        self.counts = [self.counts[k] + faults.count(k + 1) for k in range(3)]
        self.illegal += p["illegal"]
        if p["first"] is not None:
            self.illegal += self.last is not None and (self.last, p["first"]) not in LEGAL
            self.last = p["last"]
        if p["low"] is not None:
            self.turns += p["turns"] - (self.turn == p["first_turn"])
            self.low = p["low"] if self.low is None else min(self.low, p["low"])
            self.high = p["high"] if self.high is None else max(self.high, p["high"])
            self.turn = p["last_turn"]
        goals = DONE if p["to_state"] is None else (int(p["to_state"]),)
        state = int(p["from_state"] or 0)
        cost, audit, _ = search(codes, state, goals)
        self.cost += cost
        self.audit.append(audit)
        for role, text in replay(audit, state, codes, p["roles"], p["texts"])[0]:
            self.sha.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.rows += 1

    def row(self):
        gaps = 0 if self.low is None else int(self.high - self.low + 1 - self.turns)
        return [self.conv, gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()]


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _results(batches):
    """Pieces in order of conversation and place to one row each."""
    names = ["conv_id", *_COLS, "from_state", "to_state"]
    cols = ["conv_id", *[c.split()[0] for c in _RESULT.split(", ")]]
    now, out = None, []
    for values in _by_conversation(batches, names):
        p = dict(zip(names, values, strict=True))
        if now is None or now.conv != p["conv_id"]:
            out += [now.row()] if now else []
            now = _Result(p["conv_id"])
        now.add(p)
        if len(out) >= 1024:
            yield pd.DataFrame(out, columns=cols)
            out = []
    out += [now.row()] if now else []
    yield pd.DataFrame(out, columns=cols)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits and a digest
    of the repaired rows. ``rows`` has conv_id, turn, role, text, n (see ``faulty``)."""
    spark = rows.sparkSession
    worker_imports(spark)
    pieces = materialize(pieces_of(rows), "pieces")
    kind = dict(rows.dtypes)["conv_id"]
    # pieces of one range task need no shuffle to be counted
    many = pieces.groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_conv", F.lit(True).alias("_many"))
    many = small_side(materialize(many, "long-conversations"))
    split = pieces.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    short = split.where("_many is null").select("conv_id", *_COLS, F.lit(None).cast("int").alias("from_state"), F.lit(None).cast("int").alias("to_state"))
    long = split.where("_many").select("conv_id", *_COLS)
    states = materialize(chained(long), "states").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("piece").alias("_piece"), "from_state", "to_state")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece"))
    long = long.join(states, on).select("conv_id", *_COLS, "from_state", "to_state")
    long = long.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    run = f"conv_id {kind}, {_RESULT}"
    return short.mapInPandas(_results, run).unionByName(long.mapInPandas(_results, run))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(faulty(read(spark, sf_dir, "conversations")))


# every place of a conversation keeps, for each state, its cheapest way
_INITIAL = "CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * len(k))), lambda c, i: xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(k[(i // 8 + 1)::INT])::BIGINT) ELSE c END) >> 1, 3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, ascii(k[(i // 8 + 1)::INT])::BIGINT) ELSE c END) & 1))), 4294967295)"
ORACLE = {
    "op12_repair": f"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
die AS (SELECT *, {_CRC} % 20 AS d FROM base),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM die, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS tail, {_INITIAL} AS kind FROM dam),
rws AS MATERIALIZED (SELECT conv_id, i, turn, role, text, kind, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS prev, count(*) OVER (PARTITION BY conv_id) AS n FROM ord),
w(conv_id, i, st, b) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {{c: 0, a: '', r: ''}} FROM conversations
UNION ALL SELECT conv_id, i, st, min({{c: c, a: a, r: r}}) AS b FROM (
 SELECT p.conv_id, p.i + 1 AS i, q.st, q.c, q.a, q.r FROM (SELECT x.conv_id, x.i, y.st, b.c + y.c AS c, b.a || y.a AS a, b.r || y.r AS r FROM w x, LATERAL (SELECT x.st AS st, 0 AS c, '' AS a, '' AS r UNION ALL SELECT CASE WHEN x.st = 2 THEN 3 ELSE 2 END, 2, 'I', CASE WHEN x.st = 2 THEN 'assistant:' ELSE 'user:' END || chr(10)
  UNION ALL SELECT CASE WHEN x.st = 2 THEN 2 ELSE 3 END, 4, 'II', CASE WHEN x.st = 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10)) y) p
 JOIN rws t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1, LATERAL (SELECT p.st AS st, p.c + 3 AS c, p.a || 'D' AS a, p.r AS r
  UNION ALL SELECT CASE WHEN p.st = 2 THEN 3 ELSE 2 END, p.c + 2 + (t.fault = 3)::INT, p.a || 'R', p.r || CASE WHEN p.st = 2 THEN 'assistant:' ELSE 'user:' END || t.text || chr(10) WHERE t.fault IN (0, 3)
  UNION ALL SELECT t.kind, p.c + (t.fault = 3)::INT, p.a || 'K', p.r || t.role || ':' || t.text || chr(10) WHERE t.fault IN (0, 3) AND ((t.kind = 1 AND p.st = 0) OR (t.kind = 2 AND p.st <> 2) OR (t.kind = 3 AND p.st = 2))) q) GROUP BY conv_id, i, st),
ends AS (SELECT w.conv_id, min(CASE WHEN st = 2 THEN {{c: b.c + 2, a: b.a || 'I', r: b.r || 'assistant:' || chr(10)}} WHEN st = 1 THEN {{c: b.c + 4, a: b.a || 'II', r: b.r || 'user:' || chr(10) || 'assistant:' || chr(10)}} ELSE b END) AS b FROM w LEFT JOIN (SELECT DISTINCT conv_id, n FROM rws) z ON z.conv_id IS NOT DISTINCT FROM w.conv_id WHERE i = coalesce(n, 0) GROUP BY 1),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(prev IS NOT NULL AND (prev, kind) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal FROM rws GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(left(b.r, greatest(len(b.r) - 1, 0))) AS repaired_sha256 FROM ends e LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
