"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, by survivor-coalescence Viterbi."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stored

#: Faults of a row, the first that holds: it says nothing, it was said before, its sentence does not end.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
DELETE, RELABEL, INSERT, CUT_OFF = 4, 3, 3, 3
#: What has been put out so far: nothing, a system turn, a user turn last, an assistant turn last.
STATES = START, SYSTEM, USER, ASSISTANT = range(4)
KEEP_FROM = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
TO_USER, TO_ASSISTANT = KEEP_FROM["u"], KEEP_FROM["a"]
#: Inserts with which a conversation that ends in a state is complete.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = ("su", "ua", "au")
#: [y][x]: how much more than from x the rest can cost from y at most, whatever follows. From x, an insert or two reach y, or a system row that x keeps is deleted.
WORSE = ((0, 0, 3, 6), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))


class _Node:
    """One edit in the tree of survivors: ``kids`` are the nodes after it, ``held`` counts the states that end here."""

    __slots__ = ("up", "edit", "depth", "jump", "kids", "held")

    def __init__(self, up: _Node | None, edit: str):
        self.up, self.edit, self.kids, self.held = up, edit, [], 0
        self.depth = up.depth + 1 if up else 0
        jump = up.jump if up else None  # skips that make any ancestor a logarithmic number of steps away
        self.jump = jump.jump if jump and jump.jump and up.depth - jump.depth == jump.depth - jump.jump.depth else up
        if up:
            up.kids.append(self)


def _less(a: _Node, x: str, b: _Node, y: str) -> bool:
    """Is the unresolved suffix of ``a`` and then ``x`` less than that of ``b`` and then ``y``? Both are of one tree."""
    if a is b:
        return x < y
    p, q = a, b
    while p.depth > q.depth:
        p = p.jump if p.jump.depth >= q.depth else p.up
    while q.depth > p.depth:
        q = q.jump if q.jump.depth >= p.depth else q.up
    if p is q:  # one is a beginning of the other
        return _below(a, p) + x < _below(b, q) + y
    while p.up is not q.up:
        if p.jump is not q.jump and p.jump.depth == q.jump.depth:
            p, q = p.jump, q.jump
        else:
            p, q = p.up, q.up
    return p.edit < q.edit


def _below(node: _Node, top: _Node) -> str:
    edits = []
    while node is not top:
        edits.append(node.edit)
        node = node.up
    return "".join(reversed(edits))


class Survivors:
    """The cheapest edits into each state, ASCII-least among equals, over rows given one by one.

    A state that no rest of the conversation can make the best one any more is given up (unless not ``whole``: then only the
    costs are wanted). Edits come out of ``settled`` as soon as all states left share them, and their nodes are cut off, so the
    tree holds only what is still open.
    """

    def __init__(self, entry: int = START, whole: bool = True):
        self.whole = whole
        self.root = _Node(None, "")
        self.best: list[tuple[int, _Node] | None] = [None] * 4
        self.best[entry] = (0, self.root)
        self.root.held = 1
        self.settled: list[str] = []

    def _inserted(self) -> list[tuple[int, _Node, str] | None]:
        """Each state also by inserts: (cost, node, inserts behind it)."""
        reach = [(b[0], b[1], "") if b else None for b in self.best]
        for state in (START, SYSTEM, ASSISTANT):
            reach[USER] = self._better(reach[USER], self.best[state], "I", INSERT)
        if reach[USER]:
            cost, node, before = reach[USER]
            reach[ASSISTANT] = self._better(reach[ASSISTANT], (cost, node), before + "I", INSERT)
        return reach

    @staticmethod
    def _better(old, source, edits: str, cost: int):
        if source is None:
            return old
        new = (source[0] + cost, source[1], edits)
        if old is None or new[0] < old[0]:
            return new
        return new if new[0] == old[0] and _less(new[1], new[2], old[1], old[2]) else old

    def row(self, initial: str, must_go: bool, cut_off: bool) -> None:
        reach, new = self._inserted(), [None] * 4
        stay = CUT_OFF if cut_off else 0
        moves = [(state, state, "D", DELETE) for state in STATES]
        if not must_go:
            if initial in KEEP_FROM:
                to, sources = KEEP_FROM[initial]
                moves += [(state, to, "K", stay) for state in sources]
            for to, sources in (TO_USER, TO_ASSISTANT):
                moves += [(state, to, "R", RELABEL + stay) for state in sources]
        for state, to, edit, cost in moves:
            if reach[state]:
                new[to] = self._better(new[to], reach[state][:2], reach[state][2] + edit, cost)
        if self.whole:
            alive = [s for s in STATES if new[s]]
            new = [n if n and all(new[y][0] + WORSE[y][s] >= n[0] for y in alive) else None for s, n in enumerate(new)]
        made: dict[tuple[int, str], _Node] = {}

        def grown(node: _Node, edits: str) -> _Node:
            for edit in edits:
                key = (id(node), edit)
                if key not in made:
                    made[key] = _Node(node, edit)
                node = made[key]
            return node

        after = [(n[0], grown(n[1], n[2])) if n else None for n in new]
        for a in after:
            if a:
                a[1].held += 1
        for b in self.best:
            if b:
                b[1].held -= 1
                self._release(b[1])
        self.best = after
        while not self.root.held and len(self.root.kids) == 1:
            self.root.up = self.root.jump = None
            self.root = self.root.kids[0]
            self.settled.append(self.root.edit)

    def _release(self, node: _Node) -> None:
        while not node.held and not node.kids and node is not self.root:
            node.up.kids.remove(node)
            node = node.up

    def order(self) -> list[int]:
        """Rank of each state's edits among the survivors'."""
        alive = [s for s in STATES if self.best[s]]
        return [sum(_less(self.best[o][1], "", self.best[s][1], "") for o in alive if o != s) if self.best[s] else -1 for s in STATES]

    def end(self, last: int | None = None) -> tuple[int, str]:
        """(cost, edits still open), ending in ``last`` or, if None, with the cheapest complete conversation."""
        if last is None:
            order = self.order()
            last = min((s for s in STATES if self.best[s]), key=lambda s: (self.best[s][0] + INSERT * len(CLOSING[s]), order[s]))
            closing = CLOSING[last]
        else:
            closing = ""
        cost, node = self.best[last]
        return cost + INSERT * len(closing), _below(node, self.root) + closing


def _row_edits(rows: list[tuple[str, int, int]], entry: int = START, last: int | None = None) -> tuple[int, list[str]]:
    """Cost and, per row (initial, flags, copies), its edits: inserts before it, its own, a delete for every further copy."""
    run, edits, cost, current = Survivors(entry), [], 0, ""
    at = 0

    def take(chars) -> None:
        nonlocal current, at, cost
        for c in chars:
            current += c
            if c != "I":
                more = rows[at][2] - 1
                edits.append(current + "D" * more)
                cost += DELETE * more
                current, at = "", at + 1

    for initial, flags, _ in rows:
        run.row(initial, bool(flags & 1), bool(flags & 2))
        if run.settled:
            take(run.settled)
            run.settled.clear()
    own, rest = run.end(last)
    take(rest)
    if current and edits:
        edits[-1] += current
    return cost + own, edits


def _ahead(cost: list[int | None], rank: list[int], summary: list[int]) -> tuple[list[int | None], list[int], list[int | None]]:
    """Costs and order of the states behind a run of rows, from those before it, and the state before each.

    Edits that end in different states differ, and none is a beginning of another, so their order is all that later ties need.
    """
    ways = [[(cost[e] + summary[8 * e + t], rank[e], summary[8 * e + 4 + t], e) for e in STATES if cost[e] is not None and summary[8 * e + t] >= 0] for t in STATES]
    best = [min(w) if w else None for w in ways]
    order = sorted(b[1:3] for b in best if b)
    return [b and b[0] for b in best], [order.index(b[1:3]) if b else 0 for b in best], [b and b[3] for b in best]


@cache
def _row_summary(initial: str, flags: int) -> list[int]:
    out = []
    for entry in STATES:
        run = Survivors(entry, whole=False)
        run.row(initial, bool(flags & 1), bool(flags & 2))
        out += [b[0] if b else -1 for b in run.best] + run.order()
    return out


def _summary(rows: list[tuple[str, int, int]]) -> list[int]:
    """What a run of rows does to the states: per state before, four costs (-1: never) and the order of the edits into the states after."""
    out, extra = [], sum(DELETE * (n - 1) for _, _, n in rows)
    for entry in STATES:
        cost, rank = [0 if s == entry else None for s in STATES], [0] * 4
        for initial, flags, _ in rows:
            cost, rank, _ = _ahead(cost, rank, _row_summary(initial if initial in KEEP_FROM else "", flags))
        out += [-1 if c is None else c + extra for c in cost] + rank
    return out


def _through(summaries: list[list[int]]) -> tuple[int, list[tuple[int, int | None]]]:
    """Cost, and the states before and after each run, of the best edits of runs that follow each other; the last ends completely."""
    cost, rank, steps = [0, None, None, None], [0] * 4, []
    for summary in summaries:
        cost, rank, back = _ahead(cost, rank, summary)
        steps.append(back)
    last = min((s for s in STATES if cost[s] is not None), key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), rank[s]))
    total, path, state = cost[last] + INSERT * len(CLOSING[last]), [], last
    for back in reversed(steps):
        path.append((back[state], state))
        state = back[state]
    path.reverse()
    return total, [(e, t) for e, t in path[:-1]] + [(path[-1][0], None)]


STATS = ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")


def _piece_stats(rows: list[tuple[str, int, int]], turns: list[int | None], faults: list[tuple[int, int, int]]) -> tuple[list[int | None], str, str]:
    known = [t for t in turns if t is not None]
    illegal = sum(n - 1 for i, _, n in rows if i + i not in LEGAL) + sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    sums = [sum(f[j] for f in faults) for j in range(3)]
    distinct = sum(1 for a, b in zip([None, *known], known, strict=False) if a != b)
    return [known[0] if known else None, known[-1] if known else None, distinct, *sums, illegal], rows[0][0], rows[-1][0]


def _joined_stats(pieces: list[dict]) -> list[int]:
    first, last, turns, faults = None, None, 0, [0, 0, 0, 0]
    for n, piece in enumerate(pieces):
        own = piece["stats"]
        faults = [a + b for a, b in zip(faults, own[3:], strict=True)]
        if n and pieces[n - 1]["tail"] + piece["head"] not in LEGAL:
            faults[3] += 1
        if own[0] is not None:
            turns += own[2] - (last == own[0])
            first, last = own[0] if first is None else first, own[1]
    return [0 if first is None else last - first + 1 - turns, *faults]


ROW = "conv bigint, known boolean, kind int, part int, turn bigint, role string, h binary, n bigint, flags int, edits string, stats array<bigint>, head string, tail string, summary array<bigint>, cost bigint"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and position. Those of a conversation inside the partition get their edits; the
    first and the last conversation may go on in other partitions, so their rows stay open and a summary (kind 1) tells what they do.
    """
    from pyspark import TaskContext

    schema = pa.schema([("conv", pa.int64()), ("known", pa.bool_()), ("kind", pa.int32()), ("part", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.binary()), ("n", pa.int64()), ("flags", pa.int32()), ("edits", pa.string()), ("stats", pa.list_(pa.int64())), ("head", pa.string()), ("tail", pa.string()), ("summary", pa.list_(pa.int64())), ("cost", pa.int64())])
    part = TaskContext.get().partitionId()
    out: list[dict] = []

    def closed(rows: list[dict], whole: bool) -> None:
        plain = [((r["role"] or "")[:1], r["flags"], r["n"]) for r in rows]
        faults = [(r["n"], 0, 0) if r["fault"] == BLANK else (0, r["n"], 0) if r["fault"] == DUPLICATE else (0, r["n"] - 1, r["fault"] == TRUNCATED) for r in rows]
        stats, head, tail = _piece_stats(plain, [r["turn"] for r in rows], faults)
        key = {"conv": rows[0]["conv"], "known": rows[0]["known"], "part": part}
        one = key | {"kind": 1, "stats": stats, "head": head, "tail": tail}
        if whole:
            cost, edits = _row_edits(plain)
            one |= {"cost": cost, "stats": _joined_stats([one])}
        else:
            edits = [None] * len(rows)
            one["summary"] = _summary(plain)
        out.append(one)
        out.extend(key | {"kind": 2, "turn": r["turn"], "role": r["role"], "h": r["h"], "n": r["n"], "flags": r["flags"], "edits": e} for r, e in zip(rows, edits, strict=True))

    held, first = [], True
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv"], row["known"]) != (held[0]["conv"], held[0]["known"]):
                closed(held, not first)
                held, first = [], False
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
            held.append(row)
    if held:
        closed(held, False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation in several partitions: its numbers, and the states before and after each piece."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            pieces = sorted(row["pieces"], key=lambda p: p["part"])
            cost, path = _through([p["summary"] for p in pieces])
            out.append({"conv": row["conv"], "known": row["known"], "cost": cost, "stats": _joined_stats(pieces), "path": [{"part": p["part"], "entry": e, "last": t} for p, (e, t) in zip(pieces, path, strict=True)]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.int64()), ("known", pa.bool_()), ("cost", pa.int64()), ("stats", pa.list_(pa.int64())), ("path", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("last", pa.int32())])))]))


def grouped_rows(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, which come together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the pieces whose states are decided now."""
    schema = pa.schema([("conv", pa.int64()), ("known", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.binary()), ("edits", pa.string())])
    for rows in grouped_rows(batches, "conv", "known", "part"):
        _, edits = _row_edits([((r["role"] or "")[:1], r["flags"], r["n"]) for r in rows], rows[0]["entry"], rows[0]["last"])
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("conv", "known", "turn", "role", "h")} | {"edits": e} for r, e in zip(rows, edits, strict=True)], schema)


def fault_columns(text: Column) -> tuple[Column, Column]:
    """Is a text blank, and does its last character that is not white space end no sentence?"""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return last == "", ~last.isin(".", "!", "?")


def damaged(turns: DataFrame) -> DataFrame:
    """Faults put into ``turns`` by the CRC-32 of ``conv_id:turn`` modulo 20, nulls being one space: 0 drops the row, 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it (n = 2), 4 makes its role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))), F.lit(20))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(how == 4, "user").otherwise(shown("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(how == 3, 2).otherwise(1).cast("bigint").alias("n"), how.alias("how")).where("how > 0").drop("how")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits and figures of ``turns`` (conv_id long, turn long, role and text string, optionally n: how often a row stands there).

    Rows of a conversation go by turn (nulls first), then by role and the MD5 digest of the text; a null role or text is one space. First
    fault of a row: blank, duplicate (role and text stand earlier), truncated (its last character that is no white space is not one of ``.!?``).
    Edits: K keep 0, R change the role to user or assistant 3, D delete 4 (a must for blank and duplicate rows), I insert an
    empty user or assistant row 3; a truncated row that stays costs 3 more. The cheapest edits that give role initials
    ``(s?(ua)+)?`` are taken, the ASCII-least among equals. A role without characters has no legal initial.

    Returns (edits, figures). edits: one row per different row, conv, known (false: the id is null), turn, role, h (digest), edits (inserts before it, its own
    edit, a D for each repeat, and behind the last row the closing inserts). figures: conv, known, gaps, blank, duplicate, truncated, illegal, cost.

    Equal rows become one with a count. Rows are dealt by ranges of (conversation, position), so a conversation of any
    share of the table is spread: its pieces are summed up as costs from state to state and the order of equal ones, the
    summaries are put together (one per partition at most), and each piece is then traced with its two states given. Empty
    tables give empty ones.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    blank, cut_off = fault_columns(text)
    n = F.col("n") if "n" in turns.columns else F.lit(1).cast("bigint")
    rows = turns.select(F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv"), F.col("conv_id").isNotNull().alias("known"), F.col("turn").cast("bigint").alias("turn"),
                        role.alias("role"), F.unhex(F.md5(text)).alias("h"), n.alias("n"), blank.alias("blank"), cut_off.alias("cut_off"))
    rows = stored(rows.groupBy("conv", "known", "turn", "role", "h").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off")))
    said = ("conv", "known", "role", "h")
    turn_key = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    again = rows.groupBy(*said).agg(F.min(turn_key).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    rows = rows.join(again, list(said), "left")
    later = F.col("first").isNotNull() & (F.col("first") < turn_key)
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut_off"), TRUNCATED)
    flags = F.when(fault.isin(BLANK, DUPLICATE), 1).when(fault == TRUNCATED, 2).otherwise(0)
    order = ("known", "conv", "turn", "role", "h")
    dealt = rows.select(*order, "n", fault.alias("fault"), flags.cast("int").alias("flags")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(_pieces, ROW))

    open_pieces = found.where("kind = 1 and summary is not null").groupBy("conv", "known").agg(F.collect_list(F.struct("part", "stats", "head", "tail", "summary")).alias("pieces"))
    decided = stored(open_pieces.mapInArrow(_decided, "conv bigint, known boolean, cost bigint, stats array<bigint>, path array<struct<part:int,entry:int,last:int>>"))
    states = decided.select("conv", "known", F.explode("path").alias("p")).select("conv", "known", "p.*")
    opened = found.where("kind = 2 and edits is null").drop("edits").join(states, ["conv", "known", "part"]).select(*order, "n", "flags", "part", "entry", "last")
    opened = opened.repartition("conv", "known", "part").sortWithinPartitions("conv", "known", "part", "turn", "role", "h")
    opened = opened.mapInArrow(_opened, "conv bigint, known boolean, turn bigint, role string, h binary, edits string")
    edits = found.where("kind = 2 and edits is not null").select("conv", "known", "turn", "role", "h", "edits").unionByName(opened)
    figures = found.where("kind = 1 and summary is null").select("conv", "known", "cost", "stats").unionByName(decided.drop("path"))
    names = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal")
    return edits, figures.select("conv", "known", *[F.col("stats")[i].alias(c) for i, c in enumerate(names)], "cost")


class Rebuilt:
    """Reads the edits of a conversation's rows in order and gives the repaired rows."""

    def __init__(self) -> None:
        self.state = START

    def rows(self, edits: str, role: str, text: str) -> Iterator[tuple[str, str]]:
        for edit in edits:
            if edit == "D":
                continue
            forced = ("assistant", ASSISTANT) if self.state == USER else ("user", USER)
            if edit == "K":
                self.state = KEEP_FROM[role[:1]][0]
                yield role, text
            else:
                self.state = forced[1]
                yield forced[0], text if edit == "R" else ""


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads a conversation's figures, then each row's edits and its text, and holds nothing but the audit."""
    names = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    key, out, pending = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["conv"], row["known"]):
                if key is not None:
                    out.append(one | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                key, pending, audit, lines = (row["conv"], row["known"]), None, [], Rebuilt()
                one, digest, before = {"conv_id": row["conv"] if row["known"] else None} | dict.fromkeys(names, 0), hashlib.sha256(), b""
            if row["kind"] == 0 and row["cost"] is not None:
                one |= {c: row[c] for c in names}
            elif row["kind"] == 1:
                pending = row["edits"]
                audit.append(pending)
            elif row["kind"] == 2 and pending is not None:
                for role, text in lines.rows(pending, row["role"], row["text"]):
                    digest.update(before + f"{role}:{text}".encode())
                    before = b"\n"
                pending = None
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if key is not None:
        out.append(one | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def audits(conversations: DataFrame, turns: DataFrame, edits: DataFrame, figures: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: its figures, audit (all edits in order) and the SHA-256 of its repaired ``role:text`` lines.

    The digest of a conversation can only be made in order, so it streams through one task; nothing of it is held but the audit.
    """
    text = F.coalesce("text", F.lit(" "))
    conv, known = F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv"), F.col("conv_id").isNotNull().alias("known")
    every = conversations.select(conv, known).distinct().withColumn("kind", F.lit(0))
    said = turns.select(conv, known, F.lit(2).alias("kind"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.md5(text)).alias("h"), text.alias("text"))
    both = every.unionByName(figures.withColumn("kind", F.lit(0)), True).unionByName(edits.withColumn("kind", F.lit(1)), True).unionByName(said, True)
    both = both.withColumn("row", F.col("kind") > 0).repartition("conv", "known").sortWithinPartitions("conv", "known", "row", "turn", "role", "h", "kind")
    longs = ", ".join(f"{c} bigint" for c in ("conv_id", "gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"))
    return both.mapInArrow(_audited, longs + ", audit string, repaired_sha256 string")
