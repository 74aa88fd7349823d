"""Cheapest repair of a conversation's turns by a Viterbi walk whose survivors coalesce.

Rows of a conversation come in order and pass an automaton of four states (nothing yet, after a
system turn, after a user turn, after an assistant turn). Each state keeps one survivor: the
cheapest edits that lead there, and of equally cheap ones the least string of edit initials.
Survivors are leaves of one tree of back pointers with reference counts. A branch that no survivor
needs goes at once; an edit that all survivors share is emitted and leaves the tree. So memory
follows the part that is still open, not the conversation. Equally cheap survivors are compared
over all of their open edits: two paths part at their last common node, found by jump pointers in
logarithmic time, and the first edits after it decide. (An edit leads from one state and row to one
other, and a cycle of insertions costs more, so a tied path is never the beginning of another.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
BLANKS = " \t\n\v\f\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: State after a kept turn, by state and role initial; state after an inserted or re-roled turn.
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What a survivor of the first state pays at most for doing as one of the second does, whatever follows; a survivor that costs more than that goes.
AT_MOST = {(ASSISTANT, EMPTY): DELETE, (ASSISTANT, SYSTEM): 0, (EMPTY, SYSTEM): 0}


class Node:
    """An edit in the tree of survivors."""

    __slots__ = ("parent", "jump", "depth", "edit", "row", "kids", "held")

    def __init__(self, parent: Node | None, edit: str = "", row: tuple | None = None):
        self.parent, self.edit, self.row, self.kids, self.held = parent, edit, row, [], 0
        if parent is None:
            self.jump, self.depth = self, 0
        else:
            parent.kids.append(self)
            far = parent.jump
            self.jump, self.depth = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent, parent.depth + 1

    def above(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.parent
        return node


def before(left: tuple[Node, str], right: tuple[Node, str]) -> bool:
    """Whether the edits of the left path, then its new edit, come before those of the right one in ASCII order."""
    (a, e), (b, f) = left, right
    if a is b:
        return e < f
    depth = min(a.depth, b.depth)
    x, y = a.above(depth), b.above(depth)
    if x is y:  # one path ends where the other goes on
        return e < b.above(depth + 1).edit if a.depth == depth else a.above(depth + 1).edit < f
    while x.parent is not y.parent:
        x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.parent, y.parent)
    return x.edit < y.edit


class Survivors:
    """The walk over one conversation; ``emit(edit, row)`` gets the edits in order, as soon as nothing can change them."""

    def __init__(self, emit: Callable[[str, tuple | None], None]):
        self.emit, self.root = emit, Node(None)
        self.live: dict[int, tuple[int, Node]] = {}
        self._replace({EMPTY: (0, self.root, "", None)})

    def add(self, initial: str, fault: int, row: tuple) -> None:
        """The next row: its role initial, its first fault, and what ``emit`` gets of it."""
        found: dict[int, tuple] = {}
        for state, (cost, node) in self.live.items():
            self._offer(found, state, cost + DELETE, node, "D", row)
            if fault in (BLANK, DUPLICATE):
                continue
            kept = cost + (CUT_OFF if fault == TRUNCATED else 0)
            if (state, initial) in KEPT:
                self._offer(found, KEPT[state, initial], kept, node, "K", row)
            self._offer(found, NEXT[state], kept + REROLE, node, "R", row)
        self._replace(found)

    @staticmethod
    def _offer(found: dict[int, tuple], state: int, cost: int, node: Node, edit: str, row: tuple | None) -> None:
        old = found.get(state)
        if old is None or cost < old[0] or cost == old[0] and before((node, edit), (old[1], old[2])):
            found[state] = (cost, node, edit, row)

    def _replace(self, found: dict[int, tuple]) -> None:
        """New survivors with insertions after them; the old ones let go of their nodes."""
        live = {state: (cost, Node(node, edit, row) if edit else node) for state, (cost, node, edit, row) in found.items()}
        for target, sources in ((USER, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best = (live[target][0], live[target][1], "", None) if target in live else None
            for source in sources:
                if source in live:
                    cost, node = live[source]
                    if best is None or cost + INSERT < best[0] or cost + INSERT == best[0] and self._tied(node, best):
                        best = (cost + INSERT, node, "I", None)
            if best and best[2]:
                dropped = live.get(target)
                live[target] = (best[0], Node(best[1], "I"))
                if dropped:
                    self._release(dropped[1])
        for (state, other), extra in AT_MOST.items():
            if state in live and other in live and live[other][0] > live[state][0] + extra:
                self._release(live.pop(other)[1])
        for _, node in live.values():
            node.held += 1
        old, self.live = self.live, live
        for _, node in old.values():
            node.held -= 1
            self._release(node)
        while len(self.root.kids) == 1 and not self.root.held:
            self._step(self.root.kids[0])

    @staticmethod
    def _tied(node: Node, best: tuple) -> bool:
        if best[2]:
            return before((node, "I"), (best[1], best[2]))
        return before((node, "I"), (best[1].parent, best[1].edit))

    def _release(self, node: Node) -> None:
        """Drop a node that nothing refers to, and then its parents."""
        while not node.held and not node.kids and node is not self.root:
            parent = node.parent
            parent.kids.remove(node)
            node.parent, node.row = None, None
            node = parent

    def _step(self, node: Node) -> None:
        """The edit of the root's only way on leaves the tree."""
        self.emit(node.edit, node.row)
        self.root.kids, node.parent, node.row, self.root = [], None, None, node

    def end(self) -> int:
        """Emit what is left; the cost of the whole repair."""
        ends = [self.live[state] for state in (EMPTY, ASSISTANT) if state in self.live]
        best = ends[0]
        for cost, node in ends[1:]:
            if cost < best[0] or cost == best[0] and before((node, ""), (best[1], "")):
                best = (cost, node)
        path, node = [], best[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edit, node.row)
        return best[0]


class Conversation:
    """Counts, edits and repaired turns of the conversation whose rows are read."""

    def __init__(self, key: object, each: Callable[[tuple], None] | None):
        self.key, self.each, self.rows, self.faults, self.illegal = key, each, 0, [0] * 4, 0
        self.low = self.high = self.last_turn = None
        self.turns, self.last, self.state, self.n_edits = 0, None, EMPTY, 0
        self.audit, self.digest, self.n_out = [], hashlib.sha256(), 0
        self.survivors = Survivors(self.emit)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows += 1
        self.faults[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        self.survivors.add(self.last, fault, (turn, role, text))

    def emit(self, edit: str, row: tuple | None) -> None:
        turn, role, text = row or (None, None, "")
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
        elif edit != "D":
            self.state = NEXT[self.state]
            role = ROLES[self.state]
        if self.each:
            self.each((self.key, self.n_edits, edit, turn, role, text))
            self.n_edits += 1
            return
        self.audit.append(edit)
        if edit != "D":
            self.digest.update(f"{chr(10) if self.n_out else ''}{role}:{text}".encode())
            self.n_out += 1

    def row(self) -> tuple:
        cost = self.survivors.end()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.key, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def marked(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Turns with their first fault, each conversation in one partition and in order.

    Columns ``key, turn, role, text, present, fault``. Null roles and texts become one space. Order:
    turn (nulls first), role, text. One shuffle by conversation; both sorts spill to disk, so no
    conversation has to fit into memory. Repaired text and its digest are sequential over a
    conversation, so one task streams it.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        (F.lit(True) if present is None else present).alias("present")).repartition("key")
    seen = F.row_number().over(Window.partitionBy("key", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(solid == "", BLANK).when(F.col("__seen") > 1, DUPLICATE).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))
    return (rows.withColumn("__seen", seen).withColumn("fault", fault)
            .sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text", "__seen").drop("__seen"))


def _walk(batches: Iterable[pa.RecordBatch], each: Callable[[tuple], None] | None) -> Iterator[tuple | None]:
    """Summary of each conversation of a partition; None after each batch."""
    now = None
    for batch in batches:
        for key, turn, role, text, present, fault in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if now is None or now.key != key:
                if now:
                    yield now.row()
                now = Conversation(key, each)
            if present:
                now.add(turn, role, text, fault)
        yield None
    if now:
        yield now.row()


def _batches(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(kind.names, row, strict=True)) for row in rows], kind)


SUMMARY = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
EDITS = [("edit_no", "long"), ("edit", "string"), ("turn", "long"), ("role", "string"), ("text", "string")]
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _run(rows: DataFrame, columns: list[tuple[str, str]], edits: bool) -> DataFrame:
    key = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind = [], None

        def known(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in source:
                kind = kind or pa.schema([("key", batch.schema.field("key").type), *((name, _ARROW[t]) for name, t in columns)])
                yield batch

        for done in _walk(known(batches), out.append if edits else None):
            if done and not edits:
                out.append(done)
            if out and (done is None or len(out) >= 2000):
                yield _batches(out, kind)
                out.clear()
        if out:
            yield _batches(out, kind)

    return rows.mapInArrow(run, ", ".join([f"key {key}", *(f"{name} {t}" for name, t in columns)])).withColumnRenamed("key", "conv_id")


def summary(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: faults, gaps, illegal neighbours, cost, edit initials and digest of the repaired turns.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored. A row where ``present``
    is false stands for a lost turn: it counts nowhere, but its conversation gets a row (zeros and
    the digest of an empty text if it has no other). Null conversation ids are one conversation.
    Rows alike in all four columns are repeats: all but the first are duplicates. An empty table
    gives no rows.
    """
    return _run(marked(turns, present), SUMMARY, edits=False)


def repaired(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """The cheapest edits of every conversation, a row each: ``conv_id, edit_no, edit, turn, role, text``.

    Edit K keeps a turn, R gives it another role, D deletes it (role and text are those it had), I
    inserts an empty one (null turn). Rows leave as soon as they are certain. Odd rows as in ``summary``.
    """
    return _run(marked(turns, present), EDITS, edits=True)


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the contract by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays with ``present`` false."""
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")
