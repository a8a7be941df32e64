"""Repair of conversations by generalised LR parsing over the grammar of roles.

Legal conversations are ``(s?(ua)+)?`` in initials of roles (system, user, assistant). A
conversation's rows are read by an LR automaton of that grammar whose every step
may also repair: keep the row (0), change its role to user or assistant (1), delete it (2, required
if it is blank or repeats an earlier row), or insert an empty row of user or assistant
(5); a truncated row that isn't deleted adds 5. All repairs are followed at once on a graph-structured
stack, whose nodes are shared by all stacks that begin alike; equal stack tops merge by the least
(cost, audit), the audit being the initials of the edits in order.

The grammar is left-recursive, so there are few stacks whatever a conversation's length, and
reading rows is a product of small matrices: for each stack before and each stack after, the
least (cost, audit). That is what lets a conversation of any size be read in pieces:

1. Rows are sorted by ranges of (conversation, turn), so a large conversation spans many
   partitions. A conversation that lies within a partition is repaired there.
2. Others are read in segments, each from every stack that can come before it. One task for each such
   conversation multiplies the matrices, a few bytes for each row, and tells every segment its
   stack and edits.
3. Segments are repaired each by itself. The digest of a whole conversation is by its definition taken in one pass;
   the task that takes it holds one segment at a time.

Order and faults: rows come by turn (null first), rows of one turn by role, then by digest of
the text. A row's first fault counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text
came before in the conversation), truncated (the last such character is none of ``.!?``).

Defined results: null roles and texts are one space, in the key of damage null ids and turns
too; rows without conv_id are one conversation; repeated rows are adjacent and all but the
first are duplicates; an empty role has no initial and a role with another initial is illegal, as is
an upper-case one; a conversation that lost all rows has zeros, an empty audit and the
digest of nothing; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import frames

#: The grammar: the first symbol is where a parse begins.
GRAMMAR = (("C", ""), ("C", "P"), ("P", "sua"), ("P", "ua"), ("P", "Pua"))

KEEP, RENAME, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}

#: Rows and bytes of text in a segment at most, but for a single row.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20

_BLANK = " \t\n\x0b\x0c\r"


class Automaton:
    """States of LR(0) items for a grammar; a stack is a state and the stack below it."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar
        self.begin = grammar[0][0]
        self.states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self.nodes: dict[tuple, tuple] = {}
        self.memo: dict[tuple, tuple] = {}
        self.root = self.node(self._state((k, 0) for k, (left, _) in enumerate(grammar) if left == self.begin), None)

    def node(self, state: int, below: tuple | None) -> tuple:
        """One object for equal stacks."""
        return self.nodes.setdefault((state, id(below)), (state, below))

    def _state(self, items) -> int:
        todo, closed = list(items), set()
        while todo:
            if (item := todo.pop()) not in closed:
                closed.add(item)
                rule, dot = item
                ahead = self.grammar[rule][1][dot : dot + 1]
                todo += [(k, 0) for k, (left, _) in enumerate(self.grammar) if left == ahead]
        if (state := frozenset(closed)) not in self.states:
            self.states.append(state)
            number = len(self.states) - 1
            for symbol in sorted({self.grammar[r][1][d] for r, d in state if d < len(self.grammar[r][1])}):
                self.goto[number, symbol] = self._state((r, d + 1) for r, d in state if self.grammar[r][1][d : d + 1] == symbol)
        return self.states.index(state)

    def _done(self, state: int):
        return [self.grammar[r] for r, d in self.states[state] if d == len(self.grammar[r][1])]

    def accepts(self, stack: tuple) -> bool:
        return any(left == self.begin for left, _ in self._done(stack[0]))

    def read(self, stack: tuple, symbol: str) -> tuple:
        """The stacks after a symbol is shifted and all is reduced that can be."""
        key = (id(stack), symbol)
        if key not in self.memo:
            out, todo = [], []
            if (state := self.goto.get((stack[0], symbol))) is not None:
                todo.append(self.node(state, stack))
            while todo:
                top = todo.pop()
                if self.accepts(top) or any(s == top[0] for s, _ in self.goto):
                    out.append(top)
                for left, right in self._done(top[0]):
                    base = top
                    for _ in right:
                        base = base[1]
                    if left != self.begin:
                        todo.append(self.node(self.goto[base[0], left], base))
            self.memo[key] = tuple(out)
        return self.memo[key]

    def stacks(self) -> list[tuple]:
        """All stacks that rows can leave, the empty one first."""
        found = [self.root]
        for stack in found:
            for symbol in "sua":
                found += [s for s in self.read(stack, symbol) if not any(s is f for f in found)]
        return found


@cache
def _automaton() -> tuple[Automaton, list[tuple]]:
    parser = Automaton()
    return parser, parser.stacks()


#: A row to the parser: its role's initial, and "-" to be deleted, "~" truncated, "+" neither.
Move = tuple[int, str]


def _merge(tops: dict, stack: tuple, move: Move) -> bool:
    """Equal stack tops keep the least (cost, audit)."""
    node = id(stack)
    if node in tops and tops[node][1] <= move:
        return False
    tops[node] = (stack, move)
    return True


def _with_inserts(parser: Automaton, tops: dict) -> dict:
    todo = list(tops.values())
    while todo:
        stack, (cost, audit) = todo.pop()
        if tops[id(stack)][1] != (cost, audit):
            continue
        for symbol in ROLES:
            for after in parser.read(stack, symbol):
                move = (cost + INSERT, audit + "I")
                if _merge(tops, after, move):
                    todo.append((after, move))
    return tops


def parse(rows: str, entry: int = 0) -> dict[int, Move]:
    """The least (cost, audit) for each stack after ``rows`` (two characters each), from one stack before."""
    parser, stacks = _automaton()
    tops = _with_inserts(parser, {id(stacks[entry]): (stacks[entry], (0, ""))})
    for at in range(0, len(rows), 2):
        initial, state = rows[at], rows[at + 1]
        after: dict = {}
        for stack, (cost, audit) in tops.values():
            _merge(after, stack, (cost + DELETE, audit + "D"))
            if state == "-":
                continue
            cost += CUT * (state == "~")
            for top in parser.read(stack, initial):
                _merge(after, top, (cost + KEEP, audit + "K"))
            for symbol in ROLES:
                for top in parser.read(stack, symbol):
                    _merge(after, top, (cost + RENAME, audit + "R"))
        tops = _with_inserts(parser, after)
    place = {id(s): k for k, s in enumerate(stacks)}
    return {place[node]: move for node, (_, move) in tops.items()}


@cache
def _best(rows: str) -> Move:
    return best(parse(rows))


def best(ends: dict[int, Move]) -> Move:
    parser, stacks = _automaton()
    return min(move for k, move in ends.items() if parser.accepts(stacks[k]))


def replay(roles: list[str], texts: list[str], audit: str, entry: int = 0) -> list[str]:
    """The rows that an audit leaves, as ``role:text``."""
    parser, stacks = _automaton()
    stack, at, out = stacks[entry], 0, []
    for edit in audit:
        if edit != "D":
            # From each stack of this grammar one of user and assistant can follow.
            symbol = roles[at][:1] if edit == "K" else next(s for s in ROLES if parser.read(stack, s))
            stack = parser.read(stack, symbol)[0]
            out.append(f"{roles[at] if edit == 'K' else ROLES[symbol]}:{'' if edit == 'I' else texts[at]}")
        at += edit != "I"
    return out


# --- rows ---------------------------------------------------------------------------


def _space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, code): each row with its kind of damage done; 0 is a row that
    goes, 3 one that comes twice."""
    code = F.crc32(F.concat(_space(F.col("conv_id")), F.lit(":"), _space(F.col("turn"))).cast("binary")) % 20
    own = rows.select("conv_id", "turn", _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.withColumns({"role": F.when(F.col("code") == 4, "user").otherwise(F.col("role")), "text": text})


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, again): rows that don't repeat one of an earlier turn
    have ``again`` false; of those of one turn, readers tell by their neighbours."""
    own = rows.withColumn("digest", F.sha2("text", 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    first = own.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(turn).alias("first"))
    same = own["conv_id"].eqNullSafe(first["_conv"]) & (own["role"] == first["_role"]) & (own["digest"] == first["_digest"])
    return own.join(first, same).withColumn("again", turn > F.col("first")).drop("_conv", "_role", "_digest", "first")


class _Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv, part: int, seq: int):
        self.conv, self.part, self.seq = conv, part, seq
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.rows: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.size, self.last = 0, None

    def add(self, row: dict, again: bool) -> None:
        text = row["text"].rstrip(_BLANK)
        fault = "blank" if not text else "duplicate" if again else "truncated" if text[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        self.rows.append((row["role"][:1] or "-") + ("+" if fault is None else "~" if fault == "truncated" else "-"))
        self.roles.append(row["role"])
        self.texts.append(row["text"])
        self.size += len(row["text"])

    @property
    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def illegal(self) -> int:
        return sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(self.rows, self.rows[1:]))

    def base(self, whole: bool) -> dict:
        return {"conv_id": self.conv, "part": self.part, "seq": self.seq, "whole": whole, **self.counts, "illegal": self.illegal()}

    def done(self) -> dict:
        cost, audit = _best("".join(self.rows)) if len(self.rows) < 16 else best(parse("".join(self.rows)))
        text = "\n".join(replay(self.roles, self.texts, audit))
        return self.base(True) | {"cost": cost, "audit": audit, "repaired_sha256": _sha(text)}

    def open(self) -> dict:
        moves = [{"entry": entry, "exit": end, "cost": cost, "audit": audit} for entry in range(len(_automaton()[1])) for end, (cost, audit) in parse("".join(self.rows), entry).items()]
        return self.base(False) | {"head": self.rows[0][0], "tail": self.rows[-1][0], "moves": moves, "roles": self.roles, "texts": self.texts}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_MOVES = "moves array<struct<entry int, exit int, cost long, audit string>>"
_COUNTS = "blank long, duplicate long, truncated long, illegal long"
SEGMENTS = f"conv_id {{id}}, part long, seq long, whole boolean, {_COUNTS}, cost long, audit string, repaired_sha256 string, head string, tail string, {_MOVES}, roles array<string>, texts array<string>"


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most or "texts" in row and row["texts"]:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def segments(rows: DataFrame) -> DataFrame:
    """Rows of ``faults`` as repaired conversations (whole) and as segments of others."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    ddl = SEGMENTS.format(id=rows.schema["conv_id"].dataType.simpleString())
    schema = _arrow(rows, ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own: _Segment | None = None
        before: tuple | None = None
        edge = True  # whether the conversation may have begun in the partition before
        for batch in batches:
            for row in batch.to_pylist():
                if own is not None and (own.conv != row["conv_id"] or own.full):
                    on = own.conv == row["conv_id"]
                    yield own.open() if edge or on else own.done()
                    edge = on
                    own = _Segment(row["conv_id"], row["part"], own.seq + 1)
                if own is None:
                    own = _Segment(row["conv_id"], row["part"], 0)
                key = (row["conv_id"], row["turn"], row["role"], row["digest"])
                own.add(row, row["again"] or key == before)
                before = key
        if own is not None:
            yield own.open()

    return ranged.mapInArrow(lambda batches: _batches(read(batches), schema), ddl)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool]]:
    """Rows of sorted batches, and whether each is its conversation's last."""
    held = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held is not None:
                yield held, held["conv_id"] != row["conv_id"]
            held = row
    if held is not None:
        yield held, True


def _by_conversation(df: DataFrame) -> DataFrame:
    order = [F.col("conv_id"), F.col("part"), F.col("seq")]
    return df.repartition("conv_id").sortWithinPartitions(*order)


def combined(open_segments: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations in segments."""
    kind = open_segments.schema["conv_id"].dataType.simpleString()
    plan = f"conv_id {kind}, part long, seq long, entry int, edits string, cost long, {_COUNTS}"
    plan_schema = _arrow(open_segments, plan)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals: dict[int, Move] = {0: (0, "")}
        path: list[tuple[dict, dict]] = []
        tail = None
        for row, last in _grouped(batches):
            step: dict[int, tuple[Move, int, str]] = {}
            for m in row["moves"]:
                if m["entry"] in totals:
                    cost, audit = totals[m["entry"]]
                    move = (cost + m["cost"], audit + m["audit"])
                    if m["exit"] not in step or move < step[m["exit"]][0]:
                        step[m["exit"]] = (move, m["entry"], m["audit"])
            extra = tail is not None and tail + row["head"] not in ("su", "ua", "au")
            tail = row["tail"]
            counts = {name: row[name] for name in ("blank", "duplicate", "truncated", "illegal")}
            counts["illegal"] += extra
            path.append(({"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], **counts}, {end: (entry, edits) for end, (_, entry, edits) in step.items()}))
            totals = {end: move for end, (move, _, _) in step.items()}
            if last:
                least = best(totals)
                at = next(end for end, move in totals.items() if move == least and _automaton()[0].accepts(_automaton()[1][end]))
                out = []
                for base, step_of in reversed(path):
                    entry, edits = step_of[at]
                    out.append(base | {"entry": entry, "edits": edits, "cost": 0})
                    at = entry
                out[-1]["cost"] = least[0]
                yield from reversed(out)
                totals, path, tail = {0: (0, "")}, [], None

    small = open_segments.select("conv_id", "part", "seq", "blank", "duplicate", "truncated", "illegal", "head", "tail", "moves")
    plans = frames.stored(_by_conversation(small).mapInArrow(lambda batches: _batches(fold(batches), plan_schema), plan))
    texts = open_segments.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "roles", "texts")
    both = plans.join(texts, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).drop("_part", "_seq")
    ddl = f"conv_id {kind}, {_COUNTS}, cost long, audit string, repaired_sha256 string"
    schema = _arrow(open_segments, ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sha, audit, sums, any_row = hashlib.sha256(), [], {}, False
        for row, last in _grouped(batches):
            rows = replay(row["roles"], row["texts"], row["edits"], row["entry"])
            if rows:
                sha.update((("\n" if any_row else "") + "\n".join(rows)).encode("utf-8", "surrogatepass"))
                any_row = True
            audit.append(row["edits"])
            for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
                sums[name] = sums.get(name, 0) + row[name]
            if last:
                yield {"conv_id": row["conv_id"], **sums, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                sha, audit, sums, any_row = hashlib.sha256(), [], {}, False

    return _by_conversation(both).mapInArrow(lambda batches: _batches(digest(batches), schema), ddl)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn,
    role, text)."""
    frames.small_batches(rows.sparkSession)
    read = frames.stored(segments(faults(rows)))
    columns = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return read.filter("whole").select(*columns).unionByName(combined(read.filter("not whole")))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation after damage."""
    hurt = damaged(rows)
    left = hurt.filter("code <> 0")
    twice = left.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    fixed = repair(twice.select("conv_id", "turn", "role", "text")).withColumnRenamed("conv_id", "_conv")
    turn = F.when(F.col("code") != 0, F.col("turn"))
    every = hurt.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    both = every.join(fixed, every["conv_id"].eqNullSafe(fixed["_conv"]), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_sha(""))).alias("repaired_sha256"))
