"""Cheapest repair of conversations whose turns are damaged, by run-length dynamic programming.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles: perhaps a
system turn, then user and assistant in turn, or nothing at all. Rows may be kept (cost
0), given the role user or assistant (2), or deleted (3); user or assistant turns
without text may be inserted anywhere (2). Blank rows and repetitions of an earlier row
must go; a truncated row that stays costs 1 more. Of all cheapest repairs the one whose
edits (D, I, K, R in order) are the least string is taken.

A row is a symbol: the initial of its role and its fault. Each symbol is a transition
between four states (nothing yet, after s, after u, after a), a min-plus matrix. Equal
symbols in a row are one run; a run of n rows is the n-th power of its matrix, put
together from cached binary powers. Going back over the runs gives what is still to pay
after each; going forward the choices are unrolled into the audit, each looked up by
symbol and by the differences of what is still to pay.

Rows are sorted over all tasks by conversation and turn, so a conversation with a third
of all rows is shared by many tasks. Tasks cut it into blocks of bounded size. A block's
matrix, and the state after it for each state before it, are a few numbers; two scans
over these tell where each block stands, and then all blocks are repaired by themselves.
A conversation that lies within one block, as nearly all do, needs no scan.

Cases: nulls in ``role`` and ``text`` count as one space; rows of one turn are taken by
role, then text, rows without ``turn`` first; rows without ``conv_id`` are one
conversation; repeated rows are repetitions; an empty table gives no row; a text of any
length is treated whole; other columns are not read.
"""

from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.shared import ready, rows_of, saved, small

BLOCK_ROWS = 4096
BLOCK_CHARS = 1 << 22        # a block is closed by the row that reaches this
_PREFIX = 32                 # characters of a text by which rows of one turn and role are dealt
_SPACE = " \t\n\v\f\r"

FORCED = 8                   # the symbol of a row that must go; others are 2 * initial + truncated
_INITIALS = {"s": 0, "u": 1, "a": 2}
_NEVER = 1 << 40
_KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})         # state after a kept s, u, a, other
_TURN = (2, 2, 3, 2)                                     # state after the turn that an edit puts in
_SAYS = ("user", "user", "assistant", "user")
_START, _OPEN = 0, (1, 2)                                # states in which a conversation must not end


def _times(left, right):
    return tuple(tuple(min(left[i][m] + right[m][j] for m in range(4)) for j in range(4)) for i in range(4))


def _applied(matrix, after):
    return tuple(min(matrix[i][j] + after[j] for j in range(4)) for i in range(4))


def _inserts():
    """The cost of getting from state to state by inserted turns alone."""
    matrix = [[_NEVER] * 4 for _ in range(4)]
    for i in range(4):
        state, cost = i, 0
        while matrix[i][state] == _NEVER:
            matrix[i][state] = cost
            state, cost = _TURN[state], cost + 2
    return tuple(map(tuple, matrix))


_INSERTS = _inserts()
UNIT = tuple(tuple(0 if i == j else _NEVER for j in range(4)) for i in range(4))
# what is still to pay behind the last row, from each state
END = _applied(_INSERTS, tuple(_NEVER if s in _OPEN else 0 for s in range(4)))


def _steps(symbol, state):
    """(letter, cost, next state) of what can be done with a row, insertion apart."""
    yield "D", 3, state
    if symbol != FORCED:
        initial, truncated = divmod(symbol, 2)
        if state in _KEEP[initial]:
            yield "K", truncated, _KEEP[initial][state]
        yield "R", 2 + truncated, _TURN[state]


@lru_cache(None)
def power(symbol: int, k: int):
    """The matrix of 2**k rows with one symbol, turns inserted before them included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    own = [[_NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in _steps(symbol, state):
            own[state][to] = min(own[state][to], cost)
    return _times(_INSERTS, own)


def _powers(symbol, n):
    return (power(symbol, k) for k in range(n.bit_length()) if n >> k & 1)


def run_lengths(symbols) -> list:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def matrix_of(symbols):
    """The transition of all rows of a block."""
    matrix = UNIT
    for symbol, n in run_lengths(symbols):
        for factor in _powers(symbol, n):
            matrix = _times(matrix, factor)
    return matrix


def _relative(after):
    low = min(after)
    return tuple(a - low for a in after)


@lru_cache(1 << 16)
def _choice(symbol, after, state):
    """The least of the cheapest edits up to a row, and the state behind it."""
    here, letters = _applied(power(symbol, 0), after), ""
    while True:
        for letter, cost, to in sorted([*_steps(symbol, state), ("I", 2, _TURN[state])]):
            if letter == "I" and cost + here[to] == here[state]:
                letters, state = letters + "I", to
                break
            if letter != "I" and cost + after[to] == here[state]:
                return letters + letter, to


@lru_cache(1 << 16)
def _before(symbol, after):
    return _relative(_applied(power(symbol, 0), after))


def unroll(symbols, state=_START, after=END):
    """The edits up to each row of a block, and the state behind the last."""
    runs, behind = run_lengths(symbols), [after]
    for symbol, n in reversed(runs):
        after = behind[-1]
        for factor in _powers(symbol, n):
            after = _applied(factor, after)
        behind.append(after)
    letters = []
    for (symbol, n), after in zip(runs, behind[-2::-1]):
        each = [_relative(after)]
        for _ in range(n - 1):
            each.append(_before(symbol, each[-1]))
        for after in reversed(each):
            own, state = _choice(symbol, after, state)
            letters.append(own)
    return letters, state


def closing(state) -> str:
    """The turns inserted behind the last row."""
    n = 0
    while state in _OPEN:
        state, n = _TURN[state], n + 1
    return "I" * n


def faults(roles, texts, repeated=None):
    """Each row's first fault (blank, duplicate, truncated or none: b, d, t, -) and symbol.

    ``repeated``: the places of repetitions, where the rows alone cannot tell.
    """
    seen, names, symbols = set(), [], []
    for i, (role, text) in enumerate(zip(roles, texts)):
        body = text.rstrip(_SPACE)
        if not body:
            fault = "b"
        elif i in repeated if repeated is not None else (role, text) in seen:
            fault = "d"
        else:
            fault = "-" if body[-1] in ".!?" else "t"
        if repeated is None:
            seen.add((role, text))
        names.append(fault)
        symbols.append(FORCED if fault in "bd" else 2 * _INITIALS.get(role[:1], 3) + (fault == "t"))
    return names, symbols


def illegal_pairs(roles) -> int:
    initials = [r[:1] for r in roles]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_BLOCK = pa.schema([("nameless", pa.bool_()), ("name", pa.int64()), ("block", pa.int64()), ("alone", pa.bool_()),
                    ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_NAME = ["nameless", "name"]
_KEYS = [*_NAME, "block"]
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_REPAIRED = pa.schema([*[_BLOCK.field(n) for n in _KEYS], ("rows", pa.int64()), ("low_turn", pa.int64()),
                       ("high_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                       ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                       ("messages", _MESSAGES)])
_SQL = {pa.bool_(): "boolean", pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>",
        pa.list_(pa.string()): "array<string>", _MESSAGES: "array<struct<role string, text string>>"}


def _ddl(schema):
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def blocks(turns: DataFrame, block_rows=BLOCK_ROWS, block_chars=BLOCK_CHARS) -> DataFrame:
    """Rows in order, in blocks that hold one conversation or a part of one.

    ``alone`` blocks surely hold a whole one: it neither begins nor ends its task's
    rows, where neighbours may hold more of it.
    """
    plain = turns.select(
        F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("name"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        name, rows, chars, whole, first = None, [], 0, False, True
        out = {f.name: [] for f in _BLOCK}

        def close(alone):
            nonlocal number, rows, chars
            for column, value in zip(out, (*name, number, alone, *map(list, zip(*rows)))):
                out[column].append(value)
            number, rows, chars = number + 1, [], 0

        for batch in small(batches):
            for *own, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    if name is not None:
                        close(whole)
                        first = False
                    name, whole = own, not first
                elif len(rows) >= block_rows or chars >= block_chars:
                    close(False)
                    whole = False
                rows.append((turn, role, text))
                chars += len(text)
                if len(out["name"]) >= 256:
                    yield rows_of(out, _BLOCK)
                    out = {f.name: [] for f in _BLOCK}
        if rows:
            close(False)
        yield rows_of(out, _BLOCK)

    order = [*_NAME, "turn", "role"]
    return (plain.repartitionByRange(*order, F.substring("text", 1, _PREFIX)).sortWithinPartitions(*order, "text")
            .mapInArrow(run, _ddl(_BLOCK)))


def _repaired(row, state, after, last, repeated=None, joint=(0, 0)):
    """The values of ``_REPAIRED`` for a block; ``joint``: whether its first pair with the
    block before is illegal, and whether they share a turn."""
    turns, roles, texts = row["turns"], row["roles"], row["texts"]
    names, symbols = faults(roles, texts, repeated)
    letters, end = unroll(symbols, state, after)
    cost, messages = 0, []
    for role, text, name, own in zip(roles, texts, names, letters):
        for letter in own:
            if letter == "I":
                messages.append({"role": _SAYS[state], "text": ""})
                cost, state = cost + 2, _TURN[state]
            elif letter == "D":
                cost += 3
            else:
                cost += (name == "t") + 2 * (letter == "R")
                messages.append({"role": _SAYS[state] if letter == "R" else role, "text": text})
                state = _TURN[state] if letter == "R" else _KEEP[_INITIALS[role[:1]]][state]
    tail = closing(end) if last else ""
    for _ in tail:
        messages.append({"role": _SAYS[state], "text": ""})
        cost, state = cost + 2, _TURN[state]
    known = [t for t in turns if t is not None]
    return (row["nameless"], row["name"], row["block"], len(roles), min(known, default=None), max(known, default=None),
            len(set(known)) - joint[1], names.count("b"), names.count("d"), names.count("t"),
            illegal_pairs(roles) + joint[0], cost, "".join(letters) + tail, messages)


def _each(batches, treat):
    for batch in batches:
        for at in range(batch.num_rows):           # a block is large: one at a time
            out = {f.name: [] for f in _REPAIRED}
            for column, value in zip(out, treat(batch.slice(at, 1).to_pylist()[0])):
                out[column].append(value)
            yield rows_of(out, _REPAIRED)


def repair(turns: DataFrame, block_rows=BLOCK_ROWS, block_chars=BLOCK_CHARS) -> DataFrame:
    """A row for each block of each conversation that has rows: ``conv_id, block, alone``
    (this block is all), ``rows, low_turn, high_turn, turns`` (different ones that no block
    before has), the numbers ``blank, duplicate, truncated, illegal``, ``cost``, ``audit``,
    and ``messages``, the repaired turns. By ``block``, parts follow each other.
    """
    ready(turns.sparkSession)
    cut = saved(blocks(turns, block_rows, block_chars), "turn_blocks")

    def alone(batches):
        yield from _each(batches, lambda row: _repaired(row, _START, END, True))

    whole = cut.where("alone").mapInArrow(alone, _ddl(_REPAIRED)).withColumn("alone", F.lit(True))
    parts = _shared(cut.where(~F.col("alone"))).withColumn("alone", F.lit(False))
    found = whole.unionByName(parts)
    return found.select(F.when(~F.col("nameless"), F.col("name")).alias("conv_id"), "block", "alone",
                        *[f.name for f in _REPAIRED if f.name not in _KEYS])


def _shared(cut: DataFrame) -> DataFrame:
    """The repaired blocks of conversations that may go over several."""
    each = cut.select(*_KEYS, F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    words = each.select(*_KEYS, "place", F.xxhash64(F.lit(1), "row.roles", "row.texts").alias("one"),
                        F.xxhash64(F.lit(2), "row.roles", "row.texts").alias("two"))
    at = F.struct("block", "place")
    same = [*_NAME, "one", "two"]
    often = words.groupBy(*same).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = words.join(often, same).where(at > F.col("first")).groupBy(*_KEYS).agg(F.collect_list("place").alias("repeated"))
    wide = saved(cut.join(repeated, _KEYS, "left").withColumn(
        "repeated", F.coalesce("repeated", F.array().cast("array<int>"))).drop("alone"), "shared_blocks")

    def matrices(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                _, symbols = faults(row["roles"], row["texts"], set(row["repeated"]))
                known = [t for t in row["turns"] if t is not None]
                yield _as_batch([*(row[k] for k in _KEYS), [c for line in matrix_of(symbols) for c in line], row["roles"][0][:1],
                                 row["roles"][-1][:1], known[0] if known else None, known[-1] if known else None], _LINK)

    links = saved(wide.mapInArrow(matrices, _ddl(_LINK)), "block_matrices")
    to_pay = saved(_ordered(links, True).mapInArrow(_still_to_pay, _ddl(_PAY)), "blocks_to_pay")

    def ends(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                _, symbols = faults(row["roles"], row["texts"], set(row["repeated"]))
                yield _as_batch([*(row[k] for k in _KEYS), [unroll(symbols, s, row["after"])[1] for s in range(4)]], _ENDS)

    behind = wide.join(to_pay, _KEYS).mapInArrow(ends, _ddl(_ENDS))
    states = _ordered(links.join(behind, _KEYS).join(to_pay.select(*_KEYS, "after", "last"), _KEYS), False).mapInArrow(
        _where_it_stands, _ddl(_STATE))

    def finish(batches):
        yield from _each(batches, lambda row: _repaired(row, row["state"], tuple(row["after"]), row["last"],
                                                        set(row["repeated"]), (row["illegal_joint"], row["turn_joint"])))

    return wide.join(saved(states, "block_states"), _KEYS).mapInArrow(finish, _ddl(_REPAIRED))


_LINK = pa.schema([*[_BLOCK.field(n) for n in _KEYS], ("matrix", pa.list_(pa.int64())), ("first", pa.string()),
                   ("final", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
_PAY = pa.schema([*[_BLOCK.field(n) for n in _KEYS], ("after", pa.list_(pa.int64())), ("last", pa.bool_())])
_ENDS = pa.schema([*[_BLOCK.field(n) for n in _KEYS], ("ends", pa.list_(pa.int64()))])
_STATE = pa.schema([*[_BLOCK.field(n) for n in _KEYS], ("state", pa.int64()), ("after", pa.list_(pa.int64())),
                    ("last", pa.bool_()), ("illegal_joint", pa.int64()), ("turn_joint", pa.int64())])


def _as_batch(values, schema):
    return rows_of({f.name: [v] for f, v in zip(schema, values)}, schema)


def _ordered(links, backward):
    """A few numbers a block: each conversation's in one task, in order, never held together."""
    block = F.col("block").desc() if backward else F.col("block").asc()
    return links.repartition(*_NAME).sortWithinPartitions(*_NAME, block)


def _still_to_pay(batches):
    name, after = None, None
    for batch in batches:
        out = {f.name: [] for f in _PAY}
        for row in batch.to_pylist():
            own = (row["nameless"], row["name"])
            last = own != name
            if last:
                name, after = own, END
            for column, value in zip(out, (*(row[k] for k in _KEYS), list(_relative(after)), last)):
                out[column].append(value)
            matrix = [row["matrix"][4 * i:4 * i + 4] for i in range(4)]
            after = _relative(_applied(matrix, after))
        yield rows_of(out, _PAY)


def _where_it_stands(batches):
    name, state, final, high = None, _START, None, None
    for batch in batches:
        out = {f.name: [] for f in _STATE}
        for row in batch.to_pylist():
            own = (row["nameless"], row["name"])
            if own != name:
                name, state, final, high = own, _START, None, None
            illegal = final is not None and final + row["first"] not in ("su", "ua", "au")
            turn = high is not None and row["low"] == high
            for column, value in zip(out, (*(row[k] for k in _KEYS), state, row["after"], row["last"], int(illegal), int(turn))):
                out[column].append(value)
            state, final = row["ends"][state], row["final"]
            high = row["high"] if row["high"] is not None else high
        yield rows_of(out, _STATE)
