"""Least edits that give a conversation a legal structure, by Hirschberg's divide and conquer.

After its edits a conversation is empty or an optional system turn, then user and assistant in
turn, ending with the assistant: four states. Each row is one step between states with a least cost
and, among edits of that cost, the ASCII-least letters. Halving a stretch of rows, costs forward
from its entry and backward from its exit meet in the middle; of the optimal states there the one
whose letters so far come first is kept, and both halves are treated alike. Forward vectors carry
the order of their four letter strings instead of the strings: of two ways to the same row neither
continues the other, so their order stays whatever follows.

A conversation is a sequence of blocks of bounded size, cut anywhere in the sorted rows. Composed
steps are steps again, so a long conversation's blocks are composed in a tree, the same halving
chooses the states between them from the top down, and each block is then repaired by itself. What
one task takes in order for a whole conversation is its repaired text, as a digest has no parts;
it streams.

Order and ties: rows stand by turn, nulls first, then role and text. Cases: a null role, text, turn
or id counts as one space in texts and hashes, and a null id is a conversation of its own; repeated
rows are one row and its repetitions, which are duplicates; an empty role is no initial and is
never kept as it stands; texts of any length are read whole; columns other than the four and
``times`` are not carried, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import give_back, pieces, saved, small_batches

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE = 8
#: Rows and characters of a block, and blocks that are composed at once.
ROWS, CHARS, FAN = 1_000, 1 << 20, 64

# Steps -------------------------------------------------------------------------------------------
#: States: nothing yet, after the system turn, after a user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Cost and letters of the insertions that end a conversation in each state.
ENDINGS = ((0, ""), (4, "II"), (2, "I"), (0, ""))
INITIALS = "sua"


def _said(state: int) -> int:
    """The role that may be said by insertion or change of role in a state."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, role: int) -> int | None:
    """The state after a row of this role (a place in INITIALS, or 3) is kept."""
    if role == 0:
        return SYSTEM if state == START else None
    if role < 3 and _said(state) == (USER if role == 1 else ASSISTANT):
        return _said(state)
    return None


def _step(code: int) -> list[list[tuple[int, int, str]]]:
    """For each state the ways on over one row: (state, cost, letters), the best for each state reached.

    Insertions stand before the row; before a deletion they are never least, as D comes before I.
    """
    if code == DELETE:
        return [[(s, 3, "D")] for s in STATES]
    role, cut = divmod(code, 2)
    out = []
    for s in STATES:
        ways: dict[int, tuple[int, str]] = {s: (3, "D")}
        at = s
        for k in range(3):
            new = [(_said(at), (2 * k + 2 + cut, "I" * k + "R"))]
            if (to := _kept(at, role)) is not None:
                new.append((to, (2 * k + cut, "I" * k + "K")))
            for to, way in new:
                ways[to] = min(ways.get(to, way), way)
            at = _said(at)
        out.append([(t, *w) for t, w in ways.items()])
    return out


STEPS = [_step(c) for c in range(DELETE + 1)]


def step(code: int, times: int):
    return STEPS[code] if times == 1 else [[(s, 3 * times, "D")] for s in STATES]


def forward(steps, vector):
    """(cost, order) of the four states after ``steps``; None where a state cannot be reached."""
    for ways in steps:
        best = {}
        for s, got in enumerate(vector):
            if got is not None:
                for t, cost, key in ways[s]:
                    new = (got[0] + cost, got[1], key)
                    if t not in best or new < best[t]:
                        best[t] = new
        order = sorted(best, key=lambda t: best[t][1:])
        vector = [None] * 4
        for place, t in enumerate(order):
            vector[t] = (best[t][0], place)
    return vector


def backward(steps, costs):
    """Cost of each state before ``steps`` from the costs after them."""
    for ways in reversed(steps):
        costs = [min((c + costs[t] for t, c, _ in w if costs[t] is not None), default=None) for w in ways]
    return costs


def entered(state: int):
    return [(0, 0) if s == state else None for s in STATES]


def crossings(steps, enter: int, leave: int) -> list[int]:
    """The states between the steps, both ends included, on the least way from ``enter`` to ``leave``."""
    out = [enter]
    stack = [(0, len(steps), enter, leave)]
    while stack:
        lo, hi, a, b = stack.pop()
        if hi - lo == 1:
            out.append(b)
            continue
        mid = (lo + hi) // 2
        left = forward(steps[lo:mid], entered(a))
        right = backward(steps[mid:hi], [0 if s == b else None for s in STATES])
        at = min((x[0] + y, x[1], s) for s, (x, y) in enumerate(zip(left, right, strict=True)) if x is not None and y is not None)[2]
        stack += [(mid, hi, at, b), (lo, mid, a, at)]
    return out


def best_end(vector) -> int:
    """The state in which a conversation ends that leaves its last row with these costs."""
    return min((v[0] + ENDINGS[s][0], v[1], s) for s, v in enumerate(vector) if v is not None)[2]


def whole(steps):
    """A sequence of steps as one: for each state (state, cost, order)."""
    return [[(t, *v) for t, v in enumerate(forward(steps, entered(s))) if v is not None] for s in STATES]


def edits(codes, times, enter: int, leave: int) -> str:
    """The letters of a block between two states, endings not included."""
    if not codes:
        return ""
    steps = [step(c, n) for c, n in zip(codes, times, strict=True)]
    at = crossings(steps, enter, leave)
    letters = [next(k for t, _, k in ways[a] if t == b) for ways, a, b in zip(steps, at, at[1:], strict=False)]
    return "".join(k * n if n > 1 else k for k, n in zip(letters, times, strict=True))


def applied(audit: str, enter: int, codes, times, roles, texts) -> tuple[int, list[str]]:
    """Cost of the edits and the lines ``role:text`` that they leave."""
    cost, lines, state, i, used = 0, [], enter, 0, 0
    for letter in audit:
        if letter == "I":
            state = _said(state)
            lines.append("user:" if state == USER else "assistant:")
            cost += 2
            continue
        code = codes[i]
        if letter == "D":
            cost += 3
        else:
            cost += code % 2
            if letter == "K":
                state = _kept(state, code // 2)
                lines.append(f"{roles[i]}:{texts[i]}")
            else:
                cost += 2
                state = _said(state)
                lines.append(f"{'user' if state == USER else 'assistant'}:{texts[i]}")
        used += 1
        if used == times[i]:
            i, used = i + 1, 0
    return cost, lines


# Tables ------------------------------------------------------------------------------------------


def damage(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Known faults for trials, dealt by crc32 of ``id:turn``: rows with ``times`` they stand there, 0 for dropped ones."""
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(col(id_col), F.lit(":"), col("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(col("text"), ENDS, "")).otherwise(col("text"))
    return turns.select(
        F.col(f"`{id_col}`"), "turn", F.when(kind == 4, "user").otherwise(col("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _adjacent(a: str, b: str) -> int:
    return int(a + b not in ("su", "ua", "au"))


def _blocks(rows: DataFrame, kind: str, most: int, most_chars: int) -> DataFrame:
    """Sorted rows packed into blocks: (conv, part, seq, codes, times, roles, texts, first, last, illegal)."""
    schema = f"conv {kind}, part int, seq long, codes array<int>, times array<long>, roles array<string>, texts array<string>, first string, last string, illegal long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        types = None
        done, chars = [], 0
        block, conv, seq, held = None, None, 0, 0

        def closed(b):
            said = [r[:1] for r in b["roles"]]
            bad = sum(map(_adjacent, said, said[1:])) + sum((n - 1) * _adjacent(r, r) for r, n in zip(said, b["times"], strict=True))
            return b | {"first": said[0] if said else None, "last": said[-1] if said else None, "illegal": bad}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([b[n] for b in done], types[n]) for n in names], names=names)

        for batch in batches:
            if types is None:
                types = {"conv": batch.schema.field("conv").type, "part": pa.int32(), "seq": pa.int64(), "codes": pa.list_(pa.int32()), "times": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
                types |= {"first": pa.string(), "last": pa.string(), "illegal": pa.int64()}
            for small in pieces([batch], 500):
                for r in small.to_pylist():
                    if block is None or r["conv"] != conv or len(block["codes"]) >= most or held >= most_chars:
                        if block is not None:
                            done.append(closed(block))
                            chars += held
                        seq = seq + 1 if block is not None and r["conv"] == conv else 0
                        conv, held = r["conv"], 0
                        block = {"conv": conv, "part": r["part"], "seq": seq, "codes": [], "times": [], "roles": [], "texts": []}
                        if chars >= CHARS or len(done) >= ROWS:
                            yield flush()
                            done, chars = [], 0
                    if r["n"]:
                        rest = r["n"]
                        if r["code"] != DELETE:
                            block["codes"].append(r["code"]), block["times"].append(1), block["roles"].append(r["role"]), block["texts"].append(r["text"])
                            rest -= 1
                        if rest:
                            block["codes"].append(DELETE), block["times"].append(rest), block["roles"].append(r["role"]), block["texts"].append("")
                        held += len(r["text"]) + len(r["role"])
        if block is not None:
            done.append(closed(block))
            yield flush()
        give_back()

    return small_batches(rows).mapInArrow(run, schema)


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make(row)`` gives for each row, in small batches."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in pieces(batches, 100):
            rows = [make(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([pa.field(n, _arrow(t, b)) for n, t in (x.split() for x in schema.split(", "))]))
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def _arrow(kind: str, batch) -> pa.DataType:
    fixed = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return fixed[kind] if kind in fixed else batch.schema.field("conv").type


def _packed(ways) -> list[int]:
    """A step as 32 numbers: of each pair of states cost and order, -1 where there is no way."""
    out = [-1] * 32
    for s in STATES:
        for t, cost, order in ways[s]:
            out[8 * s + 2 * t : 8 * s + 2 * t + 2] = [cost, order]
    return out


def _unpacked(x) -> list:
    return [[(t, x[8 * s + 2 * t], x[8 * s + 2 * t + 1]) for t in STATES if x[8 * s + 2 * t] >= 0] for s in STATES]


def _states_between(blocks: DataFrame, kind: str, fan: int) -> DataFrame:
    """Entry and exit state of every block of conversations that have several: (conv, part, seq, pos, enter, leave)."""
    summed = _mapped(blocks.select("conv", "part", "seq", "codes", "times"), lambda r: (r["conv"], r["part"], r["seq"], _packed(whole([step(c, n) for c, n in zip(r["codes"], r["times"], strict=True)]))), f"conv {kind}, part int, seq long, way array<long>")
    pos = (F.row_number().over(W.partitionBy("conv").orderBy("part", "seq")) - 1).cast("long")
    levels = [saved(summed.select("*", pos.alias("pos")), "repair-ways")]
    most = levels[0].agg(F.max("pos")).first()[0]

    def up(key, frame):
        frame = frame.sort_values("pos")
        way = _packed(whole([_unpacked(x) for x in frame["way"]]))
        return frame.iloc[:1].assign(pos=frame["pos"].iloc[0] // fan, way=[way])

    def down(key, frame):
        frame = frame.sort_values("pos")
        at = crossings([_unpacked(x) for x in frame["way"]], int(frame["enter"].iloc[0]), int(frame["leave"].iloc[0]))
        return frame.assign(enter=at[:-1], leave=at[1:])[["conv", "pos", "enter", "leave"]]

    while most:
        levels.append(saved(levels[-1].select("conv", "pos", "way").groupBy("conv", F.floor(F.col("pos") / fan)).applyInPandas(up, f"conv {kind}, pos long, way array<long>"), "repair-ways"))
        most //= fan

    def top(r):
        steps = [_unpacked(r["way"])]
        return (r["conv"], r["pos"], START, best_end(forward(steps, entered(START))))

    ends = _mapped(levels.pop(), top, f"conv {kind}, pos long, enter int, leave int")
    while levels:
        level = levels.pop()
        above = ends.select(F.col("conv").alias("_c"), F.col("pos").alias("_p"), "enter", "leave")
        named = level.select("conv", "pos", "way").join(above, F.col("conv").eqNullSafe(F.col("_c")) & (F.floor(F.col("pos") / fan) == F.col("_p"))).drop("_c")
        ends = named.groupBy("conv", "_p").applyInPandas(down, f"conv {kind}, pos long, enter int, leave int")
        if not levels:
            at = level.select(F.col("conv").alias("_c"), "part", "seq", F.col("pos").alias("_p"))
            ends = ends.join(at, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p"))).drop("_c", "_p")
    return saved(ends, "repair-states")


def _solved(r) -> tuple:
    """One block: (conv, pos, cost, audit, text, first, last, illegal); a null text has no lines."""
    codes, times = r["codes"], r["times"]
    enter, last = r["enter"], r["last_block"]
    leave = r["leave"]
    if leave is None:
        leave = best_end(forward([step(c, n) for c, n in zip(codes, times, strict=True)], entered(enter)))
    audit = edits(codes, times, enter, leave) + (ENDINGS[leave][1] if last else "")
    cost, lines = applied(audit, enter, codes, times, r["roles"], r["texts"])
    return (r["conv"], r["pos"], cost, audit, "\n".join(lines) if lines else None, r["first"], r["last"], r["illegal"])


def _alone(r) -> tuple:
    conv, _, cost, audit, text, _, _, illegal = _solved(r)
    return (conv, illegal, cost, audit, hashlib.sha256((text or "").encode()).hexdigest())


def _joined(rows: DataFrame, kind: str) -> DataFrame:
    """Blocks' results in order of conversation and place, joined as they stream by."""
    schema = f"conv {kind}, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches):
        now, names, types = None, [x.split()[0] for x in schema.split(", ")], None

        def out():
            row = [now["conv"], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            types = [batch.schema.field("conv").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
            for small in pieces([batch], 16):
                for r in small.to_pylist():
                    if now is None or now["conv"] != r["conv"]:
                        if now is not None:
                            yield out()
                        now = {"conv": r["conv"], "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": False, "last": None}
                    now["cost"] += r["cost"]
                    now["illegal"] += r["illegal"]
                    now["audit"].append(r["audit"])
                    if r["rows"]:
                        if now["last"] is not None:
                            now["illegal"] += _adjacent(now["last"], r["first"])
                        now["last"] = r["last"]
                    if r["text"] is not None:
                        if now["lines"]:
                            now["sha"].update(b"\n")
                        now["sha"].update(r["text"].encode())
                        now["lines"] = True
        if now is not None:
            yield out()
        give_back()

    return small_batches(rows).mapInArrow(run, schema)


def repair(turns: DataFrame, id_col: str = "conv_id", block_rows: int = ROWS, block_chars: int = CHARS, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``turns`` (id, turn, role, text and, if there, ``times``).

    Columns: the id, ``gaps`` in its turn numbers, ``blank``, ``duplicate`` and ``truncated`` rows by
    first fault, ``illegal`` neighbours, ``cost`` and ``audit`` of the least edits, ``repaired_sha256``.
    The bounds of a block and how many are composed at once change nothing in the result.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    times = F.col("times") if "times" in turns.columns else F.lit(1)
    rows = turns.select(F.col(f"`{id_col}`").alias("conv"), "turn", col("role").alias("role"), col("text").alias("text"), times.cast("long").alias("n"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("text", 256)), "blank": trimmed == "", "cut": ~F.substring(trimmed, -1, 1).isin(*ENDS)})
    rows = saved(rows, "repair-rows")
    # a row is a duplicate unless its turn is the first at which its conversation says so
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = rows.where("n > 0").groupBy("conv", "role", "sha").agg(F.min(place).alias("at")).select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), F.col("at.turn").alias("_t"))
    same = F.col("conv").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("role") == F.col("_r")) & (F.col("sha") == F.col("_s"))
    rows = rows.join(firsts, same, "left").withColumn("new", F.col("_s").isNotNull()).drop("_c", "_r", "_s", "_t", "sha")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumn("code", F.when(F.col("blank") | ~F.col("new"), DELETE).otherwise(role * 2 + F.col("cut").cast("int")))
    ranges = rows.repartitionByRange(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    ranges = ranges.withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    blocks = saved(_blocks(ranges.select("conv", "part", "role", "text", "n", "code"), kind, block_rows, block_chars), "repair-blocks")
    stats = _counts(rows)
    several = saved(blocks.groupBy("conv").agg(F.count("*").alias("k"), F.max(F.struct("part", "seq")).alias("end")).where("k > 1"), "repair-long")
    long = F.col("conv").eqNullSafe(F.col("_c"))
    those = several.select(F.col("conv").alias("_c"), "end")
    none = F.lit(None)
    alone = blocks.join(those, long, "left_anti").select("*", F.lit(0).cast("long").alias("pos"), F.lit(START).alias("enter"), none.cast("int").alias("leave"), F.lit(True).alias("last_block"))
    done = _mapped(alone, _alone, f"conv {kind}, illegal long, cost long, audit string, repaired_sha256 string")
    if not several.isEmpty():
        states = _states_between(blocks.join(those, long, "left_semi"), kind, fan)
        states = states.select(F.col("conv").alias("_d"), F.col("part").alias("_p"), F.col("seq").alias("_q"), "pos", "enter", "leave")
        part = blocks.join(those, long).join(states, F.col("conv").eqNullSafe(F.col("_d")) & (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_q")))
        part = part.withColumn("last_block", F.struct("part", "seq") == F.col("end")).drop("_c", "_d", "_p", "_q", "end")
        solved = _mapped(part, lambda r: (*_solved(r), len(r["codes"])), f"conv {kind}, pos long, cost long, audit string, text string, first string, last string, illegal long, rows long")
        solved = saved(solved, "repair-parts").repartition("conv").sortWithinPartitions("conv", "pos")
        done = done.unionByName(_joined(solved, kind))
    out = stats.join(done.withColumnRenamed("conv", "_c"), long)
    return out.select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _counts(rows: DataFrame) -> DataFrame:
    """Faults and gaps of each conversation, added up before any shuffle."""
    n, there = F.col("n"), F.col("n") > 0
    fresh = there & ~F.col("blank") & F.col("new")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    turn = F.when(there, F.col("turn"))
    per = rows.groupBy("conv", turn.alias("turn")).agg(
        total(F.when(F.col("blank"), n)).alias("blank"), total(F.when(~F.col("blank"), n - fresh.cast("long"))).alias("duplicate"), total((fresh & F.col("cut")).cast("long")).alias("truncated")
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return per.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
