"""Structure repair of conversations by rank-convergence parallel Viterbi.

A conversation's rows become symbols (role class, truncated, must go).  The
cheapest edits that make the roles ``(s?(ua)+)?`` follow from backward costs over
four states: nothing yet (0), after system (1), after user (2), after assistant (3).

1. All rows are sorted once and cut into equal chunks, so a conversation of any
   size is many small tasks.
2. Every chunk computes its backward costs from a speculative cost vector at its
   right edge.
3. Fix-up passes: a chunk whose right neighbour ended on another vector starts
   again from that one, and stops as soon as its vectors differ from those it had
   by a constant only; the rest then stays.  Passes end when no chunk changes.
4. The stitched costs drive the trace from the left: of the cheapest edits the one
   with the least letter.  Entry states pass from chunk to chunk the same way.

Costs are kept as differences (four small numbers a row), so nothing grows with
the length of a conversation.

Defined cases: null roles and texts are one space; null turns come first and
null conv_ids are one conversation; rows of equal turn are taken by role, then
text (its first characters, then its hash); an empty table gives no rows.  Text
hashes stand for texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fleetdrift.llm.storage import stored
from fleetdrift.skew import with_places

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK_ROWS = 4096
_ORDER_CHARS = 64
_BLANKS = " \t\n\x0b\f\r"
_INITIALS = "sua"
#: State that an inserted (or rerolled) row leads to: user, but assistant after user.
_TURN = (2, 2, 3, 2)
#: States of the role classes (0 other, 1 system, 2 user, 3 assistant) in every state; -1 where they may not stand.
_KEPT = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))
_LEGAL = ("su", "ua", "au")
_NEVER = 1 << 20
_NAMES = {2: "user", 3: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that a hash of ``conv_id:turn`` deals them."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("start", F.substring("text", 1, _ORDER_CHARS)).withColumn("hash", F.unhex(F.sha2("text", 256)))


def _same(*names: str) -> Column:
    """Equality of the columns of ``x`` and ``y``, nulls included."""
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
    return condition


def symbols(rows: DataFrame) -> DataFrame:
    """One row per different row with its faults; ``times`` counts the equal ones."""
    text = F.rtrim(F.col("text"), F.lit(_BLANKS))
    slim = rows.select(
        "conv_id", "turn", "role", "start", "hash", (text == "").alias("blank"),
        (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("open"),
    ).groupBy("conv_id", "turn", "role", "start", "hash", "blank", "open").agg(F.count(F.lit(1)).alias("times"))
    slim = stored(slim)
    # The first of equal roles and texts is the one of the least turn, null before all.
    first = slim.where("NOT blank").groupBy("conv_id", "role", "hash").agg(
        F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("least"), F.count(F.lit(1)).alias("turns")
    ).where("turns > 1")
    seen = F.col("y.turns").isNotNull() & ~F.when(F.col("y.unnumbered"), F.col("x.turn").isNull()).otherwise(
        F.col("x.turn").eqNullSafe(F.col("y.least"))
    )
    return slim.alias("x").join(first.alias("y"), _same("conv_id", "role", "hash"), "left").select(
        "x.*", (F.coalesce(seen, F.lit(False)) & ~F.col("blank")).alias("seen")
    )


# --- costs ---


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs that allow inserted rows first."""
    return tuple(min(c, INSERT + costs[_TURN[p]], 2 * INSERT + costs[_TURN[_TURN[p]]]) for p, c in enumerate(costs))


END = _closed([0, _NEVER, _NEVER, 0])


def _edits(code: int, after: tuple[int, ...], state: int) -> list[tuple[str, int, int]]:
    """Letter, cost to the end and next state of what can be done with a row; codes are role class + 4 if truncated + 8 if it must go."""
    found = [("D", DELETE + after[state], state)]
    if code < 8:
        extra = TRUNCATED * (code >> 2 & 1)
        to = _KEPT[state][code & 3]
        if to >= 0:
            found.append(("K", KEEP + extra + after[to], to))
        found.append(("R", REROLE + extra + after[_TURN[state]], _TURN[state]))
    return found


_before: dict[tuple[int, int], int] = {}
_unpacked: dict[int, tuple[int, ...]] = {}
_steps: dict[tuple[int, int, int], tuple[int, str, int]] = {}


def _pack(costs: tuple[int, ...]) -> int:
    return costs[0] | costs[1] << 8 | costs[2] << 16 | costs[3] << 24


def _unpack(vector: int) -> tuple[int, ...]:
    if vector not in _unpacked:
        _unpacked[vector] = tuple(vector >> 8 * p & 255 for p in range(4))
    return _unpacked[vector]


def costs_before(code: int, vector: int) -> int:
    """The cost vector before a row from the one after it; the least entry of every vector is 0."""
    key = (code, vector)
    if key not in _before:
        after = _unpack(vector)
        own = _closed([min(c for _, c, _ in _edits(code, after, p)) for p in range(4)])
        _before[key] = _pack(tuple(c - min(own) for c in own))
    return _before[key]


def step(code: int, vector: int, state: int) -> tuple[int, str, int]:
    """Rows inserted before the row, its letter and the next state; ``vector`` holds the costs after the row."""
    key = (code, vector, state)
    if key not in _steps:
        after = _unpack(vector)
        own = _closed([min(c for _, c, _ in _edits(code, after, p)) for p in range(4)])
        inserted = 0
        while True:
            found = [(x, to) for x, c, to in _edits(code, after, state) if c == own[state]]
            if INSERT + own[_TURN[state]] == own[state]:
                found.append(("I", _TURN[state]))
            letter, to = min(found)
            if letter != "I":
                _steps[key] = (inserted, letter, to)
                break
            inserted, state = inserted + 1, to
    return _steps[key]


def backward(codes: bytes, right: int, known: np.ndarray | None = None) -> np.ndarray:
    """Vectors before each row, and after the last one.

    With those of an earlier pass, rows are computed from the right until a vector
    equals the known one: costs differ by a constant then, and the rest holds.
    """
    n = len(codes)
    vectors = np.empty(n + 1, np.int64) if known is None else known.copy()
    vectors[n] = vector = right
    for i in range(n - 1, -1, -1):
        vector = costs_before(codes[i], vector)
        if known is not None and vectors[i] == vector:
            break
        vectors[i] = vector
    return vectors


def trace(codes: bytes, vectors: np.ndarray, state: int) -> tuple[list[int], str, list[int], int]:
    """Inserted rows before each row, the rows' letters, the states before each row, and the last state."""
    inserted, letters, states = [], [], []
    for code, vector in zip(codes, vectors[1:].tolist(), strict=True):
        states.append(state)
        n, letter, state = step(code, vector, state)
        inserted.append(n)
        letters.append(letter)
    return inserted, "".join(letters), states, state


def _ending(state: int) -> int:
    """Rows inserted after the last one."""
    return {1: 2, 2: 1}.get(state, 0)


# --- chunks ---

_SEGMENT = (
    "conv_id {id}, chunk long, codes binary, times binary, vectors binary, left_costs long, right_costs long, "
    "cost long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
)


def _initial(role: str) -> str:
    return role[:1]


def _segment(rows: dict[str, list], a: int, b: int) -> list:
    """What a chunk knows of rows [a, b), all of one conversation."""
    codes, blank, duplicate, truncated, illegal, last = bytearray(), 0, 0, 0, 0, None
    times = rows["times"][a:b]
    for i in range(a, b):
        role, n = _initial(rows["role"][i]), rows["times"][i]
        if rows["blank"][i]:
            blank += n
        else:
            duplicate += n if rows["seen"][i] else n - 1
            truncated += bool(rows["open"][i] and not rows["seen"][i])
        must_go = rows["blank"][i] or rows["seen"][i]
        codes.append(8 if must_go else (_INITIALS.find(role) + 1 if role else 0) + 4 * rows["open"][i])
        illegal += (last is not None and last + role not in _LEGAL) + (n - 1)
        last = role
    codes = bytes(codes)
    vectors = backward(codes, _pack(END))
    # Copies after the first row always go.
    extra = DELETE * sum(n - 1 for n in times)
    return [
        rows["conv_id"][a], rows["chunk"][a], codes, np.array(times, np.int64).tobytes(), vectors.tobytes(),
        int(vectors[0]), int(vectors[-1]), extra, blank, duplicate, truncated, illegal, _initial(rows["role"][a]), last,
    ]


def _cuts(ids: list) -> list[int]:
    return [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)] if ids else [0]


def _table(rows: list[list], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _segments(placed: DataFrame, id_type: str) -> DataFrame:
    ddl = _SEGMENT.format(id=id_type)
    schema = _arrow(ddl)

    def cut(chunk: pa.Table) -> pa.Table:
        rows = chunk.sort_by("place").to_pydict()
        cuts = _cuts(rows["conv_id"])
        return _table([_segment(rows, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], schema)

    return placed.groupBy("chunk").applyInArrow(cut, ddl)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fix-up of segments from the vector ``needed`` at their right edge."""
    for batch in batches:
        new = []
        for codes, vectors, right in zip(*[batch.column(n).to_pylist() for n in ("codes", "vectors", "needed")], strict=True):
            costs = backward(codes, right, np.frombuffer(vectors, np.int64))
            new.append([costs.tobytes(), int(costs[0])])
        fresh = {
            "vectors": pa.array([x for x, _ in new], pa.binary()), "left_costs": pa.array([x for _, x in new], pa.int64()),
            "right_costs": batch.column("needed"),
        }
        names = [n for n in batch.schema.names if n != "needed"]
        yield pa.RecordBatch.from_arrays([fresh.get(n, batch.column(n)) for n in names], names)


def _converged(segments: DataFrame) -> DataFrame:
    """Segments of conversations over several chunks, with the costs that hold for the whole conversation.

    Every segment is the last of its conversation or starts from the vector its
    right neighbour ends on.  A pass touches only segments that must start again.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields)
    while True:
        right = segments.select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.col("left_costs").alias("needed"))
        joined = segments.alias("x").join(right.alias("y"), _same("conv_id", "chunk"), "left").select("x.*", "y.needed")
        stale = joined.where("needed <> right_costs")
        if stale.isEmpty():
            return segments
        fresh = joined.where("needed IS NULL OR needed = right_costs").drop("needed")
        segments = stored(fresh.unionByName(stale.mapInArrow(_again, ddl)))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last state for every entry state."""
    for batch in batches:
        exits = []
        for codes, vectors in zip(batch.column("codes").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
            costs = np.frombuffer(vectors, np.int64)
            exits.append([trace(codes, costs, p)[3] for p in range(4)])
        columns = [batch.column("conv_id"), batch.column("chunk"), pa.array(exits, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "exits"])


def _entries(segments: DataFrame, id_type: str) -> DataFrame:
    """conv_id, chunk and entry state of the segments of conversations over several chunks.

    Segments start from the state most exits lead to; passes hand on the exit of
    the left neighbour until no entry changes.
    """
    exits = stored(segments.select("conv_id", "chunk", "codes", "vectors").mapInArrow(_exits, f"conv_id {id_type}, chunk long, exits array<int>"))
    state = exits.withColumn("entry", F.lit(3))
    while True:
        left = state.select("conv_id", (F.col("chunk") + 1).alias("chunk"), F.get("exits", "entry").alias("given"))
        given = F.coalesce("y.given", F.lit(0))
        passed = state.alias("x").join(left.alias("y"), _same("conv_id", "chunk"), "left").select("x.*", given.alias("given"))
        passed = stored(passed)
        if passed.where("given <> entry").isEmpty():
            return state.drop("exits")
        state = passed.select("conv_id", "chunk", "exits", F.col("given").alias("entry"))


_SUMMED = ("cost", "blank", "duplicate", "truncated", "illegal")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each segment, those of copies and of rows inserted at the end included, and what they cost."""
    for batch in batches:
        names = ("codes", "times", "vectors", "entry", "last")
        audits, costs = [], []
        for codes, times, vectors, entry, last in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            inserted, letters, _, end = trace(codes, np.frombuffer(vectors, np.int64), entry)
            parts = [("I" * n) + x + "D" * (t - 1) for n, x, t in zip(inserted, letters, np.frombuffer(times, np.int64).tolist(), strict=True)]
            parts.append("I" * _ending(end) if last else "")
            kept = sum(1 for c, x in zip(codes, letters, strict=True) if x != "D" and c & 4)
            audits.append("".join(parts))
            costs.append(
                REROLE * letters.count("R") + DELETE * letters.count("D") + TRUNCATED * kept
                + INSERT * (sum(inserted) + len(parts[-1]))
            )
        keep = [n for n in batch.schema.names if n not in (*names, "cost")]
        total = pa.array([a + b for a, b in zip(batch.column("cost").to_pylist(), costs, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], total, pa.array(audits, pa.string())], [*keep, "cost", "audit"])


_EDIT = "conv_id {id}, place long, step int, edit string, role string, turn long, old_role string, hash binary, times long"


def _edit_rows(rows: dict[str, list], costs: dict) -> list[list]:
    cuts = _cuts(rows["conv_id"])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        codes, vectors, entry, last = costs[rows["conv_id"][a]]
        inserted, letters, states, end = trace(codes, vectors, entry)
        for i, n, letter, state in zip(range(a, b), inserted, letters, states, strict=True):
            base = [rows["conv_id"][i], rows["place"][i]]
            for k in range(n):
                state = _TURN[state]
                out.append([*base, k, "I", _NAMES[state], None, None, None, 1])
            role = {"K": rows["role"][i], "R": _NAMES[_TURN[state]], "D": None}[letter]
            out.append([*base, n, letter, role, rows["turn"][i], rows["role"][i], rows["hash"][i], 1])
            if rows["times"][i] > 1:
                out.append([*base, n + 1, "D", None, rows["turn"][i], rows["role"][i], rows["hash"][i], rows["times"][i] - 1])
        if last:
            for k in range(_ending(end)):
                end = _TURN[end]
                out.append([rows["conv_id"][b - 1], rows["place"][b - 1], 1 << 20 | k, "I", _NAMES[end], None, None, None, 1])
    return out


class Repair:
    """Edits, reports and repaired rows of conversations.

    ``rows`` has conv_id, turn, role and text.  ``reports`` holds gaps, the counts
    of faults, cost and audit per conversation; ``edits`` one row per edit, in the
    order of (place, step); ``repaired`` the rows that are left.
    """

    def __init__(self, rows: DataFrame, chunk_rows: int = CHUNK_ROWS):
        self._rows = _keyed(rows)
        self.id_type = self._rows.schema["conv_id"].dataType.simpleString()
        order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "start", "hash"]
        placed = with_places(symbols(self._rows).orderBy(*order))
        self.placed = placed.drop("start").withColumn("chunk", F.floor((F.col("place") - 1) / chunk_rows))
        segments = stored(_segments(self.placed, self.id_type))
        ends = segments.groupBy("conv_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("end"))
        placed_segments = segments.alias("x").join(ends.alias("y"), _same("conv_id")).select("x.*", "y.first", "y.end")
        several = stored(placed_segments.where("first < end").drop("first", "end"))
        whole = placed_segments.where("first = end").drop("first", "end").withColumn("entry", F.lit(0)).withColumn("last", F.lit(True))
        if several.isEmpty():
            self.segments = stored(whole)
            return
        several = _converged(several)
        entries = _entries(several, self.id_type)
        next_role = several.select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.col("first_role").alias("next_role"))
        joined = several.alias("x").join(entries.alias("y"), _same("conv_id", "chunk")).select("x.*", "y.entry")
        joined = joined.alias("x").join(next_role.alias("y"), _same("conv_id", "chunk"), "left").select("x.*", "y.next_role")
        broken = ~F.concat("last_role", "next_role").isin(*_LEGAL)
        joined = joined.withColumn("illegal", F.col("illegal") + F.coalesce(broken, F.lit(False)).cast("long"))
        joined = joined.withColumn("last", F.col("next_role").isNull()).drop("next_role")
        self.segments = stored(whole.unionByName(joined))

    def reports(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of conversations that have rows."""
        fields = "".join(f"{n} long, " for n in _SUMMED if n != "cost")
        needed = self.segments.select("conv_id", "chunk", "codes", "times", "vectors", "entry", "last", *_SUMMED)
        pieces = needed.mapInArrow(_audits, f"conv_id {self.id_type}, chunk long, {fields}cost long, audit string")
        summed = pieces.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in _SUMMED],
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        )
        span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
        gaps = self.placed.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(span.try_cast("long"), F.lit(0)).alias("gaps"))
        return summed.alias("x").join(gaps.alias("y"), _same("conv_id")).select(
            "x.conv_id", "y.gaps", "x.blank", "x.duplicate", "x.truncated", "x.illegal", "x.cost", "x.audit"
        )

    def edits(self) -> DataFrame:
        ddl = _EDIT.format(id=self.id_type)
        schema = _arrow(ddl)

        def edit(rows: pa.Table, segments: pa.Table) -> pa.Table:
            held = segments.to_pydict()
            costs = {
                c: (codes, np.frombuffer(v, np.int64), entry, last)
                for c, codes, v, entry, last in zip(*[held[n] for n in ("conv_id", "codes", "vectors", "entry", "last")], strict=True)
            }
            return _table(_edit_rows(rows.sort_by("place").to_pydict(), costs) if len(rows) else [], schema)

        rows = self.placed.select("chunk", "conv_id", "place", "turn", "role", "hash", "times")
        segments = self.segments.select(*[F.col(c).alias(c) for c in ("chunk", "conv_id", "codes", "vectors", "entry", "last")])
        return rows.groupBy("chunk").cogroup(segments.groupBy("chunk")).applyInArrow(edit, ddl)

    def repaired(self) -> DataFrame:
        """conv_id, place, step, edit, role and text of the rows that are left; texts of inserted rows are empty."""
        edits = stored(self.edits().where("edit <> 'D'"))
        kept, keys = edits.where("edit <> 'I'"), ["conv_id", "turn", "role", "hash"]
        # Copies meet on the map side; the join then moves nothing again.
        texts = self._rows.groupBy(*keys).agg(F.first("text").alias("text"))
        same = _same("conv_id", "turn", "hash") & (F.col("x.old_role") == F.col("y.role"))
        found = kept.alias("x").join(texts.alias("y"), same).select("x.conv_id", "x.place", "x.step", "x.edit", "x.role", "y.text")
        return found.unionByName(edits.where("edit = 'I'").select("conv_id", "place", "step", "edit", "role", F.lit("").alias("text")))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired ``role:text`` rows, joined by newlines.

    The hash of a text is sequential by definition: one task streams the sorted
    rows of a conversation and holds one batch of them.
    """
    id_type = repaired.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {id_type}, repaired_sha256 string"
    schema = _arrow(ddl)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or conv != own:
                    if state is not None:
                        done.append([own, state.hexdigest()])
                    state, own = hashlib.sha256(line.encode()), conv
                else:
                    state.update(b"\n" + line.encode())
            yield from _table(done, schema).to_batches()
        if state is not None:
            yield from _table([[own, state.hexdigest()]], schema).to_batches()

    lines = repaired.select("conv_id", "place", "step", F.concat_ws(":", "role", "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return ordered.select("conv_id", "line").mapInArrow(stream, ddl)


def repair_report(originals: DataFrame, rows: DataFrame, **sizes: int) -> DataFrame:
    """The report of every conversation of ``originals`` whose (damaged) rows are ``rows``."""
    repair = Repair(rows, **sizes)
    nothing = hashlib.sha256(b"").hexdigest()
    all_ids = originals.select("conv_id").distinct()
    reports = repair.reports()
    joined = all_ids.alias("x").join(reports.alias("y"), _same("conv_id"), "left").select("x.conv_id", *[f"y.{c}" for c in reports.columns[1:]])
    joined = joined.alias("x").join(digests(repair.repaired()).alias("y"), _same("conv_id"), "left").select("x.*", "y.repaired_sha256")
    return joined.fillna(0, ["gaps", *_SUMMED]).fillna({"audit": "", "repaired_sha256": nothing})


def _repair_sql() -> str:
    """The same rows by sequential backward costs, each with its audit and rows.  One step of the recursion takes one row."""
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda n: CASE WHEN n & 1 = 1 THEN xor(3988292384, n >> 1) ELSE n >> 1 END)"

    def better(at: str, cost: str, letter: str, line: str | None) -> str:
        rows = f"{at}.r" if line is None else f"{line} || CASE WHEN {at}.r = '' THEN '' ELSE chr(10) || {at}.r END"
        return f"{{'c': {at}.c + {cost}, 'a': '{letter}' || {at}.a, 'r': {rows}}}"

    def edited(p: int) -> str:
        found = [better(f"v[{p + 1}]", str(DELETE), "D", None)]
        for role, q in ((x, to) for x, to in zip(" " + _INITIALS, _KEPT[p], strict=True) if to >= 0):
            kept = better(f"v[{q + 1}]", f"{TRUNCATED} * open", "K", "role || ':' || text")
            found.append(f"CASE WHEN NOT gone AND role[1] = '{role}' THEN {kept} END")
        turned = better(f"v[{_TURN[p] + 1}]", f"{REROLE} + {TRUNCATED} * open", "R", f"'{_NAMES[_TURN[p]]}:' || text")
        return f"list_min([{', '.join([*found, f'CASE WHEN NOT gone THEN {turned} END'])}])"

    def closed(p: int) -> str:
        first, second = _TURN[p], _TURN[_TURN[p]]
        once = better(f"w[{first + 1}]", str(INSERT), "I", f"'{_NAMES[first]}:'")
        two = f"'{_NAMES[first]}:' || chr(10) || '{_NAMES[second]}:'"
        return f"list_min([w[{p + 1}], {once}, {better(f'w[{second + 1}]', str(2 * INSERT), 'II', two)}])"

    end = "{'c': %d, 'a': '%s', 'r': %s}"
    ends = [end % (0, "", "''"), end % (6, "II", "'user:' || chr(10) || 'assistant:'"), end % (3, "I", "'assistant:'"), end % (0, "", "''")]
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {table} AS t), keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
    || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 20 AS fault
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE fault <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faulty AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS unended,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS broken
  FROM ordered
), rows AS MATERIALIZED (
  SELECT conv_id, i, role, text, blank OR seen AS gone, CAST(unended AND NOT blank AND NOT seen AS INTEGER) AS open FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (unended AND NOT blank AND NOT seen) AS truncated,
    count(*) FILTER (broken) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, n + 1 AS i, [{', '.join(ends)}] AS v FROM counts
  UNION ALL
  SELECT conv_id, i, [{', '.join(closed(p) for p in range(4))}] FROM (
    SELECT r.conv_id, r.i, [{', '.join(edited(p) for p in range(4))}] AS w
    FROM walk JOIN rows r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.i = walk.i - 1
  )
), best AS (SELECT conv_id, v[1] AS b FROM walk WHERE i = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
  coalesce(b.a, '') AS audit, sha256(coalesce(b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


REPAIR_SQL = _repair_sql()
