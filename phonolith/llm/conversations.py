"""Least edits that make conversations well formed, by a Viterbi search whose chunks run in parallel.

Rows are put in order by a range shuffle and packed into chunks of codes, without texts; a conversation of any length is
many chunks. Each chunk starts from a speculative vector of costs to the end, one for each state of the form
`(s?(ua)+)?`, and works backward. Costs of a chunk are right up to a constant if the vector it started from differs from
the one that the next chunk arrived at by a constant only; fix-up passes rerun the others, each until old and new vectors
differ only by a constant, which a few rows bring about. With the stitched costs each chunk traces its cheapest edits
from every state it may be entered in; whoever reads the chunks in order follows one of them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonolith.llm.common import Scratch

#: Rows of a chunk, at most.
CHUNK = 4096
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
ROLES = "sua"
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)
RENAME = INSERT = 2
DELETE = 3
TRUNCATED = 1
#: Costs to the end of a conversation when no row is left.
END = (0, 4, 2, 0)
FORCED, CUT = 8, 4

Vector = tuple[int, ...]


def _inserted(v: list[int]) -> Vector:
    """Costs before which turns may be inserted as well; two insertions come back to the same state."""
    v = [min(c, INSERT + v[NEXT[q]]) for q, c in enumerate(v)]
    return tuple(min(c, INSERT + v[NEXT[q]]) for q, c in enumerate(v))


def _before(code: int, after: Vector) -> Vector:
    """Costs before a row, from those after it. code: place of the role's initial in `sua` (3: another), CUT, FORCED."""
    if code & FORCED:
        return _inserted([DELETE + c for c in after])
    left, role = TRUNCATED if code & CUT else 0, ROLES[code & 3 : (code & 3) + 1]
    return _inserted([min(DELETE + after[q], RENAME + left + after[NEXT[q]], left + after[KEPT[q, role]] if (q, role) in KEPT else DELETE + after[q]) for q in range(4)])


def _apart(v: Vector) -> Vector:
    least = min(v)
    return tuple(c - least for c in v)


class Steps:
    """Backward steps on vectors less their minimum; only a few dozen ever occur, so each is worked out once."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, Vector], tuple[Vector, int]] = {}

    def back(self, code: int, v: Vector) -> tuple[Vector, int]:
        found = self.known.get((code, v))
        if found is None:
            out = _before(code, v)
            found = self.known[code, v] = (_apart(out), min(out))
        return found


def costs_before(steps: Steps, codes: bytes, after: Vector) -> list[Vector]:
    """Vectors, less their minima, before each row and after the last."""
    out = [_apart(after)]
    for code in reversed(codes):
        out.append(steps.back(code, out[-1])[0])
    return out[::-1]


def rerun(steps: Steps, codes: bytes, old: Vector, new: Vector) -> tuple[Vector | None, int]:
    """The vector before the first row when the one after the last is `new`, and the rows looked at.

    None if it differs from that of `old` by a constant only: the pass stops where the two do.
    """
    old, new = _apart(old), _apart(new)
    for k, code in enumerate(reversed(codes)):
        if old == new:
            return None, k
        old, new = steps.back(code, old)[0], steps.back(code, new)[0]
    return (None if old == new else new), len(codes)


def trace(codes: bytes, counts: list[int], vectors: list[Vector], state: int) -> tuple[list[str], int, int]:
    """The cheapest edits from a state, least initials first: those of each row with insertions before it, the state after, their cost.

    Copies of a row are deleted at once: that changes no state, and no initial comes before D.
    """
    edits, cost = [], 0
    for k, code in enumerate(codes):
        here, after, own = vectors[k], vectors[k + 1], ""
        left, role = TRUNCATED if code & CUT else 0, ROLES[code & 3 : (code & 3) + 1]
        shift = min(_before(code, after))
        while own[-1:] in ("", "I"):
            now = here[state] + shift
            if now == DELETE + after[state]:
                own, cost = own + "D", cost + DELETE
            elif now == INSERT + here[NEXT[state]] + shift:
                own, cost, state = own + "I", cost + INSERT, NEXT[state]
            elif (state, role) in KEPT and now == left + after[KEPT[state, role]]:
                own, cost, state = own + "K", cost + left, KEPT[state, role]
            else:
                own, cost, state = own + "R", cost + RENAME + left, NEXT[state]
        edits += [own] + ["D"] * (counts[k] - 1)
        cost += DELETE * (counts[k] - 1)
    return edits, state, cost


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, packed: a number, the first row's place, codes, counts, pairs of neighbours that no conversation has, and whether all rows go."""
    names = PACKED
    number = TaskContext.get().partitionId() << 32
    rows: list[list] = []
    own: list | None = None
    for batch in batches:
        for conv, turn, dig, n, code in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if own is None or own[1] != conv or len(own[4]) == CHUNK:
                if own is not None:
                    rows.append([*own[:4], bytes(own[4]), *own[5:], all(c & FORCED for c in own[4])])
                own, number = [number, conv, turn, dig, bytearray(), [], 0], number + 1
            if own[4]:
                own[6] += not _legal(own[4][-1], code)
            own[4].append(code)
            own[5].append(n)
            own[6] += n - 1
        yield _batch(rows, names)
        rows = []
    if own is not None:
        yield _batch([[*own[:4], bytes(own[4]), *own[5:], all(c & FORCED for c in own[4])]], names)


def _legal(one: int, two: int) -> bool:
    return (one & 3, two & 3) in ((0, 1), (1, 2), (2, 1))


TYPES = {
    "chunk": pa.int64(), "conv_id": pa.int64(), "turn": pa.int64(), "dig": pa.binary(), "codes": pa.binary(), "counts": pa.list_(pa.int64()), "illegal": pa.int64(), "nth": pa.int64(),
    "after": pa.list_(pa.int32()), "before": pa.list_(pa.int32()), "edits": pa.list_(pa.list_(pa.string())), "states": pa.list_(pa.int32()), "costs": pa.list_(pa.int64()),
    "pos": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(), "idle": pa.bool_(),
}
SPARK = {
    "chunk": "long", "conv_id": "long", "turn": "long", "dig": "binary", "codes": "binary", "counts": "array<long>", "illegal": "long", "nth": "long", "after": "array<int>", "before": "array<int>",
    "edits": "array<array<string>>", "states": "array<int>", "costs": "array<long>", "pos": "long", "role": "string", "text": "string", "edit": "string", "cost": "long", "audit": "string",
    "repaired_sha256": "string", "idle": "boolean",
}
PACKED = ["chunk", "conv_id", "turn", "dig", "codes", "counts", "illegal", "idle"]


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[n]) for c, n in zip(columns, names, strict=True)], names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {SPARK[n]}" for n in names)


def _mapped(df: DataFrame, names: list[str], row) -> DataFrame:
    """row(dict) -> list of a new row's values, for every row of a table of chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield _batch([row(r) for r in batch.slice(at, 64).to_pylist()], names)

    return df.mapInArrow(work, _schema(names))


def well_named(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of any table of turns; a null role or text counts as one space."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct turns with their number, fault and code; texts stay behind, a digest stands for role and text.

    A digest's first turn in its conversation is found by a minimum, so a text that fills a conversation is one row per task.
    """
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    cut = ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.position(F.substring("role", 1, 1), F.lit(ROLES))
    place = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3)
    kinds = rows.select("conv_id", "turn", _digest().alias("dig"), blank.alias("blank"), cut.alias("cut"), place.alias("place"))
    grouped = kinds.groupBy("conv_id", "turn", "dig", "blank", "cut", "place").agg(F.count(F.lit(1)).alias("n"))
    first = grouped.groupBy("conv_id", "dig").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
    joined = grouped.alias("g").join(first.alias("f"), F.col("g.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("g.dig") == F.col("f.dig")))
    again = ~F.col("g.turn").eqNullSafe(F.col("f.first.turn"))
    fault = F.when(F.col("g.blank"), "blank").when(again, "duplicate").when(F.col("g.cut"), "truncated").otherwise("none")
    forced = F.when(F.col("g.blank") | again, FORCED).otherwise(0)
    code = F.col("g.place") + forced + F.when(F.col("g.cut"), CUT).otherwise(0)
    return joined.select("g.conv_id", "g.turn", "g.dig", "g.n", code.cast("int").alias("code"), fault.alias("fault"))


def counts_of(ordered: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated; a further copy of a turn is a duplicate unless it is blank."""
    n = F.col("n")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    is_ = lambda f: F.col("fault") == f
    return ordered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count(F.when(is_("blank"), n)).alias("blank"),
        count(F.when(is_("duplicate"), n).when(~is_("blank"), n - 1)).alias("duplicate"),
        count(F.when(is_("truncated"), 1)).alias("truncated"),
    )


def solved_chunks(scratch: Scratch, ordered: DataFrame) -> DataFrame:
    """Chunks with the edits of each row, the state after and the cost, for each of the four states they may be entered in.

    Only chunks whose successor arrived at another vector than they began from are run again; what is compared, round by
    round, are vectors, not rows. Chunks of rows that must go add a constant to any vector, so they are passed over.
    """
    own = ordered.select("conv_id", "turn", "dig", "n", "code").repartitionByRange("conv_id", "turn", "dig").sortWithinPartitions("conv_id", "turn", "dig")
    chunks = scratch.keep(own.mapInArrow(_chunks, _schema(PACKED)), "chunks")
    order = W.partitionBy("conv_id").orderBy("turn", "dig")
    later = F.first(F.when(~F.col("idle"), F.col("chunk")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    heads = scratch.keep(chunks.select("chunk", F.row_number().over(order).cast("long").alias("nth"), "idle", later.alias("next")), "heads")
    joints = heads.where("next is not null and not idle").select("chunk", "next")
    steps = Steps()
    ends = F.array(*(F.lit(c) for c in END))

    def begin(r: dict) -> list:  # END is a guess, but for a conversation's last chunk
        return [r["chunk"], list(END), list(costs_before(steps, r["codes"], END)[0])]

    def fix(r: dict) -> list:
        new, _ = rerun(steps, r["codes"], tuple(r["after"]), tuple(r["found"]))
        return [r["chunk"], r["found"], r["before"] if new is None else list(new)]

    several = not joints.isEmpty()
    vectors = scratch.keep(_mapped(chunks.select("chunk", "codes"), ["chunk", "after", "before"], begin), "pass-0") if several else None
    k = 0
    while several:  # a conversation's last wrong vector moves forward by a chunk at least, so this ends
        met = joints.join(vectors, "chunk").join(vectors.select(F.col("chunk").alias("next"), F.col("before").alias("found")), "next")
        wrong = scratch.keep(met.where("transform(found, x -> x - array_min(found)) <> transform(after, x -> x - array_min(after))").drop("next"), f"wrong-{k}")
        if wrong.isEmpty():
            break
        k += 1
        fixed = _mapped(chunks.select("chunk", "codes").join(wrong, "chunk"), ["chunk", "after", "before"], fix)
        vectors = scratch.keep(vectors.join(wrong, "chunk", "left_anti").unionByName(fixed), f"pass-{k}")
        scratch.drop(f"pass-{k - 1}", f"wrong-{k - 1}")
    solved = chunks.drop("idle").join(heads.select("chunk", "nth"), "chunk")
    solved = solved.join(vectors.select("chunk", "after"), "chunk") if several else solved.withColumn("after", ends)
    out = ["conv_id", "turn", "dig", "nth", "codes", "illegal", "edits", "states", "costs"]

    def follow(r: dict) -> list:
        before = costs_before(steps, r["codes"], tuple(r["after"]))
        found = [trace(r["codes"], r["counts"], before, state) for state in range(4)]
        return [*(r[c] for c in out[:4]), r["codes"][:1] + r["codes"][-1:], r["illegal"], *([f[i] for f in found] for i in range(3))]

    return _mapped(solved, out, follow)


class _Reader:
    """One conversation, read in order: chunks, each before its rows, and rows."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.illegal, self.last_code = conv, 0, 0, 0, None
        self.waiting: deque[str] = deque()
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def chunk(self, codes: bytes, illegal: int, edits: list[list[str]], states: list[int], costs: list[int]) -> None:
        if self.last_code is not None:
            illegal += not _legal(self.last_code, codes[0])
        self.illegal, self.last_code = self.illegal + illegal, codes[-1]
        self.waiting.extend(edits[self.state])
        self.cost += costs[self.state]
        self.state = states[self.state]

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1


def _read(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "pos", "role", "text", "edit"] if turns else ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
    rows: list[list] = []
    own: _Reader | None = None
    at = [0]  # state that the lines written so far leave

    def put(edit: str, role: str, text: str) -> None:
        own.audit.append(edit)
        if edit == "D":
            return
        if edit == "K":
            at[0] = KEPT[at[0], role[:1]]
        else:
            at[0] = NEXT[at[0]]
            role, text = ("user", "assistant")[at[0] - 2], "" if edit == "I" else text
        own.line(role, text)
        if turns:
            rows.append([own.conv, own.lines - 1, role, text, edit])

    def close() -> None:
        while own is not None and at[0] in (1, 2):
            own.cost += INSERT
            put("I", "", "")
        if own is not None and not turns:
            rows.append([own.conv, own.illegal, own.cost, "".join(own.audit), own.hash.hexdigest()])
        at[0] = 0

    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            conv = columns[0][i].as_py()
            if own is None or own.conv != conv:
                close()
                own = _Reader(conv)
            if columns[1][i].as_py():
                own.chunk(*(c[i].as_py() for c in columns[4:]))
                continue
            for edit in own.waiting.popleft():
                put(edit, columns[2][i].as_py(), columns[3][i].as_py())
        if rows:
            yield _batch(rows, names)
            rows = []
    close()
    yield _batch(rows, names)


def _applied(rows: DataFrame, chunks: DataFrame, turns: bool) -> DataFrame:
    """Chunks and rows of a conversation meet in one task in order and are read one by one: what is kept of it are edits, not texts."""
    texts = rows.select("conv_id", F.lit(False).alias("chunk"), "role", "text", *(F.lit(None).cast(SPARK[c]).alias(c) for c in ("codes", "illegal", "edits", "states", "costs")), "turn", _digest().alias("dig"), F.lit(0).cast("long").alias("nth"))
    plans = chunks.select("conv_id", F.lit(True).alias("chunk"), F.lit("").alias("role"), F.lit("").alias("text"), "codes", "illegal", "edits", "states", "costs", "turn", "dig", "nth")
    both = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "dig", F.col("chunk").desc(), "nth").drop("turn", "dig", "nth")
    names = ["conv_id", "pos", "role", "text", "edit"] if turns else ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
    return both.mapInArrow(lambda batches: _read(batches, turns), _schema(names))


def repaired_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, edit of every turn that repair keeps (K), renames (R) or inserts (I); see repair."""
    rows, scratch = well_named(conversations), Scratch(spark)
    return _applied(rows, solved_chunks(scratch, scratch.keep(_ordered(rows), "ordered")), True)


def repair(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Faults of each conversation and its cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Turns go by turn (nulls first), those
    of one number by a digest of role and text. Roles count by their initials. Blank turns and those whose role and text
    came before are deleted (3); others are kept (0), renamed to user or assistant (2) or deleted (3), a kept or renamed
    truncated one costs 1 more, an empty turn is inserted for 2. `audit` has the initials of the cheapest edits that leave
    `(s?(ua)+)?`, the least in ASCII order. A null role or text counts as one space; a null conv_id is a conversation like
    others; repeated rows are duplicates; an empty table gives no row; other columns are ignored.
    """
    rows, scratch = well_named(conversations), Scratch(spark)
    ordered = scratch.keep(_ordered(rows), "ordered")
    found = _applied(rows, solved_chunks(scratch, ordered), False)
    own = counts_of(ordered)
    on = own["conv_id"].eqNullSafe(found["conv_id"])
    return own.join(found, on).select(own["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of `conv_id:turn` (a null: one space) modulo 20: 0 drops the row, 1 empties its text,
    2 takes `[.!?]` out of it, 3 repeats the row, 4 makes its role user."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = well_named(conversations).withColumn("fault", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("time")


def repair_damaged(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """repair of the damaged rows, with a row of zeros, an empty audit and the hash of nothing for a conversation without rows."""
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done = repair(spark, damaged(conversations))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(done, every["conv_id"].eqNullSafe(done["conv_id"]), "left").select(
        every["conv_id"], *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
