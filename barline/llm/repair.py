"""Repair of conversation structure: the cheapest edits that leave `(s?(ua)+)?` as role initials, by an auction.

Rows are walked through an automaton of four states (nothing yet, system, user, assistant said last). With the rows of a
conversation it spans a lattice of nodes (rows consumed, state) with integer arc costs: Delete 4 (the only way past a
blank or repeated row), Insert 3, Keep 0 where the initial fits, Rerole 3, and 3 more for a truncated row that is not
deleted. Each letter leaves a node by one arc at most.

The shortest path is found by an auction. Node prices start below the true distance to the end (what each row costs at
least). The path grows from its first node along an arc whose cost is exactly the difference of the prices; where there
is none, the node's price rises to its best arc and the path shrinks by one. All shortest paths consist of such tight
arcs, arcs only get loose while their node is on the path, and of tight arcs the least letter is taken: the path that
reaches the end is the ASCII-least of the cheapest.

Rows are range-partitioned by conversation and place, so a conversation with a third of all rows spreads over tasks,
and cut into blocks of at most `BLOCK` rows and `BYTES` characters. A conversation that fits one block is repaired where
it lies. A longer one (and one at a partition's edge, which may go on in the next) is settled over its blocks: every
block's costs between states (by auctions, in parallel), exit prices from last to first (a stream of sixteen numbers a
block), paths from each entry state to these prices (in parallel), and the entry states from first to last (a stream of
four short audits a block). Texts move once to their block and, of split conversations only, once more to their edits.

Defined cases: null roles and texts are one space; null conversation ids are one conversation; null turns come first.
Rows of one turn go by role, the first 64 characters of the text and a hash of it. Equal rows repeat each other. A role
of another initial, or none, cannot be kept. Conversations without a row left stay with an empty repair. No rows give no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barline.llm.store import saved
from barline.session import shuffle_partitions

BLOCK, BYTES = 64, 1 << 18
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a kept initial, by the state before it.
STEP = {"u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "s": {NOTHING: SYSTEM}}
#: The one turn of a user or an assistant that may follow each state.
NEXT = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 40
FREE = [0, NEVER, NEVER, 0]

_ROW = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])
COUNTS = ["blank", "duplicate", "truncated", "illegal", "distinct_turns", "min_turn", "max_turn", "cost"]


# --- damage -----------------------------------------------------------------------------------------------------------


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, gone), damaged by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row (it stays
    as gone), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


# --- the auction ------------------------------------------------------------------------------------------------------


def fault(text: str) -> str:
    """`b` for a blank text, `t` for one that ends without a sentence's end, `.` for others."""
    said = text.rstrip(BLANKS)
    return "b" if not said else "." if said[-1] in STOPS else "t"


@lru_cache(maxsize=None)
def _row_arcs(initial: str, found: str) -> list[list[tuple[str, int, int, int]]]:
    """For each state the arcs (letter, cost, rows consumed, state) of a row, by letter."""
    out = []
    extra = TRUNCATED if found == "t" else 0
    for state in range(4):
        after = NEXT[state][1]
        arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, after)]
        if found not in "bd":
            if state in STEP.get(initial, {}):
                arcs.append(("K", extra, 1, STEP[initial][state]))
            arcs.append(("R", REROLE + extra, 1, after))
        out.append(arcs)
    return out


class Lattice:
    """Rows of one block, given by their initials and faults. Behind the last row of a block that others follow, nothing
    is inserted: that is the next block's to do."""

    def __init__(self, initials: str, faults: str, last: bool = True):
        self.arcs = [_row_arcs(i, f) for i, f in zip(initials, faults)]
        self.tail = [[("I", INSERT, 0, NEXT[q][1])] if last else [] for q in range(4)]
        least = [DELETE if f in "bd" else TRUNCATED if f == "t" else 0 for f in faults]
        self.floor = [0] * (len(least) + 1)
        for i in range(len(least) - 1, -1, -1):
            self.floor[i] = self.floor[i + 1] + least[i]
        self.can_open = any(i == "s" and f not in "bd" for i, f in zip(initials, faults))

    def start(self, exits: list[int]) -> tuple[list[list[int]], list[int]]:
        """Prices that no arc undercuts, for the given prices of the exit states."""
        end = min(exits)
        return [[x + end] * 4 for x in self.floor], exits

    def auction(self, prices: list[list[int]], exits: list[int], entry: int) -> tuple[int, str, int]:
        """Cost from `entry` to the exits, the ASCII-least audit of that cost, and the state it ends in. Raises `prices`,
        which stay good for another entry."""
        n, path, audit = len(self.arcs), [(0, entry)], []
        while True:
            i, q = path[-1]
            arcs = self.arcs[i][q] if i < n else self.tail[q]
            least, step = (exits[q], None) if i == n else (NEVER, None)
            for arc in arcs:
                cost = arc[1] + prices[i + arc[2]][arc[3]]
                if cost < least:
                    least, step = cost, arc
            if prices[i][q] < least:
                prices[i][q] = least
                if len(path) > 1:
                    path.pop()
                    audit.pop()
            elif step is None:
                return prices[0][entry], "".join(audit), q
            else:
                path.append((i + step[2], step[3]))
                audit.append(step[0])

    def reaches(self, entry: int, state: int) -> bool:
        return state in (USER, ASSISTANT, entry) or (entry == NOTHING and state == SYSTEM and self.can_open)

    def matrix(self) -> list[int]:
        """Least costs between all entry and exit states, row by row."""
        out = [NEVER] * 16
        for state in range(4):
            # A state that cannot lead to this exit has no price; neither has one from which no system turn is left.
            prices, exits = self.start([0 if q == state else NEVER for q in range(4)])
            if state in (NOTHING, SYSTEM):
                for row in prices:
                    row[USER] = row[ASSISTANT] = NEVER
                    if state == NOTHING:
                        row[SYSTEM] = NEVER
            if state == SYSTEM:
                for i in range(len(prices) - 1, -1, -1):
                    if i < len(self.arcs) and any(a[0] == "K" and a[3] == SYSTEM for a in self.arcs[i][NOTHING]):
                        break
                    prices[i][NOTHING] = NEVER
            for entry in range(4):
                if self.reaches(entry, state):
                    out[4 * entry + state] = self.auction(prices, exits, entry)[0]
        return out


def apply(rows: list[tuple[str, str]], audit: str, entry: int = NOTHING) -> list[tuple[str, str, str]]:
    """The repaired turns (role, text, letter) of rows (role, text)."""
    out, i, state = [], 0, entry
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            role, text = rows[i]
            state = STEP[role[:1]][state]
        else:
            role, state = NEXT[state]
            text = "" if letter == "I" else rows[i][1]
        i += letter != "I"
        out.append((role, text, letter))
    return out


def key(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def faults(rows: list[tuple[str, str]]) -> str:
    """First faults of rows (role, text) in order, repeats among them included."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        found = fault(row[1])
        out.append("d" if found != "b" and row in seen else found)
        seen.add(row)
    return "".join(out)


def _initials(roles: list[str]) -> str:
    """One character for each role; a role without one gets a blank."""
    return "".join(r[:1] or " " for r in roles)


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))


# --- blocks -----------------------------------------------------------------------------------------------------------

_BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("split", T.BooleanType()),
    T.StructField("rows", T.ArrayType(_ROW))])


def _batches(names: list[str], kinds: pa.Schema, rows: Iterator[tuple], size: Callable[[tuple], int] = lambda _: 1) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of at most a thousand rows, or about `BYTES` of what `size` counts, times 16."""
    some: list[tuple] = []
    weight = 0
    for row in rows:
        some.append(row)
        weight += size(row)
        if len(some) >= 1000 or weight > 16 * BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*some))], names=names)
            some, weight = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*some))], names=names)


def _mapped(df: DataFrame, schema: T.StructType, run: Callable[[Iterator[dict]], Iterator[tuple]], size: Callable[[tuple], int] = lambda _: 1) -> DataFrame:
    """`run` over the rows of each partition, as dictionaries in; tuples out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
        return _batches(schema.names, kinds, run(rows), size)

    return df.mapInArrow(each, schema)


def _cut(rows: Iterator[dict]) -> Iterator[tuple]:
    """Blocks of sorted rows. The first and the last conversation of a partition may go on in another."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[list] = []  # blocks of the conversation in hand, while it may still be whole
    name, block, size, split, first = None, [], 0, False, True

    def close(whole: bool):
        nonlocal seq, held
        held.append(block)
        for one in held:
            yield name, part, seq, not whole, one
            seq += 1
        held = []

    started = False
    for row in rows:
        if started and row["conv_id"] != name:
            yield from close(not split and not first)
            first, split, block, size = False, False, [], 0
        name, started = row["conv_id"], True
        if row["gone"]:
            continue
        if len(block) >= BLOCK or (block and size + len(row["text"]) > BYTES):
            split = True
            yield from close(False)
            block, size = [], 0
        block.append((row["turn"], row["role"], row["text"]))
        size += len(row["text"])
    if started:
        yield from close(False)


def blocks(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) as blocks (conv_id, part, seq, split, rows), written to the shared folder.
    Blocks of a conversation are in order of part and seq, which name a block."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text")]
    # Equal rows are in any order the same: where they are very many they may spread.
    spread = F.monotonically_increasing_id() % 64
    ranged = turns.withColumn("spread", spread).repartitionByRange(shuffle_partitions(turns.sparkSession), *order, "spread")
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *_BLOCKS])
    made = _mapped(ranged.sortWithinPartitions(*order).drop("spread"), schema, _cut, lambda b: sum(len(r[2]) for r in b[4]))
    return saved(made, "conversation-blocks")


def _counted(name, block: int, split: bool, rows: list[dict], found: str, illegal: int, distinct: int, cost: int, audit: str, turns: list) -> tuple:
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    return (name, block, split, found.count("b"), found.count("d"), found.count("t"), illegal, distinct,
            min(numbers, default=None), max(numbers, default=None), cost, audit, turns)


def _schema(conv: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("conv_id", conv), T.StructField("block", T.LongType()), T.StructField("split", T.BooleanType()),
        *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("turns", T.ArrayType(_TURN))])


def _whole(rows: Iterator[dict]) -> Iterator[tuple]:
    for b in rows:
        said = [(r["role"], r["text"]) for r in b["rows"]]
        initials, found = _initials([r for r, _ in said]), faults(said)
        lattice = Lattice(initials, found)
        cost, audit, _ = lattice.auction(*lattice.start(FREE), NOTHING)
        distinct = len({r["turn"] for r in b["rows"] if r["turn"] is not None})
        yield _counted(b["conv_id"], 0, False, b["rows"], found, _illegal(initials), distinct, cost, audit, apply(said, audit))


# --- conversations over several blocks --------------------------------------------------------------------------------


def _shapes(rows: Iterator[dict]) -> Iterator[tuple]:
    for b in rows:
        said = [(r["role"], r["text"]) for r in b["rows"]]
        found, seen, keys = faults(said), set(), []
        for k, row in enumerate(said):
            if found[k] != "b" and row not in seen:
                keys.append((k, key(*row)))
            seen.add(row)
        yield b["conv_id"], b["part"], b["seq"], _initials([r for r, _ in said]), found, keys


def _repeats(shapes: DataFrame) -> DataFrame:
    """`shapes` with the rows that an earlier block of their conversation has already marked as repeats. A key is there
    once a block, so one that fills a conversation is a row for each 64."""
    at = F.struct("part", "seq")
    rows = shapes.select("conv_id", "part", "seq", F.explode("keys").alias("key"))
    first = F.min(at).over(Window.partitionBy("conv_id", "key.digest"))
    again = rows.withColumn("first", first).where(F.col("first") < at).groupBy("part", "seq").agg(F.collect_list("key.k").alias("again"))
    return shapes.drop("keys").join(again, ["part", "seq"], "left")


def _marked(b: dict) -> str:
    again = set(b["again"] or ())
    return "".join("d" if k in again else f for k, f in enumerate(b["faults"]))


def _ordered(df: DataFrame, backward: bool) -> DataFrame:
    """Each conversation's blocks in one partition, in order."""
    way = (lambda c: F.col(c).desc()) if backward else F.col
    return df.repartition(shuffle_partitions(df.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id"), way("part"), way("seq"))


def _costs(rows: Iterator[dict]) -> Iterator[tuple]:
    for b in rows:
        found = _marked(b)
        lattice = Lattice(b["initials"], found, last=False)
        yield b["conv_id"], b["part"], b["seq"], b["initials"], found, lattice.matrix()


def _exit_prices(rows: Iterator[dict]) -> Iterator[tuple]:
    """From a conversation's last block to its first: what is still to pay behind each block, by state."""
    name, started, prices = None, False, FREE
    for b in rows:
        last = not started or b["conv_id"] != name
        if last:
            name, started = b["conv_id"], True
            # Behind the last row only inserts are left.
            prices = [0, 2 * INSERT, INSERT, 0]
        yield b["part"], b["seq"], last, prices
        m = b["costs"]
        prices = [min(m[4 * q + x] + prices[x] for x in range(4)) for q in range(4)]


def _paths(rows: Iterator[dict]) -> Iterator[tuple]:
    for b in rows:
        lattice = Lattice(b["initials"], b["faults"], b["last"])
        prices, exits = lattice.start(FREE if b["last"] else b["exits"])
        found = [lattice.auction(prices, exits, q) for q in range(4)]
        edits = [sum({"D": DELETE, "I": INSERT, "R": REROLE}.get(x, 0) for x in audit) for _, audit, _ in found]
        kept = []
        for _, audit, _ in found:
            taken = [x for x in audit if x != "I"]
            kept.append(sum(TRUNCATED for x, f in zip(taken, b["faults"]) if f == "t" and x != "D"))
        yield b["conv_id"], b["part"], b["seq"], b["initials"], b["faults"], [(e + k, a, q) for e, k, (_, a, q) in zip(edits, kept, found)]


def _entries(rows: Iterator[dict]) -> Iterator[tuple]:
    """From a conversation's first block to its last: the state that each is entered in, and so its path."""
    name, started, state, block, before = None, False, NOTHING, 0, ""
    for b in rows:
        if not started or b["conv_id"] != name:
            name, started, state, block, before = b["conv_id"], True, NOTHING, 0, ""
        path = b["paths"][state]
        yield b["part"], b["seq"], block, state, b["faults"], _illegal(before + b["initials"]), path["cost"], path["audit"]
        state, block, before = path["state"], block + 1, b["initials"][-1:] or before


def _edited(rows: Iterator[dict]) -> Iterator[tuple]:
    for b in rows:
        said = [(r["role"], r["text"]) for r in b["rows"]]
        numbers = [r["turn"] for r in b["rows"] if r["turn"] is not None]
        yield _counted(b["conv_id"], b["block"], True, b["rows"], b["faults"], b["illegal"], len(set(numbers)), b["cost"], b["audit"], apply(said, b["audit"], b["state"]))


def _text_size(row: tuple) -> int:
    return sum(len(t[1]) for t in row[-1])


def repair(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) repaired: one row a block with the counts of faults in it, its cost, audit
    and repaired turns (role, text, edit). `split` tells conversations of possibly several blocks; `block` counts from 0.
    """
    made = blocks(turns)
    conv = turns.schema["conv_id"].dataType
    named = lambda *f: T.StructType([T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), *f])
    out = _schema(conv)
    whole = _mapped(made.where("not split"), out, _whole, _text_size)
    parts = made.where("split")
    texts = [T.StructField("initials", T.StringType()), T.StructField("faults", T.StringType())]
    keys = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("digest", T.BinaryType())]))
    shapes = saved(_mapped(parts.drop("split"), named(*texts, T.StructField("keys", keys)), _shapes), "conversation-shapes")
    longs = T.ArrayType(T.LongType())
    costs = saved(_mapped(_repeats(shapes), named(*texts, T.StructField("costs", longs)), _costs), "conversation-costs")
    exits = T.StructType([*named().fields[1:], T.StructField("last", T.BooleanType()), T.StructField("exits", longs)])
    priced = costs.drop("costs").join(_mapped(_ordered(costs.drop("initials", "faults"), True), exits, _exit_prices), ["part", "seq"])
    path = T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("state", T.IntegerType())])
    paths = _mapped(priced, named(*texts, T.StructField("paths", T.ArrayType(path))), _paths)
    entry = T.StructType([
        *named().fields[1:], T.StructField("block", T.LongType()), T.StructField("state", T.IntegerType()), texts[1],
        T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    edits = _mapped(_ordered(paths, False), entry, _entries)
    return whole.unionByName(_mapped(parts.join(edits, ["part", "seq"]), out, _edited, _text_size))


# --- a row for each conversation --------------------------------------------------------------------------------------


def _joined(rows: Iterator[dict]) -> Iterator[tuple]:
    """Digest and audit of conversations over several blocks. A digest is a chain, so one conversation's blocks pass one
    after the other; no more than one is held."""
    name, started = None, False
    sums, audit, digest, any_turn, low, high, last = [0] * 6, [], hashlib.sha256(), False, None, None, None

    def close() -> tuple:
        gaps = 0 if low is None else high - low + 1 - sums[4]
        return name, gaps, *sums[:4], sums[5], "".join(audit), digest.hexdigest()

    for b in rows:
        if started and b["conv_id"] != name:
            yield close()
            started = False
        if not started:
            name, started = b["conv_id"], True
            sums, audit, digest, any_turn, low, high, last = [0] * 6, [], hashlib.sha256(), False, None, None, None
        for k, c in enumerate(["blank", "duplicate", "truncated", "illegal", "distinct_turns", "cost"]):
            sums[k] += b[c]
        if b["min_turn"] is not None:
            # Blocks rise by turn; a turn number that goes over a block's edge counts once.
            sums[4] -= b["min_turn"] == last
            low, high, last = b["min_turn"] if low is None else low, b["max_turn"], b["max_turn"]
        audit.append(b["audit"])
        for turn in b["turns"]:
            digest.update(f"{chr(10) if any_turn else ''}{turn['role']}:{turn['text']}".encode())
            any_turn = True
    if started:
        yield close()


def report(repaired: DataFrame) -> DataFrame:
    """One row a conversation, from the blocks that `repair` gives: gaps, counts of faults, cost, audit and the SHA-256 of
    its turns as lines `role:text`."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0))
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = repaired.where("not split").select("conv_id", gaps.cast("long").alias("gaps"), *names, F.sha2(lines, 256).alias("repaired_sha256"))
    split = repaired.where("split")
    ordered = split.repartition(shuffle_partitions(split.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    return whole.unionByName(_mapped(ordered, whole.schema, _joined))
