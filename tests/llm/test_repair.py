import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barline.llm import entry, repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def all_edits(rows, bound):
    """Every sequence of edits (cost, audit, turns) that gives legal initials, with at most `bound` inserts in a row."""
    out = []

    def walk(i, cost, audit, turns, inserts):
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in turns)) and i == len(rows):
            out.append((cost, audit, turns))
        if inserts < bound:
            for role in ("user", "assistant"):
                walk(i, cost + 3, audit + "I", turns + [(role, "")], inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            walk(i + 1, cost + 4, audit + "D", turns, 0)
            if fault not in "bd":
                late = 3 if fault == "t" else 0
                walk(i + 1, cost + late, audit + "K", turns + [(role, text)], 0)
                for new in ("user", "assistant"):
                    walk(i + 1, cost + 3 + late, audit + "R", turns + [(new, text)], 0)

    walk(0, 0, "", [], 0)
    return min(out, key=lambda x: (x[0], x[1]))


def by_states(rows):
    """The least (cost, audit, turns) by dynamic programming over the four states; for longer conversations."""
    follow = {"": "u", "s": "u", "a": "u", "u": "a"}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for q, (c, a, t) in list(best.items()):
                n = follow[q]
                best[n] = min(best.get(n, (1 << 60,)), (c + 3, a + "I", t + ((full[n], ""),)))
        return best

    best = inserted({"": (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for q, (c, a, t) in best.items():
            moves = [(q, (c + 4, a + "D", t))]
            if fault not in "bd":
                late, n = (3 if fault == "t" else 0), follow[q]
                if role[:1] == n or (role[:1] == "s" and q == ""):
                    moves.append((role[:1], (c + late, a + "K", t + ((role, text),))))
                moves.append((n, (c + 3 + late, a + "R", t + ((full[n], text),))))
            for n, x in moves:
                new[n] = min(new.get(n, (1 << 60,)), x)
        best = inserted(new)
    return min(best[q] for q in ("", "a") if q in best)


def expected(table):
    """The contract over rows (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else str(x)
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        groups[conv] += []
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in rows:
            said = BLANK.findall(text)
            judged.append((role, text, "b" if not said else "d" if (role, text) in seen else "." if said[-1] in ".!?" else "t"))
            seen.add((role, text))
        numbers = {t for t, _, _ in rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        faults = [f for _, _, f in judged]
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, turns = by_states(judged)
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out.add((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def result(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    df = df.withColumns({"BLOCK": F.lit(1), "part": F.lit(2), "gone": F.lit(None).cast("boolean"), "split": F.lit("x")})
    got = repair.report(repair.repair(repair.damage(df))).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {tuple(r) for r in got}


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.op11_conversation_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in got.collect()} == expected(rows)


def test_auction_finds_the_least_edits():
    rng = random.Random(2)
    for _ in range(150):
        rows = [(rng.choice(("user", "assistant", "system", "tool", "")), str(k), rng.choice("..tbd")) for k in range(rng.randint(0, 4))]
        # Two inserts in a row are enough: a third and fourth would only add a pair.
        cost, audit, turns = all_edits(rows, 2)
        assert by_states(rows) == (cost, audit, tuple(turns))
        lattice = repair.Lattice(repair._initials([r for r, _, _ in rows]), "".join(f for _, _, f in rows))
        assert lattice.auction(*lattice.start(repair.FREE), repair.NOTHING)[:2] == (cost, audit)
        assert [(r, t) for r, t, _ in repair.apply([x[:2] for x in rows], audit)] == turns


def test_prices_are_dual():
    """No arc undercuts a price, and the first node's price is the cost."""
    rng = random.Random(6)
    for _ in range(50):
        n = rng.randint(1, 20)
        lattice = repair.Lattice("".join(rng.choices("sua ", k=n)), "".join(rng.choices("..tbd", k=n)))
        prices, exits = lattice.start(repair.FREE)
        cost, _, _ = lattice.auction(prices, exits, repair.NOTHING)
        assert prices[0][repair.NOTHING] == cost
        for i in range(n + 1):
            for q in range(4):
                for _, c, step, to in lattice.arcs[i][q] if i < n else lattice.tail[q]:
                    assert prices[i][q] <= c + prices[i + step][to]


def odd(seed, n):
    rng = random.Random(seed)
    texts = ["Hi there.", "Why? ", "No", "", " \t\n", "Yes!\n", "cut off he", "é語.", None, "same.", "x" * 200]
    roles = ["user", "assistant", "system", "tool", None, "", "unknown", "User"]
    rows = [(rng.choice((1, 2, 3, None)), rng.choice((None, rng.randint(-3, 400))), rng.choices(roles, [9, 9, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]
    return list(dict.fromkeys(rows)) + [(50, k, "user", "One conversation of its own.") for k in range(3)] + [(60 + k, k, "assistant", "Short.") for k in range(40)]


@pytest.mark.parametrize("block", [64, 5, 1])
def test_long_and_odd_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = odd(block, 300) + [(7, k % 90, ("user", "assistant")[k // 90 % 2], f"turn {k}.") for k in range(180)]
    assert result(spark, rows) == expected(rows)


def test_blocks_are_bounded_in_characters_and_repeats_cross_them(spark, monkeypatch):
    monkeypatch.setattr(repair, "BYTES", 300)
    rows = [(1, k, ("user", "assistant")[k % 2], "same words again." if k % 3 else "a long one " * 20) for k in range(60)]
    rows += [(2, None, "user", "equal row.")] * 50 + [(3, None, None, None)] * 2
    assert result(spark, rows, 3) == expected(rows)


def test_all_rows_dropped_and_no_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert result(spark, [(gone, 0, "user", "Hi.")]) == {(gone, 0, 0, 0, 0, 0, 0, "", empty)}
    frame = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.report(repair.repair(repair.damage(frame))).collect() == []
