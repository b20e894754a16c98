"""Order-dependent news de-duplication without comparing all pairs.

An item survives if it duplicates no earlier *surviving* item. Two items are duplicates when
their token sets have Jaccard >= 0.40, or share a money token and a Latin-name token.

1. Equal token sets share one fate, so one representative per set goes on (copies cost one
   pre-aggregated row however many there are).
2. Every set emits join keys such that two duplicates always meet in a key: for each partner
   size the rarest tokens that a Jaccard match cannot avoid, plus each (money, name) couple.
3. Rounds: a set without an earlier undecided one in its way survives; sets similar to a new
   survivor go. In the first round all earlier sets of a key are in the way, which settles most
   groups for the price of one minimum a key. From then on only true duplicates are: each set is
   compared with the first `HEADS` undecided sets of its keys, and waits for what lies behind
   them only if a key holds more. Pairs stay within `HEADS` a set and key, and sets that merely
   share keys settle together; only a chain of true duplicates takes a round for two of its links.
   Pairs that a map of their tokens rules out are dropped inside the join and never moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.text import is_money_token, is_name_token
from barline.operators.ranking import first_k
from barline.session import use_checkpoints

THRESHOLD = 0.40
HEADS = 16


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def is_duplicate(a: Column, b: Column) -> Column:
    shared = F.array_intersect(a, b)
    couple = F.exists(shared, is_money_token) & F.exists(shared, is_name_token)
    return (F.size(a) > 0) & (F.size(b) > 0) & ((jaccard(a, b) >= THRESHOLD) | couple)


def needed_overlap(size_a: Column, size_b: Column) -> Column:
    """Shared tokens that Jaccard >= threshold asks for, given the two sizes."""
    share = THRESHOLD / (1 + THRESHOLD)
    return F.ceil(share * (size_a + size_b) - 1e-9).cast("int")


def token_bits(tokens: Column) -> Column:
    """A 64-bit map of the tokens' hashes."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(bit(t)))


def may_match(key: Column, bits_a: Column, n_a: Column, bits_b: Column, n_b: Column) -> Column:
    """Whether two sets that meet in `key` can be duplicates: each bit that only one side has is a token the other lacks.
    Sets that share a couple meet in its own key, too, where nothing is ruled out."""
    alone = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    shared = F.least(n_a - alone(bits_a, bits_b), n_b - alone(bits_b, bits_a))
    return F.startswith(key, F.lit("$|")) | (shared >= needed_overlap(n_a, n_b))


def rarest_first(sets: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Reorder every token array by rising document frequency (ties by token)."""
    flat = sets.select("set_id", F.explode(tokens).alias("token"))
    frequency = flat.groupBy("token").agg(F.count("*").alias("df"))
    ordered = flat.join(frequency, "token").groupBy("set_id").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by_rarity")
    )
    return sets.join(ordered, "set_id").withColumn(
        tokens, F.transform("by_rarity", lambda t: t["token"])
    ).drop("by_rarity")


def size_classes(limit: int = 2**31 - 1) -> list[tuple[int, int]]:
    """(low, high) set sizes, to the largest array there can be: single sizes up to 12, then steps of a quarter."""
    lows = list(range(1, 13))
    while lows[-1] < limit:
        lows.append(math.ceil(lows[-1] * 1.25))
    return [(low, nxt - 1) for low, nxt in zip(lows, lows[1:])]


def join_keys(sets: DataFrame) -> DataFrame:
    """(group, set_id, ord, bits, n, key, side). Duplicates always share a key with opposite sides.

    One set of keys per partner size class: the rarest tokens that a match with the smallest
    possible partner of the class cannot avoid. A small set thus offers its frequent tokens only
    to partners that could match on them, and the keys stay linear in the set's size. Side 0 is
    the smaller class, side 1 the larger; equal classes use both sides.
    """
    size = F.size("tokens")
    classes = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(low).alias("low"), F.lit(high).alias("high"))
                        for c, (low, high) in enumerate(size_classes())])
    smallest, largest = F.ceil(size * THRESHOLD - 1e-9), F.floor(size / THRESHOLD + 1e-9)
    partners = F.filter(classes, lambda x: (x["high"] >= smallest) & (x["low"] <= largest))
    own = F.element_at(F.filter(classes, lambda x: x["low"] <= F.size("tokens")), F.lit(-1))["c"]

    def for_class(x: Column) -> Column:
        least = F.greatest(x["low"], smallest.cast("int"))
        prefix = F.slice("tokens", 1, F.greatest(size - needed_overlap(size, least) + 1, F.lit(0)))
        pair = F.concat_ws("/", F.least(F.col("own"), x["c"]), F.greatest(F.col("own"), x["c"]))
        sides = F.when(F.col("own") < x["c"], F.array(F.lit(0))).when(F.col("own") > x["c"], F.array(F.lit(1))).otherwise(
            F.array(F.lit(0), F.lit(1)))
        return F.flatten(F.transform(prefix, lambda t: F.transform(
            sides, lambda s: F.struct(F.concat_ws("|", pair, t).alias("key"), s.alias("side")))))

    by_size = F.flatten(F.transform("partners", for_class))
    money, names = F.filter("tokens", is_money_token), F.filter("tokens", is_name_token)
    couples = F.flatten(F.flatten(F.transform(money, lambda m: F.transform(names, lambda n: F.transform(
        F.array(F.lit(0), F.lit(1)), lambda s: F.struct(F.concat_ws("|", F.lit("$"), m, n).alias("key"), s.alias("side")))))))
    ready = sets.withColumns({"partners": partners, "own": own, "bits": token_bits(F.col("tokens")), "n": size})
    carried = ["group", "set_id", "ord", "bits", "n"]
    return ready.select(*carried, F.explode(F.concat(by_size, couples)).alias("k")).select(*carried, "k.key", "k.side")


def behind_keys(live: DataFrame) -> DataFrame:
    """set_ids of keys with an earlier set on the other side, whether a duplicate or not."""
    firsts = live.groupBy("group", "key").agg(
        F.min(F.when(F.col("side") == 0, F.col("ord"))).alias("first0"),
        F.min(F.when(F.col("side") == 1, F.col("ord"))).alias("first1"),
    )
    facing = F.when(F.col("side") == 0, F.col("first1")).otherwise(F.col("first0"))
    return live.join(firsts, ["group", "key"]).filter(facing < F.col("ord")).select("set_id")


def behind_duplicates(live: DataFrame, tokens: DataFrame) -> DataFrame:
    """set_ids with an earlier duplicate among the first `HEADS` sets of a key, or with more earlier sets than these."""
    place = ["group", "key", "side"]
    heads = first_k(live, place, [F.col("ord")], HEADS + 1).select(
        "group", "key", (1 - F.col("side")).alias("side"), F.col("set_id").alias("head"), F.col("ord").alias("at"), "pos",
        F.col("bits").alias("at_bits"), F.col("n").alias("at_n"))
    near = may_match(*map(F.col, ("key", "bits", "n", "at_bits", "at_n")))
    ahead = live.join(heads, place).filter((F.col("at") < F.col("ord")) & ((F.col("pos") > HEADS) | near))
    unsure = F.max((F.col("pos") > HEADS).cast("int")) == 1
    met = ahead.groupBy("set_id", "head").agg(unsure.alias("unsure"))
    compared = (
        met.join(tokens.withColumnRenamed("tokens", "a"), "set_id")
        .join(tokens.withColumnsRenamed({"set_id": "head", "tokens": "b"}), "head")
    )
    return compared.filter(F.col("unsure") | is_duplicate(F.col("a"), F.col("b"))).select("set_id")


def surviving_sets(sets: DataFrame) -> DataFrame:
    """Greedy survivors among distinct token sets (group, set_id, ord, tokens): their set_ids.

    Every round settles at least the first undecided set of each group; keys of settled sets leave
    the table, so rounds shrink. Their number is half that of the longest chain of true duplicates,
    and where a key holds many sets that are not alike, one for each `HEADS` of them.
    """
    use_checkpoints(sets.sparkSession)
    sets = rarest_first(sets).checkpoint()
    tokens = sets.select("set_id", "tokens")
    live = join_keys(sets).checkpoint()
    undecided = sets.select("set_id")
    survivors = None

    while not undecided.isEmpty():
        blocked = behind_keys(live) if survivors is None else behind_duplicates(live, tokens)
        new = undecided.join(blocked, "set_id", "left_anti").checkpoint()
        survivors = new if survivors is None else survivors.unionByName(new)

        won = live.join(new, "set_id", "left_semi").select(
            "group", "key", (1 - F.col("side")).alias("side"), F.col("set_id").alias("winner"), F.col("ord").alias("won"),
            F.col("bits").alias("won_bits"), F.col("n").alias("won_n"))
        rest = live.join(new, "set_id", "left_anti")
        near = may_match(*map(F.col, ("key", "bits", "n", "won_bits", "won_n")))
        met = rest.join(won, ["group", "key", "side"]).filter((F.col("won") < F.col("ord")) & near).select("set_id", "winner").distinct()
        beaten = (
            met.join(tokens.withColumnRenamed("tokens", "a"), "set_id")
            .join(tokens.withColumnsRenamed({"set_id": "winner", "tokens": "b"}), "winner")
            .filter(is_duplicate(F.col("a"), F.col("b"))).select("set_id").distinct()
        )
        live = rest.join(beaten, "set_id", "left_anti").checkpoint()
        undecided = live.select("set_id").distinct()
    return sets.select("set_id").limit(0) if survivors is None else survivors


def keep_first(items: DataFrame, group: list[str], order: list[str], tokens: str = "tokens") -> DataFrame:
    """Items that survive the greedy rule. Items without tokens always survive."""
    rank = F.struct(*order)
    keyed = items.withColumn("_tokens", F.array_sort(tokens))
    filled = keyed.filter(F.size("_tokens") > 0)
    sets = filled.groupBy(F.struct(*group).alias("group"), F.col("_tokens").alias("tokens")).agg(
        F.min(rank).alias("ord")
    ).withColumn("set_id", F.substring(F.unhex(F.sha2(F.to_json(F.struct("group", "tokens")), 256)), 1, 16))
    alive = surviving_sets(sets)
    winners = sets.join(alive, "set_id", "left_semi").select("group.*", F.col("ord").alias("_ord"))
    kept = filled.withColumn("_ord", rank).join(winners, [*group, "_ord"], "left_semi").drop("_ord")
    return kept.unionByName(keyed.filter(F.size("_tokens") == 0)).drop("_tokens")
