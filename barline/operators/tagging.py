"""Watch-list tagging: which names does an item mention.

A regex match of every text against every name is a cross product. Here each name key and each
text are cut into anchors such that a match implies a shared anchor; the equi-join on anchors
finds the candidates and the full pattern then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.text import cut_legal_suffix
from barline.operators.ranking import written

RUN = r"[A-Za-z0-9]+"
WIDE = r"[^\x00-\x7F]{2,}"
MAX_TAGS = 4
#: Bits of the map of watch-list anchors; its size is the same for every list.
BITS = 1 << 21


def _neighbours(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))


def _place(value: Column, kind: str = "") -> Column:
    return F.pmod(F.xxhash64(value, F.lit(kind)), F.lit(BITS))


def bit_map(places: DataFrame) -> Column:
    """The places (one column) as one value of `BITS` bits, whatever their number: 256 KB in longs."""
    held = places.toDF("_p").select(F.expr("_p div 64").alias("_word"), F.expr("shiftleft(1L, cast(_p % 64 as int))").alias("_bits"))
    every = places.sparkSession.range(BITS // 64).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
    words = held.unionByName(every).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    ordered = words.agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("w"))
    return ordered.select(F.col("w._bits")).scalar()


def _held(bits: Column, place: Column) -> Column:
    return F.call_function("bit_get", F.get(bits, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1


def anchor_map(patterns: DataFrame) -> Column:
    """The anchors of the watch list as a bit map: whole anchors, first words of pairs, words in capitals."""
    anchor = F.col("anchor")
    pair, capitals = anchor.contains(" "), anchor.startswith("=")
    return bit_map(patterns.select(
        F.when(pair, _place(F.substring_index(anchor, " ", 1), " "))
        .when(capitals, _place(F.substring(anchor, F.lit(2), F.length(anchor)), "=")).otherwise(_place(anchor))).dropna())


def text_anchors(items: DataFrame, item_key: list[str], text: Column, patterns: DataFrame) -> DataFrame:
    """(item_key, anchor): whole ASCII words (lowered), pairs of neighbouring words, words in
    capitals (`=NVDA`), runs of digits (`#2330`) and pairs of neighbouring wide characters, as far as the watch list may
    hold them: its bit map drops the rest, words and pairs before they are made. It lets a few others through, which
    the join drops. An anchor may come more than once."""
    listed = patterns.agg(F.max(F.col("anchor").startswith("#")).alias("digits"), F.max(F.col("anchor").rlike(WIDE)).alias("wide"))
    has = lambda kind: F.coalesce(listed.select(kind).scalar(), F.lit(False))
    none = F.array().cast("array<string>")
    runs = lambda value, rule: F.regexp_extract_all(value, F.lit(rule), F.lit(0))
    digits = F.when(has("digits"), F.transform(runs(text, r"\d+"), lambda d: F.concat(F.lit("#"), d)))
    wide = F.when(has("wide"), F.flatten(F.transform(runs(F.lower(text), WIDE), _neighbours)))
    cut = items.select(*item_key, F.concat(runs(text, RUN), F.coalesce(digits, none), F.coalesce(wide, none)).alias("_words"))
    # Digits and wide characters follow the words; a pair across that seam is in no list.
    later = F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))
    words = cut.select(*item_key, F.inline(F.arrays_zip(F.col("_words").alias("_word"), later.alias("_next"))))
    bits, word, low = anchor_map(patterns), F.col("_word"), F.lower("_word")
    anchors = words.select(*item_key, F.explode(F.array(
        F.when(_held(bits, _place(low)), low),
        F.when(_held(bits, _place(low, " ")), F.concat(low, F.lit(" "), F.lower("_next"))),
        F.when(_held(bits, _place(word, "=")), F.concat(F.lit("="), word)),
    )).alias("anchor"))
    return anchors.filter("anchor IS NOT NULL")


def key_anchor(key: Column) -> Column:
    """An anchor present in every text the key can match: its first two whole ASCII words, its
    only one, else its first two wide characters."""
    words = F.transform(F.regexp_extract_all(key, F.lit(RUN), F.lit(0)), F.lower)
    wide = F.left(F.regexp_extract(F.lower(key), WIDE, 0), F.lit(2))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 2), " ")).otherwise(F.nullif(wide, F.lit("")))


def quoted(key: Column) -> Column:
    """The key as a literal inside a Java pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(key, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def watch_patterns(watchlist: DataFrame) -> DataFrame:
    """(ticker, pos, anchor, pattern): one row per alias, cleaned company name, bare ticker or digits.

    Where the anchor alone decides, `pattern` is null: a one-word name is a whole word of the
    text in any case, a ticker a whole word in capitals, a number a whole run of digits.
    """
    base = F.substring_index("ticker", ".", 1)
    name = F.trim(F.coalesce("name", F.lit("")))
    use_name = (F.length(name) >= 4) & (F.upper(name) != F.upper("ticker"))
    none = F.array().cast("array<string>")
    phrases = F.concat(F.coalesce("aliases", none), F.when(use_name, F.array(cut_legal_suffix(name))).otherwise(none))
    rule = lambda anchor, pattern: F.struct(anchor.alias("anchor"), pattern.cast("string").alias("pattern"))
    edged = lambda flags, key: F.concat(F.lit(f"{flags}(?<![A-Za-z0-9])"), key, F.lit("(?![A-Za-z0-9])"))
    loose = F.transform(
        F.filter(F.array_distinct(phrases), lambda k: F.length(k) >= 3),
        lambda k: rule(key_anchor(k), F.when(~k.rlike(f"^{RUN}$"), edged("(?iu)", quoted(k)))),
    )
    is_word = base.rlike(r"(?U)^\p{Alpha}{3,}$")
    letters = F.when(is_word, F.when(base.rlike("^[A-Z]+$"), rule(F.concat(F.lit("="), base), F.lit(None))).otherwise(
        rule(key_anchor(base), edged("", quoted(base)))))
    digits = F.when(base.rlike(r"^\d+$"), rule(F.concat(F.lit("#"), base), F.lit(None)))
    rules = F.array_compact(F.concat(loose, F.array(letters, digits)))
    return watchlist.select("ticker", "pos", F.explode(rules).alias("r")).select("ticker", "pos", "r.anchor", "r.pattern")


def tag_items(items: DataFrame, watchlist: DataFrame, item_key: list[str], limit: int = MAX_TAGS) -> DataFrame:
    """Items plus `watch`: up to `limit` tickers in watch-list order; null where none match. `item_key` names an item.

    Only keys and anchors that the list may hold travel through the join; the text is read
    again for the few items with a pattern that has to be tried and could still change the result.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    patterns = watch_patterns(watchlist).withColumnRenamed("pos", "_order")
    found = text_anchors(items, item_key, text, patterns).join(patterns, "anchor")
    hit = F.struct("_order", "ticker")
    grouped = found.groupBy(*item_key).agg(
        F.collect_set(F.when(F.col("pattern").isNull(), hit)).alias("_sure"),
        F.collect_set(F.when(F.col("pattern").isNotNull(), F.struct("_order", "ticker", "pattern"))).alias("_maybe"),
    )
    named = lambda m: F.struct(m["_order"].alias("_order"), m["ticker"].alias("ticker"))
    # What is sure already, or comes after `limit` sure ones, need not be tried.
    open_to = lambda sure: F.filter("_maybe", lambda m: ~F.array_contains(sure, named(m)) & (
        (F.size(sure) < limit) | (named(m) < F.get(sure, F.lit(limit - 1)))))
    both = F.transform(F.array(F.slice(F.sort_array("_sure"), 1, limit)), lambda sure: F.struct(sure.alias("_sure"), open_to(sure).alias("_maybe")))
    decided = written(grouped.select(*item_key, F.inline(both)))  # read three times
    opened = decided.filter(F.size("_maybe") > 0)
    # Only texts of items with a name to try are moved; those that share a bit with one are dropped by the join.
    place = F.pmod(F.xxhash64(*item_key), F.lit(BITS))
    texts = items.select(*item_key, text.alias("_text")).filter(_held(bit_map(opened.select(place)), place))
    met = F.filter("_maybe", lambda m: F.call_function("rlike", F.col("_text"), m["pattern"]))
    tried = texts.join(opened, item_key).select(*item_key, F.explode_outer(F.array_union("_sure", F.transform(met, named))).alias("_hit")).groupBy(
        *item_key).agg(F.slice(F.sort_array(F.collect_set("_hit")), 1, limit).alias("_hits"))
    settled = decided.filter(F.size("_maybe") == 0).select(*item_key, F.col("_sure").alias("_hits")).unionByName(tried)
    return items.join(settled, item_key, "left").withColumn("watch", F.when(F.size("_hits") > 0, F.col("_hits.ticker"))).drop("_hits")


def watch_order(watchlist: DataFrame) -> DataFrame:
    """Adds grade order and the priority flag: S, or A with at least three passed checks."""
    grade = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in ("S", "A", "B", "C")]), F.col("grade")), F.lit(0))
    return watchlist.withColumns({
        "grade_order": F.when(grade > 0, grade.cast("int") - 1).otherwise(9),
        "passed": F.coalesce("pass_count", F.lit(0)),
        "priority": F.coalesce(
            (F.col("grade") == "S") | ((F.col("grade") == "A") & (F.coalesce("pass_count", F.lit(0)) >= 3)), F.lit(False)
        ),
    })
