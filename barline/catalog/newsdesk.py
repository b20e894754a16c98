"""Registered queries: feeds, watch list, tagging, cleaning, de-duplication, calendars, documents."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barline.catalog import sql as s
from barline.catalog.registry import day, query
from barline.functions import dates, text
from barline.operators import feeds, similarity, tagging
from barline.operators.ranking import first_k
from barline.plans import documents as docs
from barline.plans import news
from barline.session import work_folder
from barline.sources import dims, readers, sinks
from barline.sources import driver_tables as t

# ---- feeds -----------------------------------------------------------------

FEEDS = """feeds AS (
  SELECT feed, n AS feed_pos, n % 13 + 6 AS max_items, [24, 48, 72, 168][n % 4 + 1] AS max_age_h, n % 5 = 0 AS longform
  FROM (SELECT DISTINCT source AS feed, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents))"""
ITEMS = f"""items AS (
  SELECT source AS feed, doc_id AS pos, text AS summary, CASE WHEN doc_id % 3 = 0 THEN 'Wire ' || (doc_id % 7) END AS inner_source,
    CASE WHEN doc_id % 101 = 0 THEN '' WHEN doc_id % 29 = 0 THEN 'Podcast: ' || head
         WHEN doc_id % 3 = 0 THEN head || ' - Wire ' || (doc_id % 7) ELSE head END AS title,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '{t.NEWS_EPOCH}' + to_minutes(CAST(doc_id * 10 AS INTEGER)) END AS published
  FROM (SELECT *, trim(split_part(text, chr(10), 1), ' ') AS head FROM documents))"""
NOW = f"(SELECT TIMESTAMP '{t.NEWS_EPOCH}' + to_minutes(CAST(max(doc_id) * 10 AS INTEGER)) FROM documents)"
FRESH = f"fresh AS (SELECT * FROM items JOIN feeds USING (feed) WHERE published IS NULL OR published >= {NOW} - to_hours(max_age_h))"
NOISE = s.lit(text.NOISE)
NAMED = f"named AS (SELECT * REPLACE (trim(title, ' ') AS title) FROM fresh WHERE length(trim(title, ' ')) > 0 AND NOT regexp_matches(title, {NOISE}))"
SQL_CLEAN = r"left(trim(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}\x0B]+', ' ', 'g'), ' '), 180)"
FIELDS = f"""fields AS (
  SELECT feed, feed_pos, pos, CASE WHEN inner_source IS NOT NULL AND ends_with(title, ' - ' || inner_source)
      THEN trim(left(title, length(title) - length(inner_source) - 3), ' ') ELSE title END AS title,
    {SQL_CLEAN.format('summary')} AS summary, coalesce(inner_source, feed) AS source, max_age_h > 72 AS weekly, longform, published, max_items FROM named)"""
CAPPED = "capped AS (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY feed ORDER BY pos) <= max_items)"
KEY = r"left(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+', '', 'g'), 60)"
FIRSTS = f"firsts AS (SELECT *, {KEY.format('title')} AS title_key FROM capped QUALIFY row_number() OVER (PARTITION BY {KEY.format('title')} ORDER BY feed_pos, pos) = 1)"
INGEST = [FEEDS, ITEMS, FRESH, NAMED, FIELDS, CAPPED, FIRSTS, f"ingested AS (SELECT * FROM firsts ORDER BY feed_pos, pos LIMIT {dims.RSS_TOTAL_CAP})"]


def news_now(spark, sf) -> datetime:
    """The time of the newest entry: the clock of these queries."""
    newest = t.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    return datetime.fromisoformat(t.NEWS_EPOCH) + timedelta(minutes=10 * newest)


def entries(spark, sf):
    return t.news_items(spark, sf).join(t.feeds(spark, sf), "feed")


def ingested(spark, sf):
    return news.ingest(t.news_items(spark, sf), t.feeds(spark, sf), news_now(spark, sf))


@query("feed_scan", s.with_("SELECT feed, feed_pos, max_items, max_age_h, longform FROM feeds", FEEDS))
def feed_scan(spark, sf):
    return t.feeds(spark, sf)


@query("feed_age_filter", s.with_("SELECT feed, pos FROM fresh", FEEDS, ITEMS, FRESH))
def feed_age_filter(spark, sf):
    return feeds.fresh_entries(entries(spark, sf), news_now(spark, sf)).select("feed", "pos")


@query("title_noise_filter", s.with_(
    f"SELECT feed, pos, trim(title, ' ') AS title FROM items WHERE length(trim(title, ' ')) > 0 AND NOT regexp_matches(title, {NOISE})", ITEMS))
def title_noise_filter(spark, sf):
    return feeds.clean_titles(t.news_items(spark, sf)).select("feed", "pos", "title")


@query("source_suffix_cut", s.with_("SELECT feed, pos, title, source FROM fields",
                                    FEEDS, ITEMS, "fresh AS (SELECT * FROM items JOIN feeds USING (feed))", NAMED, FIELDS))
def source_suffix_cut(spark, sf):
    return feeds.item_fields(feeds.clean_titles(entries(spark, sf))).select("feed", "pos", "title", "source")


@query("feed_top_n", s.with_("SELECT feed, pos, title FROM capped", *INGEST[:6]))
def feed_top_n(spark, sf):
    fresh = feeds.clean_titles(feeds.fresh_entries(entries(spark, sf), news_now(spark, sf)))
    return feeds.cap_per_feed(feeds.item_fields(fresh)).select("feed", "pos", "title")


@query("xfeed_first", s.with_(f"""
SELECT feed, pos, {KEY.format('title')} AS title_key FROM items JOIN feeds USING (feed)
QUALIFY row_number() OVER (PARTITION BY {KEY.format('title')} ORDER BY feed_pos, pos) = 1""", FEEDS, ITEMS))
def xfeed_first(spark, sf):
    return feeds.first_title_wins(entries(spark, sf)).select("feed", "pos", "title_key")


@query("title_key", s.with_(f"SELECT feed, pos, {KEY.format('title')} AS title_key FROM items", ITEMS))
def title_key(spark, sf):
    return t.news_items(spark, sf).select("feed", "pos", text.title_key(F.col("title")).alias("title_key"))


@query("clean_summary", f"SELECT page_id, {SQL_CLEAN.format('html')} AS summary FROM pages")
def clean_summary(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", text.clean_summary(F.col("html")).alias("summary"))


@query("news_ingest", s.with_(
    "SELECT feed, pos, title, summary, source, weekly, longform, strftime(published, '%Y-%m-%d %H:%M') AS published FROM ingested", *INGEST))
def news_ingest(spark, sf):
    return ingested(spark, sf).select("feed", "pos", "title", "summary", "source", "weekly", "longform",
                                      F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"))


@query("feed_counts", s.with_("SELECT feed, count(*) AS kept FROM firsts GROUP BY feed", *INGEST))
def feed_counts(spark, sf):
    return feeds.feed_counts(news.kept_entries(t.news_items(spark, sf), t.feeds(spark, sf), news_now(spark, sf)))


@query("group_by_feed", s.with_("""
SELECT feed, bool_or(weekly) AS weekly, count(*) AS n, string_agg(title, ' / ' ORDER BY pos) AS titles FROM ingested GROUP BY feed""", *INGEST))
def group_by_feed(spark, sf):
    grouped = feeds.group_by_feed(ingested(spark, sf))
    return grouped.select("feed", "weekly", F.size("items").cast("long").alias("n"),
                          F.array_join(F.transform("items", lambda i: i["title"]), " / ").alias("titles"))


# ---- watch list ------------------------------------------------------------

WATCH = """watch AS (
  SELECT base || '.X' AS ticker, CASE WHEN length(word) % 3 = 0 THEN word || ' Inc' ELSE word END AS name,
         ['S', 'A', 'B', 'C'][length(word) % 4 + 1] AS grade, length(word) % 5 AS pass_count, base AS pos, word,
         CASE WHEN length(word) % 2 = 0 THEN word || ' of' END AS alias
  FROM (SELECT upper(w) AS base, min(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM benchmark) GROUP BY 1))"""
# The boundary form of the patterns: the engine of this SQL has no lookaround.
KEYS = """keys AS (
  SELECT ticker, pos, '(?i)(^|[^A-Za-z0-9])' || word || '([^A-Za-z0-9]|$)' AS rx FROM watch
  UNION ALL SELECT ticker, pos, '(?i)(^|[^A-Za-z0-9])' || alias || '([^A-Za-z0-9]|$)' FROM watch WHERE alias IS NOT NULL
  UNION ALL SELECT ticker, pos, '(^|[^A-Za-z0-9])' || pos || '([^A-Za-z0-9]|$)' FROM watch)"""


def _tag_sql(source: str) -> str:
    return f"""SELECT feed, pos, array_to_string(list(ticker ORDER BY wpos)[1:4], ',') AS watch FROM (
      SELECT DISTINCT i.feed, i.pos, k.ticker, k.pos AS wpos FROM {source} i JOIN keys k ON regexp_matches(i.title || ' ' || i.summary, k.rx)) GROUP BY feed, pos"""


@query("watch_tag", s.with_(_tag_sql("ingested"), *INGEST, WATCH, KEYS))
def watch_tag(spark, sf):
    tagged = news.tag(ingested(spark, sf), t.watchlist(spark, sf), ["feed", "pos"])
    return tagged.filter("watch IS NOT NULL").select("feed", "pos", F.array_join("watch", ",").alias("watch"))


# Whole texts by their words: a name or ticker is a whole run of letters and digits, an alias two runs.
RUNS = """runs AS (
  SELECT feed, pos, regexp_extract_all(x, '[A-Za-z0-9]+') AS exact, regexp_extract_all(lower(x), '[a-z0-9]+') AS loose,
    list_transform(regexp_extract_all(lower(x), '[a-z0-9]+ of(?:[^a-z0-9]|$)'), lambda p: regexp_extract(p, '^[a-z0-9]+ of')) AS pairs
  FROM (SELECT feed, pos, title || ' ' || summary AS x FROM items)), met AS (
  SELECT feed, pos, 'x' || unnest(exact) AS key FROM runs UNION SELECT feed, pos, 'l' || unnest(loose) FROM runs
  UNION SELECT feed, pos, 'l' || unnest(pairs) FROM runs), names AS (
  SELECT ticker, pos AS wpos, 'x' || pos AS key FROM watch UNION SELECT ticker, pos, 'l' || lower(word) FROM watch
  UNION SELECT ticker, pos, 'l' || lower(alias) FROM watch WHERE alias IS NOT NULL)"""


@query("watch_tag_all", s.with_("""SELECT feed, pos, array_to_string(list(ticker ORDER BY wpos)[1:4], ',') AS watch FROM (
  SELECT DISTINCT feed, pos, ticker, wpos FROM met JOIN names USING (key)) GROUP BY feed, pos""", ITEMS, WATCH, RUNS))
def watch_tag_all(spark, sf):
    """Every feed entry with its whole text."""
    tagged = news.tag(t.news_items(spark, sf), t.watchlist(spark, sf), ["feed", "pos"])
    return tagged.filter("watch IS NOT NULL").select("feed", "pos", F.array_join("watch", ",").alias("watch"))


@query("watch_priority", s.with_("""
SELECT ticker, CAST(list_position(['S', 'A', 'B', 'C'], grade) - 1 AS INTEGER) AS grade_order, CAST(pass_count AS INTEGER) AS passed,
       grade = 'S' OR (grade = 'A' AND pass_count >= 3) AS priority FROM watch""", WATCH))
def watch_priority(spark, sf):
    return tagging.watch_order(t.watchlist(spark, sf)).select("ticker", "grade_order", F.col("passed").cast("int").alias("passed"), "priority")


@query("watch_doc_scan", s.with_("SELECT ticker, name, grade, CAST(pass_count AS INTEGER) AS pass_count FROM watch WHERE length(word) <> 9", WATCH))
def watch_doc_scan(spark, sf):
    row = F.struct(F.when(F.length("pos") != 9, F.col("ticker")).otherwise(" ").alias("ticker"), "name",
                   F.col("grade").alias("moat_grade"), F.col("pass_count").cast("int").alias("pass_count"))
    raw = t.watchlist(spark, sf).select(F.to_json(F.struct(F.lit("2024-06-01").alias("as_of"), F.array(row).alias("stocks"))).alias("doc"))
    parsed = raw.select(F.from_json("doc", "as_of string, stocks array<struct<ticker:string,name:string,moat_grade:string,pass_count:int>>").alias("d"))
    return readers.explode_watch_doc(parsed.select("d.*"))


SHEET = """sheet AS (
  SELECT c_custkey AS pos, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN 'Ticker' ELSE ' C' || (c_custkey % 20011) || ' ' END AS ticker,
         CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS sector FROM customer)"""


@query("watchlist_scan", s.with_("""
SELECT trim(ticker) AS ticker, min(pos) AS pos, arg_max(coalesce(sector, 'Unknown'), pos) AS sector FROM sheet
WHERE ticker IS NOT NULL AND ticker <> 'Ticker' AND length(trim(ticker)) <= 5 GROUP BY 1""", SHEET))
def watchlist_scan(spark, sf):
    key = F.col("c_custkey")
    ticker = F.when(key % 50 == 0, F.lit(None)).when(key % 50 == 1, "Ticker").otherwise(
        F.concat(F.lit(" C"), (key % 20011).cast("string"), F.lit(" ")))
    sheet = t.table(spark, sf, "customer").select(
        key.alias("pos"), ticker.alias("ticker"), F.when(key % 9 != 0, F.col("c_mktsegment")).alias("sector"))
    return readers.parse_watch_sheet(sheet)


@query("sector_dim", "SELECT 'N' || c_nationkey AS ticker, arg_min(c_mktsegment, c_custkey) AS sector FROM customer GROUP BY 1")
def sector_dim(spark, sf):
    members = t.table(spark, sf, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("ticker"), F.col("c_mktsegment").alias("sector"), F.col("c_custkey").alias("sector_pos"))
    return readers.first_sector(members)


@query("universe_union", s.with_("SELECT ticker, name, list FROM member1", "membership", "member1"))
def universe_union(spark, sf):
    return readers.first_membership(t.membership(spark, sf), dims.MEMBERSHIP_LISTS).select("ticker", "name", "list")


@query("sector_join", s.with_("SELECT ticker, coalesce(CASE WHEN pos % 9 <> 0 THEN sector END, 'Other') AS sector FROM universe", "universe"))
def sector_join(spark, sf):
    known = t.universe(spark, sf).filter(F.col("pos") % 9 != 0).select("ticker", "sector")
    names = t.table(spark, sf, "supplier").select(t.ticker_of(F.col("s_suppkey")).alias("ticker"))
    return names.join(known, "ticker", "left").select("ticker", F.coalesce("sector", F.lit("Other")).alias("sector"))


@query("distinct_in_order", "SELECT source, min(doc_id) AS pos FROM documents GROUP BY source")
def distinct_in_order(spark, sf):
    rows = t.table(spark, sf, "documents").select("source", F.col("doc_id").alias("pos"))
    return readers.distinct_in_order(rows, "source", "pos")


@query("snapshot_previous", s.with_(f"""
SELECT {s.day('dt')} AS as_of, ticker, {s.r('close', 4)} AS close FROM bars
WHERE dt = (SELECT max(dt) FROM bars WHERE dt < (SELECT max(dt) FROM bars))""", "bars"))
def snapshot_previous(spark, sf):
    from barline.plans.screener import newest_sessions

    bars = t.bars(spark, sf)
    today = newest_sessions(bars, 1)[0]
    rows = readers.newest_before(bars.withColumnRenamed("dt", "as_of"), F.lit(today))
    return rows.select(day("as_of").alias("as_of"), "ticker", F.round("close", 4).alias("close"))


# ---- cleaning --------------------------------------------------------------

BLOCKS = dims.NEWS_BLOCKS + [dims.REGIONAL_BLOCK] + dims.CLEAN_ONLY_BLOCKS


def _case(expr: str, values: list[str]) -> str:
    return "[" + ", ".join(s.lit(v) for v in values) + f"][{expr} + 1]"


NEWS = f"""news AS (
  SELECT *, CASE WHEN block = '{dims.REGIONAL_BLOCK}' THEN {_case('doc_id % 7', dims.NEWS_REGIONS)} END AS region FROM (
    SELECT doc_id, doc_id AS pos, source, DATE '2024-06-03' + CAST(doc_id % 4 AS INTEGER) AS as_of, {_case(f'doc_id % {len(BLOCKS)}', BLOCKS)} AS block,
      trim(split_part(text, chr(10), 1), ' ') || CASE doc_id % 19 WHEN 3 THEN '{t.HEAD_TAILS[3]}' WHEN 11 THEN '{t.HEAD_TAILS[11]}' ELSE '' END AS headline,
      text || {_case('doc_id % 5', t.BODY_TAILS)} AS body,
      CASE WHEN doc_id % 23 = 0 THEN 'n/a' ELSE strftime(DATE '2024-05-20' + CAST(doc_id % 20 AS INTEGER), '%Y-%m-%d') END AS source_date FROM documents))"""
CUTOFF = "2024-05-31"
UNDATED = ", ".join(s.lit(b) for b in dims.UNDATED_BLOCKS)
STALE = f"(block NOT IN ({UNDATED}) AND regexp_matches(source_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND source_date < '{CUTOFF}')"


@query("stale_filter", s.with_(f"SELECT pos, block, source_date FROM news WHERE NOT {STALE}", NEWS))
def stale_filter(spark, sf):
    rows = t.news_blocks(spark, sf)
    stale = ~F.col("block").isin(dims.UNDATED_BLOCKS) & text.is_stale(F.col("source_date"), F.lit(CUTOFF))
    return rows.filter(~stale).select("pos", "block", "source_date")


def _fix_sql(expr: str) -> str:
    for old, new in text.WORD_FIXES.items():
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


@query("word_fixes", s.with_(f"SELECT pos, {_fix_sql('body')} AS body FROM news", NEWS))
def word_fixes(spark, sf):
    return t.news_blocks(spark, sf).select("pos", text.fix_words(F.col("body")).alias("body"))


# The market-move rule without lookaround: subjects by name as they are; for capitals, the excluded ones are masked by
# as many small letters, and the boundary is consumed.
MOVES = "(上漲|下跌|大漲|大跌|走高|走低|收高|收低|飆漲|重挫|跳漲|急跌|持穩|站上|跌破|漲逾|跌逾|漲|跌)[^。；;]{0,6}?(\\d[\\d,.]*\\s?%|\\$\\s?\\d)"
SUBJECTS = text.MARKET_MOVE.split("|(?<![A-Za-z])", 1)[0] + ")"


def _moves(x: str) -> str:
    masked = f"regexp_replace({x}, '(^|[^A-Za-z])(CPI|PPI|GDP|PCE|PMI|ISM|NFP|EPS|ROE)', '\\1aaa', 'g')"
    capitals = "(^|[^A-Za-z])[A-Z]{2,6}([^A-Za-z。；;][^。；;]{0,29}?)?" + MOVES
    return f"(regexp_matches({x}, {s.lit(SUBJECTS + '[^。；;]{0,30}?' + MOVES)}) OR regexp_matches({masked}, {s.lit(capitals)}))"


def _headline(x: str) -> str:
    return f"({_moves(x)} AND NOT regexp_matches({x}, {s.lit(text.EVENT_WORDS)}))"


def _strip(x: str) -> str:
    parts = f"regexp_extract_all({x}, '[^。；;]*[。；;]|[^。；;]+$')"
    kept = f"list_filter({parts}, lambda p: NOT {_moves('p')})"
    return f"CASE WHEN len({kept}) = len({parts}) THEN {x} ELSE trim(array_to_string({kept}, ''), ' ' || chr(9) || chr(10) || chr(13)) END"


@query("market_headline_filter", s.with_(f"SELECT pos, headline FROM news WHERE NOT {_headline('headline')}", NEWS))
def market_headline_filter(spark, sf):
    return t.news_blocks(spark, sf).filter(~text.is_market_headline(F.col("headline"))).select("pos", "headline")


@query("market_sentence_strip", s.with_(f"SELECT pos, {_strip('body')} AS body FROM news", NEWS))
def market_sentence_strip(spark, sf):
    return t.news_blocks(spark, sf).select("pos", text.strip_market_sentences(F.col("body")).alias("body"))


FIXED = f"""fixed AS (SELECT *, {STALE} AS is_stale, {_fix_sql('headline')} AS head, {_fix_sql('body')} AS text_ FROM news),
flagged AS (SELECT *, NOT is_stale AND {_headline('head')} AS is_market, {_strip('text_')} AS cut FROM fixed)"""


@query("news_clean", s.with_("SELECT pos, block, region, head AS headline, cut AS body FROM flagged WHERE NOT is_stale AND NOT is_market", NEWS, FIXED))
def news_clean(spark, sf):
    return news.clean(t.news_blocks(spark, sf), F.lit(CUTOFF)).select("pos", "block", "region", "headline", "body")


@query("quality_counters", s.with_("""SELECT count(*) FILTER (WHERE is_stale) AS stale, count(*) FILTER (WHERE is_market) AS market_head,
  count(*) FILTER (WHERE NOT is_stale AND NOT is_market AND cut <> text_) AS market_sent FROM flagged""", NEWS, FIXED))
def quality_counters(spark, sf):
    return news.quality_counters(news.cleaning_flags(t.news_blocks(spark, sf), F.lit(CUTOFF)))


COUNT = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"


def _count_sql(expr: str, phrases: list[str]) -> str:
    return " + ".join(COUNT.format(expr, p, len(p)) for p in phrases)


GATE_TEXT = "repeat(text || ' EPS and revenue were reported. ' || CASE WHEN conv_id % 3 = 0 THEN 'No major earnings today. ' ELSE 'earnings rose. ' END, CAST(1 + turn % 4 AS INTEGER))"
_GW, _GN = _count_sql("low", text.EARNINGS_WORDS), _count_sql("low", text.EMPTY_PHRASES)


@query("content_gate", f"""
SELECT conv_id, turn, words, empties, length(low) >= 800 AND words >= 4 AND NOT (empties >= 2 AND words < 10) AS has_content FROM (
  SELECT *, CAST({_GW} AS INTEGER) AS words, CAST({_GN} AS INTEGER) AS empties FROM (SELECT conv_id, turn, lower({GATE_TEXT}) AS low FROM conversations))""")
def content_gate(spark, sf):
    tail = F.when(F.col("conv_id") % 3 == 0, "No major earnings today. ").otherwise("earnings rose. ")
    body = F.repeat(F.concat("text", F.lit(" EPS and revenue were reported. "), tail), (F.col("turn") % 4 + 1).cast("int"))
    rows = t.table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    low = F.lower("body")
    return rows.select("conv_id", "turn", text.count_phrases(low, text.EARNINGS_WORDS).alias("words"),
                       text.count_phrases(low, text.EMPTY_PHRASES).alias("empties"), text.has_earnings_content(F.col("body")).alias("has_content"))


@query("preview_release_filter", f"""
SELECT doc_id FROM (SELECT doc_id, lower(text || ['', ' It posted revenue.', ' It will report.', ' It reported, ahead of earnings.'][doc_id % 4 + 1]) AS low FROM documents)
WHERE regexp_matches(low, {s.lit('|'.join(text.RELEASED_PHRASES))}) AND NOT regexp_matches(low, {s.lit('|'.join(text.PREVIEW_PHRASES))})""")
def preview_release_filter(spark, sf):
    tails = F.array(*[F.lit(x) for x in ("", " It posted revenue.", " It will report.", " It reported, ahead of earnings.")])
    body = F.concat("text", F.element_at(tails, (F.col("doc_id") % 4 + 1).cast("int")))
    return t.table(spark, sf, "documents").filter(text.is_released_report(body)).select("doc_id")


@query("source_allowlist", "SELECT doc_id, source FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation) AND source NOT IN (SELECT 'src' || (r_regionkey * 3) FROM region)")
def source_allowlist(spark, sf):
    allow = t.table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("source"))
    deny = t.table(spark, sf, "region").select(F.concat(F.lit("src"), F.col("r_regionkey") * 3).alias("source"))
    return news.allowed_sources(t.table(spark, sf, "documents").select("doc_id", "source"), allow, deny)


# ---- similarity ------------------------------------------------------------

SQL_KEY = "headline || ' ' || left(body, 80)"
TOKENS = f"""toks AS MATERIALIZED (
  SELECT as_of, doc_id, block, region, pos, list_distinct(list_concat(
    list_transform(regexp_extract_all(k, '[A-Z][A-Za-z0-9&.\\-]{{1,}}'), lambda x: lower(x)),
    list_transform(regexp_extract_all(k, '\\$\\s?\\d[\\d,.]*\\s?[BMTK]?|\\d[\\d,.]*\\s?(?:億|兆|萬)'), lambda x: replace(x, ' ', '')),
    CASE WHEN length(c) >= 2 THEN list_filter(list_transform(range(1, length(c)), lambda i: substr(c, i, 2)),
      lambda g: NOT regexp_matches(g, '[{text.STOP_CHARS}]')) ELSE [] END)) AS toks
  FROM (SELECT *, array_to_string(regexp_extract_all(k, '[\\x{{4e00}}-\\x{{9fff}}]'), '') AS c FROM (SELECT *, {SQL_KEY} AS k FROM news)))"""


def keyed_news(spark, sf):
    return t.news_blocks(spark, sf).withColumn("tokens", news.dedup_key(F.col("headline"), F.col("body")))


@query("news_tokens", s.with_("SELECT doc_id AS pos, array_to_string(list_sort(toks), ' ') AS tokens FROM toks", NEWS, TOKENS))
def news_tokens(spark, sf):
    return keyed_news(spark, sf).select("pos", F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


# Greedy rule as a recursion over the items of a day in block order; the state is the kept list.
_WATCHED = dims.NEWS_BLOCKS + [dims.REGIONAL_BLOCK]
ORDERED = f"""ordered AS MATERIALIZED (
  SELECT as_of, doc_id, toks, row_number() OVER (PARTITION BY as_of ORDER BY list_position([{', '.join(s.lit(b) for b in _WATCHED)}], block),
    coalesce(list_position([{', '.join(s.lit(x) for x in dims.NEWS_REGIONS)}], region), 0), pos) AS n
  FROM toks WHERE block IN ({', '.join(s.lit(b) for b in _WATCHED)}))"""
PAIRS = """dups AS MATERIALIZED (
  SELECT a.as_of, a.n AS later, b.n AS earlier FROM ordered a JOIN ordered b ON a.as_of = b.as_of AND b.n < a.n AND len(a.toks) > 0 AND len(b.toks) > 0
  WHERE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.4::DOUBLE
     OR (len(list_filter(list_intersect(a.toks, b.toks), lambda x: regexp_matches(x, '^\\$|[億兆萬]'))) > 0
         AND len(list_filter(list_intersect(a.toks, b.toks), lambda x: regexp_matches(x, '^[a-z]'))) > 0))"""
GREEDY = """near AS (SELECT o.as_of, o.n, o.doc_id, coalesce(list(d.earlier) FILTER (WHERE d.earlier IS NOT NULL), []) AS before
  FROM ordered o LEFT JOIN dups d ON d.as_of = o.as_of AND d.later = o.n GROUP BY ALL),
walk AS (SELECT as_of, 1::BIGINT AS n, [1::BIGINT] AS kept FROM (SELECT DISTINCT as_of FROM ordered)
  UNION ALL SELECT w.as_of, x.n, CASE WHEN list_has_any(w.kept, x.before) THEN w.kept ELSE list_append(w.kept, x.n) END
  FROM walk w JOIN near x ON x.as_of = w.as_of AND x.n = w.n + 1),
ends AS (SELECT as_of, arg_max(kept, n) AS kept FROM walk GROUP BY as_of)"""


@query("news_dedup", s.with_(f"""SELECT o.doc_id AS pos FROM ordered o JOIN ends e ON e.as_of = o.as_of AND list_contains(e.kept, o.n)
UNION ALL SELECT pos FROM news WHERE block NOT IN ({', '.join(s.lit(b) for b in _WATCHED)})""", NEWS, TOKENS, ORDERED, PAIRS, GREEDY))
def news_dedup(spark, sf):
    """All blocks; those that are only cleaned pass through."""
    return news.dedup(t.news_blocks(spark, sf)).select("pos")


@query("duplicate_counter", s.with_(f"""SELECT (SELECT count(*) FROM ordered) - (SELECT sum(len(kept)) FROM ends) AS duplicates""",
                                    NEWS, TOKENS, ORDERED, PAIRS, GREEDY))
def duplicate_counter(spark, sf):
    blocks = t.news_blocks(spark, sf)
    return news.duplicate_counter(blocks, news.dedup(blocks)).select("duplicates")


@query("jaccard_against_previous", s.with_("""
SELECT pos, CAST(len(list_intersect(toks, p)) AS INTEGER) AS shared,
       CASE WHEN len(toks) + len(p) = 0 THEN NULL ELSE round(len(list_intersect(toks, p)) / len(list_distinct(list_concat(toks, p))), 6) END AS jaccard
FROM (SELECT pos, toks, lag(toks) OVER (PARTITION BY as_of ORDER BY pos) AS p FROM toks) WHERE p IS NOT NULL""", NEWS, TOKENS))
def jaccard_against_previous(spark, sf):
    """Each item against the one before it in its day: the similarity measure itself."""
    rows = keyed_news(spark, sf).select("as_of", "pos", "tokens")
    before = news.previous_value(rows, "as_of", "pos", "tokens", "p")
    return before.filter(F.col("p").isNotNull()).select(
        "pos", F.size(F.array_intersect("tokens", "p")).alias("shared"), F.round(similarity.jaccard(F.col("tokens"), F.col("p")), 6).alias("jaccard"))


@query("block_caps", s.with_("SELECT pos, block, region FROM news WHERE block NOT IN (" + ", ".join(s.lit(b) for b in dims.BLOCK_CAPS) + f""")
UNION ALL SELECT pos, block, region FROM (SELECT *, row_number() OVER (PARTITION BY as_of, block, region ORDER BY pos) AS n FROM news) WHERE n <= CASE block
{' '.join(f"WHEN '{b}' THEN {c}" for b, c in dims.BLOCK_CAPS.items())} END""", NEWS))
def block_caps(spark, sf):
    return news.cap_blocks(t.news_blocks(spark, sf)).select("pos", "block", "region")


@query("block_caps_code", s.with_("SELECT pos, block FROM news WHERE block <> 'world_news' UNION ALL "
                                  "SELECT pos, block FROM (SELECT * FROM news WHERE block = 'world_news' QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY pos) <= 3)", NEWS))
def block_caps_code(spark, sf):
    return news.cap_blocks(t.news_blocks(spark, sf), {"world_news": dims.CODE_CAPS["world_news"]}).select("pos", "block")


# ---- dates and calendars ---------------------------------------------------

@query("briefing_anchor", f"""
SELECT event_id, {s.day('d')} AS session_date, {s.day('d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER)')} AS weekday_session FROM (
  SELECT event_id, CAST(CASE WHEN hour(l) * 60 + minute(l) >= 1035 THEN CAST(l AS DATE) ELSE CAST(l AS DATE) - 1 END AS DATE) AS d
  FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events))""")
def briefing_anchor(spark, sf):
    local = F.convert_timezone(F.lit("UTC"), F.lit(dates.MARKET_ZONE), F.col("ts"))
    minute = F.hour(local) * 60 + F.minute(local)
    d = F.when(minute >= 17 * 60 + 15, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return t.table(spark, sf, "events").select("event_id", day(d).alias("session_date"), day(dates.session_date(F.col("ts"))).alias("weekday_session"))


@query("next_session", f"""
SELECT event_id, {s.day("d + CASE WHEN isodow(d) = 5 THEN 3 ELSE 1 END")} AS next_session FROM (
  SELECT event_id, d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER) AS d FROM (
    SELECT event_id, CAST(CASE WHEN hour(l) * 60 + minute(l) >= 1035 THEN CAST(l AS DATE) ELSE CAST(l AS DATE) - 1 END AS DATE) AS d
    FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events)))""")
def next_session(spark, sf):
    return t.table(spark, sf, "events").select("event_id", day(dates.next_session(F.col("ts"))).alias("next_session"))


@query("news_cutoff", f"""
SELECT o_orderkey, {s.day('d - CASE WHEN isodow(d) = 1 THEN 3 ELSE 2 END')} AS cutoff, 'W' || weekofyear(d) AS week,
  {s.day('d - 6')} AS week_start, CAST(year(d) * 100 + weekofyear(d) AS INTEGER) AS calendar_week
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def news_cutoff(spark, sf):
    d = F.to_date("o_orderdate")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", day(dates.news_cutoff(d)).alias("cutoff"), dates.week_label(d).alias("week"),
        day(F.date_sub(d, 6)).alias("week_start"), dates.iso_week_key(d, calendar_year=True).alias("calendar_week"))


@query("earnings_next_session", """
SELECT 'T' || o_custkey AS ticker, strftime(o_orderdate, '%Y-%m-%d') AS report_date, CASE WHEN o_orderkey % 24 < 12 THEN 'before-open' ELSE 'after-close' END AS timing
FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1999-07-06' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')""")
def earnings_next_session(spark, sf):
    watch = t.table(spark, sf, "customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(t.ticker_of(F.col("c_custkey")).alias("ticker"))
    now = datetime(1999, 7, 5, 22, 0)  # Monday 18:00 in the market zone
    out = news.upcoming_reports(t.earnings_calendar(spark, sf), watch, now)
    return out.withColumn("report_date", day("report_date"))


# ---- documents -------------------------------------------------------------

REPLY = "k int, tag string"


# Clean or mended replies, and their tags; the odd tag holds commas before brackets, an escaped quote and a brace.
REPLIES = r"""replies AS (
  SELECT event_id AS id, ts, user_id, event_id % 8 IN (3, 6) AS is_broken,
    CASE WHEN event_id % 8 NOT IN (3, 6) THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
    CASE WHEN event_id % 8 = 1 THEN 'x' WHEN event_id % 8 = 2 THEN 'y' WHEN event_id % 8 IN (4, 5, 7) THEN 'a ,] b ,} " }' END AS tag FROM events)"""


@query("json_parse", f"WITH {REPLIES} SELECT id, k, tag, is_broken FROM replies")
def json_parse(spark, sf):
    out = docs.parse_replies(t.raw_replies(spark, sf), REPLY)
    return out.select("id", F.when(~F.col("is_broken"), F.col("doc.k")).alias("k"), F.when(~F.col("is_broken"), F.col("doc.tag")).alias("tag"), "is_broken")


@query("with_defaults", f"WITH {REPLIES} SELECT id, coalesce(k, 0) AS k, coalesce(tag, 'none') AS tag, '無前日資料' AS verdict FROM replies")
def with_defaults(spark, sf):
    parsed = json_parse(spark, sf)
    filled = docs.with_defaults(parsed, {"k": F.lit(0), "tag": F.lit("none"), "verdict": F.lit("無前日資料")})
    return filled.select("id", "k", "tag", "verdict")


THEME_LIST = ", ".join(f"'{x}'" for x in dims.THEMES)


@query("theme_documents", f"""WITH {REPLIES}
SELECT {s.day('ts')} AS as_of, [{THEME_LIST}][user_id % {len(dims.THEMES)} + 1] AS theme, CAST(user_id % {len(dims.THEMES)} + 1 AS INTEGER) AS pos,
  arg_max(k, id) AS k, coalesce(arg_max_null(tag, id), '') AS week_summary, 0 AS flags FROM replies WHERE NOT is_broken GROUP BY 1, 2, 3""")
def theme_documents(spark, sf):
    """Written one folder per day and theme, read back with the schema checked."""
    made = docs.theme_documents(t.theme_replies(spark, sf), "k int, tag string").withColumn("week_summary", F.coalesce("tag", "week_summary"))
    folder = work_folder(spark, "themes")
    sinks.write_documents(made.drop("tag"), folder, "as_of", "theme")
    back = readers.read_theme_docs(spark, folder, "k int, week_summary string, risk_flags array<string>")
    return back.select(day("as_of").alias("as_of"), "theme", "pos", "k", "week_summary", F.size("risk_flags").alias("flags"))


@query("number_extract", r"SELECT doc_id, nullif(regexp_extract(doc_id || ' MOVE at ' || (n_chars % 1300) || '.5 now', '\b(\d{2,3}(?:\.\d+)?)\b', 1), '') AS number FROM documents")
def number_extract(spark, sf):
    phrase = F.concat(F.col("doc_id"), F.lit(" MOVE at "), F.col("n_chars") % 1300, F.lit(".5 now"))
    return t.table(spark, sf, "documents").select("doc_id", text.first_number(phrase).alias("number"))


@query("sources_extract", r"""
SELECT page_id, html AS answer, array_to_string(regexp_extract_all(repeat(url || ' ', CAST(page_id % 8 AS INTEGER)), 'https?://\S+')[1:5], ' ') AS sources FROM pages""")
def sources_extract(spark, sf):
    reply = F.concat("html", F.lit("\nSOURCES: "), F.repeat(F.concat("url", F.lit(" ")), (F.col("page_id") % 8).cast("int")))
    parts = t.table(spark, sf, "pages").select("page_id", text.split_sources(reply).alias("p"))
    return parts.select("page_id", "p.answer", F.array_join("p.sources", " ").alias("sources"))


@query("topic_extract", r"""
SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS topics FROM part""")
def topic_extract(spark, sf):
    reply = F.concat(F.lit("1. "), "p_name", F.lit(". 2. "), "p_brand", F.lit("\n3. "), "p_type", F.lit("\n4. other"))
    return t.table(spark, sf, "part").select("p_partkey", F.array_join(text.numbered_topics(reply), "|").alias("topics"))


REGIMES = f"""checks AS (
  SELECT as_of, call, review_day, metric, op, threshold FROM (
    SELECT dt AS as_of, CASE WHEN close < 20 THEN '偏多' ELSE '偏空' END AS call, close,
           (SELECT min(d.dt) FROM closes d WHERE d.dt > v.dt) AS review_day FROM closes v WHERE symbol = '^VIX') v,
    LATERAL (SELECT '^VIX' AS metric, '>' AS op, {s.r('close + 1', 2)} AS threshold UNION ALL SELECT 'HYG', '<', 78.0)),
hits AS (SELECT c.*, x.close AS today_value, coalesce(CASE WHEN op = '>' THEN x.close > threshold ELSE x.close < threshold END, false) AS hit
  FROM checks c LEFT JOIN closes x ON x.symbol = c.metric AND x.dt = c.review_day)"""


def _reviews(spark, sf):
    readings = t.closes(spark, sf).select(F.col("dt").alias("as_of"), F.col("symbol").alias("metric"), F.col("close").alias("value"))
    return docs.review_regime(t.regimes(spark, sf), readings)


@query("regime_review", s.with_(f"""
SELECT {s.day('as_of')} AS as_of, {s.day('review_day')} AS review_day, metric, op, threshold, today_value, hit FROM hits""", "instruments", "closes", REGIMES))
def regime_review(spark, sf):
    return _reviews(spark, sf).select(day("as_of").alias("as_of"), day("review_day").alias("review_day"), "metric", "op", "threshold", "today_value", "hit")


@query("regime_stored_review", s.with_(f"""
SELECT {s.day('as_of')} AS as_of, {s.day('review_day')} AS review_day, metric, op, threshold, today_value, hit FROM hits WHERE review_day IS NOT NULL""",
                                        "instruments", "closes", REGIMES))
def regime_stored_review(spark, sf):
    """Regimes written one folder per day, each day's predecessor looked up in what was read back, and reviewed."""
    folder = work_folder(spark, "regimes")
    sinks.write_regimes(t.regimes(spark, sf), folder)
    readings = t.closes(spark, sf).select(F.col("dt").alias("as_of"), F.col("symbol").alias("metric"), F.col("close").alias("value"))
    held = docs.regime_as_of(spark.read.parquet(folder), readings.select(F.col("as_of").alias("review_day")).distinct())
    checks = docs.review_regime(held.select("regime.*").dropDuplicates(["as_of"]), readings)
    return checks.select(day("as_of").alias("as_of"), day("review_day").alias("review_day"), "metric", "op", "threshold", "today_value", "hit")


@query("regime_verdict", s.with_(f"""
SELECT {s.day('as_of')} AS as_of, call, CASE WHEN bool_or(hit) THEN '被證偽' ELSE '延續' END AS verdict, count(*) FILTER (WHERE hit) AS hits
FROM hits GROUP BY as_of, call""", "instruments", "closes", REGIMES))
def regime_verdict(spark, sf):
    return docs.review_verdict(_reviews(spark, sf)).select(day("as_of").alias("as_of"), "call", "verdict", "hits")
