"""Building blocks of the check SQL (DuckDB dialect) for the registered queries."""

from __future__ import annotations

from barline.sources import dims
from barline.sources import driver_tables as dt


def r(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def pct(new: str, old: str) -> str:
    return f"(({new}) - ({old})) / nullif({old}, 0) * 100"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def with_(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(CTE.get(c, c) for c in ctes) + "\n" + body


def trend_case(a: str, b: str, c: str) -> str:
    return (f"CASE WHEN {a} > {b} AND {b} > {c} THEN '加速上升' WHEN {a} >= {b} AND {b} >= {c} THEN '穩定維持' "
            f"WHEN {a} < {b} AND {b} < {c} THEN '開始衰退' ELSE '震盪' END")


def bonus_case(a: str, b: str, c: str) -> str:
    return (f"CASE WHEN {a} > {b} AND {b} > {c} THEN 5 WHEN {a} >= {b} AND {b} >= {c} THEN 2 "
            f"WHEN {a} < {b} AND {b} < {c} THEN -5 ELSE 0 END")


def total(a: str, b: str, c: str) -> str:
    return f"least(100.0::DOUBLE, {a} * 0.2::DOUBLE + {b} * 0.3::DOUBLE + {c} * 0.5::DOUBLE + {bonus_case(a, b, c)})"


def share(value: str, by: str = "") -> str:
    part = f"{by}, " if by else ""
    body = f"CASE WHEN {value} IS NOT NULL THEN cume_dist() OVER (PARTITION BY {part}{value} IS NULL ORDER BY {value}) * 100 END"
    return r(body, 1)


def fmt_change(change: str, unit: str) -> str:
    bps = f"printf('%.0f', {r(f'abs({change})', 0)}) || 'bps'"
    pc = f"printf('%.2f', {r(f'abs({change})', 2)}) || '%'"
    return (f"coalesce(CASE WHEN {change} > 0 THEN '▲ ' ELSE '▼ ' END || "
            f"CASE WHEN {unit} = 'bps' THEN {bps} ELSE {pc} END, '—')")


def fmt_signed(change: str, digits: int) -> str:
    rounded = r(f"abs({change})", digits)
    return f"coalesce(CASE WHEN {change} < 0 THEN '-' ELSE '+' END || printf('%.{digits}f', {rounded}) || '%', '—')"


def three(v: str, up: str, down: str, drift: str | None = None) -> str:
    extra = f"WHEN {v}[-1] < {v}[-3] THEN '{drift}' " if drift else ""
    return (f"CASE WHEN len({v}) < 3 THEN '震盪' WHEN {v}[-1] > {v}[-2] AND {v}[-2] > {v}[-3] THEN '{up}' "
            f"WHEN {v}[-1] < {v}[-2] AND {v}[-2] < {v}[-3] THEN '{down}' {extra}ELSE '震盪' END")


_UNIT = "l_extendedprice / l_quantity"
_SPAN_ROWS = [
    (row[0], row[1], row[2], row[3], row[4], row[5], row[6], row[7], row[8], row[9],
     *dt.SERIES_RANGE.get(row[1], dt.DEFAULT_RANGE))
    for row in dims.instrument_rows()
]

CTE: dict[str, str] = {
    "bars": f"""bars AS (
  SELECT 'T' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS dt,
         first({_UNIT} ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max({_UNIT}) AS high, min({_UNIT}) AS low,
         last({_UNIT} ORDER BY l_orderkey, l_linenumber, l_partkey) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))""",
    "smooth": f"""smooth AS (
  SELECT ticker, dt, volume, {r('avg(high) OVER w', 4)} AS high, {r('avg(low) OVER w', 4)} AS low, {r('avg(close) OVER w', 4)} AS close
  FROM (SELECT ticker, dt, volume, round(high * 10000) / 10000 AS high, round(low * 10000) / 10000 AS low, round(close * 10000) / 10000 AS close FROM bars) WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""",
    "bench": f"bench AS (SELECT dt, {r('avg(close)', 4)} AS close FROM bars GROUP BY dt)",
    "sbench": f"bench AS (SELECT dt, {r('avg(close)', 4)} AS close FROM smooth GROUP BY dt)",
    "bench13": f"""bench13 AS (
  SELECT {pct('close', 'lag(close, 62) OVER (ORDER BY dt)')} AS bench_13w FROM bench ORDER BY dt DESC LIMIT 1)""",
    "universe": """universe AS (
  SELECT 'T' || s_suppkey AS ticker, r_name AS sector, s_suppkey AS pos
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "membership": f"""membership AS (
  SELECT 'T' || s_suppkey AS ticker, s_suppkey AS pos, l.list, s_name || '@' || l.list AS name, l.precedence
  FROM supplier, (VALUES ('{dims.MEMBERSHIP_LISTS[0]}', 0), ('{dims.MEMBERSHIP_LISTS[1]}', 1), ('{dims.MEMBERSHIP_LISTS[2]}', 2)) l(list, precedence)
  WHERE (precedence = 0 AND s_suppkey % 3 = 0) OR (precedence = 1 AND s_suppkey % 2 = 0)
     OR (precedence = 2 AND (s_suppkey % 3 <> 0 OR s_suppkey % 5 = 0)))""",
    "instruments": values("instruments", "symbol_no, key, symbol, label, prefix, category, pool, invert, use_bps, pos, base, span", _SPAN_ROWS),
    "closes": f"""closes AS (
  SELECT symbol, dt, {r('base + price % span', 4)} AS close FROM (
    SELECT l_partkey % {len(_SPAN_ROWS)} AS symbol_no, CAST(l_shipdate AS DATE) AS dt,
           last({_UNIT} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS price
    FROM lineitem GROUP BY 1, 2) JOIN instruments USING (symbol_no))""",
    "weekly": """weekly AS (
  SELECT symbol, CAST(date_trunc('week', dt) AS DATE) AS dt, arg_max(close, dt) AS close FROM closes GROUP BY 1, 2)""",
    "lines": f"""lines AS (
  SELECT series, strftime(dt, '%Y-%m-%d') AS ds,
         CASE WHEN day(dt) % 7 = 0 THEN NULL WHEN series = 'nfci' THEN {r('total % 2 - 1', 3)} ELSE total END AS value, dt
  FROM (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dt.MACRO_EVENTS.items())} END AS series,
               CAST(ts AS DATE) AS dt, {r('sum(value)', 2)} AS total FROM events GROUP BY 1, 2))""",
    "returns": f"""returns AS (
  SELECT ticker, dt, close, {pct('close', 'lag(close, 4) OVER w')} AS ret_1w, {pct('close', 'lag(close, 20) OVER w')} AS ret_4w,
         {pct('close', 'lag(close, 62) OVER w')} AS ret_13w, row_number() OVER w AS n_bars
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt))""",
    "sreturns": f"""returns AS (
  SELECT ticker, dt, close, {pct('close', 'lag(close, 4) OVER w')} AS ret_1w, {pct('close', 'lag(close, 20) OVER w')} AS ret_4w,
         {pct('close', 'lag(close, 62) OVER w')} AS ret_13w, row_number() OVER w AS n_bars
  FROM smooth WINDOW w AS (PARTITION BY ticker ORDER BY dt))""",
    # names without a bar in the last 300 days are gone
    "today": """today AS (SELECT * FROM (SELECT * FROM returns QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) = 1)
  WHERE dt >= (SELECT max(dt) FROM returns) - 300)""",
    "raw": f"""raw AS (
  SELECT *, {share('ret_1w')} AS raw_1w, {share('ret_4w')} AS raw_4w, {share('ret_13w')} AS raw_13w FROM today)""",
    # as-of fill over all sessions and the smoothed chain
    "cal": "cal AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS seq FROM (SELECT DISTINCT dt AS as_of FROM bars))",
    "grid": """grid AS (
  SELECT c.as_of, c.seq, x.ticker, x.close, x.ret_1w, x.ret_4w, x.ret_13w, x.n_bars
  FROM cal c JOIN (SELECT *, lead(dt) OVER (PARTITION BY ticker ORDER BY dt) AS nxt FROM returns) x
    ON c.as_of >= x.dt AND c.as_of <= x.dt + 300 AND (x.nxt IS NULL OR c.as_of < x.nxt))""",
    "graw": f"""graw AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY seq) AS k FROM (
    SELECT *, {share('ret_1w', 'as_of')} AS raw_1w, {share('ret_4w', 'as_of')} AS raw_4w, {share('ret_13w', 'as_of')} AS raw_13w
    FROM grid) WHERE n_bars >= 150)""",
    "ema": f"""ema AS (
  SELECT ticker, k, seq, raw_1w AS rs_1w, raw_4w AS rs_4w, raw_13w AS rs_13w FROM graw WHERE k = 1
  UNION ALL
  SELECT g.ticker, g.k, g.seq,
         CASE WHEN g.seq = e.seq + 1 THEN {r('e.rs_1w * 0.8::DOUBLE + g.raw_1w * 0.2::DOUBLE', 1)} ELSE g.raw_1w END,
         CASE WHEN g.seq = e.seq + 1 THEN {r('e.rs_4w * 0.8::DOUBLE + g.raw_4w * 0.2::DOUBLE', 1)} ELSE g.raw_4w END,
         CASE WHEN g.seq = e.seq + 1 THEN {r('e.rs_13w * 0.8::DOUBLE + g.raw_13w * 0.2::DOUBLE', 1)} ELSE g.raw_13w END
  FROM ema e JOIN graw g ON g.ticker = e.ticker AND g.k = e.k + 1)""",
    # contraction score at the newest two sessions
    "days": "days AS (SELECT as_of FROM (SELECT DISTINCT dt AS as_of FROM smooth) ORDER BY as_of DESC LIMIT 2)",
    "marked": """marked AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
         high = max(high) OVER h AND count(high) OVER h = 16 AS is_high, row_number() OVER w AS n_bars
  FROM smooth WINDOW w AS (PARTITION BY ticker ORDER BY dt),
       h AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 5 FOLLOWING))""",
    "asof_rows": """asof_rows AS MATERIALIZED (
  SELECT m.*, d.as_of, row_number() OVER (PARTITION BY ticker, d.as_of ORDER BY dt DESC) AS back
  FROM marked m JOIN days d ON m.dt <= d.as_of QUALIFY back <= 200)""",
    "measures": """measures AS MATERIALIZED (
  SELECT ticker, as_of, max(n_bars) AS n_bars, max(CASE WHEN back = 1 THEN close END) AS price,
         avg(CASE WHEN back <= 150 THEN close END) AS ma150, avg(close) AS ma200,
         avg(CASE WHEN back <= 10 THEN tr END) AS atr10, avg(CASE WHEN back <= 60 THEN tr END) AS atr60,
         avg(CASE WHEN back <= 10 THEN volume END) AS vol10, avg(CASE WHEN back <= 60 THEN volume END) AS vol60,
         max(CASE WHEN back <= 10 THEN high END) AS high10, min(CASE WHEN back <= 10 THEN low END) AS low10,
         list([{'b': back, 'v': high}] ORDER BY back DESC) FILTER (WHERE is_high AND back BETWEEN 6 AND 80) AS marks
  FROM asof_rows GROUP BY ticker, as_of HAVING max(n_bars) >= 150)""",
    "merged": """merged AS MATERIALIZED (
  SELECT ticker, as_of, CASE WHEN marks IS NULL THEN NULL ELSE list_reduce(marks, lambda a, x:
    CASE WHEN a[-1].b - x[1].b < 10 THEN CASE WHEN x[1].v > a[-1].v THEN list_concat(a[:-2], x) ELSE a END
         ELSE list_concat(a, x) END) END AS highs FROM measures)""",
    "legs": """legs AS (
  SELECT ticker, as_of, i, highs[i] AS h, highs[i + 1] AS n FROM (
    SELECT *, unnest(range(1, len(highs))) AS i FROM merged WHERE len(highs) >= 2))""",
    "pullbacks": """pullbacks AS MATERIALIZED (
  SELECT ticker, as_of, i, depth, low, vol, row_number() OVER w AS k, row_number() OVER (PARTITION BY ticker, as_of ORDER BY i DESC) AS kb
  FROM (
    SELECT l.ticker, l.as_of, l.i, (l.h.v - m.low) / l.h.v * 100 AS depth, m.low,
           (SELECT avg(b.volume) FROM asof_rows b WHERE b.ticker = l.ticker AND b.as_of = l.as_of AND b.back <= l.h.b AND b.back >= m.low_back) AS vol
    FROM legs l JOIN (
      SELECT l.ticker, l.as_of, l.i, min(b.low) AS low, arg_min(b.back, {'l': b.low, 'o': -b.back}) AS low_back
      FROM legs l JOIN asof_rows b ON b.ticker = l.ticker AND b.as_of = l.as_of AND b.back <= l.h.b AND b.back > l.n.b
      GROUP BY 1, 2, 3) m USING (ticker, as_of, i))
  WHERE depth >= 3 WINDOW w AS (PARTITION BY ticker, as_of ORDER BY i))""",
    "pb": """pb AS (
  SELECT ticker, as_of, count(*) AS n, max(CASE WHEN kb = 1 THEN depth END) AS last_depth,
         bool_and(depth < pd) AS falling_depths, bool_and(low > pl) AS rising_lows, bool_and(vol < pv) AS falling_volumes
  FROM (SELECT *, lag(depth) OVER w AS pd, lag(low) OVER w AS pl, lag(vol) OVER w AS pv FROM pullbacks
        WINDOW w AS (PARTITION BY ticker, as_of ORDER BY i)) GROUP BY 1, 2)""",
    "vcp_in": """vcp_in AS (
  SELECT m.*, coalesce(p.n, 0) AS n, last_depth, CASE WHEN p.n >= 2 THEN falling_depths END AS falling_depths,
         CASE WHEN p.n >= 2 THEN rising_lows END AS rising_lows, CASE WHEN p.n >= 2 THEN falling_volumes END AS falling_volumes,
         price > ma150 AND ma150 > ma200 AS trend_ok, (g.highs[-1].v - price) / g.highs[-1].v * 100 AS distance,
         CASE WHEN atr60 > 0 THEN atr10 / atr60 ELSE 1.0 END AS atr_ratio
  FROM measures m JOIN merged g USING (ticker, as_of) LEFT JOIN pb p USING (ticker, as_of))""",
    "vcp": f"""vcp AS MATERIALIZED (
  SELECT ticker, as_of, {r('''greatest(0.0::DOUBLE, least(100.0::DOUBLE,
           CASE WHEN trend_ok THEN 20 ELSE 0 END
         + CASE WHEN n BETWEEN 2 AND 4 THEN 20 WHEN n = 1 THEN 8 WHEN n > 4 THEN 10 ELSE 0 END
         + CASE WHEN falling_depths THEN 15 ELSE 0 END + CASE WHEN rising_lows THEN 15 ELSE 0 END
         + CASE WHEN falling_volumes THEN 10 ELSE 0 END
         + CASE WHEN last_depth < 4 THEN 15 WHEN last_depth < 6 THEN 10 WHEN last_depth < 10 THEN 5 ELSE 0 END
         + CASE WHEN distance IS NULL THEN 0 WHEN distance < 3 THEN 15 WHEN distance < 5 THEN 10 WHEN distance < 10 THEN 5 ELSE -5 END
         + CASE WHEN atr_ratio < 0.5 THEN 10 WHEN atr_ratio < 0.7 THEN 5 ELSE 0 END))''', 1)} AS contraction_score,
         CAST(n AS INTEGER) AS vcp_pullback_count, {r('last_depth', 1)} AS last_pullback_pct, {r('distance', 1)} AS dist_from_high_pct,
         rising_lows, trend_ok, {r('(1 - atr_ratio) * 100', 1)} AS atr_contraction,
         {r('(high10 - low10) / nullif(price, 0) * 100', 2)} AS price_range_pct,
         CASE WHEN vol60 > 0 THEN {r('vol10 / vol60', 2)} ELSE 1.0 END AS volume_ratio
  FROM vcp_in)""",
    "ma": "ma AS (SELECT ticker, as_of, avg(close) AS ma200 FROM asof_rows GROUP BY 1, 2 HAVING count(*) >= 200)",
    "rs2": f"""rs2 AS (
  SELECT e.ticker, g.as_of, g.close, g.ret_13w, e.rs_1w, e.rs_4w, e.rs_13w, {trend_case('rs_1w', 'rs_4w', 'rs_13w')} AS rs_trend,
         {total('rs_1w', 'rs_4w', 'rs_13w')} AS rs_total, {r(total('rs_1w', 'rs_4w', 'rs_13w'), 1)} AS rs_score
  FROM ema e JOIN graw g ON g.ticker = e.ticker AND g.k = e.k WHERE g.as_of IN (SELECT as_of FROM days))""",
    "us": f"""us AS (
  SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY combined_score DESC, ticker) AS rank FROM (
    SELECT as_of, ticker, coalesce(sector, 'Other') AS sector, rs_score, rs_trend, rs_1w, rs_4w, rs_13w, contraction_score,
           vcp_pullback_count, last_pullback_pct, dist_from_high_pct, rising_lows,
           {r('rs_score * 0.6::DOUBLE + contraction_score * 0.4::DOUBLE', 1)} AS combined_score, {r('close', 2)} AS price,
           {r('ret_13w', 2)} AS return_63d, {r(pct('close', 'ma200'), 2)} AS vs_200ma_pct, atr_contraction, price_range_pct, volume_ratio
    FROM rs2 JOIN vcp USING (ticker, as_of) LEFT JOIN ma USING (ticker, as_of) LEFT JOIN universe USING (ticker)))""",
    "member1": """member1 AS (
  SELECT ticker, name, list FROM membership QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY precedence) = 1)""",
    "tw": f"""tw AS (
  SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY combined_score DESC, ticker) AS rank FROM (
    SELECT as_of, ticker, name, list AS etf, rs_score, rs_1w, rs_4w, rs_13w, rs_trend, coalesce(contraction_score, 50.0) AS contraction_score,
           {r('rs_total * 0.6::DOUBLE + coalesce(contraction_score, 50.0) * 0.4::DOUBLE', 1)} AS combined_score, {r('close', 1)} AS price,
           {r(pct(r('close', 1), 'ma200'), 2)} AS vs_200ma_pct, vcp_pullback_count, last_pullback_pct, dist_from_high_pct, rising_lows, volume_ratio
    FROM rs2 LEFT JOIN vcp USING (ticker, as_of) LEFT JOIN ma USING (ticker, as_of) JOIN member1 USING (ticker)))""",
}

SCREEN = ["bars", "smooth", "sreturns", "cal", "grid", "graw", "ema", "days", "marked", "asof_rows", "measures",
          "merged", "legs", "pullbacks", "pb", "vcp_in", "vcp", "ma", "rs2"]


def changed(source: str) -> str:
    """Latest session of a ranked table with the change since the session before."""
    return f"""chg AS (
  SELECT t.*, p.rank - t.rank AS rank_change,
         CASE WHEN p.rank IS NULL THEN '新進' WHEN p.rank > t.rank THEN '↑' || (p.rank - t.rank)
              WHEN p.rank < t.rank THEN '↓' || (t.rank - p.rank) ELSE '—' END AS rank_change_str
  FROM {source} t LEFT JOIN (SELECT ticker, rank FROM {source} WHERE as_of = (SELECT min(as_of) FROM days)) p USING (ticker)
  WHERE t.as_of = (SELECT max(as_of) FROM days))"""


def points(weekly: bool = False) -> str:
    if weekly:
        return """points AS (
  SELECT symbol, coalesce(b.c1, last_all) AS new, coalesce(b.c0, first_all) AS old FROM (
    SELECT symbol, max(CASE WHEN n >= 2 THEN {'w': w, 'c0': c0, 'c1': c1} END) AS b, arg_min(c0, d0) AS first_all, arg_max(c1, d1) AS last_all
    FROM (SELECT symbol, date_trunc('week', dt) AS w, min(dt) AS d0, max(dt) AS d1, arg_min(close, dt) AS c0, arg_max(close, dt) AS c1, count(*) AS n
          FROM closes WHERE isodow(dt) <= 5 GROUP BY 1, 2) GROUP BY symbol))"""
    return """points AS (
  SELECT symbol, max(dt) AS data_date, max(CASE WHEN rn = 1 THEN close END) AS new, max(CASE WHEN rn = 2 THEN close END) AS old
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM closes) WHERE rn <= 2 GROUP BY symbol)"""


READINGS = f"""readings AS (
  SELECT *, CASE WHEN change IS NULL THEN 'neu' WHEN (change > 0) <> invert THEN 'pos' ELSE 'neg' END AS dir,
         coalesce(prefix || format('{{:,.2f}}', {r('value', 2)}), '—') AS val_str, {fmt_change('change', 'unit')} AS chg_str FROM (
    SELECT i.*, new AS value, CASE WHEN use_bps THEN 'bps' ELSE 'pct' END AS unit,
           CASE WHEN use_bps THEN (new - old) * 100 ELSE {pct('new', 'old')} END AS change
    FROM instruments i LEFT JOIN points USING (symbol)))"""
PICKS = """picks AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY pool ORDER BY coalesce(abs(change), 0) DESC, pos) AS place
    FROM readings WHERE pool IS NOT NULL AND (pool = 'sector' OR value IS NOT NULL))
  WHERE place <= CASE WHEN pool = 'sector' THEN 3 ELSE 2 END)"""
PAIR_ITEMS = ",\n".join([
    values("pairs", "key, category, kind, lhs, rhs, label, pos", dims.PAIRS),
    f"""pair_items AS (
  SELECT category, pos, key, label, value, change, unit,
         CASE WHEN kind = 'ratio' THEN CASE WHEN change > 0 THEN 'pos' WHEN change < 0 THEN 'neg' ELSE 'neu' END
              WHEN value IS NULL THEN 'neu' WHEN value > 0 THEN 'pos' ELSE 'neg' END AS dir,
         coalesce(CASE WHEN kind = 'ratio' THEN printf('%.4f', {r('value', 4)}) ELSE printf('%.2f', {r('value', 2)}) || '%' END, '—') AS val_str,
         {fmt_change('change', 'unit')} AS chg_str
  FROM (SELECT *, CASE WHEN kind = 'ratio' THEN {pct('value', 'before')} ELSE (value - before) * 100 END AS change,
               CASE WHEN kind = 'ratio' THEN 'pct' ELSE 'bps' END AS unit FROM (
    SELECT p.*, CASE WHEN kind = 'ratio' THEN a.new / nullif(b.new, 0) ELSE a.new - b.new END AS value,
           CASE WHEN kind = 'ratio' THEN a.old / nullif(b.old, 0) ELSE a.old - b.old END AS before
    FROM pairs p LEFT JOIN points a ON a.symbol = lhs LEFT JOIN points b ON b.symbol = rhs)))""",
])
ITEMS = f"""items AS (
  SELECT category, pos, key, label, {r('value', 4)} AS value, {r('change', 4)} AS change, unit, dir, is_dynamic, val_str, chg_str FROM (
    SELECT category, pos, key, label, value, change, unit, dir, false AS is_dynamic, val_str, chg_str FROM readings
      WHERE pool IS NULL AND category <> 'ratio_leg'
    UNION ALL SELECT category, 100 + place, key, label, value, change, unit, dir, true, val_str, chg_str FROM picks
    UNION ALL SELECT category, pos, key, label, value, change, unit, dir, false, val_str, chg_str FROM pair_items))"""
