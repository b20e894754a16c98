"""Quality metrics from quote fields and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.numeric import ratio, rnd

DEFAULT_TAX = 0.21
# Statement lines read, by output column.
LINES = {"op_income": "Operating Income", "invested": "Invested Capital", "tax": "Tax Rate For Calcs"}


def latest_lines(statements: DataFrame) -> DataFrame:
    """Newest value of each needed statement line per ticker."""
    newest = lambda item: F.max_by(
        F.when(F.col("line_item") == item, F.col("value")),
        F.when(F.col("line_item") == item, F.struct("period_end", "seq")),
    )
    return statements.filter(F.col("line_item").isin(*LINES.values())).groupBy("ticker").agg(
        *[newest(item).alias(name) for name, item in LINES.items()]
    )


def metrics(info: DataFrame, statements: DataFrame) -> DataFrame:
    """Growth, margins and return on capital (with the source it came from)."""
    rows = info.join(latest_lines(statements), "ticker", "left")
    trail, nxt = F.col("trailing_eps"), F.col("eps_next_yr")
    roic = F.when(
        F.col("invested") > 0,
        ratio(F.col("op_income") * (1 - F.coalesce("tax", F.lit(DEFAULT_TAX))), F.col("invested")) * 100,
    )
    pct = lambda c: rnd(F.col(c) * 100, 1)
    fcf = F.when((F.col("total_revenue") > 0) & (F.col("free_cashflow") != 0),
                 ratio(F.col("free_cashflow"), F.col("total_revenue")) * 100)
    return rows.select(
        "ticker", rnd(trail, 2).alias("eps_ttm"), rnd(F.col("forward_eps"), 2).alias("eps_fwd"),
        rnd(nxt, 2).alias("eps_next_yr"),
        rnd(F.when((trail > 0) & (rnd(nxt, 2) > 0), (F.sqrt(ratio(rnd(nxt, 2), trail)) - 1) * 100), 1).alias("eps_cagr_2y"),
        rnd(fcf, 1).alias("fcf_margin"),
        rnd(F.coalesce(roic, F.col("roe") * 100, F.col("roa") * 100), 1).alias("roic"),
        F.when(roic.isNotNull(), "ROIC").when(F.col("roe").isNotNull(), "ROE")
        .when(F.col("roa").isNotNull(), "ROA").alias("roic_source"),
        pct("op_margin").alias("op_margin"), pct("gross_margin").alias("gross_margin"), pct("rev_growth").alias("rev_growth"),
    )


def fund_metrics(info: DataFrame) -> DataFrame:
    """The short set shown for funds; zeros read as missing."""
    shown = lambda c, d: rnd(F.nullif(c, F.lit(0.0)), d).alias(c)
    return info.select("ticker", shown("pe", 1), shown("div_yield", 2), shown("beta", 2))


def enrich(top: DataFrame, facts: DataFrame) -> DataFrame:
    """Left join after the limit, so the facts side is read for a short list only."""
    return top.join(facts, "ticker", "left")


def material_releases(info: DataFrame) -> DataFrame:
    """Large companies, and mid-sized ones whose result surprised."""
    cap = F.col("market_cap_b")
    surprise = F.abs(ratio(F.col("forward_eps") - F.col("eps_next_yr"), F.col("forward_eps")) * 100) >= 20
    return info.filter((cap >= 40) | ((cap >= 10) & F.coalesce(surprise, F.lit(False))))
