"""Threshold rules of the dashboards. Labels and limits are fixed values; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fear_greed_band(score: Column) -> Column:
    return (
        F.when(score <= 25, "extreme_fear").when(score <= 45, "fear").when(score <= 55, "neutral")
        .when(score <= 75, "greed").when(score > 75, "extreme_greed")
    )


def tail_tag(skew: Column) -> Column:
    return F.when(skew > 140, "尾部風險")


def vol_tag(vvix: Column) -> Column:
    return F.when(vvix > 120, "高波動")


def short_panic_tag(vix: Column, vix9d: Column, strict: bool = False) -> Column:
    """Daily: gaps below 1 are silent. `strict` (weekly) asks for more than 1 either way."""
    gap = vix9d - vix
    if strict:
        return F.when(gap < -1, "短期恐慌").when(gap > 1, "持續風險")
    return F.when(F.abs(gap) < 1, F.lit(None)).when(gap < 0, "短期恐慌").when(gap > 0, "持續風險")


def move_band(move: Column) -> Column:
    return F.when(move > 120, "high").when(move >= 80, "elevated").when(move < 80, "calm")


def is_inverted(us2y: Column, us10y: Column) -> Column:
    return us2y > us10y


def curve_tag(spread: Column) -> Column:
    return F.when(spread < -0.1, "倒掛").when(spread > 0.1, "正常").when(spread.isNotNull(), "趨平")


def mega_cap_tag(ndx: Column, nyfang: Column) -> Column:
    return F.when((ndx < 0) & (nyfang < ndx), "科技巨頭領跌").when((ndx < 0) & (nyfang > ndx), "巨頭相對抗跌")


def breadth_tag(rsp_spy: Column) -> Column:
    return F.when(rsp_spy > 0, "市場變寬").when(rsp_spy < 0, "市場集中")


def small_cap_tag(iwm_spy: Column) -> Column:
    return F.when(iwm_spy > 0, "小型股強").when(iwm_spy < 0, "大型股主導")


def nfci_band(nfci: Column) -> Column:
    return (
        F.when(nfci > 0.5, "金融條件偏緊").when(nfci > 0, "略偏緊").when(nfci > -0.5, "neutral")
        .when(nfci <= -0.5, "金融條件寬鬆")
    )


def credit_spread_label(hyg_lqd_change: Column) -> Column:
    """The arrow is down for a zero change."""
    return F.when(hyg_lqd_change > 0, "↑利差收窄").when(hyg_lqd_change <= 0, "↓利差擴大")


def capital_label(direction: Column) -> Column:
    return F.when(direction == "pos", "寬鬆").when(direction == "neg", "收緊").otherwise("中性")


def rs_band(rs: Column) -> Column:
    return F.when(rs >= 80, "strong").when(rs >= 60, "fair").when(rs < 60, "weak")


def quality_band(value: Column, good: float = 15.0) -> Column:
    return F.when(value >= good, "strong").when(value >= 5, "fair").when(value < 5, "weak")


def cash_band(fcf_margin: Column, market: str) -> Column:
    return quality_band(fcf_margin, 10.0 if market == "tw" else 15.0)


def beta_band(beta: Column) -> Column:
    return F.when(beta > 1.2, "high").when(beta < 0.8, "low").when(beta.isNotNull(), "mid")


def sheet_band(value: Column) -> Column:
    return F.when(value > 20, "deep_green").when(value >= 10, "green").when(value < 0, "red")


def term_structure(vix: Column, vix3m: Column) -> Column:
    return F.when(vix < vix3m, "contango").when(vix > vix3m, "backwardation").when(vix == vix3m, "flat")


def is_stale_data(data_date: Column, today: Column) -> Column:
    return data_date < today


def sentiment_stage(
    vix: Column, vvix: Column, skew: Column, fear_greed: Column, vvix_trend: Column, peak_ago: Column, decline: Column
) -> Column:
    """Daily four-stage reading: struct(stage, reliability)."""
    needed = (vix > 35) & (peak_ago >= 2) & (skew < 120)
    sure = needed & (vix > 40) & (decline > 10) & (fear_greed < 20)
    stage = (
        F.when(needed, "第三階段")
        .when((vix > 30) & ((peak_ago <= 1) | (vvix_trend == "持續上升")), "第二階段")
        .when((vix < 20) & (skew > 135), "第一階段")
        .otherwise("無明確訊號")
    )
    return F.struct(stage.alias("stage"), F.when(sure, "高").otherwise("中").alias("reliability"))


def sentiment_stage_weekly(
    vix: Column, skew: Column, fear_greed: Column, vvix_trend: Column, peak_ago: Column, decline: Column,
    hyg_trend: Column,
) -> Column:
    """Weekly reading: two weeks since the peak and a falling trend are required."""
    needed = (vix > 35) & (peak_ago >= 2) & (skew < 120) & vvix_trend.isin("連續回落", "高位震盪後回落")
    sure = needed & (vix > 40) & (decline > 15) & (fear_greed < 20) & (hyg_trend != "連續下降")
    stage = (
        F.when(needed, "第三階段").when((vix > 30) & (vvix_trend == "持續上升"), "第二階段")
        .when((vix < 20) & (skew > 135), "第一階段").otherwise("無明確訊號")
    )
    return F.struct(stage.alias("stage"), F.when(sure, "高").otherwise("中").alias("reliability"))


def credit_reliability(hyg_change: Column, lqd_change: Column) -> Column:
    """High while the fall stays below 1 % with steady investment grade, low beyond 3 %."""
    return (
        F.when(hyg_change < -3, "低").when((hyg_change > -1) & (lqd_change > -1), "高")
        .when(hyg_change.isNotNull(), "中")
    )


def confirmations(gold: Column, btc: Column, jpy: Column, dxy: Column) -> Column:
    """Count of confirming signals from the four trend labels."""
    one = lambda cond: F.when(cond, 1).otherwise(0)
    return (
        one(gold != "連續下降") + one(btc == "連續上升") + one(jpy != "連續上升") + one(dxy != "連續上升")
    )


def combination_signals(gold: Column, btc: Column, dxy: Column, hyg: Column, rsp_spy: Column, iwm_spy: Column) -> Column:
    return F.array_join(F.array_compact(F.array(
        F.when((gold == "連續上升") & (btc != "連續上升"), "避險需求主導"),
        F.when(gold == "連續下降", "流動性危機"),
        F.when((dxy == "連續上升") & (hyg == "連續下降"), "美元收緊流動性"),
        F.when((rsp_spy == "連續收縮") & (iwm_spy == "連續收縮"), "高度集中化"),
        F.when((btc == "連續上升") & (gold != "連續上升"), "風險偏好率先回升"),
    )), "、")


def style_rotation(vtv: Column, vug: Column) -> Column:
    return F.when(vtv > vug, "defensive").when(vtv < vug, "growth").when(vtv == vug, "balanced")


def momentum_read(mtum: Column, ndx: Column) -> Column:
    return F.when(mtum > ndx, "momentum_holds").when(mtum < ndx, "momentum_breaks").when(mtum == ndx, "in_line")


def breadth_combination(rsp_spy: Column, iwm_spy: Column) -> Column:
    return (
        F.when((rsp_spy > 0) & (iwm_spy > 0), "真正變寬").when((rsp_spy < 0) & (iwm_spy < 0), "高度集中化")
        .when((rsp_spy > 0) & (iwm_spy < 0), "部分寬化").when(rsp_spy.isNotNull() & iwm_spy.isNotNull(), "混合")
    )
