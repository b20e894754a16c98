"""Sinks: day snapshots, nested result documents, report sheets and theme documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report columns and their headings.
SCREEN_SHEET = {
    "rank": "Rank", "rank_change_str": "Change", "ticker": "Ticker", "sector": "Sector", "rs_score": "RS Score",
    "rs_trend": "RS Trend", "rs_1w": "RS 1w", "rs_4w": "RS 4w", "rs_13w": "RS 13w", "contraction_score": "VCP Score",
    "vcp_pullback_count": "VCP Pullbacks", "last_pullback_pct": "Last Pullback %", "dist_from_high_pct": "Dist from High %",
    "combined_score": "Combined Score", "price": "Price", "vs_200ma_pct": "vs 200MA %",
    "atr_contraction": "ATR Contraction %", "volume_ratio": "Volume Ratio",
}
FACT_SHEET = {"eps_ttm": "EPS TTM", "eps_fwd": "EPS Fwd", "eps_cagr_2y": "EPS CAGR 2Y%", "fcf_margin": "FCF Margin%",
              "roic": "ROIC%", "op_margin": "Op Margin%", "rev_growth": "Rev Growth%"}
SECTOR_SHEET = {"rank": "排名", "name": "名稱", "ticker": "Ticker", "rs_score": "RS Score", "rs_trend": "RS Trend",
                "rs_1w": "RS 1w", "rs_4w": "RS 4w", "rs_13w": "RS 13w", "vs_benchmark": "vs SPY 13w%", "price": "股價"}
GLOBAL_SHEET = {"rank": "排名", "region": "地區", "name": "市場", "ticker": "Ticker", "rs_score": "RS Score",
                "rs_trend": "RS Trend", "rs_1w": "RS 1w", "rs_4w": "RS 4w", "rs_13w": "RS 13w", "vs_benchmark": "vs VT 13w%"}
SNAPSHOT_US = ["rank", "ticker", "sector", "rs_score", "rs_1w", "rs_4w", "rs_13w", "rs_trend", "contraction_score",
               "combined_score", "price", "vs_200ma_pct", "rank_change", "rank_change_str"]
SNAPSHOT_TW = ["rank", "ticker", "name", "etf", "rs_score", "rs_1w", "rs_4w", "rs_13w", "rs_trend",
               "contraction_score", "combined_score", "price", "vs_200ma_pct"]


def _sheet(rows: DataFrame, headings: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(h) for c, h in headings.items()])


def screen_sheet(ranked: DataFrame) -> DataFrame:
    return _sheet(ranked, SCREEN_SHEET)


def top_sheet(enriched: DataFrame) -> DataFrame:
    return _sheet(enriched, SCREEN_SHEET | FACT_SHEET)


def sector_sheet(ranking: DataFrame) -> DataFrame:
    return _sheet(ranking, SECTOR_SHEET)


def global_sheet(ranking: DataFrame) -> DataFrame:
    return _sheet(ranking, GLOBAL_SHEET)


def write_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").csv(path, header=True)


def write_snapshot(ranked: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One partition per as-of day; a rerun replaces that day only. The latest snapshot is the
    newest partition, so nothing is written twice."""
    (
        ranked.select("as_of", *(columns or SNAPSHOT_US)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    newest = snapshots.agg(F.max("as_of").alias("as_of"))
    return snapshots.join(F.broadcast(newest), "as_of", "left_semi")  # one row


def result_document(top: DataFrame, picks: DataFrame, sectors: DataFrame, markets: DataFrame, total: int | None = None) -> DataFrame:
    """One nested document of the short lists (30 rows, 3 picks, the two group rankings)."""
    def part(df: DataFrame, name: str, order: str) -> DataFrame:
        row = F.struct(order, F.struct(*df.columns).alias("row"))
        return df.agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["row"]).alias(name))

    doc = part(top, "top30", "rank")
    for frame, name, order in ((picks, "top_picks", "direction"), (sectors, "sector_ranking", "rank"), (markets, "global_ranking", "rank")):
        doc = doc.join(part(frame, name, order), F.lit(True))  # one row each
    return doc.withColumn("total_screened", F.lit(total)) if total is not None else doc


def write_documents(docs: DataFrame, path: str, *keys: str) -> None:
    """Nested rows as JSON, one folder per key (as_of, theme)."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def write_regimes(regimes: DataFrame, path: str) -> None:
    regimes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
