"""Reference dimensions. Every literal table here has a size fixed by this file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Instruments by category: (key, symbol, label, prefix, invert, use_bps).
INSTRUMENTS: dict[str, list[tuple[str, str, str, str, bool, bool]]] = {
    "indices": [
        ("ndx", "^NDX", "NDX", "", False, False),
        ("sp500", "^GSPC", "S&P500", "", False, False),
        ("sox", "^SOX", "費半", "", False, False),
        ("twii", "^TWII", "台灣加權", "", False, False),
        ("dax", "^GDAXI", "歐洲DAX", "", False, False),
        ("vt", "VT", "VT", "$", False, False),
        ("vo", "VO", "VO", "$", False, False),
        ("btc", "BTC-USD", "BTC", "$", False, False),
    ],
    "factors": [
        ("nyfang", "FNGS", "NYFANG", "", False, False),
        ("vtv", "VTV", "VTV 價值", "$", False, False),
        ("vug", "VUG", "VUG 成長", "$", False, False),
        ("mtum", "MTUM", "MTUM", "$", False, False),
    ],
    # Legs of ratio items: read, but never shown on their own.
    "ratio_leg": [
        ("rsp", "RSP", "RSP", "$", False, False),
        ("spy", "SPY", "SPY", "$", False, False),
        ("iwm", "IWM", "IWM", "$", False, False),
    ],
    "sentiment": [
        ("vix", "^VIX", "VIX", "", True, False),
        ("vix9d", "^VIX9D", "VIX9D", "", True, False),
        ("skew", "^SKEW", "SKEW", "", False, False),
        ("vvix", "^VVIX", "VVIX", "", True, False),
    ],
    "commodities": [
        ("brent", "BZ=F", "Brent油", "$", False, False),
        ("wti", "CL=F", "WTI油", "$", False, False),
        ("gold", "GC=F", "黃金", "$", False, False),
        ("silver", "SI=F", "白銀", "$", False, False),
        ("copper", "HG=F", "銅", "$", False, False),
        ("alum", "ALI=F", "鋁", "$", False, False),
    ],
    "bonds": [
        ("us2y", "^IRX", "美2Y", "", False, True),
        ("us10y", "^TNX", "美10Y", "", False, True),
        ("us30y", "^TYX", "美30Y", "", False, True),
        ("tlt", "TLT", "TLT", "$", False, False),
    ],
    "fx": [
        ("dxy", "DX-Y.NYB", "DXY", "", False, False),
        ("jpyusd", "JPY=X", "JPY/USD", "¥", False, False),
        ("twdusd", "TWD=X", "USD/TWD", "NT$", False, False),
    ],
    "credit": [
        ("hyg", "HYG", "HYG", "$", False, False),
        ("lqd", "LQD", "LQD", "$", False, False),
        ("bkln", "BKLN", "BKLN", "$", False, False),
    ],
}

# Pools with their category, display prefix, pick count and members.
POOLS: dict[str, tuple[str, str, int, dict[str, str]]] = {
    "sector": ("factors", "$", 3, {
        "XLE": "能源", "XLF": "金融", "XLK": "科技", "XLV": "醫療", "XLI": "工業", "XLY": "非必需消費",
        "XLP": "必需消費", "XLU": "公用事業", "XLB": "材料", "XLRE": "房地產", "XLC": "通訊", "XBI": "生技",
    }),
    "commodity": ("commodities", "$", 2, {
        "NG=F": "天然氣", "PA=F": "鈀金", "PL=F": "鉑金", "ZW=F": "小麥", "ZC=F": "玉米",
        "ZS=F": "黃豆", "CC=F": "可可", "KC=F": "咖啡", "SB=F": "糖",
    }),
    "fx": ("fx", "", 2, {
        "MYR=X": "MYR/USD", "CNH=X": "CNH/USD", "KRW=X": "KRW/USD", "EURUSD=X": "EUR/USD",
        "GBPUSD=X": "GBP/USD", "AUD=X": "AUD/USD", "INR=X": "INR/USD", "SGD=X": "SGD/USD",
    }),
}

# Derived items: (name, category, kind, numerator, denominator, label, position in the category).
PAIRS = [
    ("rsp_spy", "factors", "ratio", "RSP", "SPY", "RSP/SPY", 50),
    ("iwm_spy", "factors", "ratio", "IWM", "SPY", "IWM/SPY 小型", 60),
    ("hyg_lqd", "credit", "ratio", "HYG", "LQD", "HYG/LQD", 25),
    ("curve", "bonds", "spread", "^TNX", "^IRX", "10Y-2Y", 35),
]

# Symbols read by the sentiment and second-layer panels.
SENTIMENT_SYMBOLS = ["^VIX", "^VVIX", "^SKEW", "^VIX9D"]
TREND_SYMBOLS = {"hyg": "HYG", "dxy": "DX-Y.NYB", "us10y": "^TNX", "gold": "GC=F", "btc": "BTC-USD"}
TREND_PAIRS = {"rsp_spy": ("RSP", "SPY"), "iwm_spy": ("IWM", "SPY")}

# Sector exchange-traded funds and their benchmark.
SECTOR_FUNDS = {
    "VTV": "價值因子", "VUG": "成長因子", "MTUM": "動能因子", "IWM": "小型股", "RSP": "等權重",
} | POOLS["sector"][3]
SECTOR_BENCHMARK = "SPY"

# Markets by region, in listing order, and the index symbol of each market.
REGIONS = {
    "美洲": ["美國", "加拿大", "巴西", "墨西哥"],
    "歐洲": ["英國", "德國", "法國", "瑞士", "西班牙", "義大利", "波蘭", "以色列"],
    "亞太": ["日本", "中國", "香港", "台灣", "韓國", "印度", "澳洲", "紐西蘭", "新加坡", "馬來西亞",
             "印尼", "菲律賓", "泰國", "越南"],
    "中東": ["杜拜"],
}
GLOBAL_INDICES = {
    "^GSPC": "美國", "^GSPTSE": "加拿大", "^FTSE": "英國", "^GDAXI": "德國", "^FCHI": "法國", "^SSMI": "瑞士",
    "^IBEX": "西班牙", "FTSEMIB.MI": "義大利", "^BVSP": "巴西", "^MXX": "墨西哥", "^HSI": "香港",
    "000001.SS": "中國", "^TWII": "台灣", "^KS11": "韓國", "^N225": "日本", "^STI": "新加坡",
    "^KLSE": "馬來西亞", "^BSESN": "印度", "^AXJO": "澳洲", "^NZ50": "紐西蘭", "^TA125.TA": "以色列",
    "UAE": "杜拜", "^JKSE": "印尼", "PSEI.PS": "菲律賓", "^SET.BK": "泰國", "VNM": "越南", "EPOL": "波蘭",
}
GLOBAL_BENCHMARK = "VT"
OTHER_REGION = "其他"

# Macro series: (series, label, up label, down label, rising is good).
MACRO = [
    ("rrp", "RRP餘額", "RRP↑", "RRP↓", False),
    ("tga", "TGA", "TGA↑", "TGA↓", False),
    ("reserves", "銀行準備金", "準備金↑", "準備金↓", True),
    ("nfci", "NFCI", "NFCI收緊", "NFCI改善", False),
]

# Weekly themes in publication order.
THEMES = ["central_bank", "liquidity", "credit", "options", "ai_industry", "semiconductor", "earnings",
          "macro", "commodities", "black_swan"]

# News blocks in de-duplication priority order, regions, and blocks that are cleaned only.
NEWS_BLOCKS = ["top_stories", "macro", "geopolitical", "world_news", "ai_industry", "fintech_crypto",
               "startup_news", "tech_trends", "daily_deep_dive"]
REGIONAL_BLOCK = "regional_tech"
NEWS_REGIONS = ["taiwan", "japan", "us", "korea", "china", "europe", "asean"]
CLEAN_ONLY_BLOCKS = ["smart_money", "watchlist_news", "weekend_reads"]
UNDATED_BLOCKS = ["tech_trends", "daily_deep_dive", "weekend_reads"]

# Item caps by block.
BLOCK_CAPS = {"top_stories": 12, "macro": 5, "ai_industry": 5, "regional_tech": 3, "fintech_crypto": 4,
              "geopolitical": 4, "startup_news": 4, "world_news": 3, "watchlist_news": 8, "weekend_reads": 3,
              "today_events": 5}
CODE_CAPS = {"world_news": 3, "system_status_fixed": 3, "system_status_dynamic": 3, "sub_items": 3}

# Ordering of watch-list grades.
GRADES = ["S", "A", "B", "C"]

# Precedence of overlapping membership lists.
MEMBERSHIP_LISTS = ["0050", "0051", "富櫃50"]

RSS_TOTAL_CAP = 280


def instrument_rows() -> list[tuple]:
    """(symbol_no, key, symbol, label, prefix, category, pool, invert, use_bps, pos)."""
    rows: list[tuple] = []
    for category, members in INSTRUMENTS.items():
        for i, (key, symbol, label, prefix, invert, bps) in enumerate(members):
            rows.append((len(rows), key, symbol, label, prefix, category, None, invert, bps, (i + 1) * 10))
    for pool, (category, prefix, _, members) in POOLS.items():
        for i, (symbol, label) in enumerate(members.items()):
            shown = f"{symbol} {label}" if pool == "sector" else label
            rows.append((len(rows), symbol, symbol, shown, prefix, category, pool, False, False, (i + 1) * 10))
    return rows


INSTRUMENT_SCHEMA = (
    "symbol_no int, key string, symbol string, label string, prefix string, category string, "
    "pool string, invert boolean, use_bps boolean, pos int"
)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table of known size, so Catalyst may broadcast it on its own."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, to_arrow_schema(fields))],
                     schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, fields)


def instruments(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, instrument_rows(), INSTRUMENT_SCHEMA)


def region_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (region, market, r, m)
        for r, (region, markets) in enumerate(REGIONS.items())
        for m, market in enumerate(markets)
    ]
    return literal_frame(spark, rows, "region string, market string, region_pos int, market_pos int")
