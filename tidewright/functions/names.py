"""Names of feature columns: group, timeframe, parameters and metric, without the symbol, which is a column."""

import re


def clean(part) -> str:
    return re.sub(r"[^0-9a-z]+", "_", str(part).lower().replace(".", "p")).strip("_")


def feature_name(group: str, timeframe: str, metric: str, params: tuple = (), zscore: int | None = None) -> str:
    """macd, 1h, hist, (12, 26, 9), 168 to macd_1h_12_26_9_hist_zscore_168."""
    parts = [group, timeframe, *params, metric] + ([f"zscore_{zscore}"] if zscore else [])
    return "_".join(p for p in map(clean, parts) if p)


def select_names(columns: list[str], prefix: str = "", containing: str = "", leave_out: tuple[str, ...] = ()) -> list[str]:
    """Columns by prefix, substring and a list of those left out, in their order."""
    return [c for c in columns if c.startswith(prefix) and containing in c and c not in leave_out]


def short_symbol(symbol: str) -> str:
    """'BTCUSDT' to 'btc': lower case without the quote currency."""
    return symbol.lower().removesuffix("usdt")
