"""Recursive indicators: values that depend on their own past, one pass over each series.

A series is one asset and candle width, so its length is bounded by time and a group fits a task; everything that a
window can express stays in SQL (plans.candles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def ema(x, period: int, alpha: float | None = None):
    """Seeded with the mean of the first `period` values; NaN before."""
    import numpy as np

    out = np.full(len(x), np.nan)
    if len(x) >= period:
        k = 2 / (period + 1) if alpha is None else alpha
        value = float(np.mean(x[:period]))
        out[period - 1] = value
        for i in range(period, len(x)):
            value = k * x[i] + (1 - k) * value
            out[i] = value
    return out


def wilder(x, period: int):
    return ema(x, period, 1 / period)


def rsi(close, period: int = 14):
    """Wilder's; 50 without movement, 100 without loss."""
    import numpy as np

    out = np.full(len(close), np.nan)
    if len(close) > period:
        step = np.diff(close)
        gain, loss = wilder(np.maximum(step, 0), period), wilder(np.maximum(-step, 0), period)
        both = np.where(gain + loss > 0, gain + loss, 1.0)
        out[1:] = np.where(np.isnan(gain), np.nan, np.where(gain + loss == 0, 50.0, 100 * gain / both))
    return out


def true_range(h, low, c):
    import numpy as np

    out = np.full(len(c), np.nan)
    out[1:] = np.maximum.reduce([h[1:] - low[1:], np.abs(h[1:] - c[:-1]), np.abs(low[1:] - c[:-1])])
    return out


def atr(h, low, c, period: int = 14):
    import numpy as np

    out = np.full(len(c), np.nan)
    out[1:] = wilder(true_range(h, low, c)[1:], period) if len(c) > 1 else []
    return out


def adx(h, low, c, period: int = 14):
    """(ADX, +DI, -DI) by Wilder's running sums; ADX from index 2 * period - 1."""
    import numpy as np

    n = len(c)
    line, plus, minus = (np.full(n, np.nan) for _ in range(3))
    if n < 2 * period:
        return line, plus, minus
    up, down = np.diff(h), -np.diff(low)
    moves = (np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0), true_range(h, low, c)[1:])
    sums = [float(m[:period].sum()) for m in moves]
    dx = np.full(n, np.nan)
    for i in range(period, n):
        if i > period:
            sums = [s - s / period + m[i - 1] for s, m in zip(sums, moves, strict=True)]
        p, q, t = sums
        plus[i], minus[i] = (100 * p / t, 100 * q / t) if t > 0 else (0.0, 0.0)
        both = plus[i] + minus[i]
        dx[i] = 100 * abs(plus[i] - minus[i]) / both if both > 0 else 0.0
    line[2 * period - 1 :] = np.clip(wilder(dx[period:], period)[period - 1 :], 0, 100)
    return line, plus, minus


def ewma_vol(returns, decay: float = 0.94):
    import numpy as np

    out = np.full(len(returns), np.nan)
    if len(returns):
        variance = returns[0] ** 2
        out[0] = np.sqrt(variance)
        for i in range(1, len(returns)):
            variance = decay * variance + (1 - decay) * returns[i - 1] ** 2
            out[i] = np.sqrt(variance)
    return out


def macd(close, fast: int = 12, slow: int = 26, signal: int = 9):
    import numpy as np

    line = ema(close, fast) - ema(close, slow)
    sig = np.full(len(close), np.nan)
    sig[slow - 1 :] = ema(line[slow - 1 :], signal) if len(close) >= slow else []
    return line, sig, line - sig


def log_returns(close):
    import numpy as np

    good = (close[1:] > 0) & (close[:-1] > 0)
    return np.where(good, np.log(np.where(good, close[1:] / np.where(close[:-1] > 0, close[:-1], 1), 1)), 0.0)


COLUMNS = ("ema12", "ema26", "macd", "macd_signal", "macd_histogram", "rsi14", "stoch_rsi_k", "stoch_rsi_d", "atr14", "adx14", "plus_di", "minus_di", "ewma_vol")


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """(asset, rn, ...) for bars(asset, rn, o, h, l, c, v): the columns of COLUMNS, null while warming up."""

    def each(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("rn")
        h, low, c = (pdf[k].to_numpy(float) for k in ("h", "l", "c"))
        line, sig, hist = macd(c)
        r = rsi(c)
        smooth = lambda x, p: pd.Series(x).rolling(p, min_periods=p).mean().to_numpy()
        top, bottom = pd.Series(r).rolling(14, min_periods=14).max().to_numpy(), pd.Series(r).rolling(14, min_periods=14).min().to_numpy()
        k = smooth(np.where(top > bottom, 100 * (r - bottom) / np.where(top > bottom, top - bottom, 1), np.where(np.isnan(top), np.nan, 50.0)), 3)
        trend, plus, minus = adx(h, low, c)
        vol = np.concatenate([[np.nan], ewma_vol(log_returns(c))])[: len(c)]
        values = (ema(c, 12), ema(c, 26), line, sig, hist, r, k, smooth(k, 3), atr(h, low, c), trend, plus, minus, vol)
        out = pd.DataFrame({"asset": pdf["asset"].to_numpy(), "rn": pdf["rn"].to_numpy(np.int64)} | dict(zip(COLUMNS, values, strict=True)))
        return out.astype(object).where(out.notna(), None)

    return bars.select("asset", "rn", "h", "l", "c").groupBy("asset").applyInPandas(each, "asset string, rn bigint, " + ", ".join(f"{c} double" for c in COLUMNS))


def support_levels(bars: DataFrame, width: float = 0.005, top: int = 8) -> DataFrame:
    """(asset, level, touches, strength, is_support): swing prices joined within `width` of a cluster's running mean, in price order."""

    def each(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("rn")
        h, low, v, n = pdf["h"].to_numpy(), pdf["l"].to_numpy(), pdf["v"].to_numpy(), len(pdf)
        swings = [(h[i], i) for i in range(2, n - 2) if h[i] > max(h[i - 2], h[i - 1], h[i + 1], h[i + 2])]
        swings += [(low[i], i) for i in range(2, n - 2) if low[i] < min(low[i - 2], low[i - 1], low[i + 1], low[i + 2])]
        groups: list[list[tuple[float, int]]] = []
        total = 0.0  # of the last group's prices
        for price, i in sorted(swings):
            mean = total / len(groups[-1]) if groups else None
            if mean is not None and abs(price - mean) <= width * mean:
                groups[-1].append((price, i))
                total += price
            else:
                groups.append([(price, i)])
                total = price
        rows = []
        for g in (g for g in groups if len(g) >= 2):
            level, age = sum(p for p, _ in g) / len(g), n - 1 - max(i for _, i in g)
            near = v[(low <= level * (1 + width)) & (h >= level * (1 - width))].sum()
            strength = 0.4 * min(1, (len(g) - 1) / 3) + 0.3 * np.exp(-np.log(2) / (n / 4) * age) + 0.3 * min(1, near / max(v.sum(), 1e-12) / 0.15)
            rows.append((pdf["asset"].iloc[0], level, len(g), float(strength), bool(level < pdf["c"].iloc[-1])))
        rows = sorted(rows, key=lambda r: (-r[3], r[1]))[:top]
        return pd.DataFrame(rows, columns=["asset", "level", "touches", "strength", "is_support"])

    return bars.select("asset", "rn", "h", "l", "c", "v").groupBy("asset").applyInPandas(each, "asset string, level double, touches bigint, strength double, is_support boolean")


def value_area(bins: DataFrame, share: float = 0.7) -> DataFrame:
    """(asset, poc_bin, low_bin, high_bin, share) of a volume profile: grown from the fullest bin towards the fuller side, above at ties."""

    def each(pdf):
        import pandas as pd

        v = pdf.sort_values("bin")["volume"].to_numpy()
        poc = int(v.argmax())
        low, high, held, total = poc, poc, v[poc], max(v.sum(), 1e-12)
        while held < share * total and (low > 0 or high < len(v) - 1):
            above, below = v[high + 1] if high < len(v) - 1 else -1, v[low - 1] if low > 0 else -1
            if above >= below:
                high, held = high + 1, held + above
            else:
                low, held = low - 1, held + below
        return pd.DataFrame([(pdf["asset"].iloc[0], poc, low, high, float(held / total))], columns=["asset", "poc_bin", "low_bin", "high_bin", "share"])

    return bins.select("asset", "bin", "volume").groupBy("asset").applyInPandas(each, "asset string, poc_bin bigint, low_bin bigint, high_bin bigint, share double")


def breakouts(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """(asset, kind, level, is_support, strength): the last bar against each level that the three closes before did not pass.

    kind is breakout (a close beyond it, upwards), breakdown (downwards), rejection (it was pierced and held) or none: a
    break on thin volume, under 1.5 times the mean of the 20 bars before. The strongest level counts, the first at ties.
    Without any such level the kind is none with no strength; assets with fewer than five bars or without levels have no row.
    """

    def each(key, pdf, lev):
        import numpy as np
        import pandas as pd

        pdf, out, n = pdf.sort_values("rn"), [], len(pdf)
        if n >= 5 and len(lev):
            h, low, c, v = (pdf[k].to_numpy(float) for k in ("h", "l", "c", "v"))
            scale = atr(h, low, c, min(14, max(2, n // 3)))[-1]
            scale = scale if np.isfinite(scale) and scale > 0 else c[-1] * 0.005
            usual = v[-21:-1].mean()
            ratio = v[-1] / usual if usual > 0 else 0.0
            for level, strength, support in zip(lev["level"], lev["strength"], lev["is_support"], strict=True):
                under, over = (c[-4:-1] <= level).all(), (c[-4:-1] >= level).all()
                if under and c[-1] > level * 1.001:
                    kind = "breakout"
                elif over and c[-1] < level * 0.999:
                    kind = "breakdown"
                elif (under and h[-1] > level >= c[-1]) or (over and low[-1] < level <= c[-1]):
                    kind = "rejection"
                else:
                    continue
                reach = abs((h[-1] if kind == "rejection" else c[-1]) - level) / scale
                score = 0.35 * strength + 0.35 * min(1.0, ratio / 3) + 0.30 * min(1.0, reach)
                thin = ratio < 1.5 and kind != "rejection"
                out.append(("none" if thin else kind, level, bool(support), score * (0.4 if thin else 1.0)))
            out.append(("none", None, None, 0.0))
        best = sorted(out, key=lambda x: -x[3])[:1]
        return pd.DataFrame([(key[0], *b) for b in best], columns=["asset", "kind", "level", "is_support", "strength"])

    sides = levels.select("asset", "level", "strength", "is_support").groupBy("asset")
    return bars.select("asset", "rn", "h", "l", "c", "v").groupBy("asset").cogroup(sides).applyInPandas(each, "asset string, kind string, level double, is_support boolean, strength double")
