"""Technical features of price bars: 46 columns per bar, and an optional preset of further ones."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.bars import usable
from ..functions.frames import in_parts, long_frames
from ..functions.ranges import in_ranges, over_ranges, own_rows, ranged, with_index
from ..functions.ranks import below_quantile, mean_deviation
from ..functions.scan import Recurrence, affine_scan, ema, wilder
from ..functions.windows import change, clip, flag, full, lagged, upto, wide_mean


@dataclass(frozen=True)
class Preset:
    """Window lengths in bars. The defaults take 25 bars of 15 minutes as a day."""

    hour: int = 4
    four_hours: int = 16
    day: int = 25
    rsi: tuple[int, int, int, int] = (14, 56, 224, 350)
    sma: tuple[int, int, int, int] = (5, 20, 500, 1250)
    ema: tuple[int, int, int, int] = (9, 21, 525, 1250)
    macd: tuple[tuple[int, int, int], tuple[int, int, int]] = ((12, 26, 9), (192, 416, 144))
    volume: tuple[int, int] = (20, 500)
    drawdown: tuple[int, int] = (16, 500)
    sharpe: int = 16
    bars_per_sharpe_year: float = 384.0


FULL = Preset()
#: About a tenth of the lengths, for short series.
SHORT = replace(FULL, rsi=(14, 14, 22, 35), sma=(5, 20, 50, 125), ema=(9, 21, 52, 125), macd=((12, 26, 9), (19, 42, 14)), volume=(20, 50), drawdown=(16, 50))

# The features, in order.
NAMES = (
    "Open High Low Close Volume Close_15m Close_1h Volume_15m Price_Change_15m Price_Change_1h Price_Change_4h Price_Change_1d "
    "High_Low_Ratio Price_Range Intraday_Return Price_Position RSI_15m RSI_1h RSI_4h RSI_1d RSI_Change RSI_Overbought RSI_Oversold "
    "SMA_5_20_Ratio_15m SMA_20_50_Ratio_1d EMA_9_15m EMA_21_15m EMA_21_1d EMA_50_1d SMA_Cross_5_20_15m SMA_Cross_20_50_1d "
    "MACD_15m MACD_Signal_15m MACD_Histogram_15m MACD_4h MACD_Signal_4h MACD_Histogram_4h MACD_Change_15m MACD_Bull_Cross_15m "
    "MACD_Bear_Cross_15m Volume_Ratio_20_15m Volume_Ratio_20_1d OBV Max_Drawdown_4h Max_Drawdown_20d Sharpe_Approx_4h"
).split()

O, H, L, C, V = "open", "high", "low", "close", "volume"


def price_action() -> dict[str, Column]:
    """Within one bar."""
    o, h, l, c = (F.col(x) for x in (O, H, L, C))
    return {
        "High_Low_Ratio": F.try_divide(h, l),
        "Price_Range": F.try_divide(h - l, (h + l) / 2),
        "Intraday_Return": F.try_divide(c - o, o),
        "Price_Position": F.try_divide(c - l, h - l + 0.001),
    }


def raw_columns() -> dict[str, Column]:
    return {"Open": F.col(O), "High": F.col(H), "Low": F.col(L), "Close": F.col(C), "Volume": F.bround(V).cast("long")}


def lags(p: Preset = FULL, w: WindowSpec | None = None) -> dict[str, Column]:
    return {"Close_15m": lagged(C, 1, w), "Close_1h": lagged(C, p.hour, w), "Volume_15m": lagged(V, 1, w)} | {
        f"Price_Change_{n}": change(C, k, w) for n, k in (("15m", 1), ("1h", p.hour), ("4h", p.four_hours), ("1d", p.day))
    }


def sma_columns(p: Preset = FULL, w: WindowSpec | None = None) -> dict[str, Column]:
    """Ratios of simple means, short over long, and whether the short one is above."""
    a, b = (full(C, n, F.avg, w) for n in p.sma[:2])
    c, d = (wide_mean(C, n, w) for n in p.sma[2:])
    return {"SMA_5_20_Ratio_15m": F.try_divide(a, b), "SMA_20_50_Ratio_1d": F.try_divide(c, d), "SMA_Cross_5_20_15m": flag(a > b), "SMA_Cross_20_50_1d": flag(c > d)}


def volume_columns(p: Preset = FULL, w: WindowSpec | None = None) -> dict[str, Column]:
    """Volume over its mean (with 1 added)."""
    v = F.col(V)
    return {"Volume_Ratio_20_15m": F.try_divide(v, full(V, p.volume[0], F.avg, w) + 1), "Volume_Ratio_20_1d": F.try_divide(v, wide_mean(V, p.volume[1], w) + 1)}


def obv_step() -> Column:
    """What a bar adds to on-balance volume; the first counts in full."""
    return F.coalesce(F.signum(F.col(C) - F.col(f"_prev_{C}")) * F.col(V), F.col(V))


def with_drawdown(df: DataFrame, p: Preset = FULL) -> DataFrame:
    """Distance from the trailing peak in percent."""
    names = dict(zip(("4h", "20d"), p.drawdown, strict=True))
    df = long_frames(df, {f"_peak_{n}": ("max", C, k) for n, k in names.items()})
    return df.withColumns({f"Max_Drawdown_{n}": (F.try_divide(C, f"_peak_{n}") - 1) * 100 for n in names}).drop(*[f"_peak_{n}" for n in names])


def sharpe(mean: Column, deviation: Column, scale: float) -> Column:
    """A clipped Sharpe ratio from the mean and the deviation of the returns."""
    ratio = F.try_divide(mean, deviation + 1e-8) * F.sqrt(F.lit(scale))
    return clip(ratio, -50.0, 50.0)


def rolling_sharpe(ret: str, n: int, scale: float, w: WindowSpec | None = None) -> Column:
    return sharpe(full(ret, n, F.avg, w), full(ret, n, F.stddev_samp, w), scale)


def _rsi(i: int, n: int) -> list[Recurrence]:
    return [wilder(f"_g{i}", F.col("_gain"), n), wilder(f"_l{i}", F.col("_loss"), n)]


def rsi_value(i: int, end: str = "") -> Column:
    g, l = F.col(f"_g{i}{end}"), F.col(f"_l{i}{end}")
    return F.when(g + l == 0, 0.0).otherwise(100 * g / (g + l))


def _macd(i: int, fast: int, slow: int) -> list[Recurrence]:
    """The fast mean is seeded where the slow one starts, with the mean of the ``fast`` values that end there."""
    k = 2 / (fast + 1)
    return [Recurrence(f"_fast{i}", F.col(C), 1 - k, k, slow - 1, fast), ema(f"_slow{i}", F.col(C), slow)]


def _rsi_events(r: Column, before: Column) -> dict[str, Column]:
    return {"RSI_Change": r - before, "RSI_Overbought": flag(r > 70), "RSI_Oversold": flag(r < 30)}


def _macd_events(m: Column, s: Column, m1: Column, s1: Column) -> dict[str, Column]:
    return {"MACD_Change_15m": m - m1, "MACD_Bull_Cross_15m": flag((m > s) & (m1 <= s1)), "MACD_Bear_Cross_15m": flag((m < s) & (m1 >= s1))}


def _scanned(df: DataFrame, p: Preset, parts: tuple[str, ...], more: tuple[Recurrence, ...] = (), then=None) -> DataFrame:
    """``df`` (with _i and _prev_close) and the columns of the parts asked for; one scan, and one more for signal lines.
    ``more`` recurrences go into the first; ``then`` gives columns made of it, and recurrences of these for the second."""
    d = F.col(C) - F.col(f"_prev_{C}")
    df = df.withColumns({"_gain": F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)), "_loss": F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0)), "_flow": F.coalesce(obv_step(), F.lit(0.0))})
    todo = [*more]
    lags: list[str] = []
    if "ema" in parts:
        todo += [ema(name, F.col(C), n) for name, n in zip(("EMA_9_15m", "EMA_21_15m", "EMA_21_1d", "EMA_50_1d"), p.ema, strict=True)]
    if "rsi" in parts:
        todo += [r for i, n in enumerate(p.rsi) for r in _rsi(i, n)]
        lags += ["_g0", "_l0"]
    if "macd" in parts:
        todo += [r for i, (f, s, _) in enumerate(p.macd) for r in _macd(i, f, s)]
        lags += ["_fast0", "_slow0"]
    if "obv" in parts:
        todo.append(Recurrence("OBV", F.col("_flow"), 1.0, 1.0, 0, F.col("_flow")))
    df = affine_scan(df, todo, lags=tuple(lags))
    if "rsi" in parts:
        df = df.withColumns({name: rsi_value(i) for i, name in enumerate(("RSI_15m", "RSI_1h", "RSI_4h", "RSI_1d"))})
        df = df.withColumns(_rsi_events(F.col("RSI_15m"), rsi_value(0, "_lag")))
    if "macd" in parts:
        df = df.withColumns({f"_m{i}": F.coalesce(F.col(f"_fast{i}") - F.col(f"_slow{i}"), F.lit(0.0)) for i in range(2)})
        lines = [Recurrence(f"_signal{i}", F.col(f"_m{i}"), 1 - 2 / (n + 1), 2 / (n + 1), s + n - 2, n) for i, (_, s, n) in enumerate(p.macd)]
        columns, last = then or ({}, [])
        df = affine_scan(df.withColumns(columns), [*lines, *last], lags=("_signal0",))
        out = {}
        for i, name in enumerate(("15m", "4h")):
            out[f"MACD_{name}"] = F.when(F.col(f"_signal{i}").isNotNull(), F.col(f"_m{i}"))
            out[f"MACD_Signal_{name}"] = F.col(f"_signal{i}")
            out[f"MACD_Histogram_{name}"] = F.col(f"_m{i}") - F.col(f"_signal{i}")
        df = df.withColumns(out)
        before = F.when(F.col("_signal0_lag").isNotNull(), F.col("_fast0_lag") - F.col("_slow0_lag"))
        df = df.withColumns(_macd_events(F.col("MACD_15m"), F.col("MACD_Signal_15m"), before, F.col("_signal0_lag")))
    return df


def recurrences(bars: DataFrame, p: Preset = FULL, parts: tuple[str, ...] = ("ema", "rsi", "macd")) -> DataFrame:
    """Usable ``bars`` with EMA_*, RSI_*, MACD_* and OBV columns of the parts asked for (ema, rsi, macd, obv)."""
    df = _scanned(with_index(usable(bars), previous=(C,)), p, parts)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def framed(bars: DataFrame, stages, before: int) -> DataFrame:
    """ticker, ts and the columns of ``stages`` (each gets the window to use) over frames of at most ``before`` rows back."""
    df = over_ranges(bars, *stages, before=before)
    return df.select("ticker", "ts", *[c for c in df.columns if c not in bars.columns and c[0] != "_"])


def longest(p: Preset = FULL) -> int:
    """The rows that the frames of a preset look back."""
    return max(*p.sma, *p.volume, *p.drawdown, p.sharpe + 1, p.day + 1, p.four_hours + 1) - 1


def build_features(bars: DataFrame, preset: Preset = FULL) -> DataFrame:
    """ticker, ts and the 46 features of ``bars`` (ticker, ts, open, high, low, close, volume), one row for each usable bar."""
    p = preset
    df = usable(bars.select("ticker", "ts", *[F.col(c).cast("double").alias(c) for c in (O, H, L, C, V)]))
    df = in_ranges(with_index(df, previous=(C,)), longest(p))
    df = with_drawdown(df.withColumns(lags(p, ranged()) | sma_columns(p, ranged()) | volume_columns(p, ranged())), p)
    df = df.withColumn("Sharpe_Approx_4h", rolling_sharpe("Price_Change_15m", p.sharpe, p.bars_per_sharpe_year, ranged()))
    df = _scanned(own_rows(df, "_i"), p, ("ema", "rsi", "macd", "obv")).withColumns(price_action())
    inputs = df.withColumnsRenamed({c: f"_{c}" for c in (O, H, L, C, V)})
    raw = {"Open": F.col("_open"), "High": F.col("_high"), "Low": F.col("_low"), "Close": F.col("_close"), "Volume": F.bround("_volume").cast("long")}
    return inputs.select("ticker", "ts", *[raw[n].alias(n) if n in raw else F.col(n) for n in NAMES])


def optional_features(bars: DataFrame, preset: Preset = FULL) -> DataFrame:
    """ticker, ts and the indicators that the default preset leaves out: ranges, rates of change, channel position,
    divergence, distance to means, directional movement, true range, deviations, Bollinger bands, volume spikes, time
    under water and time since the peak."""
    c, h, l, v = F.col(C), F.col(H), F.col(L), F.col(V)
    df = with_index(usable(bars), previous=(C, H, L))
    up, down = h - F.col(f"_prev_{H}"), F.col(f"_prev_{L}") - l
    moves = {"_tr": F.greatest(h - l, F.abs(h - F.col(f"_prev_{C}")), F.abs(l - F.col(f"_prev_{C}")))}
    moves |= {"_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "_ndm": F.when((down > up) & (down > 0), down).otherwise(0.0)}
    # Wilder means of true range and directional movement, then of the index made of them
    index: dict[str, Column] = {}
    for name, k in (("15m", 14), ("1d", 350)):
        p, n = F.col(f"_w_pdm{k}"), F.col(f"_w_ndm{k}")  # the true range cancels out
        index[f"_dx{k}"] = F.coalesce(100 * F.try_divide(F.abs(p - n), p + n), F.lit(0.0))
        index |= {f"ATR_14_{name}": F.col(f"_w_tr{k}"), f"ATR_Ratio_{name}": F.try_divide(f"_w_tr{k}", c)}
    adx = [Recurrence(f"ADX_{n}", F.col(f"_dx{k}"), (k - 1) / k, 1 / k, 2 * k - 1, k) for n, k in (("15m", 14), ("1d", 350))]
    df = _scanned(df.withColumns(moves), preset, ("ema", "rsi", "macd"), tuple(wilder(f"_w{x}{k}", F.col(x), k) for k in (14, 350) for x in moves), (index, adx))
    df = df.select(*bars.columns, "_i", *[x for x in df.columns if x[0] != "_" and x not in bars.columns])
    df = df.withColumns({"_r": change(C, 1), "_typical": (h + l + c) / 3})
    frames = {f"_high{k}": ("max", H, k) for k in (14, 56, 350)} | {f"_low{k}": ("min", L, k) for k in (14, 56, 350)}
    frames |= {n: ("stddev_samp", C, k) for n, k in (("Std_10_15m", 10), ("Std_10_1d", 500), ("Std_20_15m", 20), ("Std_20_1d", 500))}
    frames |= {f"_mean{k}": ("avg", C, k) for k in (20, 500)} | {f"_dev{k}": ("stddev_pop", C, k) for k in (20, 500)} | {f"_top{k}": ("max", C, k) for k in (16, 500)}
    frames |= {"_r_mean": ("avg", "_r", 500), "_r_dev": ("stddev_samp", "_r", 500)} | {f"_typical{k}": ("avg", "_typical", k) for k in (14, 350)}
    df = long_frames(df, frames)
    out: dict[str, Column] = {}
    for name, k in (("15m", 14), ("1h", 56), ("1d", 350)):
        top, low = F.col(f"_high{k}"), F.col(f"_low{k}")
        out[f"Williams_R_{name}"] = clip(F.try_divide(top - c, top - low) * -100, -100.0, 0.0)
    out |= {"ROC_10_15m": change(C, 10) * 100, "ROC_10_1h": change(C, 40) * 100}
    out["Price_Momentum_Div"] = flag(change(C, preset.day) > 0) - flag(F.col("RSI_15m") > 50)
    out |= {f"Price_vs_EMA{n}": F.try_divide(c, f"EMA_{n}") for n in ("21_15m", "21_1d", "50_1d")}
    out |= {f"MACD_Position_{n}": flag(F.col(f"MACD_{n}") > F.col(f"MACD_Signal_{n}")) for n in ("15m", "4h")}
    for name, k in (("15m", 20), ("1d", 500)):
        mean, dev = F.col(f"_mean{k}"), F.col(f"_dev{k}")
        out[f"BB_Position_{name}"] = clip(F.try_divide(c - mean + 2 * dev, 4 * dev + 1e-6), -3.0, 3.0)
        out[f"BB_Width_{name}"] = F.try_divide(4 * dev, mean + 1e-6)
    out["Volume_Ratio_10_15m"] = F.try_divide(v, full(V, 10, F.avg) + 1)
    out["Volume_Spike_15m"] = flag(F.try_divide(v, full(V, 20, F.avg) + 1) > 2)
    out["Volume_Spike_1d"] = flag(F.try_divide(v, wide_mean(V, 500) + 1) > 1.5)
    out["Volume_Change"] = clip(change(V, 1), -0.99, 10.0)
    df = df.withColumns(out)

    more: dict[str, Column] = {"Sharpe_Approx_20d": sharpe(F.col("_r_mean"), F.col("_r_dev"), 96.0 * 252)}
    for name, k in (("4h", 16), ("20d", 500)):
        more[f"Distance_From_Peak_{name}"] = (F.try_divide(c, f"_top{k}") - 1) * 100
        more[f"_under{k}"] = flag(c < F.col(f"_top{k}"))
        more[f"_new{k}"] = F.coalesce(F.col(f"_top{k}") != lagged(f"_top{k}"), F.lit(True)).cast("int")
    df = df.withColumns(more)
    df = long_frames(df, {n: ("sum", f"_under{k}", k) for n, k in (("Underwater_Periods_4h", 16), ("Underwater_Days", 500))})
    df = df.withColumns({f"_run{k}": F.sum(f"_new{k}").over(upto()) for k in (16, 500)})
    runs = {n: F.row_number().over(W.partitionBy("ticker", f"_run{k}").orderBy("ts")) - 1 for n, k in (("Periods_Since_Peak_4h", 16), ("Days_Since_Peak", 500))}
    df = df.withColumns(runs)
    ranked = {f"_squeeze_{n}": (below_quantile, f"BB_Width_{n}", k) for n, k in (("15m", 20), ("1d", 500))}
    df = in_parts(df, ranked | {f"_spread{k}": (mean_deviation, "_typical", k) for k in (14, 350)})
    last: dict[str, Column] = {f"BB_Squeeze_{n}": flag(F.col(f"_squeeze_{n}") == 1) for n in ("15m", "1d")}
    for name, k in (("15m", 14), ("1d", 350)):
        mean = F.col(f"_typical{k}")
        cci = F.coalesce(F.try_divide(F.col("_typical") - mean, 0.015 * F.col(f"_spread{k}")), F.lit(0.0))
        last[f"CCI_{name}"] = clip(F.when(mean.isNotNull(), cci), -500.0, 500.0)
    df = df.withColumns(last)
    drop = {*bars.columns, *NAMES}
    return df.select("ticker", "ts", *sorted(x for x in df.columns if x[0] != "_" and x not in drop))
