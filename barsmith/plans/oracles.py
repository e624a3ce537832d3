"""SQL (for DuckDB) that gives the rows of the queries, written independently of the operators."""

from __future__ import annotations

from ..operators.features import NAMES
from . import fixtures as fx

ORACLES: dict[str, str] = {}
W = "PARTITION BY ticker ORDER BY ts"
DAILY, Q15 = f"WITH {fx.BARS_DAILY}", f"WITH {fx.BARS15}"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0"


def full(x: str, n: int, agg: str) -> str:
    frame = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def change(x: str, n: int) -> str:
    return f"({div(x, lag(x, n))} - 1)"


def flag(c: str) -> str:
    return f"CAST(coalesce({c}, FALSE) AS INTEGER)"


def pick(columns: dict[str, str], keys: str = "ticker, ts") -> str:
    return f"SELECT {keys}, " + ", ".join(f"{x} AS {n}" for n, x in columns.items())


def rounded(columns: dict[str, str], exact: tuple[str, ...] = ()) -> dict[str, str]:
    return {n: x if n in exact else r(x) for n, x in columns.items()}


# recurrences: one recursive pass, a state for each


def recursion(states: dict[str, tuple[int, str, float, float, str]], source: str, name: str = "rec") -> str:
    """states: name -> (first, seed, a, b, x), expressions on the row ``b``; the rows need ticker, ts and rn from 0."""
    first = ", ".join(f"CASE WHEN b.rn = {f} THEN {seed} END AS {n}" for n, (f, seed, *_) in states.items())
    step = ", ".join(f"CASE WHEN b.rn = {f} THEN {seed} WHEN b.rn > {f} THEN {a!r}::DOUBLE * e.{n} + {k!r}::DOUBLE * {x} END" for n, (f, seed, a, k, x) in states.items())
    return f"{name} AS (SELECT b.ticker, b.ts, b.rn, {first} FROM {source} b WHERE b.rn = 0 UNION ALL SELECT b.ticker, b.ts, b.rn, {step} FROM {name} e JOIN {source} b ON b.ticker = e.ticker AND b.rn = e.rn + 1)"


def ema_state(n: int, x: str = "b.close") -> tuple:
    k = 2 / (n + 1)
    return n - 1, "b.mean_close", 1 - k, k, x


def wilder_state(n: int, x: str) -> tuple:
    return n, f"b.sum_{x} / {n}", (n - 1) / n, 1 / n, f"b.{x}"


EMAS = {"EMA_9_15m": 9, "EMA_21_15m": 21, "EMA_21_1d": 525, "EMA_50_1d": 1250}
RSIS = {"RSI_15m": 14, "RSI_1h": 56, "RSI_4h": 224, "RSI_1d": 350}
MACDS = {"15m": (12, 26, 9), "4h": (192, 416, 144)}


class Lengths:
    """Window lengths of a preset."""

    emas, rsis, macds = EMAS, RSIS, MACDS
    sma, volume, drawdown = (5, 20, 500, 1250), (20, 500), (16, 500)


class Short(Lengths):
    emas = dict(zip(EMAS, (9, 21, 52, 125)))
    rsis = dict(zip(RSIS, (14, 14, 22, 35)))
    macds = {"15m": (12, 26, 9), "4h": (19, 42, 14)}
    sma, volume, drawdown = (5, 20, 50, 125), (20, 50), (16, 50)


def numbered(p: type[Lengths] = Lengths) -> str:
    d = f"close - {lag('close')}"
    befores = ", ".join(f"coalesce(lag(sum_close, {f}) OVER ({W}), 0) AS before_{n}" for n, (f, _, _) in p.macds.items())
    return (
        f"changes AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, greatest(coalesce({d}, 0), 0) AS gain, greatest(coalesce(-({d}), 0), 0) AS loss FROM bars), "
        f"sums AS (SELECT *, avg(close) OVER ({W}) AS mean_close, sum(close) OVER ({W}) AS sum_close, sum(gain) OVER ({W}) AS sum_gain, sum(loss) OVER ({W}) AS sum_loss FROM changes), "
        f"num AS (SELECT *, {befores} FROM sums)"
    )


def states(*kinds: str, p: type[Lengths] = Lengths) -> dict:
    out: dict = {}
    if "ema" in kinds:
        out |= {n: ema_state(k) for n, k in p.emas.items()}
    if "rsi" in kinds:
        for n, k in p.rsis.items():
            out |= {f"g_{n}": wilder_state(k, "gain"), f"l_{n}": wilder_state(k, "loss")}
    if "macd" in kinds:
        for n, (f, s, _) in p.macds.items():
            k = 2 / (f + 1)
            out |= {f"fast_{n}": (s - 1, f"(b.sum_close - b.before_{n}) / {f}", 1 - k, k, "b.close"), f"slow_{n}": ema_state(s)}
    return out


def rsi_sql(n: str) -> str:
    return f"CASE WHEN g_{n} + l_{n} = 0 THEN 0 ELSE 100 * g_{n} / (g_{n} + l_{n}) END"


def recurrent(prefix: str, *kinds: str, p: type[Lengths] = Lengths) -> str:
    """CTEs up to ``feats``: bars with the recurrent columns of the kinds asked for."""
    sql = f"{prefix.replace('WITH', 'WITH RECURSIVE', 1)}, {numbered(p)}, {recursion(states(*kinds, p=p), 'num')}"
    columns = [f"{rsi_sql(n)} AS {n}" for n in RSIS] if "rsi" in kinds else []
    columns += list(EMAS) if "ema" in kinds else []
    if "macd" not in kinds:
        return sql + f", feats AS (SELECT ticker, ts, rn, {', '.join(columns)} FROM rec)"
    m = ", ".join(f"coalesce(fast_{n} - slow_{n}, 0) AS m_{n}" for n in MACDS)
    sums = ", ".join(f"sum(m_{n}) OVER ({W}) AS sum_m_{n}" for n in MACDS)
    lines = {}
    for n, (_, s, m9) in p.macds.items():
        k = 2 / (m9 + 1)
        lines[f"signal_{n}"] = (s + m9 - 2, f"b.sum_m_{n} / {m9}", 1 - k, k, f"b.m_{n}")
    sql += f", lines AS (SELECT *, {m} FROM rec), lines2 AS (SELECT *, {sums} FROM lines), {recursion(lines, 'lines2', 'sig')}"
    for n in MACDS:
        columns += [f"CASE WHEN signal_{n} IS NOT NULL THEN m_{n} END AS MACD_{n}", f"signal_{n} AS MACD_Signal_{n}", f"m_{n} - signal_{n} AS MACD_Histogram_{n}"]
    return sql + f", feats AS (SELECT l.ticker, l.ts, l.rn, {', '.join(columns)} FROM lines2 l JOIN sig s ON l.ticker = s.ticker AND l.rn = s.rn)"


LAGS = {"Close_15m": lag("close"), "Close_1h": lag("close", 4), "Volume_15m": lag("volume")} | {f"Price_Change_{n}": change("close", k) for n, k in (("15m", 1), ("1h", 4), ("4h", 16), ("1d", 25))}
ACTION = {
    "High_Low_Ratio": div("high", "low"), "Price_Range": div("high - low", "(high + low) / 2"), "Intraday_Return": div("close - open", "open"), "Price_Position": div("close - low", "high - low + 0.001"),
}
RAW = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "CAST(round_even(volume, 0) AS BIGINT)"}


def smas(p: type[Lengths] = Lengths) -> dict[str, str]:
    a, b, c, d = (full("close", n, "avg") for n in p.sma)
    return {"SMA_5_20_Ratio_15m": div(a, b), "SMA_20_50_Ratio_1d": div(c, d), "SMA_Cross_5_20_15m": flag(f"({a}) > ({b})"), "SMA_Cross_20_50_1d": flag(f"({c}) > ({d})")}


def volumes(p: type[Lengths] = Lengths) -> dict[str, str]:
    return {f"Volume_Ratio_20_{n}": div("volume", f"({full('volume', k, 'avg')}) + 1") for n, k in zip(("15m", "1d"), p.volume)}


def drawdowns(p: type[Lengths] = Lengths) -> dict[str, str]:
    return {f"Max_Drawdown_{n}": f"({div('close', full('close', k, 'max'))} - 1) * 100" for n, k in zip(("4h", "20d"), p.drawdown)}


MEANS = {n: full("close", n, "avg") for n in (5, 20)}
SMAS, VOLUMES, DRAWDOWNS = smas(), volumes(), drawdowns()
OBV_STEP = f"coalesce(sign(close - {lag('close')}) * volume, volume)"
RSI_EVENTS = {"RSI_Change": f"RSI_15m - {lag('RSI_15m')}", "RSI_Overbought": flag("RSI_15m > 70"), "RSI_Oversold": flag("RSI_15m < 30")}
_m, _s = "MACD_15m", "MACD_Signal_15m"
MACD_EVENTS = {"MACD_Change_15m": f"{_m} - {lag(_m)}", "MACD_Bull_Cross_15m": flag(f"{_m} > {_s} AND {lag(_m)} <= {lag(_s)}"), "MACD_Bear_Cross_15m": flag(f"{_m} < {_s} AND {lag(_m)} >= {lag(_s)}")}
FLAGS = ("SMA_Cross_5_20_15m", "SMA_Cross_20_50_1d", "RSI_Overbought", "RSI_Oversold", "MACD_Bull_Cross_15m", "MACD_Bear_Cross_15m", "Volume")


def sharpe(ret: str, n: int, scale: float) -> str:
    x = f"(({full(ret, n, 'avg')}) / (({full(ret, n, 'stddev_samp')}) + 1e-8) * sqrt({scale}))"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-50.0, least(50.0, {x})) END"


BAR_COLUMNS = "ticker, ts, " + ", ".join(f"{r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume"))
ORACLES["bars_15m"] = f"{Q15} SELECT {BAR_COLUMNS} FROM bars"
ORACLES["bars_daily"] = f"{DAILY} SELECT {BAR_COLUMNS} FROM bars"
ORACLES["landed_bars"] = f"{DAILY} SELECT ticker, ts, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, {r('CASE WHEN ts >= TIMESTAMP ' + repr('1995-01-01') + ' THEN volume ELSE volume + 1 END')} AS volume FROM bars"
ORACLES["bars_between"] = f"{DAILY} SELECT {BAR_COLUMNS} FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars WHERE ts >= TIMESTAMP '1994-01-01' AND ts < TIMESTAMP '1996-01-01') WHERE n >= 100"
ORACLES["recent_bars"] = f"{DAILY} SELECT {BAR_COLUMNS} FROM (SELECT *, max(ts) OVER (PARTITION BY ticker) AS newest FROM bars) WHERE ts >= newest - INTERVAL 60 DAY"
ORACLES["universe_codes"] = f"{DAILY}, codes AS (SELECT ticker, CAST(row_number() OVER (ORDER BY ticker) - 1 AS SMALLINT) AS code FROM (SELECT DISTINCT ticker FROM bars)) SELECT ticker, ts, {r('close')} AS close, code FROM bars JOIN codes USING (ticker) WHERE code < 4"
ORACLES["ticker_report"] = "SELECT n_name AS ticker, count(c_custkey) AS n_rows, CAST(count(c_custkey) > 0 AS INTEGER) AS succeeded FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT r_name, 0, 0 FROM region"
ORACLES["pool_profile"] = f"{DAILY} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers FROM bars"

ORACLES["lag_change"] = f"{DAILY} {pick(rounded(LAGS | {'Close_Diff': 'close - ' + lag('close')}))} FROM bars"
ORACLES["price_action"] = f"{Q15} {pick(rounded(RAW | ACTION, FLAGS))} FROM bars"
ORACLES["sma_ratios"] = f"{DAILY} {pick(rounded(SMAS, FLAGS))} FROM bars"
ORACLES["ema"] = f"{recurrent(DAILY, 'ema')} {pick(rounded({n: n for n in EMAS}))} FROM feats"
ORACLES["rsi"] = f"{recurrent(DAILY, 'rsi')} {pick(rounded({n: n for n in RSIS}))} FROM feats"
ORACLES["rsi_flags"] = f"{recurrent(Q15, 'rsi')} {pick(rounded(RSI_EVENTS, FLAGS))} FROM feats"
MACD_COLUMNS = {f"MACD_{p}{n}": f"MACD_{p}{n}" for n in MACDS for p in ("", "Signal_", "Histogram_")}
ORACLES["macd"] = f"{recurrent(DAILY, 'macd')} {pick(rounded(MACD_COLUMNS))} FROM feats"
ORACLES["macd_cross"] = f"{recurrent(Q15, 'macd')} {pick(rounded(MACD_EVENTS, FLAGS))} FROM feats"
ORACLES["volume_ratio"] = f"{DAILY} {pick(rounded(VOLUMES))} FROM bars"
ORACLES["obv"] = f"{DAILY}, steps AS (SELECT ticker, ts, {OBV_STEP} AS step FROM bars) {pick(rounded({'OBV': f'sum(step) OVER ({W})'}))} FROM steps"
ORACLES["trailing_drawdown"] = f"{DAILY} {pick(rounded(DRAWDOWNS))} FROM bars"
ORACLES["rolling_sharpe"] = f"{DAILY}, rets AS (SELECT ticker, ts, {change('close', 1)} AS ret FROM bars) {pick(rounded({'Sharpe_Approx_4h': sharpe('ret', 16, 384.0)}))} FROM rets"
ALL = RAW | LAGS | ACTION | SMAS | VOLUMES | DRAWDOWNS
EVENTS = RSI_EVENTS | MACD_EVENTS | {"OBV": f"sum(step) OVER ({W})", "Sharpe_Approx_4h": sharpe("Price_Change_15m", 16, 384.0)}


def featured(p: type[Lengths] = Lengths) -> tuple[str, dict[str, str]]:
    """CTEs up to ``joined``, and the columns of all 46 features on it."""
    plain = RAW | LAGS | ACTION | smas(p) | volumes(p) | drawdowns(p)
    sql = f"{recurrent(DAILY, 'ema', 'rsi', 'macd', p=p)}, plain AS ({pick(plain)}, {OBV_STEP} AS step FROM bars), joined AS (SELECT p.*, f.* EXCLUDE (ticker, ts, rn) FROM plain p JOIN feats f ON p.ticker = f.ticker AND p.ts = f.ts) "
    return sql, {n: n for n in [*plain, *RSIS, *EMAS, *MACD_COLUMNS]} | EVENTS


_sql, _columns = featured()
ORACLES["features_all"] = _sql + pick(rounded(_columns, FLAGS)) + " FROM joined"

# the optional preset
_top = {k: full("close", k, "max") for k in (16, 500)}
_clip = lambda x, a, b: f"CASE WHEN ({x}) IS NOT NULL THEN greatest({a}, least({b}, {x})) END"
FIRST = {"ret": change("close", 1), "typical": "(high + low + close) / 3", "top16": _top[16], "top500": _top[500]}
FIRST["tr"] = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
FIRST["pdm"] = f"CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} ELSE 0 END"
FIRST["ndm"] = f"CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low ELSE 0 END"
FIRST |= {f"dev{k}": full("close", k, "stddev_pop") for k in (20, 500)} | {f"mean{k}": full("close", k, "avg") for k in (20, 500)}
SECOND = {f"BB_Width_{n}": div(f"4 * dev{k}", f"mean{k} + 1e-6") for n, k in (("15m", 20), ("1d", 500))}
SECOND |= {f"tm{k}": full("typical", k, "avg") for k in (14, 350)} | {f"tl{k}": f"list(typical) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (14, 350)}
SECOND |= {f"under{k}": flag(f"close < top{k}") for k in (16, 500)} | {f"new{k}": f"CAST(coalesce(top{k} <> {lag(f'top{k}')}, TRUE) AS INTEGER)" for k in (16, 500)}
SECOND |= {f"sum_{x}": f"sum(CASE WHEN rn > 0 THEN {x} END) OVER ({W})" for x in ("tr", "pdm", "ndm")}
THIRD: dict[str, str] = {}
for _n, _k in (("15m", 14), ("1h", 56), ("1d", 350)):
    _hi, _lo = f"({full('high', _k, 'max')})", f"({full('low', _k, 'min')})"
    THIRD[f"Williams_R_{_n}"] = _clip(f"{div(f'{_hi} - close', f'{_hi} - {_lo}')} * -100", "-100.0", "0.0")
THIRD |= {"ROC_10_15m": f"{change('close', 10)} * 100", "ROC_10_1h": f"{change('close', 40)} * 100", "Price_Momentum_Div": f"{flag(change('close', 25) + ' > 0')} - {flag('RSI_15m > 50')}"}
THIRD |= {f"Price_vs_EMA{n}": div("close", f"EMA_{n}") for n in ("21_15m", "21_1d", "50_1d")} | {f"MACD_Position_{n}": flag(f"MACD_{n} > MACD_Signal_{n}") for n in ("15m", "4h")}
THIRD |= {n: full("close", k, "stddev_samp") for n, k in (("Std_10_15m", 10), ("Std_10_1d", 500), ("Std_20_15m", 20), ("Std_20_1d", 500))}
for _n, _k in (("15m", 20), ("1d", 500)):
    THIRD[f"BB_Position_{_n}"] = _clip(div(f"close - mean{_k} + 2 * dev{_k}", f"4 * dev{_k} + 1e-6"), "-3.0", "3.0")
    THIRD[f"BB_Width_{_n}"] = f"BB_Width_{_n}"
    THIRD[f"BB_Squeeze_{_n}"] = flag(f"BB_Width_{_n} < CASE WHEN count(BB_Width_{_n}) OVER ({W} ROWS BETWEEN {_k - 1} PRECEDING AND CURRENT ROW) = {_k} THEN quantile_cont(BB_Width_{_n}, 0.2) OVER ({W} ROWS BETWEEN {_k - 1} PRECEDING AND CURRENT ROW) END")
THIRD["Volume_Ratio_10_15m"] = div("volume", f"({full('volume', 10, 'avg')}) + 1")
THIRD["Volume_Spike_15m"] = flag(div("volume", "(" + full("volume", 20, "avg") + ") + 1") + " > 2")
THIRD["Volume_Spike_1d"] = flag(div("volume", "(" + full("volume", 500, "avg") + ") + 1") + " > 1.5")
THIRD["Volume_Change"] = _clip(change("volume", 1), "-0.99", "10.0")
THIRD["Sharpe_Approx_20d"] = sharpe("ret", 500, 96.0 * 252)
for _n, _k in (("4h", 16), ("20d", 500)):
    THIRD[f"Distance_From_Peak_{_n}"] = f"({div('close', f'top{_k}')} - 1) * 100"
for _n, _k in (("15m", 14), ("1d", 350)):
    THIRD[f"CCI_{_n}"] = _clip(f"CASE WHEN tm{_k} IS NOT NULL THEN coalesce({div(f'typical - tm{_k}', f'0.015::DOUBLE * list_sum(list_transform(tl{_k}, lambda x: abs(x - tm{_k}))) / {_k}')}, 0) END", "-500.0", "500.0")
    THIRD[f"ATR_14_{_n}"], THIRD[f"ATR_Ratio_{_n}"], THIRD[f"ADX_{_n}"] = f"tr{_k}", div(f"tr{_k}", "close"), f"adx{_k}"
THIRD |= {n: full(f"under{k}", k, "sum") for n, k in (("Underwater_Periods_4h", 16), ("Underwater_Days", 500))}
THIRD |= {f"run{k}": f"sum(new{k}) OVER ({W})" for k in (16, 500)}
SINCE = {n: f"row_number() OVER (PARTITION BY ticker, run{k} ORDER BY ts) - 1" for n, k in (("Periods_Since_Peak_4h", 16), ("Days_Since_Peak", 500))}
WHOLE = ("Price_Momentum_Div", "MACD_Position_15m", "MACD_Position_4h", "BB_Squeeze_15m", "BB_Squeeze_1d", "Volume_Spike_15m", "Volume_Spike_1d")
MOVES = {f"{x}{k}": (k, f"b.sum_{x} / {k}", (k - 1) / k, 1 / k, f"b.{x}") for k in (14, 350) for x in ("tr", "pdm", "ndm")}
INDEX = {f"adx{k}": (2 * k - 1, f"b.sum_dx{k} / {k}", (k - 1) / k, 1 / k, f"b.dx{k}") for k in (14, 350)}
_dx = ", ".join(f"coalesce(100 * abs(pdm{k} - ndm{k}) / nullif(pdm{k} + ndm{k}, 0), 0) AS dx{k}" for k in (14, 350))
_sdx = ", ".join(f"sum(CASE WHEN rn >= {k} THEN dx{k} END) OVER ({W}) AS sum_dx{k}" for k in (14, 350))
ORACLES["features_optional"] = (
    f"{recurrent(DAILY, 'ema', 'rsi', 'macd')}, one AS ({pick(FIRST, '*')} FROM bars), one2 AS (SELECT o.*, f.* EXCLUDE (ticker, ts) FROM one o JOIN feats f ON o.ticker = f.ticker AND o.ts = f.ts), two AS ({pick(SECOND, '*')} FROM one2), "
    f"{recursion(MOVES, 'two', 'mov')}, dxs AS (SELECT *, {_dx} FROM mov), dx2 AS (SELECT *, {_sdx} FROM dxs), {recursion(INDEX, 'dx2', 'adx')}, "
    "three AS (SELECT t.*, m.* EXCLUDE (ticker, ts, rn), a.* EXCLUDE (ticker, ts, rn) FROM two t JOIN mov m ON t.ticker = m.ticker AND t.rn = m.rn JOIN adx a ON t.ticker = a.ticker AND t.rn = a.rn), "
    f"four AS ({pick(THIRD)} FROM three) "
    + pick({n: n if n in WHOLE else r(n) for n in THIRD if not n.startswith("run")} | SINCE)
    + " FROM four"
)
ORACLES["target"] = f"{DAILY} SELECT ticker, ts, {r(div(f'lead(close, 4) OVER ({W})', 'close') + ' - 1')} AS target FROM bars"

# data sets
SMALL = f"small AS (SELECT ticker, ts, close, {change('close', 1)} AS f1, {change('close', 4)} AS f4, {div(MEANS[5], MEANS[20])} AS f_sma, 3.0::DOUBLE AS f_const, {div(f'lead(close, 4) OVER ({W})', 'close')} - 1 AS target FROM bars)"
COMPLETE = f"{DAILY}, {SMALL}, complete AS (SELECT * FROM small WHERE f1 IS NOT NULL AND f4 IS NOT NULL AND f_sma IS NOT NULL AND target IS NOT NULL AND close IS NOT NULL)"
PLACED = f"{COMPLETE}, placed AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER ({W}) AS place FROM complete)"
SPLIT = f"{PLACED}, parts AS (SELECT *, CASE WHEN place > floor(n * (1 - 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM placed WHERE n >= 32)"
LABELLED = f"{SPLIT}, q AS (SELECT ticker, quantile_cont(target, 0.45) AS q_low, quantile_cont(target, 0.55) AS q_high FROM parts WHERE split = 'train' GROUP BY ticker), lab AS (SELECT p.*, q_low, q_high, CASE WHEN target > q_high THEN 2 WHEN target < q_low THEN 0 ELSE 1 END AS label FROM parts p JOIN q USING (ticker))"
ORACLES["complete_rows"] = f"{COMPLETE} SELECT ticker, ts, " + ", ".join(f"{r(c)} AS {c}" for c in ("close", "f1", "f4", "f_sma", "f_const", "target")) + " FROM complete"
ORACLES["temporal_split"] = f"{SPLIT} SELECT ticker, ts, split FROM parts"
ORACLES["three_way_split"] = f"{PLACED} SELECT ticker, ts, CASE WHEN place > floor(n * (1 - 0.2::DOUBLE)) THEN 'test' WHEN place > floor(floor(n * (1 - 0.2::DOUBLE)) * (1 - 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM placed WHERE n >= 32"
ORACLES["labels"] = f"{LABELLED} SELECT ticker, ts, split, {r('q_low')} AS q_low, {r('q_high')} AS q_high, label FROM lab"
ORACLES["labels_per_split"] = f"{SPLIT}, q AS (SELECT ticker, split, quantile_cont(target, 0.45) AS q_low, quantile_cont(target, 0.55) AS q_high FROM parts GROUP BY ticker, split) SELECT ticker, ts, split, CASE WHEN target > q_high THEN 2 WHEN target < q_low THEN 0 ELSE 1 END AS label FROM parts JOIN q USING (ticker, split)"


def scaled(c: str) -> str:
    train = f"(SELECT quantile_cont({c}, {{}}) FROM parts WHERE split = 'train')"
    iqr = f"({train.format(0.75)} - {train.format(0.25)})"
    return f"({c} - {train.format(0.5)}) / CASE WHEN {iqr} = 0 THEN 1 ELSE {iqr} END"


ORACLES["robust_scale"] = f"{SPLIT} {pick(rounded({c: scaled(c) for c in ('f1', 'f4', 'f_sma', 'f_const')}))} FROM parts"
COUNTS = "counts AS (SELECT label, count(x.label2) AS n FROM (SELECT unnest([0, 1, 2]) AS label) d LEFT JOIN (SELECT {} AS label2 FROM {} ) x ON d.label = x.label2 GROUP BY label), weights AS (SELECT label, n, 100.0 * n / sum(n) OVER () AS percent, (sum(n) OVER () / (n + 1e-6)) AS raw FROM counts)"
ORACLES["class_weights"] = f"{LABELLED}, {COUNTS.format('label', 'lab WHERE split = ' + repr('train'))} SELECT label, n, {r('percent')} AS percent, {r('raw / avg(raw) OVER ()')} AS weight FROM weights"
ORACLES["balanced_batches"] = "SELECT batch_no, label, CAST(32 // 3 + CASE WHEN label < 32 % 3 THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT unnest(range(50)) AS batch_no), (SELECT unnest([0, 1, 2]) AS label)"
for _name, _from in (("sequences", 16), ("sequences_strict", 17)):
    ORACLES[_name] = f"{LABELLED} SELECT ticker, ts, label, CAST(16 AS INTEGER) AS n, {r('first_f1')} AS first_f1, {r('f1')} AS last_f1 FROM (SELECT *, lag(f1, 15) OVER ({W}) AS first_f1, row_number() OVER ({W}) AS k FROM lab) WHERE k >= {_from}"
ORACLES["prepared"] = (
    f"{DAILY}, small AS (SELECT ticker, ts, {change('close', 1)} AS f1, {change('close', 4)} AS f4, {div(f'lead(close, 4) OVER ({W})', 'close')} - 1 AS target FROM bars), complete AS (SELECT * FROM small WHERE f1 IS NOT NULL AND f4 IS NOT NULL AND target IS NOT NULL)"
    + LABELLED[len(COMPLETE) :]
    + f" SELECT ticker, ts, split, label, {r(scaled('f1'))} AS f1, {r(scaled('f4'))} AS f4 FROM lab"
)
_sql, _columns = featured(Short)
_complete = " AND ".join(f"{n} IS NOT NULL" for n in (*_columns, "target"))
_train = ", ".join(f"quantile_cont({n}, {q}) AS {n}_{k}" for n in _columns for k, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75)))
_scaled = {n: f"({n} - {n}_mid) / CASE WHEN {n}_high - {n}_low = 0 THEN 1 ELSE {n}_high - {n}_low END" for n in _columns}
FEATURED = (
    f"{_sql}, feat AS ({pick(_columns)} FROM joined), aimed AS (SELECT *, {div(f'lead(Close, 4) OVER ({W})', 'Close')} - 1 AS target FROM feat), complete AS MATERIALIZED (SELECT * FROM aimed WHERE {_complete})"
    + LABELLED[len(COMPLETE) :]
    + f", train AS MATERIALIZED (SELECT {_train} FROM parts WHERE split = 'train'), ready AS MATERIALIZED ({pick(_scaled, 'ticker, ts, split, label')} FROM lab, train)"
)
ORACLES["prepared_features"] = f"{FEATURED} {pick({n: r(n, 4) for n in _columns}, 'ticker, ts, split, label')} FROM ready"


def probabilities(logits: tuple[str, str, str], source: str, name: str) -> str:
    """Classes and probabilities of a model's logits, worked out from ``source`` (ticker, ts, label)."""
    x = [f"exp({z})" for z in logits]
    total = f"({' + '.join(x)})"
    pred = f"CASE WHEN {logits[0]} >= {logits[1]} AND {logits[0]} >= {logits[2]} THEN 0 WHEN {logits[1]} >= {logits[2]} THEN 1 ELSE 2 END"
    return f"SELECT '{name}' AS model, ticker, ts, label AS actual, {pred} AS pred, " + ", ".join(f"{r(f'{e} / {total}')} AS {n}" for e, n in zip(x, ("p_down", "p_neutral", "p_up"))) + f" FROM {source}"


def weighted(names: list[str], weights: tuple[tuple[float, ...], ...], k: int) -> str:
    return " + ".join(f"{n} * {row[k]!r}::DOUBLE" for n, row in zip(names, weights))


_three = {c: scaled(c) for c in ("f1", "f4", "f_sma")}
_logits = tuple(f"({weighted([*_three], fx.DENSE, k)} + {b!r}::DOUBLE)" for k, b in enumerate(fx.BIAS))
ORACLES["linear_scores"] = f"{LABELLED}, three AS ({pick(_three, 'ticker, ts, label')} FROM lab WHERE split = 'test') {probabilities(_logits, 'three', 'linear')}"
# the recurrent net, place by place of the sequence that ends at a row
_hidden = range(len(fx.OWN))
_inputs = ", ".join(f"{weighted(NAMES, fx.INNER, j)} AS i{j}" for j in _hidden)
_places = ", ".join(f"lag(i{j}, {15 - t}) OVER ({W}) AS i{j}_{t}" for j in _hidden for t in range(16))
_steps = "".join(f", s{t} AS (SELECT *, " + ", ".join(f"tanh(i{j}_{t}" + (f" + {weighted([f'h{i}_{t - 1}' for i in _hidden], fx.OWN, j)}" if t else "") + f") AS h{j}_{t}" for j in _hidden) + f" FROM {f's{t - 1}' if t else 'placed16'})" for t in range(16))
_logits = tuple(f"({weighted([f'h{j}_15' for j in _hidden], fx.HEAD, k)} + {b!r}::DOUBLE)" for k, b in enumerate(fx.BIAS))
ORACLES["network_scores"] = (
    f"{FEATURED}, inputs AS (SELECT ticker, ts, label, {_inputs} FROM ready), windows16 AS (SELECT *, {_places}, row_number() OVER ({W}) AS k FROM inputs), placed16 AS (SELECT * FROM windows16 WHERE k >= 16){_steps} "
    + probabilities(_logits, "s15", "network")
)

# evaluation
SCORED = f"WITH {fx.SCORES}"
ORACLES["softmax_argmax"] = f"{SCORED} SELECT model, ts, pred, {r('x0 / (x0 + x1 + x2)')} AS p_down, {r('x1 / (x0 + x1 + x2)')} AS p_neutral, {r('x2 / (x0 + x1 + x2)')} AS p_up FROM scored"
GRID = f"{SCORED}, dims AS (SELECT * FROM (SELECT DISTINCT model FROM scored), (SELECT unnest([0, 1, 2]) AS label)), cls AS (SELECT d.model, d.label, count(*) FILTER (pred = label AND actual = label) AS tp, count(*) FILTER (pred = label) AS n_pred, count(*) FILTER (actual = label) AS support FROM dims d JOIN scored s ON s.model = d.model GROUP BY ALL), "
GRID += "pr AS (SELECT *, coalesce(tp / nullif(n_pred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM cls), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"
ORACLES["accuracy_f1"] = f"{GRID} SELECT model, {r('(SELECT 100 * avg(CAST(pred = actual AS INTEGER)) FROM scored s WHERE s.model = f.model)')} AS accuracy, {r('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM f GROUP BY model"
ORACLES["confusion"] = f"{SCORED} SELECT m.model, a.actual, p.pred, (SELECT count(*) FROM scored s WHERE s.model = m.model AND s.actual = a.actual AND s.pred = p.pred) AS n FROM (SELECT DISTINCT model FROM scored) m, (SELECT unnest([0, 1, 2]) AS actual) a, (SELECT unnest([0, 1, 2]) AS pred) p"
_three = lambda e: ", ".join(f"{r(e.format(c))} AS {c}" for c in ("precision", "recall", "f1"))
_tot = "CAST(sum(support) AS BIGINT) AS support"
ORACLES["class_report"] = (
    f"{GRID} SELECT model, CAST(label AS VARCHAR) AS row, {_three('{}')}, CAST(support AS BIGINT) AS support FROM f UNION ALL SELECT model, 'accuracy', {_three('sum(tp) / sum(support)')}, {_tot} FROM f GROUP BY model "
    f"UNION ALL SELECT model, 'macro avg', {_three('avg({})')}, {_tot} FROM f GROUP BY model UNION ALL SELECT model, 'weighted avg', {_three('sum({} * support) / sum(support)')}, {_tot} FROM f GROUP BY model"
)
ORACLES["weighted_xent"] = (
    f"{SCORED}, {COUNTS.format('actual', 'scored WHERE model = ' + repr('a'))}, w AS (SELECT label, raw / avg(raw) OVER () AS weight FROM weights), "
    "rows AS (SELECT model, weight, ln(x0 / (x0 + x1 + x2)) AS p0, ln(x1 / (x0 + x1 + x2)) AS p1, ln(x2 / (x0 + x1 + x2)) AS p2, actual FROM scored JOIN w ON label = actual) "
    f"SELECT model, {r('sum(weight * -(0.9::DOUBLE * CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END + 0.1::DOUBLE / 3 * (p0 + p1 + p2))) / sum(weight)')} AS loss FROM rows GROUP BY model"
)
ORACLES["best_model"] = f"{SCORED} SELECT model, {r('100 * avg(CAST(pred = actual AS INTEGER))')} AS accuracy FROM scored GROUP BY model ORDER BY accuracy DESC, model LIMIT 1"
LOG = f"WITH RECURSIVE {fx.EPOCHS}"
ORACLES["epoch_log"] = f"{LOG} SELECT run, epoch, {r('train_loss')} AS train_loss, {r('test_loss')} AS test_loss, {r('accuracy')} AS accuracy, {r('lr')} AS lr FROM log"
ORACLES["best_epoch"] = f"{LOG} SELECT run, first(epoch ORDER BY test_loss, epoch) AS best_epoch, {r('min(test_loss)')} AS best_loss, {r('last(test_loss - train_loss ORDER BY epoch)')} AS last_gap FROM log GROUP BY run"
ORACLES["early_stop"] = (
    f"{LOG}, num AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM log), fold AS (SELECT run, k, epoch, test_loss AS best, epoch AS kept, 0 AS waited FROM num WHERE k = 1 "
    "UNION ALL SELECT n.run, n.k, n.epoch, CASE WHEN n.test_loss < f.best - 1e-4::DOUBLE THEN n.test_loss ELSE f.best END, CASE WHEN n.test_loss < f.best - 1e-4::DOUBLE THEN n.epoch ELSE f.kept END, CASE WHEN n.test_loss < f.best - 1e-4::DOUBLE THEN 0 ELSE f.waited + 1 END FROM fold f JOIN num n ON n.run = f.run AND n.k = f.k + 1 WHERE f.waited < 6) "
    f"SELECT run, last(kept ORDER BY k) AS best_epoch, {r('last(best ORDER BY k)')} AS best_loss, max(epoch) AS stop_epoch FROM fold GROUP BY run"
)
_flags = ", ".join(f"CAST({k} = {i} AS INTEGER) AS {k}_{n}" for k in ("pred", "actual") for i, n in enumerate(("down", "neutral", "up")))
ORACLES["prediction_head"] = f"{SCORED} SELECT model, ticker, ts, actual, pred, {r('x0 / (x0 + x1 + x2)')} AS p_down, {r('x1 / (x0 + x1 + x2)')} AS p_neutral, {r('x2 / (x0 + x1 + x2)')} AS p_up, {_flags} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ticker, ts) AS k FROM scored) WHERE k <= 100"

# signals
_y = "(value / 100 * 0.5::DOUBLE + 0.01::DOUBLE)"
ORACLES["inverse_target"] = f"SELECT event_id, {r(_y + ' * 100')} AS plain, {r(f'(exp(greatest(-10.0, least(10.0, {_y}))) - 1) * 100')} AS logged, {r('greatest(10.0, least(200.0, value))')} AS clipped FROM events"
ORACLES["latest_row"] = f"{DAILY} SELECT {BAR_COLUMNS} FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1"
ORACLES["latest_sequence"] = f"{DAILY} SELECT ticker, max(ts) AS ts, CAST(count(*) AS INTEGER) AS n, {r('first(close ORDER BY ts)')} AS first_close, {r('sum(volume)')} AS volume FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 10) GROUP BY ticker HAVING count(*) = 10"
SIGNALS = f"WITH {fx.PREDICTIONS}, means AS (SELECT ticker, avg(predicted_return) AS p FROM predictions GROUP BY ticker), sig AS (SELECT ticker, CASE WHEN p > 0 THEN 'BUY' ELSE 'SELL' END AS action, p, abs(p) AS confidence, CASE WHEN abs(p) >= 0.05 THEN 'STRONG' ELSE 'MODERATE' END AS signal_strength, CAST(row_number() OVER (ORDER BY abs(p) DESC, ticker) AS INTEGER) AS rank FROM means WHERE abs(p) >= 0.02)"
ORACLES["signals"] = f"{SIGNALS} SELECT ticker, action, {r('p')} AS predicted_return, {r('confidence')} AS confidence, signal_strength, rank FROM sig"
ORACLES["signal_lines"] = f"{SIGNALS} SELECT ticker, action, rank, model, {r('predicted_return')} AS model_return FROM sig JOIN predictions USING (ticker)"

# strategy
_d = f"coalesce(close - {lag('close')}, 0)"
INDICATORS = (
    f"moves AS (SELECT *, greatest({_d}, 0) AS gain, greatest(-({_d}), 0) AS loss FROM bars), inds AS (SELECT *, "
    + ", ".join(f"{full('close', n, 'avg')} AS sma_{n}" for n in (10, 20, 50))
    + f", {full('gain', 14, 'avg')} AS g, {full('loss', 14, 'avg')} AS l, {full('close', 20, 'stddev_samp')} AS dev, {full('volume', 10, 'avg')} AS volume_sma FROM moves), "
    "ind AS (SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN l = 0 AND g > 0 THEN 100 END AS rsi FROM inds)"
)
ORACLES["strategy_indicators"] = f"{DAILY}, {INDICATORS} {pick(rounded({'sma_10': 'sma_10', 'sma_20': 'sma_20', 'sma_50': 'sma_50', 'rsi': 'rsi', 'bb_upper': 'sma_20 + 2 * dev', 'bb_lower': 'sma_20 - 2 * dev', 'volume_sma': 'volume_sma'}))} FROM ind"
_f = lambda n: f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
VECTOR = {
    "f_close": "close", "f_high": "high", "f_low": "low", "f_open": "open", "f_range": div("high - low", "close"), "f_volume": div("volume", f"avg(volume) OVER {_f(21)}"),
    "f_sma_10": div("sma_10", "close") + " - 1", "f_sma_20": div("sma_20", "close") + " - 1", "f_sma_50": div("sma_50", "close") + " - 1", "f_rsi": "rsi / 100",
    "f_mean_5": f"avg(ret) OVER {_f(5)}", "f_mean_10": f"avg(ret) OVER {_f(10)}", "f_std_10": f"stddev_pop(ret) OVER {_f(10)}", "f_max_5": f"max(ret) OVER {_f(5)}", "f_min_5": f"min(ret) OVER {_f(5)}",
}
ORACLES["strategy_vector"] = f"{DAILY}, {INDICATORS}, rets AS (SELECT *, {change('close', 1)} AS ret, row_number() OVER ({W}) - 1 AS i FROM ind) " + pick({n: r(f"CASE WHEN i >= 20 THEN {x} END") for n, x in VECTOR.items()}) + " FROM rets"

K = "period, ticker, model"
RUNS = (
    f"{DAILY.replace('WITH', 'WITH RECURSIVE', 1)}, {INDICATORS}, fc AS (SELECT *, {change('close', 1)} AS c1, {change('close', 5)} AS c5 FROM ind), "
    "runs AS (SELECT CASE WHEN ts < TIMESTAMP '1995-07-01' THEN 'early' ELSE 'late' END AS period, model, ticker, ts, open, close, sma_10, rsi, CASE model WHEN 'follow' THEN c1 WHEN 'revert' THEN -c1 ELSE c5 END AS pred FROM fc, (SELECT unnest(['follow', 'revert', 'trend']) AS model)), "
    f"bar AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ts) - 1 AS i, lead(ts) OVER (PARTITION BY {K} ORDER BY ts) AS next_ts, lead(open) OVER (PARTITION BY {K} ORDER BY ts) AS next_open FROM runs), "
    # state after a bar: the entry held (price and time) or none, the number of trades, and what the bar decided
    "walk AS (SELECT period, ticker, model, i, NULL::DOUBLE AS entry, NULL::TIMESTAMP AS entry_ts, 0 AS trades, NULL::VARCHAR AS did FROM bar WHERE i = 0 UNION ALL "
    "SELECT b.period, b.ticker, b.model, b.i, "
    "CASE WHEN d.act = 'enter' THEN b.next_open WHEN d.act IS NOT NULL THEN NULL ELSE w.entry END, CASE WHEN d.act = 'enter' THEN b.next_ts WHEN d.act IS NOT NULL THEN NULL ELSE w.entry_ts END, w.trades + CASE WHEN d.act = 'enter' THEN 1 ELSE 0 END, d.act "
    "FROM walk w JOIN bar b ON b.period = w.period AND b.ticker = w.ticker AND b.model = w.model AND b.i = w.i + 1, "
    "LATERAL (SELECT CASE WHEN b.i < 20 OR b.next_ts IS NULL THEN NULL WHEN w.entry IS NULL THEN CASE WHEN b.pred > 0.02 AND b.close > b.sma_10 AND b.rsi < 70 THEN 'enter' END "
    "WHEN b.pred < -0.02 AND b.close < b.sma_10 AND b.rsi > 30 THEN 'rule' WHEN (b.close - w.entry) / w.entry < -0.05 THEN 'stop' WHEN (b.close - w.entry) / w.entry > 0.10 THEN 'take' END AS act) d), "
    "acts AS (SELECT w.*, b.next_ts, b.next_open FROM walk w JOIN bar b ON b.period = w.period AND b.ticker = w.ticker AND b.model = w.model AND b.i = w.i WHERE did IS NOT NULL), "
    "ledger AS (SELECT e.period, e.ticker, e.model, CAST(e.trades AS BIGINT) AS trade_no, e.next_ts AS entry_ts, e.next_open AS entry_price, x.next_ts AS exit_ts, x.next_open AS exit_price, x.did AS reason FROM acts e LEFT JOIN acts x ON x.period = e.period AND x.ticker = e.ticker AND x.model = e.model AND x.trades = e.trades AND x.did <> 'enter' WHERE e.did = 'enter')"
)
ORACLES["position_ledger"] = f"{RUNS} SELECT {K}, trade_no, entry_ts, {r('entry_price')} AS entry_price, exit_ts, {r('exit_price')} AS exit_price, reason FROM ledger"
RESULTS = (
    f"{RUNS}, cash AS (SELECT *, 10000 * coalesce(product(1 - 0.95 * 1.002 + 0.95 * 0.998 * exit_price / entry_price) OVER (PARTITION BY {K} ORDER BY trade_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM ledger), "
    "eq AS (SELECT b.period, b.ticker, b.model, b.ts, CASE WHEN c.trade_no IS NULL THEN 10000 WHEN c.exit_ts IS NULL OR b.ts < c.exit_ts THEN c.before * (1 - 0.95 * 1.002) + c.before * 0.95 / c.entry_price * b.close ELSE c.before * (1 - 0.95 * 1.002 + 0.95 * 0.998 * c.exit_price / c.entry_price) END AS equity FROM bar b ASOF LEFT JOIN cash c ON b.period = c.period AND b.ticker = c.ticker AND b.model = c.model AND b.ts >= c.entry_ts), "
    f"er AS (SELECT *, equity / lag(equity) OVER (PARTITION BY {K} ORDER BY ts) - 1 AS ret, equity / max(equity) OVER (PARTITION BY {K} ORDER BY ts) - 1 AS down FROM eq), "
    f"m AS (SELECT {K}, last(equity ORDER BY ts) AS final_value, 100 * (last(equity ORDER BY ts) / first(equity ORDER BY ts) - 1) AS total_return, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, 100 * min(down) AS max_drawdown FROM er GROUP BY ALL), "
    f"n AS (SELECT {K}, count(*) AS total_trades, 100 * avg(CAST(0.998 * exit_price > 1.002 * entry_price AS INTEGER)) AS win_rate FROM ledger WHERE exit_ts IS NOT NULL GROUP BY ALL), "
    f"results AS (SELECT m.*, coalesce(total_trades, 0) AS total_trades, coalesce(win_rate, 0) AS win_rate FROM m LEFT JOIN n USING ({K}))"
)
ORACLES["backtest_metrics"] = f"{RESULTS} SELECT {K}, " + ", ".join(f"{r(c, 3)} AS {c}" for c in ("final_value", "total_return", "sharpe", "max_drawdown", "win_rate")) + ", total_trades FROM results"
VALID = "sharpe IS NOT NULL AND sharpe <> 0"
ORACLES["leaderboard"] = f"{RESULTS}, l AS (SELECT model, avg(total_return) AS a, avg(sharpe) AS s, count(*) AS total_tests FROM results WHERE {VALID} GROUP BY model) SELECT model, {r('a', 3)} AS avg_return, {r('s', 3)} AS avg_sharpe, total_tests, CAST(row_number() OVER (ORDER BY a DESC, model) AS INTEGER) AS rank, {r('10000 * (1 + a / 100)', 3)} AS final_value, {r('10000 * a / 100', 3)} AS profit FROM l"
ORACLES["return_box"] = f"{RESULTS}, q AS (SELECT model, quantile_cont(total_return, 0.25) AS q1, quantile_cont(total_return, 0.5) AS median, quantile_cont(total_return, 0.75) AS q3 FROM results GROUP BY model) SELECT model, {r('any_value(q1)', 3)} AS q1, {r('any_value(median)', 3)} AS median, {r('any_value(q3)', 3)} AS q3, {r('min(total_return) FILTER (total_return >= q1 - 1.5 * (q3 - q1) AND total_return <= q3 + 1.5 * (q3 - q1))', 3)} AS low, {r('max(total_return) FILTER (total_return >= q1 - 1.5 * (q3 - q1) AND total_return <= q3 + 1.5 * (q3 - q1))', 3)} AS high FROM results JOIN q USING (model) GROUP BY model"
ORACLES["return_grid"] = f"{RESULTS} SELECT ticker, " + ", ".join(f"{r(f'coalesce(avg(total_return) FILTER (model = {m!r}), 0)', 3)} AS {m}" for m in ("follow", "revert", "trend")) + " FROM results WHERE ticker IN (SELECT DISTINCT ticker FROM results ORDER BY ticker LIMIT 5) GROUP BY ticker"
ORACLES["avg_trades"] = f"{RESULTS} SELECT model, {r('avg(total_trades)', 3)} AS avg_trades FROM results GROUP BY model"
ORACLES["risk_return"] = f"{RESULTS} SELECT {K}, {r('sharpe', 3)} AS sharpe, {r('total_return', 3)} AS total_return FROM results WHERE {VALID}"

# fundamentals
WIDE = f"WITH {fx.STATEMENTS}"
_items = ", ".join(fx.ITEMS)
LONG = f"{WIDE}, long AS (SELECT ticker, 'income_stmt' AS source, item, period, value FROM (UNPIVOT wide ON {_items} INTO NAME item VALUE value) WHERE NOT (ticker LIKE '%7' AND item = 'TaxProvision')), have AS (SELECT ticker, count(DISTINCT item) AS n_items FROM long GROUP BY ticker)"
ORACLES["statement_items"] = f"{LONG} SELECT source, ticker, item, CAST(period AS VARCHAR) AS period, {r('value')} AS value FROM long JOIN have USING (ticker) WHERE n_items = 9"
ORACLES["statement_rejects"] = f"{LONG} SELECT ticker, n_items FROM have WHERE n_items < 9"
ORACLES["statement_pivot"] = f"{WIDE} SELECT ticker, CAST(period AS VARCHAR) AS period, " + ", ".join(f"{r(i)} AS {i}" for i in fx.ITEMS) + " FROM wide"
_before = "lag({0}) OVER (PARTITION BY ticker ORDER BY period)"
RATIOS = {
    "roa": div("NetIncome", "TotalAssets"), "cash_conversion": div("OperatingCashFlow", "NetIncome"), "price_to_sales": div("marketCap", "TotalRevenue"), "ocf_margin": div("OperatingCashFlow", "TotalRevenue"),
    "current_ratio": div("CurrentAssets", "CurrentLiabilities"), "asset_turnover": div("TotalRevenue", "TotalAssets"), "revenue_per_share": div("TotalRevenue", "OrdinarySharesNumber"), "working_capital_ratio": div("CurrentAssets - CurrentLiabilities", "TotalAssets"),
    "pe_ratio": "pe",
}
ORACLES["ratios"] = f"{WIDE}, {fx.INFO}, px AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_suppkey % 11 <> 0 THEN (s_acctbal / 10) / nullif(s_acctbal / 90, 0) END AS pe FROM supplier) SELECT ticker, CAST(period AS VARCHAR) AS period, " + ", ".join(f"{r(x)} AS {n}" for n, x in RATIOS.items()) + " FROM wide JOIN info USING (ticker) JOIN px USING (ticker)"
ORACLES["yoy"] = f"{WIDE} SELECT ticker, CAST(period AS VARCHAR) AS period, {r(div('TotalAssets - ' + _before.format('TotalAssets'), _before.format('TotalAssets')))} AS asset_growth, {r(div('OperatingCashFlow - ' + _before.format('OperatingCashFlow'), 'abs(' + _before.format('OperatingCashFlow') + ')'))} AS ocf_growth FROM wide"
_px = "px AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_suppkey % 11 <> 0 THEN (s_acctbal / 10) / nullif(s_acctbal / 90, 0) END AS pe FROM supplier)"
ALL_RATIOS = RATIOS | {
    "roe": div("NetIncome", "StockholdersEquity"), "ev_ebitda": div("enterpriseValue", "EBITDA"), "fcf_margin": div("FreeCashFlow", "TotalRevenue"), "fcf_conversion": div("FreeCashFlow", "NetIncome"),
    "capex_intensity": div("CapitalExpenditure", "TotalRevenue"), "reinvestment_rate": div("CapitalExpenditure", "OperatingCashFlow"), "cash_ratio": div("CashAndCashEquivalents", "CurrentLiabilities"),
    "debt_to_equity": div("TotalDebt", "StockholdersEquity"), "debt_to_assets": div("TotalDebt", "TotalAssets"), "equity_ratio": div("StockholdersEquity", "TotalAssets"), "tangible_equity_ratio": div("TangibleBookValue", "TotalAssets"),
    "receivables_turnover": div("TotalRevenue", "AccountsReceivable"), "inventory_turnover": div("CostOfRevenue", "Inventory"), "book_value_per_share": div("StockholdersEquity", "OrdinarySharesNumber"),
    "tangible_book_per_share": div("TangibleBookValue", "OrdinarySharesNumber"), "operating_margin": div("OperatingIncome", "TotalRevenue"), "ebitda_margin": div("EBITDA", "TotalRevenue"), "gross_margin": div("GrossProfit", "TotalRevenue"),
    "fcf_after_capex": "OperatingCashFlow + CapitalExpenditure", "quick_ratio": div("CurrentAssets - Inventory", "CurrentLiabilities"), "working_capital_efficiency": div("ChangeInWorkingCapital", f"TotalRevenue - {_before.format('TotalRevenue')}"),
}
ORACLES["all_ratios"] = f"WITH {fx.FILED}, {fx.INFO}, {_px} SELECT ticker, CAST(period AS VARCHAR) AS period, " + ", ".join(f"{r(x)} AS {n}" for n, x in ALL_RATIOS.items()) + " FROM filed JOIN info USING (ticker) JOIN px USING (ticker)"
_grown = {"asset_growth": "TotalAssets", "equity_growth": "StockholdersEquity", "debt_growth": "TotalDebt", "cash_growth": "CashAndCashEquivalents", "fcf_growth": "FreeCashFlow", "ocf_growth": "OperatingCashFlow", "capex_growth": "CapitalExpenditure"}
_signed = ("asset_growth", "equity_growth")
ORACLES["all_growth"] = f"WITH {fx.FILED} SELECT ticker, CAST(period AS VARCHAR) AS period, " + ", ".join(f"{r(div(f'{i} - {_before.format(i)}', _before.format(i) if n in _signed else f'abs({_before.format(i)})'))} AS {n}" for n, i in _grown.items()) + " FROM filed"
ORACLES["pe_gap"] = f"WITH {fx.INFO} SELECT ticker, {r('trailingPE - forwardPE')} AS pe_gap, CASE WHEN abs(trailingPE - forwardPE) <= 1 THEN 'small' WHEN trailingPE > forwardPE THEN 'positive' WHEN trailingPE < forwardPE THEN 'negative' END AS pe_outlook FROM info"
ORACLES["ratings_since"] = "SELECT o_custkey AS ticker, o_orderdate AS rating_ts, o_orderkey AS rating_id FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01'"

# news and options
NEWS = f"WITH {fx.NEWS}, kept AS (SELECT ticker, time AS datetime, headline, confidence FROM confident WHERE confidence >= 0.9 AND NOT isnan(confidence))"
ORACLES["news_confidence"] = f"{NEWS} SELECT ticker, datetime, headline, {r('confidence')} AS confidence FROM kept"
ORACLES["news_weekly"] = f"{NEWS}, weeks AS (SELECT time_bucket(INTERVAL '7 days', datetime, TIMESTAMP '1970-01-01') AS week, count(*) AS n_articles FROM kept GROUP BY 1) SELECT week, n_articles, CAST(sum(n_articles) OVER (ORDER BY week) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY week) % 10 = 0 AS INTEGER) AS checkpoint FROM weeks"
ORACLES["greeks_rows"] = (
    f"SELECT event_type || '-' || event_id AS symbol, ts, {r('(value + 0.01) - (value - 0.01)')} AS spread, g AS greeks, {r('value / (500 + k)')} AS implied_vol, {r('value / 1000')} AS delta, {r('value + k')} AS opt_price, {r('CASE WHEN event_id % 3 <> 0 THEN value / 100 END')} AS pv_dividend, "
    f"{r('value / 2000')} AS gamma, {r('value / 300')} AS vega, {r('-value / 400')} AS theta, {r('value * 2')} AS und_price FROM events, (VALUES ('bid', 0), ('ask', 1), ('last', 2), ('model', 3)) AS v(g, k)"
)

# streams: what a batch over all rows gives
ORACLES["stream_bars"] = f"{Q15} SELECT {BAR_COLUMNS} FROM bars WHERE ts + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE"
ORACLES["stream_latest_quote"] = f"SELECT event_type AS symbol, ts, {r('value')} AS last, {r('value - 0.01')} AS bid, {r('value + 0.01')} AS ask FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"
ORACLES["stream_ema"] = f"WITH RECURSIVE {fx.TICKS}, num AS (SELECT ticker, ts, seq, price AS close, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) - 1 AS rn, avg(price) OVER (PARTITION BY ticker ORDER BY ts, seq) AS mean_close FROM ticks), {recursion({'ema': ema_state(9)}, 'num')} SELECT n.ticker, n.ts, n.seq, {r('rec.ema')} AS ema FROM num n JOIN rec ON n.ticker = rec.ticker AND n.rn = rec.rn WHERE date_trunc('hour', n.ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE"
ORACLES["resample_total"] = "SELECT CAST(9000 AS BIGINT) AS n, CAST(3 AS BIGINT) AS n_labels"
ORACLES["float_features"] = f"{SPLIT} {pick({c: r(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)') for c in ('close', 'f1', 'f4', 'f_sma', 'f_const')})} FROM parts"
ORACLES["feature_manifest"] = f"{DAILY} SELECT ticker, CAST(count(*) AS BIGINT) AS n_rows, 8 AS n_columns, CAST(0 AS BIGINT) AS n_errors FROM bars GROUP BY ticker"
ORACLES["landed_months"] = f"{DAILY} SELECT ticker, ts, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, {r('CASE WHEN ts >= TIMESTAMP ' + repr('1995-05-20') + ' THEN volume + 1 ELSE volume END')} AS volume FROM bars"
ORACLES["stream_pair"] = f"SELECT s.event_type AS symbol, s.ts AS s_ts, {r('s.value')} AS s_last, o.ts AS o_ts, {r('o.value')} AS o_last FROM events s JOIN events o ON s.event_type = o.event_type AND s.user_id % 2 = 0 AND o.user_id % 2 = 1 AND o.ts >= s.ts AND o.ts <= s.ts + INTERVAL 5 MINUTE"
_num = "num AS (SELECT *, avg(close) OVER (PARTITION BY ticker ORDER BY rn) AS mean_close, sum(gain) OVER (PARTITION BY ticker ORDER BY rn) AS sum_gain, sum(loss) OVER (PARTITION BY ticker ORDER BY rn) AS sum_loss, sum(coalesce(sign(d) * size, size)) OVER (PARTITION BY ticker ORDER BY rn) AS obv FROM moves)"
_moves = "placed AS (SELECT ticker, ts, seq, size, price AS close, row_number() OVER s - 1 AS rn, price - lag(price) OVER s AS d FROM ticks WINDOW s AS (PARTITION BY ticker ORDER BY ts, seq)), moves AS (SELECT *, greatest(coalesce(d, 0), 0) AS gain, greatest(coalesce(-d, 0), 0) AS loss FROM placed)"
ORACLES["stream_indicators"] = (
    f"WITH RECURSIVE {fx.TICKS}, {_moves}, {_num}, {recursion({'ema': ema_state(9), 'g': wilder_state(14, 'gain'), 'l': wilder_state(14, 'loss')}, 'num')} "
    f"SELECT n.ticker, n.ts, n.seq, {r('rec.ema')} AS ema, {r('CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END')} AS rsi, {r('coalesce(obv, 0)')} AS obv FROM num n JOIN rec ON n.ticker = rec.ticker AND n.rn = rec.rn WHERE date_trunc('hour', n.ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE"
)
_side = "SELECT event_type, ts, value FROM events WHERE user_id % 2 = {} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"
_quote = lambda k, n: f"{k}.ts AS {n}_ts, {r(f'{k}.value')} AS {n}_last, {r(f'{k}.value - 0.01')} AS {n}_bid, {r(f'{k}.value + 0.01')} AS {n}_ask"
ORACLES["latest_pairs"] = f"SELECT s.event_type AS symbol, {_quote('s', 'stock')}, {_quote('o', 'option')} FROM ({_side.format(0)}) s JOIN ({_side.format(1)}) o USING (event_type)"
_means = "means AS (SELECT ticker, avg(v) AS p FROM (SELECT event_type AS ticker, user_id % 3 AS m, avg(value) / 1000 AS v FROM events GROUP BY ALL) GROUP BY ticker)"
ORACLES["stream_signals"] = f"WITH {_means}, {SIGNALS[SIGNALS.index('sig AS'):]} SELECT ticker, action, {r('p')} AS predicted_return, {r('confidence')} AS confidence, signal_strength, rank FROM sig"

# sinks
ORACLES["landed_files"] = ORACLES["bars_daily"]
ORACLES["feature_files"] = f"{DAILY} SELECT ticker, count(*) AS n_rows, TRUE AS found FROM bars GROUP BY ticker"
ORACLES["signals_json"] = ORACLES["signals"]
ORACLES["signals_files"] = f"{SIGNALS} SELECT ticker, action, {r('confidence')} AS confidence, signal_strength, rank, run FROM sig, (SELECT unnest(['20240131_093000', '20240131_160000']) AS run)"
ORACLES["news_json"] = ORACLES["news_confidence"]
ORACLES["model_comparison"] = ORACLES["accuracy_f1"].replace("SELECT model, round((SELECT", "SELECT model, CAST(row_number() OVER (ORDER BY (SELECT avg(CAST(pred = actual AS INTEGER)) FROM scored s WHERE s.model = f.model) DESC, model) AS INTEGER) AS place, round((SELECT")
_import = f"{Q15.replace('bars AS (', 'whole AS (')}, bars AS (SELECT ticker, ts, close, CASE WHEN volume <= 300 THEN volume END AS volume FROM whole WHERE close >= 20)"
ORACLES["imported_bars"] = f"{recurrent(_import, 'rsi')} SELECT b.ticker, b.ts, {r('close')} AS close, {r('volume')} AS volume, {r('RSI_15m')} AS RSI_15m FROM bars b JOIN feats f ON b.ticker = f.ticker AND b.ts = f.ts"
