"""Streams of ticks and quotes: bars, latest quotes, pairing, incremental recurrences, signal runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.bars import bars_from_ticks


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come, ``files`` in each micro-batch; ``like`` gives the schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(df: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """With a watermark; times without zone are made instants first, as watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_bars(ticks: DataFrame, every: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks; in append mode a bar comes once it is closed. Later ticks are dropped."""
    return bars_from_ticks(timed(ticks, delay), every)


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The last quote of each symbol; for update or complete mode."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct("ts", "last", "bid", "ask"), F.struct("ts", "seq")).alias("_q")).select("symbol", "_q.*")


#: Quotes of an underlying are joined by blocks of time as long as so many pairing intervals, as arrays of so many quotes at
#: most; a task puts so many quotes in order at once.
INTERVALS, CHUNK, SORTED = 12, 1_024, 1_000_000


def met_quotes(stocks: DataFrame, options: DataFrame, within: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """The pairs of :func:`pair_quotes`, folded: symbol, stock quotes ``s`` (s_ts, s_last, and the places from ``first`` to
    ``until`` of the option quotes that each is paired with) and option quotes as arrays ``o_ts``, ``o_last`` in order of time.

    A dense stream has many more pairs than quotes, and a row of this holds up to CHUNK times CHUNK pairs: kept like this, the
    result is no larger than the quotes of the chunks that meet. :func:`unfolded` gives the pairs, one row each."""
    step = stocks.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {within})").first()[0]
    length = max(INTERVALS * step, 1_000_000)
    s, o = _chunks(stocks, "s", delay, length, step), _chunks(options, "o", delay, length, 0)
    span = F.expr(f"INTERVAL {length + step} MICROSECONDS")  # no chunk is longer; the last two conditions bound the state
    near = (F.col("s_symbol") == F.col("o_symbol")) & (F.col("s_block") == F.col("o_block")) & (F.col("o_to") >= F.col("s_from")) & (F.col("o_from") <= F.col("s_to") + step)
    near &= (F.col("o_time") >= F.col("s_time") - span) & (F.col("o_time") <= F.col("s_time") + span)
    met = s.join(o, near).select(F.col("s_symbol").alias("symbol"), "s_at", "s_last", "o_at", "o_last")
    kind, price = dict(met.dtypes), met.schema["s_last"].dataType.elementType.simpleString()
    return met.mapInArrow(partial(_places_of_pairs, step), f"symbol {kind['symbol']}, s array<struct<s_ts: timestamp, s_last: {price}, first: int, until: int>>, o_ts array<timestamp>, o_last {kind['o_last']}")


def unfolded(met: DataFrame) -> DataFrame:
    """One row for each pair of :func:`met_quotes`: symbol, s_ts, s_last, o_ts, o_last. For streams and for tables of them."""
    each = met.select("symbol", F.inline("s"), "o_ts", "o_last").withColumn("_place", F.explode(F.sequence("first", "until")))
    return each.select("symbol", "s_ts", "s_last", *[F.get(c, F.col("_place")).alias(c) for c in ("o_ts", "o_last")])


def pair_quotes(stocks: DataFrame, options: DataFrame, within: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stock quotes with the option quotes of the same underlying that follow within ``within``; both have a last price.

    Time is cut into blocks of INTERVALS times ``within``: an option quote is in one, a stock quote waits in its own and, if
    the interval reaches over its end, in the next; so each pair meets once. The state holds the quotes of a block in chunks,
    each in order of time, and places in two chunks are found by bisection: the work grows with the quotes and with the pairs,
    not with all that an underlying or a block has. A quote is late by the newest of its chunk: one behind the watermark may
    still be paired if it comes with a timely one. The state holds all quotes of a batch: large ones need STATE_STORE."""
    return unfolded(met_quotes(stocks, options, within, delay))


def _chunks(quotes: DataFrame, side: str, delay: str, length: int, reach: int) -> DataFrame:
    """The quotes of each underlying and block of ``length``, in order of time, as arrays of up to CHUNK; the last ``reach`` of
    a block is in the next one too. Times are in microseconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = quotes.where("last IS NOT NULL AND ts IS NOT NULL AND symbol IS NOT NULL").select("symbol", at.alias("at"), "last")
    block = F.col("at") - F.pmod("at", F.lit(length))
    blocks = F.when(F.col("at") + reach >= block + length, F.array(block, block + length)).otherwise(F.array(block)) if reach else F.array(block)
    rows = rows.withColumn("block", F.explode(blocks)).repartition("symbol", "block")
    kind = dict(rows.dtypes)
    found = rows.mapInArrow(_in_chunks, f"symbol {kind['symbol']}, block long, at array<long>, last array<{kind['last']}>, from long, to long")
    found = found.withColumn("time", F.timestamp_micros("to"))
    return found.select(*[F.col(c).alias(f"{side}_{c}") for c in found.columns]).withWatermark(f"{side}_time", delay)


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= SORTED:
            yield _sorted_chunks(held)
            held, n = [], 0
    if n:
        yield _sorted_chunks(held)


def _sorted_chunks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    symbol, block, at, last = (rows.column(c) for c in ("symbol", "block", "at", "last"))
    code, blocks, times = symbol.dictionary_encode().indices.to_numpy(), block.to_numpy(), at.to_numpy()
    order = np.lexsort((times, blocks, code))
    code, blocks, times = code[order], blocks[order], times[order]
    starts = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(blocks) != 0)))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    starts = np.flatnonzero(place % CHUNK == 0)
    ends = np.append(starts[1:], len(order))
    lists = [pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), x) for x in (pa.array(times), last.take(pa.array(order)))]
    return pa.RecordBatch.from_arrays([symbol.take(pa.array(order[starts])), pa.array(blocks[starts]), *lists, pa.array(times[starts]), pa.array(times[ends - 1])], ["symbol", "block", "at", "last", "from", "to"])


def _places_of_pairs(step: int, batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """For each stock quote the places of the option quotes from its time to ``step`` later, if any."""
    for batch in (whole.slice(k, rows) for whole in batches for k in range(0, len(whole), rows)):
        (s, s_row, s_start), (o, o_row, o_start) = (_flat(batch.column(c)) for c in ("s_at", "o_at"))
        low = np.minimum(s[s_start], o[o_start])  # chunks are never empty
        s_key, o_key = s - low[s_row], o - low[o_row]
        width = max(s_key.max() + step, o_key.max()) + 1  # times of a row stay below those of the next
        s_key, o_key = s_key + s_row * width, o_key + o_row * width
        first, until = np.searchsorted(o_key, s_key), np.searchsorted(o_key, s_key + step, "right")
        paired = np.flatnonzero(until > first)
        n = np.bincount(s_row[paired], minlength=len(batch))
        shift, kept, us = o_start[s_row[paired]], pa.array(n > 0), pa.timestamp("us", "UTC")
        fields = [pa.array(s[paired]).cast(us), batch.column("s_last").flatten().take(pa.array(paired)), *(pa.array(x, pa.int32()) for x in (first[paired] - shift, until[paired] - shift - 1))]
        quotes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[n > 0])), pa.int32()), pa.StructArray.from_arrays(fields, ["s_ts", "s_last", "first", "until"]))
        yield pa.RecordBatch.from_arrays([batch.column("symbol").filter(kept), quotes, batch.column("o_at").filter(kept).cast(pa.list_(us)), batch.column("o_last").filter(kept)], ["symbol", "s", "o_ts", "o_last"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of all lists, the row of each, and where each list begins."""
    n = lists.value_lengths().to_numpy()
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n


def latest_pairs(quotes: DataFrame) -> DataFrame:
    """symbol with the last stock quote and the last option quote (ts, last, bid, ask) of ``quotes`` (kind: stock or
    option), where both are there and have a last price. For tables, and for streams in complete mode."""
    q = F.struct("ts", "last", "bid", "ask")
    newest = [F.max_by(F.when(F.col("kind") == k, q), F.when(F.col("kind") == k, F.struct("ts", "seq"))).alias(k) for k in ("stock", "option")]
    found = quotes.groupBy("symbol").agg(*newest).where("stock.last IS NOT NULL AND option.last IS NOT NULL")
    return found.select("symbol", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("stock", "option") for c in ("ts", "last", "bid", "ask")])


#: Rows of a key are put in order by stretches of so many seconds; one stretch of a key stands in memory at a time.
STRETCH = 3_600


class IndicatorProcessor(StatefulProcessor):
    """For each key an exponential mean, a relative strength index and on-balance volume, in order of event time.

    Rows wait in the state, by stretches of time, until the watermark has passed the end of their stretch; then no more of
    them can come, and the stretches are folded one after another in order of (ts, seq). So neither the order of rows in a
    micro-batch nor that of micro-batches matters. A timer at the end of the earliest stretch sees to keys without new rows.
    The state further holds the number of values, what the seeds need and the last values."""

    def __init__(self, ema: int, rsi: int, stretch: int = STRETCH):
        self.ema, self.rsi, self.stretch = ema, rsi, stretch * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("indicators", "n long, price double, total double, mean double, gain double, loss double, obv double")
        self.waiting = handle.getMapState("waiting", "stretch long", "at array<long>, seq array<long>, price array<double>, size array<double>")
        self.closed = handle.getValueState("closed", "until long")  # stretches that end here or before are done

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.closed.get()[0] if self.closed.exists() else None
        for chunk in rows:
            for k, part in chunk.groupby(chunk["at"] // self.stretch):
                if until is not None and (k + 1) * self.stretch <= until:
                    continue  # late
                new = [part[c].tolist() for c in ("at", "seq", "price", "size")]
                if self.waiting.containsKey((int(k),)):
                    new = [[*old, *more] for old, more in zip(self.waiting.getValue((int(k),)), new, strict=True)]
                self.waiting.updateValue((int(k),), tuple(new))
        yield from self._close(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key, timerValues)

    def _close(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Fold the stretches that the watermark has passed, and wait for the next."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        stretches = sorted(int(k[0]) for k in self.waiting.keys())
        done = [k for k in stretches if (k + 1) * self.stretch <= mark]
        for k in done:
            at, seq, price, size = (np.array(x, dtype=t) for x, t in zip(self.waiting.getValue((k,)), ("int64", "int64", "float64", "float64"), strict=True))
            order = np.lexsort((seq, at))
            yield self._fold(key, at[order], seq[order], price[order], size[order])
            self.waiting.removeKey((k,))
        if done:
            self.closed.update(((done[-1] + 1) * self.stretch,))
        set_ = set(self.handle.listTimers())
        if len(done) < len(stretches):
            due = -(-(stretches[len(done)] + 1) * self.stretch // 1000)
            if due not in set_ and due > mark // 1000:
                self.handle.registerTimer(due)

    def _fold(self, key, at_us: np.ndarray, seq: np.ndarray, x: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        n, price, total, mean, gain, loss, obv = self.state.get() if self.state.exists() else (0, None, 0.0, 0.0, 0.0, 0.0, 0.0)
        step = np.diff(x, prepend=x[0] if price is None else price)
        flow = np.nan_to_num(np.sign(step) * size)
        if price is None:
            flow[0] = np.nan_to_num(size[0])  # the first value counts in full
        flow[0] += obv
        obvs = np.cumsum(flow)
        at = n + np.arange(len(x))  # places in the series
        means = _seeded(x, at, mean, total, self.ema - 1, self.ema, 2 / (self.ema + 1))
        gains = _seeded(np.maximum(step, 0), at, gain, gain * min(max(n - 1, 0), self.rsi), self.rsi, self.rsi, 1 / self.rsi)
        losses = _seeded(np.maximum(-step, 0), at, loss, loss * min(max(n - 1, 0), self.rsi), self.rsi, self.rsi, 1 / self.rsi)
        both = gains + losses
        rsi = np.where(both == 0, 0.0, 100 * gains / np.where(both == 0, 1, both))
        rsi[at < self.rsi] = np.nan
        n += len(x)
        self.state.update((n, float(x[-1]), float(total + x.sum()) if n <= self.ema else 0.0, float(means[-1]), float(gains[-1]), float(losses[-1]), float(obvs[-1])))
        none = lambda a: pd.Series(a, dtype="float64").astype(object).where(~np.isnan(a), None)
        return pd.DataFrame({"ticker": key[0], "at": at_us, "seq": seq, "ema": none(np.where(at >= self.ema - 1, means, np.nan)), "rsi": none(rsi), "obv": none(obvs)})

    def close(self) -> None:
        pass


def _seeded(x: np.ndarray, at: np.ndarray, last: float, total: float, first: int, n: int, k: float) -> np.ndarray:
    """y[i] = (1 - k) * y[i - 1] + k * x[i] from place ``first`` on, where y is the mean of the n values up to there;
    before, the running mean. ``last`` is y before these values, ``total`` the sum of the values so far."""
    warm = at <= first
    skip = first + 1 - n  # values before this place are no part of the seed
    sums = total + np.cumsum(np.where(warm & (at >= skip), x, 0.0))
    out = sums / np.maximum(1, at + 1 - skip)
    if not warm.all():
        start = out[warm][-1] if warm.any() else last
        out[~warm] = pd.Series([start, *x[~warm]]).ewm(alpha=k, adjust=False).mean().to_numpy()[1:]
    return out


#: State that outgrows memory needs this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: With it, joins of streams keep both sides of a partition in one store, not in four: fewer files and shorter commits.
JOIN_STATE = ("spark.sql.streaming.join.stateFormatVersion", "3")


def stream_indicators(ticks: DataFrame, ema: int = 9, rsi: int = 14, delay: str = "10 minutes", stretch: int = STRETCH) -> DataFrame:
    """ticker, ts, seq and the running EMA, RSI and OBV of each ticker's prices and sizes in order of (ts, seq), whatever the
    order in which rows come. A row comes out once the watermark (``delay`` behind the latest time seen) has passed the end
    of its ``stretch`` (seconds); rows of a stretch that is done are late and dropped. Rows without a time or a price are left
    out; a missing size counts as none. Needs STATE_STORE."""
    rows = timed(ticks, delay).select("ticker", "ts", F.unix_micros("ts").alias("at"), "seq", "price", F.col("size").cast("double").alias("size"))
    rows = rows.where("ts IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)")
    found = rows.groupBy("ticker").transformWithStateInPandas(IndicatorProcessor(ema, rsi, stretch), "ticker string, at long, seq long, ema double, rsi double, obv double", "Append", "EventTime")
    return found.select("ticker", F.timestamp_micros("at").alias("ts"), "seq", "ema", "rsi", "obv")


def stream_ema(ticks: DataFrame, n: int = 9, delay: str = "10 minutes") -> DataFrame:
    """The running EMA alone."""
    return stream_indicators(ticks.withColumn("size", F.lit(0.0)), n, delay=delay).select("ticker", "ts", "seq", "ema")


def drained(stream: DataFrame, name: str, folder: str, settings: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Runs a stream in append mode over what is there and returns its rows, written as Parquet. ``settings`` hold while the
    stream starts."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k, _ in settings}
    for k, v in settings:
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{folder}/{name}").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_incrementally(stream: DataFrame, work: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Gives each new micro-batch to ``work`` (say, one that writes signals) and ends when all is done. After a failure the
    last micro-batch may be given again under the same number: see :func:`write_once`."""
    stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def write_once(df: DataFrame, number: int, path: str, form: str = "json") -> None:
    """The rows of micro-batch ``number`` in a folder of its own, and then a marker that it is complete. A batch that comes
    again after a failure replaces what it has left, so each batch is there exactly once."""
    df.write.mode("overwrite").format(form).save(f"{path}/rows/batch={number}")
    df.sparkSession.range(1).select(F.lit(True).alias("complete")).coalesce(1).write.mode("overwrite").format(form).save(f"{path}/done/batch={number}")


def latest_of(spark: SparkSession, path: str, schema: str, key: str, form: str = "json") -> DataFrame:
    """The newest row of each key of the micro-batches of :func:`write_once`, where each holds the keys that it changes: a
    table with upserts of which a batch writes its own keys only, and a reader takes the last."""
    rows = read_complete(spark, path, schema, form, with_batch=True)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_row")).select("_row.*")


def read_complete(spark: SparkSession, path: str, schema: str, form: str = "json", with_batch: bool = False) -> DataFrame:
    """The rows of all complete micro-batches of :func:`write_once`; those of a batch without its marker stay out."""

    def found(part: str, columns: str) -> DataFrame:
        try:
            return spark.read.schema(f"{columns}, batch long").format(form).load(f"{path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{columns}, batch long")

    rows = found("rows", schema).join(found("done", "complete boolean").where("complete"), "batch", "left_semi")
    return rows if with_batch else rows.drop("batch")
