"""Domain tables built from the given ones, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fundamentals
from ..sources.bars import bars_from_ticks


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; the 0 makes a negative zero positive."""
    return F.round(x, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r6(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("ticker"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").try_cast("double").alias("size"))


TICKS = "ticks AS (SELECT event_type AS ticker, ts, event_id AS seq, value AS price, TRY_CAST(regexp_extract(props, '\"k\": *([0-9.]+)', 1) AS DOUBLE) AS size FROM events)"


def bars15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir))


BARS15 = f"{TICKS}, bars AS (SELECT ticker, time_bucket(INTERVAL '15 minutes', ts) AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(size) AS volume FROM ticks GROUP BY ALL)"


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    at = F.struct("l_orderkey", "l_linenumber", F.floor("l_extendedprice"))
    x = x.select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").alias("ts"), (F.lit(1000.0) + F.floor("l_extendedprice") / 1000).alias("price"), "l_quantity", at.alias("at"))
    return x.groupBy("ticker", "ts").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"))


BARS_DAILY = (
    "items AS (SELECT l_returnflag || l_linestatus AS ticker, l_shipdate AS ts, 1000.0::DOUBLE + floor(l_extendedprice) / 1000 AS price, l_quantity AS size, l_orderkey, l_linenumber FROM lineitem), "
    "bars AS (SELECT ticker, ts, first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, price) AS close, sum(size) AS volume FROM items GROUP BY ALL)"
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on the embeddings: logits are elements 1 to 3, and 4 to 6."""
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), F.col("label")).alias("ticker"), F.col("vec_id").alias("ts"), (F.col("label") % 3).cast("int").alias("actual"), "embedding")
    part = lambda k: F.transform(F.slice("embedding", 3 * k + 1, 3), lambda v: v.cast("double"))
    one = e.select(F.lit("a").alias("model"), "ticker", "ts", "actual", part(0).alias("logits"))
    return one.unionByName(e.select(F.lit("b").alias("model"), "ticker", "ts", "actual", part(1).alias("logits")))


SCORES = (
    "e AS (SELECT 't' || label AS ticker, vec_id AS ts, CAST(label % 3 AS INTEGER) AS actual, embedding FROM embeddings), "
    "scores AS (SELECT 'a' AS model, ticker, ts, actual, CAST(embedding[1] AS DOUBLE) AS l0, CAST(embedding[2] AS DOUBLE) AS l1, CAST(embedding[3] AS DOUBLE) AS l2 FROM e "
    "UNION ALL SELECT 'b', ticker, ts, actual, CAST(embedding[4] AS DOUBLE), CAST(embedding[5] AS DOUBLE), CAST(embedding[6] AS DOUBLE) FROM e), "
    "scored AS (SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS pred, exp(l0 - greatest(l0, l1, l2)) AS x0, exp(l1 - greatest(l0, l1, l2)) AS x1, exp(l2 - greatest(l0, l1, l2)) AS x2 FROM scores)"
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns in percent that three models give for each event type: means of centred values."""
    e = read(spark, sf_dir, "events")
    every = e.agg(F.avg("value").alias("mean"))
    by = e.groupBy(F.col("event_type").alias("ticker"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model")).agg(F.avg("value").alias("v"))
    return by.crossJoin(F.broadcast(every)).select("ticker", "model", ((F.col("v") - F.col("mean")) / 50).alias("predicted_return"))


PREDICTIONS = (
    "predictions AS (SELECT event_type AS ticker, 'm' || (user_id % 3) AS model, (avg(value) - (SELECT avg(value) FROM events)) / 50 AS predicted_return FROM events GROUP BY ALL)"
)


def strategy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by period (two) and model (three simple forecasts), with the strategy's indicators."""
    from ..functions.windows import lagged
    from ..operators.strategy import grid, indicators

    bars = indicators(bars_daily(spark, sf_dir))
    bars = bars.withColumns({"_1": F.try_divide("close", lagged("close", 1)) - 1, "_5": F.try_divide("close", lagged("close", 5)) - 1})
    models = spark.createDataFrame([("follow",), ("revert",), ("trend",)], "model string")
    periods = spark.createDataFrame([("early", "1990-01-01", "1995-07-01"), ("late", "1995-07-01", "2005-01-01")], "period string, start string, end string")
    periods = periods.select("period", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"))
    out = grid(bars, models, periods)
    pred = F.when(F.col("model") == "follow", F.col("_1")).when(F.col("model") == "revert", -F.col("_1")).otherwise(F.col("_5"))
    return out.withColumn("predicted_return", pred).drop("_1", "_5")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement items of suppliers by year, from what they shipped."""
    x = read(spark, sf_dir, "lineitem")
    amounts = {
        "TotalRevenue": F.col("l_extendedprice"), "CostOfRevenue": F.col("l_extendedprice") * F.col("l_discount"), "TaxProvision": F.col("l_extendedprice") * F.col("l_tax"),
        "OrdinarySharesNumber": F.col("l_quantity"), "TotalAssets": F.col("l_extendedprice") * 2 + F.col("l_quantity"), "NetIncome": F.col("l_extendedprice") * (F.lit(0.06) - F.col("l_discount")),
        "OperatingCashFlow": F.col("l_extendedprice") * (F.lit(0.08) - F.col("l_tax")), "CurrentAssets": F.col("l_quantity") * 10, "CurrentLiabilities": F.col("l_quantity") * 7 + F.col("l_linenumber"),
    }
    wide = x.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.trunc("l_shipdate", "year").alias("period")).agg(*[F.sum(v).alias(k) for k, v in amounts.items()])
    long = wide.unpivot(["ticker", "period"], list(amounts), "item", "value")
    return long.select("ticker", F.lit("income_stmt").alias("source"), "item", "period", "value")


ITEMS = ("TotalRevenue", "CostOfRevenue", "TaxProvision", "OrdinarySharesNumber", "TotalAssets", "NetIncome", "OperatingCashFlow", "CurrentAssets", "CurrentLiabilities")
STATEMENTS = (
    "wide AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('year', l_shipdate) AS DATE) AS period, sum(l_extendedprice) AS TotalRevenue, sum(l_extendedprice * l_discount) AS CostOfRevenue, "
    "sum(l_extendedprice * l_tax) AS TaxProvision, sum(l_quantity) AS OrdinarySharesNumber, sum(l_extendedprice * 2 + l_quantity) AS TotalAssets, sum(l_extendedprice * (0.06::DOUBLE - l_discount)) AS NetIncome, "
    "sum(l_extendedprice * (0.08::DOUBLE - l_tax)) AS OperatingCashFlow, sum(l_quantity * 10) AS CurrentAssets, sum(l_quantity * 7 + l_linenumber) AS CurrentLiabilities FROM lineitem GROUP BY ALL)"
)


def _amount(j: int) -> str:
    """A sum in whole numbers that both engines read and give exactly; every third item can be negative."""
    return f"sum(CAST(round(l_extendedprice * 100) AS BIGINT) * {'(CAST(l_linenumber AS BIGINT) - 4)' if j % 3 == 2 else 2 + j % 7} + CAST(l_quantity AS BIGINT) * {(37 * j) % 101})"


_FILED = {**fundamentals.ITEMS, "notes": ["Inventory"]}
FILINGS = {item: (source, _amount(j)) for j, (source, item) in enumerate((s, i) for s, items in _FILED.items() for i in items)}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of all three statements of suppliers by year; of suppliers whose number ends in 7 one item is missing."""
    x = read(spark, sf_dir, "lineitem")
    wide = x.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.trunc("l_shipdate", "year").alias("period")).agg(*[F.expr(v).cast("double").alias(k) for k, (_, v) in FILINGS.items()])
    long = wide.unpivot(["ticker", "period"], list(FILINGS), "item", "value")
    source = F.element_at(F.create_map(*[F.lit(x) for k, (s, _) in FILINGS.items() for x in (k, s)]), F.col("item"))
    return long.select("ticker", source.alias("source"), "item", "period", "value").where("NOT (ticker LIKE '%7' AND item = 'GrossProfit')")


FILED = "filed AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('year', l_shipdate) AS DATE) AS period, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, (_, v) in FILINGS.items()) + " FROM lineitem WHERE l_suppkey % 10 <> 7 GROUP BY ALL)"


def news_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose headline carries a confidence, every seventh without; every fifth comes twice."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    score = (F.col("doc_id") % 21) / F.lit(20.0)
    mark = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{A:"), F.col("doc_id"), F.lit("}"))).otherwise(F.concat(F.lit("{A:"), F.col("doc_id"), F.lit(":L:"), "lang", F.lit(":K:n/a:C:"), score.cast("decimal(4,2)").cast("string"), F.lit("}")))
    time = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 9000).cast("int"))
    one = d.select(F.col("source").alias("ticker"), F.col("doc_id").alias("article_id"), time.alias("time"), F.concat(mark, F.sha2("text", 256)).alias("headline"), F.sha2(F.col("text"), 224).alias("article"))
    again = one.where("article_id % 5 = 0").withColumn("time", F.col("time") + F.make_dt_interval(F.lit(1)))
    return one.unionByName(again)


NEWS = (
    "one AS (SELECT source AS ticker, doc_id AS article_id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 9000 AS INTEGER)) AS time, "
    "CASE WHEN doc_id % 7 = 0 THEN '{A:' || doc_id || '}' ELSE '{A:' || doc_id || ':L:' || lang || ':K:n/a:C:' || CAST(CAST((doc_id % 21) / 20.0 AS DECIMAL(4,2)) AS VARCHAR) || '}' END || sha256(text) AS headline FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), "
    "raw AS (SELECT * FROM one UNION ALL SELECT ticker, article_id, time + INTERVAL 1 DAY, headline FROM one WHERE article_id % 5 = 0), "
    "firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY ticker, article_id ORDER BY time, headline) = 1), "
    "confident AS (SELECT ticker, article_id, time, TRY_CAST(split_part(split_part(headline, 'C:', 2), '}', 1) AS DOUBLE) AS confidence, CASE WHEN instr(headline, '}') > 0 THEN substr(headline, instr(headline, '}') + 1) ELSE headline END AS headline FROM firsts)"
)


def epoch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made of orders by month: one run for each priority."""
    o = read(spark, sf_dir, "orders")
    month = F.months_between(F.trunc("o_orderdate", "month"), F.lit("1990-01-01").cast("date")).cast("int")
    by = o.groupBy(F.col("o_orderpriority").alias("run"), month.alias("epoch")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("c"))
    dec = lambda x: F.concat((x.cast("int") / 1000).cast("int").cast("string"), F.lit("."), F.lpad((x % 1000).cast("string"), 3, "0"))
    line = F.concat(F.lit("Epoch "), F.lpad(F.col("epoch").cast("string"), 3, " "), F.lit(": Train Loss: "), dec(F.col("c") * 10), F.lit(", Test Loss: "), dec(F.col("n") * 10 + 7), F.lit(", Accuracy: "), dec(F.col("c") * 100), F.lit("%, Lr: 8.150e-05"), F.when(F.col("epoch") % 10 == 0, F.lit("   Overfits here")).otherwise(F.lit("")))
    return by.select("run", line.alias("value"))


EPOCHS = (
    "log AS (SELECT o_orderpriority AS run, CAST(date_diff('month', DATE '1990-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS INTEGER) AS epoch, "
    "count(DISTINCT o_custkey) * 10 / 1000.0::DOUBLE AS train_loss, (count(*) * 10 + 7) / 1000.0::DOUBLE AS test_loss, count(DISTINCT o_custkey) * 100 / 1000.0::DOUBLE AS accuracy, 8.15e-05::DOUBLE AS lr FROM orders GROUP BY ALL)"
)


def option_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")

    def greeks(k: int) -> Column:
        v = F.col("value")
        pv = F.when(F.col("event_id") % 3 != 0, v / 100)
        parts = {"implied_vol": v / (500 + k), "delta": v / 1000, "opt_price": v + k, "pv_dividend": pv, "gamma": v / 2000, "vega": v / 300, "theta": -v / 400, "und_price": v * 2}
        return F.struct(*[x.alias(n) for n, x in parts.items()])

    return e.select(F.concat("event_type", F.lit("-"), F.col("event_id")).alias("symbol"), "ts", (F.col("value") - 0.01).alias("bid"), (F.col("value") + 0.01).alias("ask"), *[greeks(k).alias(f"{n}_greeks") for k, n in enumerate(("bid", "ask", "last", "model"))])


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 2 == 0, "stock").otherwise("option")
    return e.select(F.col("event_type").alias("symbol"), kind.alias("kind"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("last"), (F.col("value") - 0.01).alias("bid"), (F.col("value") + 0.01).alias("ask"))


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company information of suppliers as (ticker, field, value), some of it unreadable."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), "s_acctbal", "s_suppkey")
    v = {"trailingPE": F.col("s_acctbal") / 300, "forwardPE": F.col("s_acctbal") / 320, "marketCap": F.col("s_acctbal") * 1000, "currentPrice": F.col("s_acctbal") / 10, "trailingEps": F.col("s_acctbal") / 90, "enterpriseValue": F.col("s_acctbal") * 1100}
    parts = F.array(*[F.struct(F.lit(k).alias("field"), F.when(F.col("s_suppkey") % 11 == 0, "n/a").otherwise(x.cast("string")).alias("value")) for k, x in v.items()])
    return s.select("ticker", F.explode(parts).alias("_f")).select("ticker", "_f.field", "_f.value")


INFO = "info AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal / 300 END AS trailingPE, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal / 320 END AS forwardPE, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal * 1000 END AS marketCap, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal * 1100 END AS enterpriseValue FROM supplier)"


# weights of two small networks of a user's own, by rule
DENSE = tuple(tuple(((3 * i + 2 * k) % 7 - 3) / 4 for k in range(3)) for i in range(3))
BIAS = (0.1, 0.0, -0.1)
INNER = tuple(tuple(((7 * i + 3 * j) % 11 - 5) / 100 for j in range(3)) for i in range(46))
OWN = tuple(tuple(((i + 2 * j) % 5 - 2) / 10 for j in range(3)) for i in range(3))
HEAD = tuple(tuple(float((j + k) % 3 - 1) for k in range(3)) for j in range(3))
