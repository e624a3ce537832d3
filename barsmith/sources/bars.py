"""Reading, landing and writing of price bars, ticker universes, logs and records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import no_nan

BAR_COLUMNS = ("ticker", "ts", "open", "high", "low", "close", "volume")


def bars_from_ticks(ticks: DataFrame, every: str = "15 minutes") -> DataFrame:
    """OHLCV bars of ``ticks`` (ticker, ts, price, size, seq). Ticks of one instant are ordered by seq. Windows without
    ticks give no bar."""
    at = F.struct("ts", "seq")
    bars = ticks.groupBy("ticker", F.window("ts", every).alias("_w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("ticker", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Bars of a directory; text timestamps are parsed, the order lives in windows and not in the files."""
    df = spark.read.format(form).option("header", "true").load(path)
    kind = dict(df.dtypes)
    ts = F.to_timestamp_ntz("ts") if kind.get("ts") == "string" else F.col("ts")
    return df.select("ticker", ts.alias("ts"), *[F.col(c).cast("double").alias(c) for c in BAR_COLUMNS[2:]])


def usable(bars: DataFrame) -> DataFrame:
    """Bars that can take part in a series: NaN and infinities are missing values, and a bar without all four prices is
    left out, so that it shifts no mean and breaks no recurrence. A missing volume stays missing."""
    kinds = dict(bars.dtypes)
    numbers = {c: no_nan(F.col(c)) for c in BAR_COLUMNS[2:] if kinds[c] in ("double", "float")}
    return bars.withColumns(numbers).dropna("any", subset=list(BAR_COLUMNS[2:6]))


def land_months(bars: DataFrame, path: str) -> None:
    """Adds ``bars`` to the table at ``path``, which is kept in a folder for each month: of rows of one (ticker, ts) the new
    one stays. Only the months that ``bars`` has rows in are read and written again."""
    spark = bars.sparkSession
    month = lambda df: df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    new = month(bars.select(*BAR_COLUMNS))
    try:
        there = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in bars.select(*BAR_COLUMNS).schema)}, month string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = None
    rows = new.withColumn("_old", F.lit(0))
    if there is not None:  # one row for each touched month: a broadcast of months, and partitions pruned by them
        rows = rows.unionByName(there.join(F.broadcast(new.select("month").distinct()), "month", "left_semi").withColumn("_old", F.lit(1)))
    rows = rows.groupBy("ticker", "ts").agg(F.min_by(F.struct(*BAR_COLUMNS[2:], "month"), "_old").alias("_row")).select("ticker", "ts", "_row.*")
    rows.repartition("month").sortWithinPartitions("month", "ticker", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def file_manifest(spark: SparkSession, path: str, pattern: str = r"([^/=]+)/[^/]*$|([^/]+)\.parquet$") -> DataFrame:
    """(file, ticker, n_rows, columns, error) of every Parquet file below a folder; a file that can't be read has an error in
    place of rows and columns; empty files are not listed. Files are opened by tasks, one after another; each must fit into a worker's memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.col("path").alias("file"), F.regexp_extract("path", pattern, 1).alias("ticker"), "content")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                try:
                    found = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                    rows.append((found.metadata.num_rows, found.schema_arrow.names, None))
                except (pa.ArrowException, OSError) as e:
                    rows.append((None, None, f"{type(e).__name__}: {e}"[:300]))
            n, columns, errors = zip(*rows, strict=True) if rows else ([], [], [])
            made = [pa.array(n, pa.int64()), pa.array(columns, pa.list_(pa.string())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("ticker"), *made], ["file", "ticker", "n_rows", "columns", "error"])

    return files.mapInArrow(look, "file string, ticker string, n_rows long, columns array<string>, error string")


def land_bars(*chunks: DataFrame, source_zone: str | None = None, target_zone: str = "America/New_York") -> DataFrame:
    """Chunks in any order and overlap as one table: local time without zone, the six columns, one row for each
    (ticker, ts): that of the chunk given first."""
    parts = []
    for rank, c in enumerate(chunks):
        ts = F.convert_timezone(F.lit(source_zone), F.lit(target_zone), F.col("ts")) if source_zone else F.col("ts")
        parts.append(c.select("ticker", ts.cast("timestamp_ntz").alias("ts"), *BAR_COLUMNS[2:], F.lit(rank).alias("_rank")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    w = W.partitionBy("ticker", "ts").orderBy("_rank")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*BAR_COLUMNS)


def read_feature_files(spark: SparkSession, path: str, pattern: str = r"([^/=]+)/[^/]*$|([^/]+)\.parquet$", skip_broken: bool = False, schema: str | None = None) -> DataFrame:
    """All feature files below a directory with the ticker taken from the file's path: its folder (``ticker=X/part``) or,
    for other ``pattern``s, what the first group finds. With ``skip_broken`` files that can't be read are passed over;
    :func:`files_read` says which were read, :func:`file_manifest` which can't be and why. With a ``schema`` no footer is read
    beforehand; without one those of all files are, to merge their columns."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_broken).lower()).option("recursiveFileLookup", "true")
    df = (reader.schema(schema) if schema else reader.option("mergeSchema", "true")).parquet(path)
    return df.withColumn("ticker", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def files_read(features: DataFrame) -> DataFrame:
    """(ticker, n_files, n_rows): what a feature scan has found for each ticker."""
    return features.withColumn("_file", F.input_file_name()).groupBy("ticker").agg(F.countDistinct("_file").alias("n_files"), F.count("*").alias("n_rows"))


def write_bars(bars: DataFrame, path: str) -> None:
    """A folder for each ticker, in order of time within the files."""
    bars.repartition("ticker").sortWithinPartitions("ticker", "ts").write.partitionBy("ticker").parquet(path)


def bars_between(bars: DataFrame, start: str, end: str, symbols: list[str] | None = None, least: int = 100) -> DataFrame:
    """Complete bars of [start, end); tickers with fewer than ``least`` of them go."""
    found = bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    if symbols is not None:
        found = found.where(F.col("ticker").isin(symbols))
    found = found.select(*BAR_COLUMNS).dropna()
    return found.withColumn("_n", F.count("*").over(W.partitionBy("ticker"))).where(F.col("_n") >= least).drop("_n")


def recent_bars(bars: DataFrame, days: int) -> DataFrame:
    """The last ``days`` days of each ticker."""
    newest = F.max("ts").over(W.partitionBy("ticker"))
    return bars.withColumn("_newest", newest).where(F.col("ts") >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")


def universe(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(code, ticker): trimmed non-blank lines of ``lines`` (pos, value) in order, coded from 0."""
    clean = lines.select("pos", F.trim("value").alias("ticker")).where("ticker <> ''")
    coded = clean.withColumn("code", (F.row_number().over(W.orderBy("pos")) - 1).cast("short")).select("code", "ticker")
    return coded.orderBy("code").limit(limit) if limit else coded


def read_universe(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A ticker list; whole files are read as one value each, so the order of lines is kept."""
    text = spark.read.option("wholetext", "true").text(path)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    return universe(lines, limit)


def with_codes(bars: DataFrame, codes: DataFrame) -> DataFrame:
    """``bars`` with the code of their ticker; other tickers go."""
    return bars.join(F.broadcast(codes), "ticker")  # a universe is a short list by definition (16-bit codes)


def ticker_report(codes: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of each ticker of the universe, and whether there are any."""
    n = features.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    return codes.join(n, "ticker", "left").select("ticker", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.col("n_rows").isNotNull().cast("int").alias("succeeded"))


def pool_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"))


def write_signals(signals: DataFrame, path: str) -> None:
    """Signals as JSON lines in a folder for each time at which they were made (``run=yyyyMMdd_HHmmss``); a run that is
    written again replaces its folder and no other."""
    rows = signals.withColumn("run", F.date_format("timestamp", "yyyyMMdd_HHmmss"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema: no pass over the data to infer one, and lines of another form give nulls."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of ``by``."""
    (df.write.partitionBy(by) if by else df.write).json(path)


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def epoch_log(lines: DataFrame) -> DataFrame:
    """(run, epoch, train_loss, test_loss, accuracy, lr) of ``lines`` (run, value); lines of another form go."""
    form = r"^Epoch\s+(\d+): Train Loss: ([\d.]+), Test Loss: ([\d.]+), Accuracy: ([\d.]+)%, Lr: ([\d.eE+-]+)"
    part = lambda i, t: F.regexp_extract("value", form, i).try_cast(t)
    found = lines.select("run", part(1, "int").alias("epoch"), part(2, "double").alias("train_loss"), part(3, "double").alias("test_loss"), part(4, "double").alias("accuracy"), part(5, "double").alias("lr"))
    return found.where("epoch IS NOT NULL")


def as_float(df: DataFrame) -> DataFrame:
    """Every double as float, at a sink."""
    return df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def feature_names(df: DataFrame, keys: tuple[str, ...] = ("ticker", "ts", "code", "target", "split", "label")) -> list[str]:
    return [c for c in df.columns if c not in keys]


def newest(df: DataFrame, order: Column | None = None) -> DataFrame:
    """The last row of each ticker, without a sort; of rows of one time always the same, whatever the partitions."""
    at = F.struct(F.col("ts") if order is None else order, F.xxhash64(*df.columns))
    row = F.max_by(F.struct(*df.columns), at).alias("_row")
    return df.groupBy("ticker").agg(row).select("_row.*")
