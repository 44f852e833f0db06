"""Incremental ingestion with Structured Streaming: daily prices, month bars, point-in-time rows, positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..plans.panel import last_rows_of_month, merge_point_in_time
from ..session import materialize

DAILY = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("id", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("adj_close", T.DoubleType()), T.StructField("dividend", T.DoubleType()), T.StructField("shares", T.DoubleType())])


def price_stream(spark: SparkSession, folder: str, schema: T.StructType = DAILY, files_per_batch: int | None = None) -> DataFrame:
    """Price files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _store(batch: DataFrame, batch_id: int, table: str) -> None:
    """A batch into ``table`` under its month and id; a replayed batch replaces its own files and nothing else."""
    laid_out = batch.withColumns({"month": F.last_day("date"), "batch": F.lit(batch_id)}).repartitionByRange("month", "ticker")
    (laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(table))


def _stored(spark: SparkSession, batch: DataFrame, table: str) -> DataFrame:
    """Rows of ``table`` in the months of a batch, whose list prunes the partitions; no rows while there is no table."""
    schema = T.StructType([*batch.schema.fields, T.StructField("month", T.DateType()), T.StructField("batch", T.LongType())])
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("month", "batch").parquet(table)
    months = [r[0] for r in batch.select(F.last_day("date")).distinct().collect()]
    return spark.read.schema(schema).parquet(table).where(F.col("month").isin(months))


def _months_met(rows: DataFrame, batch_id: int, table: str) -> list:
    """Months of ``table`` in which an earlier batch has a day of ``rows``; the days of ``rows`` are noted under their batch.

    The note beside the table has one row per batch and day, so days that no batch has brought yet are known to be new
    without a look at the stored prices. It is written before the prices; a replayed batch replaces its own note.
    """
    spark, index = rows.sparkSession, f"{table.rstrip('/')}_days"
    days = rows.select("date").distinct()
    days.write.mode("overwrite").parquet(f"{index}/batch={batch_id}")
    noted = spark.read.schema("date date, batch long").option("basePath", index).parquet(index)
    met = noted.where(F.col("batch") < batch_id).join(days, "date", "left_semi")
    return [r[0] for r in met.select(F.last_day("date")).distinct().collect()]


def _one_a_day(rows: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """One row per (ticker, date): the largest by ``first`` and then by all columns, so a replay chooses the same."""
    rest = [c for c in rows.columns if c not in ("ticker", "date", *first)]
    best = F.max(F.struct(*first, *rest)).alias("__best")
    return rows.groupBy("ticker", "date").agg(best).select("ticker", "date", *[F.col(f"__best.{c}").alias(c) for c in rest])


def append_prices(stream: DataFrame, table: str, checkpoint: str, symbols: DataFrame | None = None) -> StreamingQuery:
    """All files present now into the price table, one row per (ticker, date), known symbols only.

    A row enters unless an earlier batch has brought its day already, whatever its age, and there is no watermark. Only
    months in which an earlier batch has one of the batch's days are read; a batch of new days reads no stored prices.
    The checkpoint keeps what was read, so a restart resumes.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("ticker").isNotNull() & F.col("date").isNotNull())
        if symbols is not None:
            rows = rows.join(symbols.select("ticker").distinct(), "ticker", "left_semi")
        rows = materialize(_one_a_day(rows).select(*batch.columns))
        met = _months_met(rows, batch_id, table)
        if met:
            stored = batch.sparkSession.read.schema("ticker string, date date, month date, batch long").parquet(table)
            earlier = stored.where(F.col("month").isin(met) & (F.col("batch") < batch_id))
            rows = rows.join(earlier.select("ticker", "date"), ["ticker", "date"], "left_anti")
        _store(rows, batch_id, table)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_month_bars(stream: DataFrame, daily: str, bars: str, checkpoint: str, ties: Sequence[str] = ()) -> StreamingQuery:
    """Month rows kept current: a batch is stored under its id, and the months it touches are rebuilt and overwritten.

    Of a day that several batches bring, the latest batch counts, so a corrected price replaces the first one. Without
    ``ties`` a batch has one row per ticker and day. Storing and overwriting are idempotent.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch.where(F.col("ticker").isNotNull() & F.col("date").isNotNull()))
        if batch.isEmpty():
            return
        _store(batch, batch_id, daily)
        stored = _stored(batch.sparkSession, batch, daily).drop("month")  # listed after the batch is in it
        if ties:
            latest = stored.groupBy("ticker", "date").agg(F.max("batch").alias("batch"))
            unique = stored.join(latest, ["ticker", "date", "batch"], "left_semi").drop("batch")
        else:
            unique = _one_a_day(stored, ["batch"])
        rebuilt = last_rows_of_month(unique, ties)
        (rebuilt.repartitionByRange("public_date", "TICKER").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("public_date").parquet(bars))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_point_in_time(stream: DataFrame, statements: str, bars: DataFrame, panel: str, checkpoint: str, lag_months: int = 1, buckets: int = 64) -> StreamingQuery:
    """Panel rows refreshed as statements arrive.

    The first batch writes every month of every ticker, with or without a known statement. A new statement is the latest
    one only until the next known statement of its ticker, so a later batch looks for the month rows whose latest
    statement is one of its own, and rewrites those months alone, with all other rows as they are. Statements are kept by
    ``buckets`` of tickers; a batch reads its own tickers' buckets from its earliest statement on.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        laid_out = batch.withColumns({"bucket": F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"), "batch": F.lit(batch_id).cast("long")})
        stored = T.StructType([*laid_out.schema.fields])
        laid_out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(statements)
        known = spark.read.schema(stored).parquet(statements).where(F.col("batch") <= batch_id)
        schema = merge_point_in_time(bars, known.select(*names), lag_months).schema
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("public_date").parquet(panel)
        written = spark.read.schema(schema).parquet(panel).select(*schema.fieldNames())
        if batch_id == 0 or written.isEmpty():
            rebuilt = merge_point_in_time(bars, known.select(*names), lag_months)
        else:
            dated = batch.where(F.col("publish_date").isNotNull() & F.col("ticker").isNotNull())
            reach = materialize(dated.groupBy("ticker").agg(F.min("publish_date").alias("since")))
            mine = [r[0] for r in reach.select(F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")).distinct().collect()]  # at most ``buckets``
            first = reach.agg(F.min("since")).first()[0]
            if first is None:
                return
            recent = known.where(F.col("bucket").isin(mine) & (F.col("publish_date") >= F.lit(first))).join(reach, "ticker").where(F.col("publish_date") >= F.col("since"))
            own = bars.where(F.col("public_date") >= F.add_months(F.lit(first), lag_months)).join(reach.select(F.col("ticker").alias("TICKER")), "TICKER", "left_semi")
            merged = merge_point_in_time(own, recent.select(*names, F.col("batch").alias("from_batch")), lag_months)
            changed = materialize(merged.where(F.col("from_batch") == batch_id).select(*schema.fieldNames()))
            months = [r[0] for r in changed.select("public_date").distinct().collect()]
            if not months:
                return
            others = written.where(F.col("public_date").isin(months)).join(changed.select("TICKER", "public_date"), ["TICKER", "public_date"], "left_anti")
            rebuilt = changed.unionByName(others)
        (materialize(rebuilt).repartitionByRange("public_date", "TICKER").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("public_date").parquet(panel))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_POSITION = "account string, symbol string, at long, trade_id string, shares double, avg_cost double, total_cost double"
_TRADE = pa.schema([("account", pa.string()), ("symbol", pa.string()), ("at", pa.int64()), ("trade_id", pa.string()), ("side", pa.string()), ("quantity", pa.float64()), ("price", pa.float64())])
_HELD = pa.schema([("account", pa.string()), ("symbol", pa.string()), ("shares", pa.float64()), ("cost", pa.float64())])
_ENTRY_ROWS = 50_000
_BUCKETS = 1024


class _Replay(StatefulProcessor):
    """Trades of a bucket of keys wait until the watermark has passed them, then change their key's (shares, total cost) in time order.

    A call into the state costs as much as hundreds of trades, so the keys of a bucket share their calls: the state has
    one entry with two numbers a key, and an entry for each ``_ENTRY_ROWS`` waiting trades.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._positions = handle.getValueState("positions", "held binary")
        self._waiting = handle.getListState("waiting", "trades binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        trades = pa.concat_tables([pa.Table.from_pandas(part[_TRADE.names], schema=_TRADE, preserve_index=False) for part in rows] or [_TRADE.empty_table()])
        if trades.num_rows:
            self._waiting.appendList(_entries(trades))
            self._handle.registerTimer(_millis(pc.min(trades["at"]).as_py()))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = pa.concat_tables([_TRADE.empty_table(), *(_table(entry[0]) for entry in self._waiting.get())])
        passed = pc.less_equal(waiting["at"], timerValues.getCurrentWatermarkInMs() * 1000)
        due, rest = waiting.filter(passed), waiting.filter(pc.invert(passed))
        if not due.num_rows:
            return
        due = due.sort_by([(c, "ascending") for c in ("account", "symbol", "at", "trade_id")])
        held = _table(self._positions.get()[0]).to_pydict() if self._positions.exists() else {c: [] for c in _HELD.names}
        positions = {(a, s): (n, c) for a, s, n, c in zip(*(held[c] for c in _HELD.names), strict=True)}
        # Through numpy, so that a missing number is no number instead of None.
        numbers = [due[c].to_numpy().tolist() for c in ("quantity", "price")]
        after = []
        for account, symbol, side, q, price in zip(*(due[c].to_pylist() for c in ("account", "symbol", "side")), *numbers, strict=True):
            shares, cost = positions.get((account, symbol), (0.0, 0.0))
            if side == "BUY":
                shares, cost = shares + q, cost + q * price
            elif q >= shares:
                shares, cost = 0.0, 0.0
            else:
                cost, shares = cost * (shares - q) / shares, shares - q
            positions[account, symbol] = shares, cost
            after.append((shares, cost / shares if shares > 0 else None, cost))
        self._positions.update((_bytes(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*k, *v) for k, v in positions.items()]), _HELD, strict=True)], schema=_HELD)),))
        if rest.num_rows:
            self._waiting.put(_entries(rest))
            self._handle.registerTimer(_millis(pc.min(rest["at"]).as_py()))
        else:
            self._waiting.clear()
        out = due.select(["account", "symbol", "at", "trade_id"]).to_pandas()
        yield out.assign(**dict(zip(("shares", "avg_cost", "total_cost"), map(list, zip(*after)), strict=True)))

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """Milliseconds, rounded up, so that a time is never taken for passed before it is."""
    return -(-micros // 1000)


def _entries(trades: pa.Table) -> list[tuple[bytes]]:
    return [(_bytes(trades.slice(i, _ENTRY_ROWS)),) for i in range(0, trades.num_rows, _ENTRY_ROWS)]


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def running_positions(trades: DataFrame, delay: str = "7 days", buckets: int = _BUCKETS) -> DataFrame:
    """Position after every trade of a stream, in time order within a key, however trades arrive within ``delay``.

    A trade waits in the state of its bucket of (account, symbol) until the watermark, ``delay`` behind the latest trade
    of all keys, has passed its time; then a timer folds the waiting trades of each key in order of (ts, trade_id). So
    the state holds two numbers a key and the trades of the last ``delay``. A trade that comes later than that would
    change rows already written; Spark's watermark leaves it out, as it does one without a time. A checkpoint belongs to
    its number of ``buckets``. Needs the RocksDB state store, which this sets for the session.
    """
    trades.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ts = F.col("ts").cast("timestamp")
    narrow = trades.where(F.col("ts").isNotNull()).select("account", "symbol", ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col("trade_id").cast("string").alias("trade_id"), "side",
                                                          F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"))
    bucket = F.pmod(F.xxhash64("account", "symbol"), F.lit(buckets)).cast("int")
    moved = narrow.withWatermark("ts", delay).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(_Replay(), _POSITION, "append", "EventTime")
    return moved.select("account", "symbol", F.timestamp_micros("at").alias("ts"), "trade_id", "shares", "avg_cost", "total_cost")
