"""Structured Streaming jobs; each has a batch twin in the operators."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from shelfline.functions.text import finite
from shelfline.plans.import_feed import import_records
from shelfline.sources import feeds, store

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, so it is not bound by executor memory."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def event_time(df: DataFrame, column: str = "observed_at") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_available(query_frame: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there into a table of files and read it; a restart continues from the checkpoint."""
    spark = query_frame.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        # overwriting the folder of its own number makes a repeated batch harmless
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id:09d}")

    query = (query_frame.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return spark.read.schema(T.StructType(query_frame.schema.fields + [T.StructField("batch", T.IntegerType())])).parquet(f"{path}/data")


def stream_feed_ingest(spark: SparkSession, path: str, root: str, checkpoint: str, now: Callable[[], Column], *,
                       allow_partial: bool = False, snapshot: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """New JSON-lines feed files become catalog versions, one per micro-batch, all or nothing.

    Every version is tagged with the stream (its checkpoint) and the micro-batch that wrote it: a batch that was
    committed before a failure is recognised by its tag and skipped, whatever versions others have added.
    """
    lines = feeds.file_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch), path)

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def ingest(batch: DataFrame, batch_id: int) -> None:
        tag = f"{stream}-{batch_id}"
        if store.tagged(spark, root, tag):
            return
        records = feeds.records_from_lines(feeds.number_lines(batch))
        import_records(spark, records, root, now(), allow_partial=allow_partial, snapshot=snapshot, tag=tag)

    return (lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


ALERT_TYPE = T.StructType([
    T.StructField("chat_id", T.LongType()), T.StructField("product_key", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("previous_price", T.DoubleType())])


class LowestPriceAlert(StatefulProcessor):
    """Remembers the last notified price of a key and emits once per new low.

    The baseline it started from is remembered too: a subscription that names another one has been renewed, and the new baseline wins.
    """

    def init(self, handle) -> None:
        self._last = handle.getValueState("last_notified", T.StructType([T.StructField("price", T.DoubleType()), T.StructField("baseline", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lowest = baseline = None
        for chunk in rows:
            low = float(chunk["price"].min())
            lowest = low if lowest is None else min(lowest, low)
            baseline = float(chunk["last_notified_price"].iloc[0])
        last, started = self._last.get() if self._last.exists() else (baseline, baseline)
        if started != baseline:
            last = baseline
        fires = lowest is not None and lowest < last
        self._last.update((lowest if fires else last, baseline))
        if fires:
            yield pd.DataFrame([(*key, lowest, last)], columns=ALERT_TYPE.names)

    def close(self) -> None:
        pass


def stream_price_alerts(prices: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts from a stream of observed prices joined with the active subscriptions.

    A micro-batch is one check: the lowest sellable price of a product and currency in it counts.
    """
    use_rocksdb(prices.sparkSession)
    watched = subscriptions.filter("active").select(
        F.col("chat_id").cast("bigint"), "product_key", F.lower("currency").alias("currency"), F.col("last_notified_price").cast("double"))
    joined = _sellable(prices).select("product_key", "currency", "price").join(watched, ["product_key", "currency"])
    return joined.groupBy("chat_id", "product_key", "currency").transformWithStateInPandas(
        LowestPriceAlert(), ALERT_TYPE, "Append", "None")


def _sellable(prices: DataFrame) -> DataFrame:
    return prices.filter(finite(F.col("price")) & (F.col("price") >= 0)).withColumn("currency", F.lower("currency"))


WATCH_TYPE = T.StructType([
    T.StructField("chat_id", T.LongType()), T.StructField("product_key", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("previous_price", T.DoubleType()), T.StructField("observed_at", T.TimestampType())])


class WatchedPrice(StatefulProcessor):
    """All subscriptions of one product and currency, moved by toggles and prices in the order of their times.

    A toggle switches a subscription on with its own price as the baseline, or off. A price below the baseline of an active subscription
    fires and becomes its baseline. At one instant toggles come before prices.
    """

    def init(self, handle) -> None:
        self._watchers = handle.getMapState("watchers", T.StructType([T.StructField("chat_id", T.LongType())]),
                                            T.StructType([T.StructField("active", T.BooleanType()), T.StructField("baseline", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one price per instant (the lowest) and the toggles: what came before is already combined per task
        lows: dict[int, float] = {}
        toggles: list[tuple[int, int, int, float]] = []
        for chunk in rows:
            for at, chat, place, price in zip(chunk["at"].tolist(), chunk["chat_id"].tolist(), chunk["position"].tolist(), chunk["price"].tolist(), strict=True):
                if place < 0:
                    lows[at] = min(price, lows.get(at, price))
                else:
                    toggles.append((at, place, chat, price))
        watchers = {k[0]: v for k, v in self._watchers.iterator()}
        fired, changed = [], set()
        events = sorted([(at, 0, place, chat, price) for at, place, chat, price in toggles] + [(at, 1, 0, 0, price) for at, price in lows.items()])
        # only watchers whose baseline is above a price are looked at: the highest baselines come first
        above = [(-b, chat) for chat, (active, b) in watchers.items() if active]
        heapq.heapify(above)
        for at, is_price, _, chat, price in events:
            if not is_price:
                active, baseline = watchers.get(chat, (False, None))
                watchers[chat] = (not active, baseline if active else price)
                changed.add(chat)
                if not active:
                    heapq.heappush(above, (-price, chat))
                continue
            while above and -above[0][0] > price:
                baseline, one = -above[0][0], heapq.heappop(above)[1]
                # entries of switched off or renewed subscriptions are stale
                if watchers[one] == (True, baseline):
                    fired.append((one, *key, price, baseline, at))
                    watchers[one] = (True, price)
                    changed.add(one)
                    heapq.heappush(above, (-price, one))
        for chat in changed:
            self._watchers.updateValue((chat,), watchers[chat])
        if fired:
            out = pd.DataFrame(fired, columns=WATCH_TYPE.names)
            out["observed_at"] = pd.to_datetime(out["observed_at"], unit="us")
            yield out

    def close(self) -> None:
        pass


def stream_watched_prices(prices: DataFrame, toggles: DataFrame) -> DataFrame:
    """Alerts from two streams: observed prices and toggles of subscriptions, both with observed_at.

    ``prices(product_key, currency, price, observed_at)``, ``toggles(chat_id, product_key, currency, price, position, observed_at)``.
    Every price is a check of its own; within a micro-batch both streams are taken in the order of time.
    """
    use_rocksdb(prices.sparkSession)
    at = F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at")
    seen = _sellable(prices).select("product_key", "currency", at, F.lit(-1).cast("bigint").alias("chat_id"), F.lit(-1).cast("bigint").alias("position"), F.col("price").cast("double"))
    turned = _sellable(toggles).select("product_key", "currency", at, F.col("chat_id").cast("bigint"), F.col("position").cast("bigint"), F.col("price").cast("double"))

    def lowest_per_instant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(["product_key", "currency", "at", "chat_id", "position"], as_index=False)["price"].min()

    # a hot product's prices are combined in every task before they meet
    combined = seen.mapInPandas(lowest_per_instant, seen.schema).unionByName(turned)
    return combined.groupBy("product_key", "currency").transformWithStateInPandas(WatchedPrice(), WATCH_TYPE, "Append", "None")


def stream_min_price(prices: DataFrame, delay: str = "1 hour", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Cheapest observation per product, currency and event-time window; rows later than the delay are dropped."""
    span = F.window("observed_at", window, slide) if slide else F.window("observed_at", window)
    best = F.struct("price", "source")
    return (prices.withWatermark("observed_at", delay).groupBy(span.alias("window"), "product_key", "currency")
            .agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("observations"))
            .select("product_key", "currency", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    F.col("_best.price").alias("min_price"), F.col("_best.source").alias("source"), "observations"))


def stream_observation_dedupe(observations: DataFrame, delay: str = "1 hour",
                              keys: tuple[str, ...] = ("source", "external_id", "observed_at")) -> DataFrame:
    """Replayed observations inside the delay are dropped."""
    return observations.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(list(keys))


STALE_TYPE = T.StructType([T.StructField("product_key", T.StringType()), T.StructField("latest_update", T.TimestampType())])


class StaleWatch(StatefulProcessor):
    """Emits a key whose last update is older than the freshness time by event time."""

    def __init__(self, fresh_ms: int) -> None:
        self._fresh_ms = fresh_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._latest = handle.getValueState("latest", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(chunk["ms"].max()) for chunk in rows)
        if self._latest.exists():
            before = self._latest.get()[0]
            if before >= newest:
                return iter(())
            self._handle.deleteTimer(before + self._fresh_ms)
        self._latest.update((newest,))
        self._handle.registerTimer(newest + self._fresh_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        latest = self._latest.get()[0]
        yield pd.DataFrame({"product_key": [key[0]], "latest_update": [pd.Timestamp(latest, unit="ms")]})

    def close(self) -> None:
        pass


def stream_stale_watch(updates: DataFrame, fresh_hours: float, delay: str = "1 hour") -> DataFrame:
    """Products without an update for the freshness time, as the watermark passes it."""
    use_rocksdb(updates.sparkSession)
    keyed = updates.withWatermark("observed_at", delay).select(
        "product_key", "observed_at", F.unix_millis("observed_at").alias("ms"))
    return keyed.groupBy("product_key").transformWithStateInPandas(
        StaleWatch(int(fresh_hours * 3_600_000)), STALE_TYPE, "Append", "EventTime")


SUBSCRIPTION_TYPE = T.StructType([
    T.StructField("chat_id", T.LongType()), T.StructField("product_key", T.StringType()), T.StructField("active", T.BooleanType()),
    T.StructField("last_notified_price", T.DoubleType()), T.StructField("position", T.LongType())])
#: Toggles of a subscription, combined: how many, and the last two by position (the one before may be missing).
PART_TYPE = T.StructType([
    T.StructField("chat_id", T.LongType()), T.StructField("product_key", T.StringType()), T.StructField("flips", T.LongType()),
    T.StructField("position", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("before", T.LongType()), T.StructField("price_before", T.DoubleType())])


def combined_toggles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per subscription of a batch."""
    for batch in batches:
        last = batch.sort_values("position", kind="stable").groupby(["chat_id", "product_key"], sort=False)
        ends = last.tail(1).set_index(["chat_id", "product_key"])[["position", "price"]]
        ends["flips"] = last.size()
        two = last.tail(2)
        before = two[two.duplicated(["chat_id", "product_key"], keep="last")].set_index(["chat_id", "product_key"])
        ends["before"] = before["position"].reindex(ends.index).fillna(-1).astype("int64")
        ends["price_before"] = before["price"].reindex(ends.index)
        yield ends.reset_index()[PART_TYPE.names]


class Subscription(StatefulProcessor):
    """Current state of one subscription; every valid toggle flips it, switching on renews the baseline.

    A batch's toggles come as combined parts; only their number and the last two matter, so parts merge one after the other.
    """

    def init(self, handle) -> None:
        self._state = handle.getValueState("state", T.StructType([
            T.StructField("active", T.BooleanType()), T.StructField("price", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, baseline = self._state.get() if self._state.exists() else (False, None)
        flips, last = 0, []
        for chunk in rows:
            flips += int(chunk["flips"].sum())
            ends = [*zip(chunk["position"], chunk["price"], strict=True), *((b, p) for b, p in zip(chunk["before"], chunk["price_before"], strict=True) if b >= 0)]
            last = sorted(last + ends, key=lambda e: e[0])[-2:]
        active = bool(active) != (flips % 2 == 1)
        # switched on by the last toggle, or off by it and on by the one before
        if active:
            baseline = float(last[-1][1])
        elif flips > 1:
            baseline = float(last[-2][1])
        self._state.update((active, baseline))
        yield pd.DataFrame([(*key, active, baseline, int(last[-1][0]))], columns=SUBSCRIPTION_TYPE.names)

    def close(self) -> None:
        pass


def stream_subscriptions(toggles: DataFrame) -> DataFrame:
    """Latest state per subscription after every micro-batch of toggles."""
    use_rocksdb(toggles.sparkSession)
    valid = toggles.filter(finite(F.col("price")) & (F.col("price") >= 0)).select(
        F.col("chat_id").cast("bigint"), "product_key", F.col("price").cast("double"), F.col("position").cast("bigint"))
    return valid.mapInPandas(combined_toggles, PART_TYPE).groupBy("chat_id", "product_key").transformWithStateInPandas(
        Subscription(), SUBSCRIPTION_TYPE, "Update", "None")


def latest_subscriptions(states: DataFrame) -> DataFrame:
    """Current subscriptions from the emitted states."""
    return states.groupBy("chat_id", "product_key").agg(
        F.max_by(F.struct("active", "last_notified_price"), "position").alias("_s")).select("chat_id", "product_key", "_s.*")
