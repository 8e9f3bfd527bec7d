"""Streams over several micro-batches, against a plain walk over their events."""

import random

from pyspark.sql import functions as F

from shelfline.streaming import jobs

PRICES = "product_key string, currency string, price double, observed_at timestamp, part int"
TOGGLES = "chat_id long, product_key string, currency string, price double, position long, observed_at timestamp, part int"


def moments(spark, rows, schema, path):
    """Rows as a stream of files, one micro-batch per part."""
    df = spark.createDataFrame(rows, schema.replace("timestamp", "double")).withColumn("observed_at", F.timestamp_seconds("observed_at"))
    for part in range(3):
        df.filter(F.col("part") == part).coalesce(1).write.parquet(f"{path}/{part}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_watched_prices_follow_the_order_of_events(spark, tmp_path):
    rng = random.Random(3)
    prices = [(f"p{rng.randrange(3)}", rng.choice(["BYN", "byn", "USD"]), float(rng.randrange(1, 60)), float(100 * part + rng.randrange(50)), part) for part in range(3) for _ in range(60)]
    prices += [("p0", "BYN", float("nan"), 10.0, 0), ("p0", "BYN", -1.0, 10.0, 0), ("p0", "BYN", None, 10.0, 1)]
    toggles = [(rng.randrange(4), f"p{rng.randrange(3)}", rng.choice(["BYN", "USD"]), float(rng.randrange(20, 90)), i, float(100 * part + rng.randrange(50)), part)
               for part in range(3) for i in range(40 * part, 40 * part + 40)]
    # both streams read one file a batch, so a batch holds the same part of both
    out = jobs.run_available(jobs.stream_watched_prices(moments(spark, prices, PRICES, f"{tmp_path}/prices"), moments(spark, toggles, TOGGLES, f"{tmp_path}/toggles")), f"{tmp_path}/out")
    got = sorted((r.chat_id, r.product_key, r.currency, r.price, r.previous_price, r.observed_at.timestamp()) for r in out.collect())
    lows = {}
    for key, currency, price, at, _ in prices:
        if price is not None and price >= 0:
            lows[key, currency.lower(), at] = min(price, lows.get((key, currency.lower(), at), price))
    events = [(at, 0, i, key, currency.lower(), chat, price) for chat, key, currency, price, i, at, _ in toggles] + [(at, 1, 0, key, currency, 0, price) for (key, currency, at), price in lows.items()]
    state, want = {}, []
    for at, is_price, _, key, currency, chat, price in sorted(events):
        if not is_price:
            active, baseline = state.get((chat, key, currency), (False, None))
            state[chat, key, currency] = (not active, baseline if active else price)
            continue
        for one in range(4):
            active, baseline = state.get((one, key, currency), (False, None))
            if active and price < baseline:
                want.append((one, key, currency, price, baseline, at))
                state[one, key, currency] = (True, price)
    assert got == sorted(want) and len(want) > 10


def test_subscriptions_merge_parts(spark, tmp_path):
    rng = random.Random(4)
    toggles = [(rng.randrange(3), f"p{rng.randrange(2)}", "BYN", float(rng.randrange(1, 99)), 50 * part + i, 0.0, part) for part in range(3) for i in range(rng.randrange(20, 50))]
    stream = moments(spark, toggles, TOGGLES, f"{tmp_path}/toggles")
    got = {(r.chat_id, r.product_key): (r.active, r.last_notified_price) for r in jobs.latest_subscriptions(jobs.run_available(
        jobs.stream_subscriptions(stream.repartition(5)), f"{tmp_path}/out", "update")).collect()}
    want = {}
    for chat, key, _, price, _, _, _ in sorted(toggles, key=lambda t: t[4]):
        active, baseline = want.get((chat, key), (False, None))
        want[chat, key] = (not active, baseline if active else price)
    assert got == want


def test_a_renewed_baseline_wins(spark, tmp_path):
    rows = [("p", "BYN", price, float(part), part) for part, price in enumerate((90.0, 95.0, 95.0))]
    subscriptions = str(tmp_path / "subscriptions")

    def subscribe(baseline):
        spark.createDataFrame([(1, "p", "byn", baseline, True)], "chat_id long, product_key string, currency string, last_notified_price double, active boolean").write.mode(
            "overwrite").parquet(subscriptions)

    found = []
    for part, baseline in ((0, 100.0), (1, 100.0), (2, 97.0)):
        subscribe(baseline)
        moments_of = [r for r in rows if r[4] == part]
        spark.createDataFrame(moments_of, PRICES.replace("timestamp", "double")).withColumn("observed_at", F.timestamp_seconds("observed_at")).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/prices")
        stream = spark.readStream.schema("product_key string, currency string, price double, observed_at timestamp, part int").parquet(f"{tmp_path}/prices")
        out = jobs.run_available(jobs.stream_price_alerts(stream, spark.read.parquet(subscriptions)), f"{tmp_path}/out")
        found.append(sorted((r.price, r.previous_price) for r in out.collect()))
    # 90 fires below 100; 95 does not, as 90 is known; after the subscription was renewed at 97, 95 fires again
    assert found == [[(90.0, 100.0)], [(90.0, 100.0)], [(90.0, 100.0), (95.0, 97.0)]]
