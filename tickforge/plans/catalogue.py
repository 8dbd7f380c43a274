"""The registered queries over the reference operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ceiling, fixed, ns_to_text
from ..operators import anomaly, backtest, book, feed, features, generators, reports, validate
from ..schema import FEATURES
from ..sources import adapters, frames
from . import oracle


def validated(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(adapters.tape(spark, d))


def bar_features(spark: SparkSession, d: str) -> DataFrame:
    return features.features(adapters.minute_bars(spark, d))


def latencies(spark: SparkSession, d: str) -> DataFrame:
    return adapters.events(spark, d).selectExpr("(event_id * 7919) % 2000 as ns")


def split_features(spark: SparkSession, d: str) -> DataFrame:
    return features.time_split(bar_features(spark, d))


def leaking(split: DataFrame) -> DataFrame:
    """split with the fit rows of some symbols moved by a year, so that they reach into later folds."""
    return split.withColumn("start_ns", F.expr("case when fold = 'fit' and symbol like '%7' then start_ns + 31536000000000000 else start_ns end"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.robust_z(bar_features(spark, d))


def tested(spark: SparkSession, d: str) -> DataFrame:
    """The test fold of the calibrated scores with a label from the row number."""
    return anomaly.calibrated(split_features(spark, d)).where("fold = 'test'").withColumn("label", F.expr("cast(arrival_ix % 9 = 0 as int)"))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: fixed(F.col(n), places) for n in names})


def json_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a trade, every fourth with a bar before it, some with acknowledgements, errors and unknown messages; some are no JSON."""
    stamp = "concat(date_format(timestamp_micros(us), \"yyyy-MM-dd'T'HH:mm:ss\"), '.', lpad(cast(us % 1000000 * 1000 + {extra} as string), 9, '0'), 'Z')"
    e = adapters.events(spark, d).selectExpr("event_id", "concat('S', user_id % 20) as s", "value", "event_id * 3 % 1000 as n", "us")
    parts = [
        "case when event_id % 10 = 0 then '{\"T\":\"success\",\"msg\":\"connected\"}' end",
        "case when event_id % 4 = 0 then concat('{\"T\":\"b\",\"S\":\"', s, '\",\"o\":1,\"h\":2.5,\"l\":1,\"c\":', value, ',\"v\":', n, ',\"n\":5,\"vw\":1.5,\"t\":\"', " + stamp.format(extra="0") + ", '\"}') end",
        "concat('{\"T\":\"t\",\"S\":\"', s, '\",\"i\":', event_id, ',\"x\":\"V\",\"p\":', value, ',\"s\":', n, ',\"z\":\"C\",\"t\":\"', " + stamp.format(extra="event_id % 1000") + ", '\"}')",
        "case when event_id % 6 = 0 then '7' end",
        "case when event_id % 15 = 0 then '{\"T\":\"error\",\"code\":402,\"msg\":\"auth failed\"}' end",
    ]
    return e.selectExpr("event_id as frame_ix", f"case when event_id % 25 = 24 then 'not json' else concat('[', concat_ws(',', {', '.join(parts)}), ']') end as frame")


def frame_acks(spark: SparkSession, d: str) -> DataFrame:
    return frames.acknowledgements(frames.messages(json_frames(spark, d))).select("frame_ix", "connected", F.size("unknown").alias("unknown"), F.size("errors").alias("errors"))


def frame_rows(spark: SparkSession, d: str) -> DataFrame:
    return frames.market_rows(frames.messages(json_frames(spark, d))).select("kind", "symbol", "ts_ns", "price", F.coalesce("size", F.lit(-1)).alias("size"), "close", F.coalesce("volume", F.lit(-1)).alias("volume"))


def frame_tape(spark: SparkSession, d: str) -> DataFrame:
    tape = frames.to_tape(frames.market_rows(frames.messages(json_frames(spark, d))))
    return tape.groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"), F.expr("cast(sum(seq * (1 + (arrival_ix div 4194304) % 7)) as bigint)").alias("digest"))


def history_bars(spark: SparkSession, d: str) -> DataFrame:
    """Pages of at most 100 bars of a symbol, as text, read back."""
    bars = adapters.minute_bars(spark, d).withColumn("page_ix", F.expr("floor((row_number() over (partition by symbol order by start_ns) - 1) / 100)"))
    stamp = F.date_format(F.timestamp_seconds(F.floor(F.col("start_ns") / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bar = F.struct(stamp.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("vwap").alias("vw"), F.col("volume").alias("v"), F.col("trade_count").alias("n"))
    pages = bars.groupBy("symbol", "page_ix").agg(F.collect_list(bar).alias("b")).select(F.to_json(F.struct(F.create_map("symbol", "b").alias("bars"))).alias("page"))
    return frames.history_bars(pages).select("symbol", "start_ns", "seq", "close", "volume")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    env = backtest.environment(bar_features(spark, d))
    done = backtest.episodes(backtest.step(backtest.with_costs(backtest.act(env, backtest.POLICIES | backtest.CLAIRVOYANT))))
    return rounded(done.drop("reward"), "pnl", "sharpe", "max_drawdown")


def cost_sweep(spark: SparkSession, d: str) -> DataFrame:
    split = split_features(spark, d)
    env = backtest.environment(split.drop("fold")).join(split.select("symbol", "start_ns", "arrival_ix", "fold"), ["symbol", "start_ns", "arrival_ix"])
    return rounded(backtest.cost_sweep(env, policies=backtest.POLICIES | backtest.CLAIRVOYANT), "pnl", "sharpe", "max_drawdown")


def arbitrate_window(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the exact arbitrator, window 4096: on this feed those of the unbounded form."""
    stats = feed.arbitrate(adapters.packets(spark, d)).where("event = 'stats'")
    return stats.select("feed", F.from_json("stats", "delivered long, duplicates_a long, duplicates_b long, gaps long").alias("s")).select("feed", "s.*")


def book_events(spark: SparkSession, d: str) -> DataFrame:
    deltas = adapters.book_deltas(spark, d)
    start = deltas.select("instrument").distinct().selectExpr("instrument", "'snapshot' as etype", "0L as seq", "cast(null as string) as side", "cast(null as double) as price", "cast(null as bigint) as new_size", "-1L as arrival_ix", "'[]' as levels")
    return deltas.selectExpr("instrument", "'delta' as etype", "seq", "side", "price", "new_size", "arrival_ix", "cast(null as string) as levels").unionByName(start)


def book_builder(spark: SparkSession, d: str) -> DataFrame:
    built = book.build_books(book_events(spark, d))
    best = lambda side: F.from_json(side, "array<array<double>>")[0][0]
    return built.select("instrument", "state", "expected", best("bids").alias("best_bid"), best("asks").alias("best_ask"))


def books_equal(spark: SparkSession, d: str) -> DataFrame:
    """The exact builder's books against the last-writer form."""
    built = book.build_books(book_events(spark, d))
    side = lambda name, column: built.select("instrument", F.lit(name).alias("side"), F.posexplode(F.from_json(column, "array<array<double>>")).alias("pos", "l")).select("instrument", "side", (F.col("pos") + 1).alias("level"), F.col("l")[0].alias("price"), F.col("l")[1].cast("long").alias("size"))
    return book.books_equal(side("bid", "bids").unionByName(side("ask", "asks")), book.levels_at(adapters.book_deltas(spark, d), depth=book.MAX_LEVELS))


def synthetic_tallies(spark: SparkSession, d: str) -> DataFrame:
    return reports.tallies(validate.validate(generators.synthetic_tape(spark, 2000, 8)))


def ladder(spark: SparkSession, d: str) -> DataFrame:
    bars = generators.joint_anomaly_bars(spark, 1500, 2)
    rows = features.features(bars).join(bars.select("symbol", "start_ns", "label"), ["symbol", "start_ns"])
    return anomaly.ladder(bars, features.time_split(rows))


def lossy_feed(spark: SparkSession, d: str) -> DataFrame:
    return feed.arbitration_stats(generators.lossy_feed(spark, 20_000))


def sharded_tallies(spark: SparkSession, d: str) -> DataFrame:
    """Tallies of the stateless and sequencing checks after dealing the tape out by symbol: the same, however many shards."""
    dealt = adapters.tape(spark, d).repartition(16, "symbol")
    checked = validate.with_sequencing(validate.with_stateless(dealt)).withColumn("flags", F.col("stateless_flags") + F.col("sequencing_flags"))
    return reports.checksum(checked)


QUERIES = {
    "validate_tallies": lambda s, d: reports.tallies(validated(s, d)),
    "validate_stateless": lambda s, d: validate.with_stateless(adapters.tape(s, d)).groupBy("kind", F.col("stateless_flags").alias("flags")).agg(F.count(F.lit(1)).alias("n")),
    "sequencing": lambda s, d: validate.with_sequencing(adapters.tape(s, d)).groupBy("symbol").agg(F.count_if(F.expr("sequencing_flags & 256 <> 0")).alias("regressions"), F.count_if(F.expr("sequencing_flags & 512 <> 0")).alias("gaps"), F.sum("gap").alias("lost")),
    "ohlcv_bars": lambda s, d: rounded(validate.bars_from_trades(adapters.tape(s, d)), "vwap"),
    "bar_reconcile": lambda s, d: validate.with_reconciliation(adapters.tape(s, d)).where("kind = 'bar'").select("symbol", "arrival_ix", "reconcile_flags"),
    "price_band": lambda s, d: rounded(validate.price_band(adapters.tape(s, d)), "reference"),
    "quote_asof_band": lambda s, d: rounded(validate.quote_reference(adapters.tape(s, d)), "reference"),
    "validate_checksum": lambda s, d: reports.checksum(validated(s, d)),
    "live_summary": lambda s, d: reports.live_summary(validated(s, d)),
    "describe_flags": lambda s, d: reports.surfaced(validated(s, d)),
    "violation_log": lambda s, d: reports.violation_log(validated(s, d)),
    "latency_histogram": lambda s, d: reports.latency_histogram(latencies(s, d), 1000),
    "latency_percentiles": lambda s, d: reports.percentiles(latencies(s, d), 1000, [0.25, 0.5, 0.99]),
    "latency_summary": lambda s, d: reports.latency_summary(latencies(s, d), 1000),
    "bar_features": lambda s, d: rounded(bar_features(s, d).select("symbol", "start_ns", *FEATURES), *FEATURES),
    "bar_sessions": lambda s, d: features.sessions(adapters.minute_bars(s, d)),
    "forward_returns": lambda s, d: rounded(features.forward_returns(adapters.minute_bars(s, d)).drop("arrival_ix"), "forward_return", places=9),
    "robust_z": lambda s, d: rounded(scored(s, d).select("symbol", "start_ns", "score", "worst_feature", "is_anomaly"), "score"),
    "top_anomalies": lambda s, d: rounded(anomaly.top(scored(s, d)).select("symbol", ns_to_text(F.col("start_ns")).alias("at"), "score"), "score"),
    "top_flagged": lambda s, d: rounded(anomaly.top(anomaly.top(scored(s, d), 12).where("is_anomaly = 1"), 5).select("symbol", "start_ns", "score"), "score"),
    "time_split": lambda s, d: split_features(s, d).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("first_ns"), F.max("start_ns").alias("last_ns")),
    "leakage": lambda s, d: features.leakage(leaking(split_features(s, d))),
    "calibrated_threshold": lambda s, d: rounded(anomaly.calibrated(split_features(s, d)).select("threshold").limit(1), "threshold"),
    "calibrated_flags": lambda s, d: anomaly.calibrated(split_features(s, d)).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("is_anomaly").alias("flagged")),
    "confusion": lambda s, d: rounded(anomaly.confusion(tested(s, d)), "precision", "recall", "flag_rate", "f1"),
    "auc": lambda s, d: rounded(anomaly.auc(rounded(tested(s, d), "score")), "auc"),
    "standardization": lambda s, d: (lambda x: rounded(x, *x.columns))(anomaly.standardization(bar_features(s, d))),
    "policy_episodes": episodes,
    "cost_sweep": cost_sweep,
    "most_bars": lambda s, d: backtest.most_bars(adapters.minute_bars(s, d)),
    "symbols": lambda s, d: adapters.minute_bars(s, d).select("symbol").distinct(),
    "bar_counts": lambda s, d: adapters.minute_bars(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    "arbitrate_ab": lambda s, d: feed.delivered(adapters.packets(s, d)),
    "arbitration_stats": lambda s, d: feed.arbitration_stats(adapters.packets(s, d)),
    "arbitrate_window": arbitrate_window,
    "feed_gaps": lambda s, d: feed.lost(adapters.packets(s, d)),
    "book_levels": lambda s, d: book.levels_at(adapters.book_deltas(s, d)),
    "top_of_book": lambda s, d: book.top_of_book(book.levels_at(adapters.book_deltas(s, d))),
    "book_builder": book_builder,
    "books_equal": books_equal,
    "frame_rows": frame_rows,
    "frame_acks": frame_acks,
    "frame_tape": frame_tape,
    "history_bars": history_bars,
    "backoff": lambda s, d: s.range(40).select(F.col("id").alias("attempt"), backoff_ceiling(F.lit(100), F.col("id"), F.lit(2000)).alias("ceiling")),
    "sharded_checksum": sharded_tallies,
    "synthetic_tallies": synthetic_tallies,
    "anomaly_ladder": ladder,
    "lossy_feed": lossy_feed,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    found = oracle.queries()
    found["sharded_checksum"] = f"WITH {oracle.TAPE}, {oracle.SEQUENCING}, v AS (SELECT {oracle.STATELESS} + sf AS flags FROM seqd) SELECT count(*) AS records, count(*) FILTER (flags <> 0) AS violations, CAST(sum(flags) AS BIGINT) AS checksum FROM v"
    return found
