"""The adapters of sources.adapters as DuckDB SQL, and the counterparts of the registered queries."""

from __future__ import annotations

from ..schema import FEATURES, LABELS, SURFACED

DAY = 86_400_000_000_000
EV = """ev AS (SELECT *, 'U' || user_id AS symbol, epoch_us(ts) AS us, 10000 + CAST(round(value * 100) AS BIGINT) % 400 AS cents, epoch_us(ts) // 86400000000 AS day FROM events)"""
TAPE = f"""{EV},
e AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN -cents WHEN event_id % 37 = 0 THEN cents * 16 // 10 ELSE cents END AS p,
  CASE WHEN event_id % 113 = 0 THEN 0 ELSE 1 + event_id % 100 END AS s, us * 1000 - CASE WHEN event_id % 89 = 0 THEN {3 * DAY} ELSE 0 END AS ns FROM ev),
days AS (SELECT symbol, day, max(event_id) AS last, arg_min(p, event_id) FILTER (p > 0 AND s > 0) AS o, max(p) FILTER (p > 0 AND s > 0) AS h, min(p) FILTER (p > 0 AND s > 0) AS l,
  arg_max(p, event_id) FILTER (p > 0 AND s > 0) AS c, CAST(sum(p * s) FILTER (p > 0 AND s > 0) AS BIGINT) AS pv, CAST(sum(s) FILTER (p > 0 AND s > 0) AS BIGINT) AS v, count(*) FILTER (p > 0 AND s > 0) AS n FROM e GROUP BY symbol, day),
merged AS (
  SELECT event_id * 4 AS arrival_ix, 'trade' AS kind, symbol, ns AS ts_ns, event_id, p / 100::DOUBLE AS price, s AS size, NULL::DOUBLE AS bid_price, NULL::DOUBLE AS ask_price, NULL::BIGINT AS bid_size, NULL::BIGINT AS ask_size,
    NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, NULL::DOUBLE AS close, NULL::DOUBLE AS vwap, NULL::BIGINT AS volume, NULL::BIGINT AS trade_count FROM e
  UNION ALL SELECT event_id * 4 + 1, 'quote', symbol, ns, 0, NULL, NULL, CASE WHEN event_id % 65 = 0 THEN 0::DOUBLE WHEN event_id % 55 = 0 THEN (cents + 9) / 100::DOUBLE ELSE cents / 100::DOUBLE END,
    CASE WHEN event_id % 35 = 0 THEN cents / 100::DOUBLE ELSE (cents + 2) / 100::DOUBLE END, CASE WHEN event_id % 85 = 0 THEN 0 ELSE 3 END, 5, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE event_id % 5 = 0
  UNION ALL SELECT last * 4 + 3, 'bar', symbol, day * {DAY}, 0, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN last % 29 = 0 THEN -1::DOUBLE ELSE o / 100::DOUBLE END, CASE WHEN last % 17 = 0 THEN h / 100::DOUBLE + 5 ELSE h / 100::DOUBLE END,
    CASE WHEN last % 19 = 0 THEN h / 100::DOUBLE + 50 ELSE l / 100::DOUBLE END, c / 100::DOUBLE, pv::DOUBLE / v / 100::DOUBLE * CASE WHEN last % 13 = 0 THEN 1.001::DOUBLE ELSE 1::DOUBLE END,
    CASE WHEN last % 23 = 0 THEN 0 WHEN last % 7 = 0 THEN v + 100 ELSE v END, CASE WHEN last % 11 = 0 THEN n + 1 ELSE n END FROM days WHERE n > 0),
tape AS (SELECT *, CAST(row_number() OVER w + 3 * sum(CASE WHEN kind = 'trade' AND event_id % 97 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS seq FROM merged WINDOW w AS (PARTITION BY symbol ORDER BY arrival_ix))"""

STATELESS = """CASE kind
  WHEN 'trade' THEN (CASE WHEN price > 0 THEN 0 ELSE 64 END) + (CASE WHEN size = 0 THEN 128 ELSE 0 END)
  WHEN 'bar' THEN (CASE WHEN low > high THEN 1 ELSE 0 END) + (CASE WHEN open < low OR open > high THEN 2 ELSE 0 END) + (CASE WHEN close < low OR close > high THEN 4 ELSE 0 END)
    + (CASE WHEN vwap < low OR vwap > high THEN 8 ELSE 0 END) + (CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 16 ELSE 0 END) + (CASE WHEN (trade_count = 0) <> (volume = 0) THEN 32 ELSE 0 END)
  ELSE (CASE WHEN bid_price > ask_price THEN 16384 ELSE 0 END) + (CASE WHEN bid_price = ask_price THEN 32768 ELSE 0 END) + (CASE WHEN bid_price <= 0 OR ask_price <= 0 THEN 65536 ELSE 0 END) + (CASE WHEN bid_size = 0 OR ask_size = 0 THEN 131072 ELSE 0 END) END"""
SEQUENCING = """sq AS (SELECT *, lag(ts_ns) OVER (PARTITION BY symbol, kind ORDER BY arrival_ix) AS pt, lag(seq) OVER (PARTITION BY symbol ORDER BY arrival_ix) AS ps FROM tape),
seqd AS (SELECT *, CASE WHEN pt <> 0 AND ts_ns < pt THEN 256 ELSE 0 END + CASE WHEN seq > ps + 1 THEN 512 ELSE 0 END AS sf, CASE WHEN seq > ps + 1 THEN seq - ps - 1 ELSE 0 END AS gap FROM sq)"""
NEAR = lambda a, b: f"abs({a} - {b}) <= 1e-6::DOUBLE * greatest(abs({a}), abs({b}), 1::DOUBLE)"
WINDOWS = """wd AS (SELECT *, count(*) FILTER (kind = 'bar') OVER (PARTITION BY symbol ORDER BY arrival_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bw FROM tape),
agg AS (SELECT symbol, bw, count(*) AS n, CAST(sum(size) AS BIGINT) AS vol, sum(price * size) AS pv, arg_min(price, arrival_ix) AS o, max(price) AS h, min(price) AS l, arg_max(price, arrival_ix) AS c FROM wd WHERE kind = 'trade' AND price > 0 AND size <> 0 GROUP BY symbol, bw)"""
RECONCILED = f"""{WINDOWS},
rec AS (SELECT wd.symbol, wd.arrival_ix, CASE WHEN n IS NULL THEN 0 ELSE CASE WHEN volume <> vol THEN 1024 ELSE 0 END + CASE WHEN trade_count <> n THEN 2048 ELSE 0 END + CASE WHEN {NEAR('vwap', 'pv / vol')} THEN 0 ELSE 4096 END
  + CASE WHEN {NEAR('open', 'o')} AND {NEAR('high', 'h')} AND {NEAR('low', 'l')} AND {NEAR('close', 'c')} THEN 0 ELSE 8192 END END AS rf FROM wd LEFT JOIN agg ON agg.symbol = wd.symbol AND agg.bw = wd.bw WHERE kind = 'bar')"""
BAND = """vt AS (SELECT symbol, arrival_ix, price, row_number() OVER (PARTITION BY symbol ORDER BY arrival_ix) AS rn FROM tape WHERE kind = 'trade' AND price > 0 AND size <> 0),
fold AS (
  SELECT symbol, arrival_ix, rn, price AS ref, 0 AS run, 0 AS bf FROM vt WHERE rn = 1
  UNION ALL SELECT vt.symbol, vt.arrival_ix, vt.rn,
    CASE WHEN abs(price - ref) > 0.05::DOUBLE * ref THEN CASE WHEN run = 2 THEN price ELSE ref END ELSE 0.2::DOUBLE * price + (1 - 0.2::DOUBLE) * ref END,
    CASE WHEN abs(price - ref) > 0.05::DOUBLE * ref AND run < 2 THEN run + 1 ELSE 0 END, CASE WHEN abs(price - ref) > 0.05::DOUBLE * ref THEN 262144 ELSE 0 END
  FROM fold JOIN vt ON vt.symbol = fold.symbol AND vt.rn = fold.rn + 1),
carried AS (SELECT t.symbol, t.arrival_ix, t.kind, t.bid_price, t.ask_price, f.bf, last_value(f.ref IGNORE NULLS) OVER (PARTITION BY t.symbol ORDER BY t.arrival_ix ROWS UNBOUNDED PRECEDING) AS ref FROM tape t LEFT JOIN fold f ON f.symbol = t.symbol AND f.arrival_ix = t.arrival_ix),
band AS (SELECT symbol, arrival_ix, kind, ref, CASE WHEN kind = 'quote' AND ref IS NOT NULL AND bid_price > 0 AND ask_price > 0 AND abs((bid_price + ask_price) * 0.5::DOUBLE - ref) > 0.05::DOUBLE * ref THEN 262144 ELSE coalesce(bf, 0) END AS bf FROM carried)"""
VALIDATED = f"""{TAPE}, {SEQUENCING}, {RECONCILED}, {BAND},
validated AS (SELECT q.*, CAST({STATELESS} + sf + coalesce(rf, 0) + bf AS INTEGER) AS flags FROM seqd q JOIN band USING (symbol, arrival_ix) LEFT JOIN rec USING (symbol, arrival_ix))""".replace("band USING", "(SELECT symbol, arrival_ix, bf FROM band) b USING")

BARS = f"""{EV},
m AS (SELECT *, 'M' || (user_id % 50) AS m, cents AS c, cents - event_id % 7 + 3 AS o FROM ev),
mk AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY event_id) - 1 AS k FROM m),
bars AS (SELECT m AS symbol, (1700000000 + 60 * k + 3600 * (k // 50)) * 1000000000 AS start_ns, event_id AS arrival_ix, o / 100::DOUBLE AS open, (greatest(o, c) + 5) / 100::DOUBLE AS high, (least(o, c) - 5) / 100::DOUBLE AS low, c / 100::DOUBLE AS close,
  (o + c + greatest(o, c) + least(o, c)) / 400::DOUBLE AS vwap, 100 + (event_id * 37) % 1000 AS volume, 1 + event_id % 20 AS trade_count FROM mk)"""
ROLL = "(PARTITION BY symbol ORDER BY start_ns, arrival_ix ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
FEATURED = f"""{BARS},
f0 AS (SELECT *, lag(close) OVER t AS pc, start_ns - lag(start_ns) OVER t AS since FROM bars WINDOW t AS (PARTITION BY symbol ORDER BY start_ns, arrival_ix)),
f1 AS (SELECT symbol, start_ns, arrival_ix, close, CASE WHEN pc > 0 AND close > 0 AND since <= 300000000000 THEN ln(close / pc) ELSE 0::DOUBLE END AS log_return, (high - low) / close AS hl_range, (close - vwap) / vwap AS vwap_dev, ln(1 + volume::DOUBLE) AS log_volume, trade_count::DOUBLE AS trade_count FROM f0),
f2 AS (SELECT *, stddev_pop(log_return) OVER {ROLL} AS realized_vol, median(log_volume) OVER {ROLL} AS md, mad(log_volume) OVER {ROLL} AS dv FROM f1),
feats AS (SELECT symbol, start_ns, arrival_ix, close, log_return, hl_range, vwap_dev, log_volume, trade_count, realized_vol, CASE WHEN dv > 0 THEN (log_volume - md) / (dv * 1.4826::DOUBLE) ELSE 0::DOUBLE END AS volume_z FROM f2)"""


def fixed(x: str, places: int = 6) -> str:
    return f"floor({x} * {10**places}::DOUBLE + 0.5::DOUBLE) / {10**places}::DOUBLE"


def stats(source: str, name: str) -> str:
    med = ", ".join(f"median({f}) AS {f}_m" for f in FEATURES)
    dev = ", ".join(f"median(abs({f} - {f}_m)) * 1.4826::DOUBLE AS {f}_s" for f in FEATURES)
    return f"{name}_m AS (SELECT symbol, {med} FROM {source} GROUP BY symbol), {name} AS (SELECT symbol, {dev}, {', '.join(f'any_value({f}_m) AS {f}_m' for f in FEATURES)} FROM {source} JOIN {name}_m USING (symbol) GROUP BY symbol)"


ZS = ", ".join(f"CASE WHEN {f}_s > 0 THEN abs({f} - {f}_m) / {f}_s ELSE 0::DOUBLE END AS z{k}" for k, f in enumerate(FEATURES))
WORST = "CASE " + " ".join(f"WHEN z{k} = score THEN '{f}'" for k, f in enumerate(FEATURES)) + " END"
GREATEST = "greatest(" + ", ".join(f"z{k}" for k in range(len(FEATURES))) + ")"
SCORED = f"""{FEATURED}, {stats('feats', 'st')},
z AS (SELECT feats.*, {ZS} FROM feats JOIN st USING (symbol)),
scored AS (SELECT *, {WORST} AS worst_feature FROM (SELECT *, {GREATEST} AS score FROM z))"""
FOLDS = """placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_ns, arrival_ix) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS cnt FROM feats),
split AS (SELECT *, CASE WHEN rn < CAST(floor(cnt * 0.4::DOUBLE) AS BIGINT) THEN 'fit' WHEN rn < CAST(floor(cnt * 0.4::DOUBLE) AS BIGINT) + CAST(floor(cnt * 0.2::DOUBLE) AS BIGINT) THEN 'calibrate' ELSE 'test' END AS fold FROM placed)"""
CALIBRATED = f"""{FEATURED}, {FOLDS}, train AS (SELECT * FROM split WHERE fold <> 'test'), {stats('train', 'st')},
z AS (SELECT split.*, {ZS} FROM split JOIN st USING (symbol)), sc AS (SELECT *, {GREATEST} AS score FROM z), scored AS (SELECT *, {WORST} AS worst_feature FROM sc),
lim AS (SELECT quantile_cont(score, 0.95) AS threshold FROM scored WHERE fold = 'calibrate')"""
LABEL = "CAST(arrival_ix % 9 = 0 AS INTEGER)"
ENV = """envr AS (SELECT * FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY start_ns, arrival_ix) / close - 1 AS forward_return FROM {source}) WHERE forward_return IS NOT NULL),
env0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_ns, arrival_ix) - 1 AS k FROM envr), env AS (SELECT * FROM env0 {where}),
acts AS (SELECT *, 'always_flat' AS policy, 0 AS action FROM env UNION ALL SELECT *, 'momentum', CAST(sign(log_return) AS INTEGER) FROM env
  UNION ALL SELECT *, 'random', CAST((k * 1103515245 + 12345) % 2147483648 % 3 AS INTEGER) - 1 FROM env UNION ALL SELECT *, 'clairvoyant', CAST(sign(forward_return) AS INTEGER) FROM env),
costed AS (SELECT acts.*, cost FROM acts, (VALUES (0::DOUBLE), (0.0001::DOUBLE), (0.0005::DOUBLE), (0.001::DOUBLE)) c(cost)),
moved AS (SELECT *, lag(action, 1, 0) OVER (PARTITION BY policy, cost, symbol ORDER BY start_ns, arrival_ix) AS before FROM costed),
stepped AS (SELECT *, CAST(action <> before AS INTEGER) AS change, action * forward_return - cost * abs(action - before) AS pnl FROM moved),
eq AS (SELECT *, sum(pnl) OVER (PARTITION BY policy, cost, symbol ORDER BY start_ns, arrival_ix ROWS UNBOUNDED PRECEDING) AS equity FROM stepped),
dd AS (SELECT *, max(equity) OVER (PARTITION BY policy, cost, symbol ORDER BY start_ns, arrival_ix ROWS UNBOUNDED PRECEDING) - equity AS drawdown FROM eq),
episodes AS (SELECT policy, cost, symbol, count(*) AS steps, sum(pnl) AS pnl, CAST(sum(change) AS BIGINT) AS trades, CASE WHEN count(*) <= 1 OR stddev_pop(pnl) < 1e-15::DOUBLE THEN 0::DOUBLE ELSE avg(pnl) / stddev_pop(pnl) END AS sharpe, max(drawdown) AS max_drawdown FROM dd GROUP BY policy, cost, symbol)"""
DESCRIBED = "concat_ws(', ', " + ", ".join(f"CASE WHEN (flags & {b}) <> 0 THEN '{t}' END" for b, t in LABELS) + ")"
PACKETS = """pe AS (SELECT event_type AS feed, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events),
packets AS (SELECT feed, seq, 'A' AS line, event_id * 2 AS arrival_ix, event_id AS payload FROM pe WHERE seq % 50 NOT IN (5, 7) UNION ALL SELECT feed, seq, 'B', event_id * 2 + 1, event_id FROM pe WHERE seq % 50 NOT IN (7, 9)),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, seq ORDER BY arrival_ix) AS n FROM packets) WHERE n = 1),
delivered AS (SELECT feed, seq, line, payload, coalesce(lead(seq) OVER (PARTITION BY feed ORDER BY seq) - seq - 1, 0) AS gap FROM won)"""
BOOK = f"""{EV},
deltas AS (SELECT event_type AS instrument, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
  CAST(CASE WHEN event_id % 2 = 0 THEN 100 - cents % 20 ELSE 100 + cents % 20 END AS DOUBLE) AS price, CASE WHEN event_id % 4 >= 2 AND event_id % 3 = 0 THEN 0 ELSE 1 + event_id % 500 END AS new_size FROM ev),
lastd AS (SELECT instrument, side, price, arg_max(new_size, seq) AS size FROM deltas GROUP BY instrument, side, price),
levels AS (SELECT * FROM (SELECT instrument, side, CAST(row_number() OVER (PARTITION BY instrument, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS INTEGER) AS level, price, size FROM lastd WHERE size > 0) WHERE level <= 10)"""
LATENCY = "lat AS (SELECT (event_id * 7919) % 2000 AS ns FROM events)"
TALLY = ", ".join(f"count(*) FILTER (flags & {m} <> 0) AS {n}" for n, m in [("bad_trades", 192), ("bad_bars", 63), ("ts_regressions", 256), ("seq_gaps", 512), ("volume_mismatches", 1024), ("count_mismatches", 2048), ("vwap_mismatches", 4096), ("ohlc_mismatches", 8192), ("crossed_quotes", 16384), ("locked_quotes", 32768), ("non_positive_quotes", 65536), ("zero_size_quotes", 131072), ("band_breaches", 262144)])
FSEL = "symbol, start_ns, " + ", ".join(f"{fixed(f)} AS {f}" for f in FEATURES)
FRAMES = """fr AS (SELECT event_id, user_id, 'S' || user_id % 20 AS s, value, CAST(event_id * 3 % 1000 AS BIGINT) AS n, epoch_us(ts) AS us FROM events)"""


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["validate_stateless"] = f"WITH {TAPE} SELECT kind, CAST({STATELESS} AS INTEGER) AS flags, count(*) AS n FROM tape GROUP BY ALL"
    q["sequencing"] = f"WITH {TAPE}, {SEQUENCING} SELECT symbol, count(*) FILTER (sf & 256 <> 0) AS regressions, count(*) FILTER (sf & 512 <> 0) AS gaps, CAST(sum(gap) AS BIGINT) AS lost FROM seqd GROUP BY symbol"
    q["ohlcv_bars"] = f"WITH {TAPE}, {WINDOWS} SELECT symbol, bw AS bar_window, o AS open, h AS high, l AS low, c AS close, {fixed('pv / vol')} AS vwap, vol AS volume, n AS trade_count FROM agg"
    q["bar_reconcile"] = f"WITH {TAPE}, {RECONCILED} SELECT symbol, arrival_ix, CAST(rf AS INTEGER) AS reconcile_flags FROM rec"
    q["price_band"] = f"WITH RECURSIVE {TAPE}, {BAND} SELECT symbol, arrival_ix, CAST(bf AS INTEGER) AS band_flag, {fixed('ref')} AS reference FROM band"
    q["quote_asof_band"] = f"WITH RECURSIVE {TAPE}, {BAND} SELECT symbol, arrival_ix, {fixed('ref')} AS reference, CAST(bf AS INTEGER) AS band_flag FROM band WHERE kind = 'quote'"
    q["validate_tallies"] = f"WITH RECURSIVE {VALIDATED} SELECT count(*) FILTER (kind = 'trade') AS n_trades, count(*) FILTER (kind = 'quote') AS n_quotes, count(*) FILTER (kind = 'bar') AS n_bars, {TALLY}, CAST(sum(gap) AS BIGINT) AS lost_messages FROM validated"
    q["validate_checksum"] = f"WITH RECURSIVE {VALIDATED} SELECT count(*) AS records, count(*) FILTER (flags <> 0) AS violations, CAST(sum(flags) AS BIGINT) AS checksum FROM validated"
    q["live_summary"] = f"WITH RECURSIVE {VALIDATED} SELECT label, count(*) AS n FROM validated JOIN (VALUES {', '.join(f'({b}, {chr(39)}{t}{chr(39)})' for b, t in LABELS)}) l(bit, label) ON flags & bit <> 0 GROUP BY label"
    q["describe_flags"] = f"WITH RECURSIVE {VALIDATED} SELECT kind, symbol, ts_ns, seq, flags, {DESCRIBED} AS description FROM validated WHERE flags & {SURFACED} <> 0"
    q["violation_log"] = f"""WITH RECURSIVE {VALIDATED} SELECT '{{"checks":["' || replace({DESCRIBED}, ', ', '","') || '"],"kind":"' || kind || '","seq":' || seq || ',"symbol":"' || symbol || '","ts":"' || ts_ns || '"}}' AS value FROM validated WHERE flags & {SURFACED} <> 0""".replace("replace(concat_ws(', ',", "(concat_ws('\",\"',").replace("), ', ', '\",\"') ||", ")) ||")
    q["latency_histogram"] = f"WITH {LATENCY} SELECT least(ns, 1001) AS ns, count(*) AS n FROM lat GROUP BY ALL"
    q["latency_percentiles"] = f"WITH {LATENCY}, h AS (SELECT least(ns, 1001) AS ns, count(*) AS n FROM lat GROUP BY ALL), r AS (SELECT ns, sum(n) OVER (ORDER BY ns) AS upto, sum(n) OVER () AS total FROM h) SELECT p, min(CASE WHEN upto >= floor(p * total) THEN ns END) AS ns FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) v(p) GROUP BY p"
    q["latency_summary"] = f"WITH {LATENCY} SELECT count(ns) AS n, CAST(sum(ns) AS BIGINT) AS total, min(ns) AS least, max(ns) AS most, count(*) FILTER (ns > 1000) AS overflow FROM lat"
    q["bar_features"] = f"WITH {FEATURED} SELECT {FSEL} FROM feats"
    q["bar_sessions"] = f"WITH {BARS}, g AS (SELECT *, CASE WHEN start_ns - lag(start_ns) OVER (PARTITION BY symbol ORDER BY start_ns, arrival_ix) > 300000000000 THEN 1 ELSE 0 END AS new FROM bars), s AS (SELECT symbol, start_ns, arrival_ix, CAST(sum(new) OVER (PARTITION BY symbol ORDER BY start_ns, arrival_ix) AS BIGINT) AS session FROM g) SELECT * FROM s"
    q["forward_returns"] = f"WITH {BARS} SELECT symbol, start_ns, {fixed('forward_return', 9)} AS forward_return FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY start_ns, arrival_ix) / close - 1 AS forward_return FROM bars) WHERE forward_return IS NOT NULL"
    q["robust_z"] = f"WITH {SCORED} SELECT symbol, start_ns, {fixed('score')} AS score, worst_feature, CAST(score > 5 AS INTEGER) AS is_anomaly FROM scored"
    q["top_anomalies"] = f"WITH {SCORED} SELECT symbol, strftime(make_timestamp(start_ns // 1000), '%Y-%m-%d %H:%M:%S') AS at, {fixed('score')} AS score FROM scored ORDER BY score DESC, symbol, start_ns LIMIT 15"
    q["top_flagged"] = f"WITH {SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, symbol, start_ns LIMIT 12) SELECT symbol, start_ns, {fixed('score')} AS score FROM t WHERE score > 5 ORDER BY t.score DESC, symbol, start_ns LIMIT 5"
    q["time_split"] = f"WITH {FEATURED}, {FOLDS} SELECT symbol, fold, count(*) AS n, min(start_ns) AS first_ns, max(start_ns) AS last_ns FROM split GROUP BY symbol, fold"
    q["leakage"] = f"WITH {FEATURED}, {FOLDS}, moved AS (SELECT symbol, fold, CASE WHEN fold = 'fit' AND symbol LIKE '%7' THEN start_ns + 31536000000000000 ELSE start_ns END AS start_ns FROM split), b AS (SELECT symbol, max(start_ns) FILTER (fold = 'fit') AS fit_to, min(start_ns) FILTER (fold = 'calibrate') AS calibrate_from, max(start_ns) FILTER (fold = 'calibrate') AS calibrate_to, min(start_ns) FILTER (fold = 'test') AS test_from FROM moved GROUP BY symbol) SELECT * FROM b WHERE fit_to >= test_from OR calibrate_to >= test_from OR fit_to >= calibrate_from"
    q["calibrated_threshold"] = f"WITH {CALIBRATED} SELECT {fixed('threshold')} AS threshold FROM lim"
    q["calibrated_flags"] = f"WITH {CALIBRATED} SELECT symbol, fold, count(*) AS n, count(*) FILTER (score > threshold) AS flagged FROM scored, lim GROUP BY symbol, fold"
    q["confusion"] = f"""WITH {CALIBRATED}, j AS (SELECT CAST(score > threshold AS INTEGER) AS p, {LABEL} AS y FROM scored, lim WHERE fold = 'test'), c AS (SELECT count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn, count(*) FILTER (p = 0 AND y = 0) AS tn FROM j),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0::DOUBLE ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0::DOUBLE ELSE tp / (tp + fn) END AS rc, (tp + fp) / (tp + fp + fn + tn) AS fr FROM c)
SELECT tp, fp, fn, tn, {fixed('pr')} AS precision, {fixed('rc')} AS recall, {fixed('fr')} AS flag_rate, {fixed('CASE WHEN pr + rc = 0 THEN 0::DOUBLE ELSE 2 * pr * rc / (pr + rc) END')} AS f1 FROM r"""
    q["auc"] = f"""WITH {CALIBRATED}, d AS (SELECT {fixed('score')} AS s, {LABEL} AS y FROM scored WHERE fold = 'test'), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2::DOUBLE AS rk FROM d)
SELECT {fixed('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2::DOUBLE) / (count(*) FILTER (y = 1) * (count(*) FILTER (y = 0))::DOUBLE)')} AS auc FROM r"""
    q["standardization"] = f"WITH {FEATURED} SELECT {', '.join(f'{fixed(f'avg({f})')} AS {f}_mean, {fixed(f'CASE WHEN stddev_pop({f}) = 0 THEN 1::DOUBLE ELSE stddev_pop({f}) END')} AS {f}_std' for f in FEATURES)} FROM feats"
    env = f"WITH {FEATURED}, {FOLDS}, {ENV.format(source='split', where='WHERE fold = ' + chr(39) + 'test' + chr(39))}"
    whole = f"WITH {FEATURED}, {ENV.format(source='feats', where='')}"
    q["policy_episodes"] = f"{whole} SELECT policy, cost, symbol, steps, {fixed('pnl')} AS pnl, trades, {fixed('sharpe')} AS sharpe, {fixed('max_drawdown')} AS max_drawdown FROM episodes"
    q["cost_sweep"] = f"{env} SELECT cost, policy, {fixed('sum(pnl)')} AS pnl, CAST(sum(trades) AS BIGINT) AS trades, {fixed('avg(sharpe)')} AS sharpe, {fixed('max(max_drawdown)')} AS max_drawdown FROM episodes GROUP BY cost, policy"
    q["most_bars"] = f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars GROUP BY symbol ORDER BY n DESC, symbol LIMIT 1"
    q["symbols"] = f"WITH {BARS} SELECT DISTINCT symbol FROM bars"
    q["bar_counts"] = f"WITH {BARS} SELECT symbol, count(*) AS n FROM bars GROUP BY symbol"
    q["arbitrate_ab"] = f"WITH {PACKETS} SELECT feed, seq, line, payload, gap FROM delivered"
    q["arbitration_stats"] = f"WITH {PACKETS}, c AS (SELECT feed, count(*) FILTER (line = 'A') AS a, count(*) FILTER (line = 'B') AS b FROM packets GROUP BY feed), d AS (SELECT feed, count(*) AS delivered, count(*) FILTER (line = 'A') AS wa, count(*) FILTER (line = 'B') AS wb, CAST(sum(gap) AS BIGINT) AS gaps FROM delivered GROUP BY feed) SELECT feed, delivered, a - wa AS duplicates_a, b - wb AS duplicates_b, gaps FROM d JOIN c USING (feed)"
    q["arbitrate_window"] = q["arbitration_stats"]
    q["feed_gaps"] = f"WITH {PACKETS}, span AS (SELECT feed, min(seq) AS a, max(seq) AS b FROM delivered GROUP BY feed) SELECT pe.feed, pe.seq FROM pe JOIN span USING (feed) WHERE pe.seq BETWEEN a AND b AND NOT EXISTS (SELECT 1 FROM delivered d WHERE d.feed = pe.feed AND d.seq = pe.seq)"
    q["book_levels"] = f"WITH {BOOK} SELECT * FROM levels"
    top = f"WITH {BOOK}, t AS (SELECT instrument, max(price) FILTER (side = 'bid' AND level = 1) AS bid, max(size) FILTER (side = 'bid' AND level = 1) AS bid_size, max(price) FILTER (side = 'ask' AND level = 1) AS ask, max(size) FILTER (side = 'ask' AND level = 1) AS ask_size FROM levels GROUP BY instrument)"
    q["top_of_book"] = f"{top} SELECT *, ask - bid AS spread, 0.5::DOUBLE * (bid + ask) AS mid, coalesce(CAST(bid >= ask AS INTEGER), 0) AS crossed FROM t"
    q["book_builder"] = f"WITH {BOOK}, l AS (SELECT instrument, side, price, arg_max(new_size, seq) AS size FROM deltas GROUP BY instrument, side, price), b AS (SELECT instrument, count(*) AS n FROM deltas GROUP BY instrument) SELECT b.instrument, 'live' AS state, n + 1 AS expected, (SELECT max(price) FROM l WHERE l.instrument = b.instrument AND side = 'bid' AND size > 0) AS best_bid, (SELECT min(price) FROM l WHERE l.instrument = b.instrument AND side = 'ask' AND size > 0) AS best_ask FROM b"
    q["books_equal"] = "SELECT DISTINCT event_type AS instrument, 1 AS equal FROM events"
    q["frame_rows"] = f"WITH {FRAMES} SELECT kind, symbol, ts_ns, price, coalesce(size, -1) AS size, close, coalesce(volume, -1) AS volume FROM (SELECT 'trade' AS kind, s AS symbol, us * 1000 + event_id % 1000 AS ts_ns, value AS price, n AS size, NULL::DOUBLE AS close, NULL::BIGINT AS volume FROM fr UNION ALL SELECT 'bar', s, us * 1000, NULL, NULL, value, n FROM fr WHERE event_id % 4 = 0)"
    q["frame_acks"] = f"WITH {FRAMES} SELECT event_id AS frame_ix, CAST(event_id % 10 = 0 AS INTEGER) AS connected, CAST(event_id % 6 = 0 AS INTEGER) AS unknown, CAST(event_id % 15 = 0 AS INTEGER) AS errors FROM fr WHERE event_id % 25 <> 24 UNION ALL SELECT event_id, 0, 0, 0 FROM fr WHERE event_id % 25 = 24"
    q["frame_rows"] = q["frame_rows"].replace("FROM fr UNION ALL", "FROM fr WHERE event_id % 25 <> 24 UNION ALL").replace("WHERE event_id % 4 = 0", "WHERE event_id % 4 = 0 AND event_id % 25 <> 24")
    q["frame_tape"] = f"WITH {FRAMES}, r AS (SELECT event_id AS f, 0 AS k, s FROM fr WHERE event_id % 25 <> 24 UNION ALL SELECT event_id, 2, s FROM fr WHERE event_id % 4 = 0 AND event_id % 25 <> 24), n AS (SELECT s AS symbol, CASE k WHEN 0 THEN 'trade' ELSE 'bar' END AS kind, row_number() OVER (PARTITION BY s ORDER BY f, k) AS seq, f FROM r) SELECT symbol, kind, count(*) AS n, CAST(sum(seq * (1 + f % 7)) AS BIGINT) AS digest FROM n GROUP BY symbol, kind"
    q["history_bars"] = f"WITH {BARS} SELECT symbol, start_ns, row_number() OVER (PARTITION BY symbol ORDER BY start_ns) AS seq, close, volume FROM bars"
    q["backoff"] = "SELECT a.attempt, CASE WHEN a.attempt >= 32 THEN 2000 ELSE CAST(least(2000::DOUBLE, 100 * pow(2::DOUBLE, a.attempt)) AS BIGINT) END AS ceiling FROM (SELECT unnest(range(0, 40)) AS attempt) a"
    return q
