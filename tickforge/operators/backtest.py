"""Policies on bars under transaction costs: steps, episodes, cost sweep, drawdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import BY_TIME, forward_returns

COSTS = [0.0, 0.0001, 0.0005, 0.001]
#: Policies as SQL over an observation (features, forward_return, k: the step's number).
POLICIES = {
    "always_flat": "0",
    "momentum": "cast(sign(log_return) as int)",
    "random": "cast((k * 1103515245 + 12345) % 2147483648 % 3 as int) - 1",
}
CLAIRVOYANT = {"clairvoyant": "cast(sign(forward_return) as int)"}


def environment(features: DataFrame) -> DataFrame:
    """The features of every bar but each symbol's last, with forward_return and k, the step's number."""
    steps = features.join(forward_returns(features), ["symbol", "start_ns", "arrival_ix"])
    return steps.withColumn("k", F.expr(f"cast(row_number() over ({BY_TIME}) - 1 as long)"))


def act(env: DataFrame, policies: dict[str, str] | None = None) -> DataFrame:
    """A row for each step and policy, with action."""
    chosen = policies or POLICIES
    return env.withColumn("_p", F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.expr(e).cast("int").alias("action")) for n, e in chosen.items())))).select(*env.columns, "_p.policy", "_p.action")


def check_actions(steps: DataFrame) -> None:
    """Actions are -1, 0 or 1, and returns are known."""
    if steps.where("action is null or action not in (-1, 0, 1) or forward_return is null").take(1):
        raise ValueError("an action is not one of -1, 0, 1, or a forward return is missing")


def step(steps: DataFrame, risk_aversion: float = 0.0) -> DataFrame:
    """steps (symbol, policy, cost, action, forward_return) with change, pnl and reward. Positions start flat and are not closed at the end."""
    by = "partition by policy, cost, symbol order by start_ns, arrival_ix"
    moved = steps.withColumn("_before", F.expr(f"lag(action, 1, 0) over ({by})"))
    gross = "action * forward_return"
    return moved.withColumns({"change": F.expr("cast(action <> _before as int)"), "pnl": F.expr(f"{gross} - cost * abs(action - _before)")}).withColumn("reward", F.expr(f"pnl - {risk_aversion}D * {gross} * {gross}")).drop("_before")


def equity(stepped: DataFrame) -> DataFrame:
    """stepped with equity and drawdown; the running peak starts at the first equity, not at 0."""
    by = "over (partition by policy, cost, symbol order by start_ns, arrival_ix rows between unbounded preceding and current row)"
    return stepped.withColumn("equity", F.expr(f"sum(pnl) {by}")).withColumn("drawdown", F.expr(f"max(equity) {by} - equity"))


def episodes(stepped: DataFrame) -> DataFrame:
    """policy, cost, symbol, steps, reward, pnl, trades, sharpe, max_drawdown."""
    return (
        equity(stepped).groupBy("policy", "cost", "symbol")
        .agg(F.count(F.lit(1)).alias("steps"), F.sum("reward").alias("reward"), F.sum("pnl").alias("pnl"), F.sum("change").cast("long").alias("trades"), F.avg("pnl").alias("_m"), F.stddev_pop("pnl").alias("_s"), F.max("drawdown").alias("max_drawdown"))
        .withColumn("sharpe", F.expr("case when steps <= 1 or _s < 1e-15 then 0D else _m / _s end")).drop("_m", "_s")
    )


def with_costs(steps: DataFrame, costs: list[float] | None = None) -> DataFrame:
    return steps.withColumn("cost", F.explode(F.array(*(F.lit(c) for c in costs or COSTS))))


def cost_sweep(split_env: DataFrame, costs: list[float] | None = None, policies: dict[str, str] | None = None) -> DataFrame:
    """cost, policy: total pnl and trades, mean of the symbols' sharpes, largest drawdown, on the test fold of environment rows with fold."""
    tested = episodes(step(with_costs(act(split_env.where("fold = 'test'"), policies), costs)))
    return tested.groupBy("cost", "policy").agg(F.sum("pnl").alias("pnl"), F.sum("trades").alias("trades"), F.avg("sharpe").alias("sharpe"), F.max("max_drawdown").alias("max_drawdown"))


def most_bars(bars: DataFrame) -> DataFrame:
    """The symbol with the most bars, the smallest of several, and their number."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(1)
