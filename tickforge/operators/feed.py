"""Arbitration of two redundant sequenced lines into one stream, exactly once, in order, with gaps counted.

Two forms: the unbounded one is a window over (feed, seq); the exact one, with its bounded reorder window, is a fold.
They agree if no packet is rejected, none precedes the first seen, and lines differ by less than the window.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import fold

MAX_GAP = 1 << 20
#: Sequence numbers that one window partition spans.
BLOCK = 1 << 16


def delivered(packets: DataFrame) -> DataFrame:
    """feed, seq, line, payload of the first arrival of every sequence number, with gap: numbers missing before the next.

    A feed is cut into blocks of BLOCK numbers, so that its windows are spread over tasks. The next number after a
    block's last is the first of the next block, from a table of one row for each block.
    """
    cut = packets.withColumn("_block", F.expr(f"seq div {BLOCK}"))
    first = cut.withColumn("_n", F.expr("row_number() over (partition by feed, _block, seq order by arrival_ix)")).where("_n = 1")
    inside = first.withColumn("_next", F.expr("lead(seq) over (partition by feed, _block order by seq)"))
    starts = cut.groupBy("feed", "_block").agg(F.min("seq").alias("_first"))
    after = starts.select("feed", "_block", F.expr("lead(_first) over (partition by feed order by _block)").alias("_after"))
    return inside.join(after, ["feed", "_block"]).select("feed", "seq", "line", "payload", F.expr("coalesce(coalesce(_next, _after) - seq - 1, 0)").cast("long").alias("gap"))


def arbitration_stats(packets: DataFrame) -> DataFrame:
    """feed, delivered, duplicates_a, duplicates_b, gaps."""
    copies = packets.groupBy("feed").agg(F.count_if(F.col("line") == "A").alias("a"), F.count_if(F.col("line") == "B").alias("b"))
    won = delivered(packets).groupBy("feed").agg(F.count(F.lit(1)).alias("delivered"), F.count_if(F.col("line") == "A").alias("won_a"), F.count_if(F.col("line") == "B").alias("won_b"), F.sum("gap").alias("gaps"))
    return won.join(copies, "feed").select("feed", "delivered", (F.col("a") - F.col("won_a")).alias("duplicates_a"), (F.col("b") - F.col("won_b")).alias("duplicates_b"), "gaps")


def lost(packets: DataFrame) -> DataFrame:
    """feed, seq of every number between the first and the last that neither line delivered.

    Spelled out from each gap, so the work follows what is lost and not the range.
    """
    return delivered(packets).where("gap > 0").select("feed", F.explode(F.expr("sequence(seq + 1, seq + gap)")).alias("seq"))


class Arbitrator:
    """Exact arbitration of one feed. Rows: (arrival_ix, seq, line, payload).

    Gives ('deliver', seq, line, payload, null) for each packet in order, and at the end ('stats', ..., JSON of the counts).
    """

    def __init__(self, window: int = 4096) -> None:
        self.window = window
        self.frontier: int | None = None
        self.held: dict[int, list] = {}
        self.stats = {"delivered": 0, "duplicates_a": 0, "duplicates_b": 0, "gaps": 0, "max_reorder": 0, "rejected": 0}

    def advance(self, out: list[tuple]) -> None:
        """Move the frontier one step: deliver what is held there, or count a gap."""
        packet = self.held.pop(self.frontier, None)
        if packet is None:
            self.stats["gaps"] += 1
        else:
            out.append(("deliver", self.frontier, *packet, None))
            self.stats["delivered"] += 1
        self.frontier += 1

    def step(self, row: tuple) -> list[tuple]:
        _, seq, line, payload = row
        out: list[tuple] = []
        if self.frontier is None:
            self.frontier = seq
        if seq < self.frontier:
            self.stats[f"duplicates_{line.lower()}"] += 1
            return out
        if seq - self.frontier > MAX_GAP:
            self.stats["rejected"] += 1
            return out
        while seq - self.frontier >= self.window:
            self.advance(out)
        self.stats["max_reorder"] = max(self.stats["max_reorder"], seq - self.frontier)
        if seq in self.held:
            self.stats[f"duplicates_{line.lower()}"] += 1
            return out
        self.held[seq] = [line, payload]
        while self.frontier in self.held:
            self.advance(out)
        return out

    def finish(self) -> list[tuple]:
        out: list[tuple] = []
        while self.held:
            self.advance(out)
        return [*out, ("stats", None, None, None, json.dumps(self.stats, sort_keys=True))]

    def dump(self) -> str:
        return json.dumps([self.window, self.frontier, sorted(self.held.items()), self.stats])

    def load(self, state: str) -> None:
        self.window, self.frontier, held, self.stats = json.loads(state)
        self.held = {int(k): v for k, v in held}


def arbitrate(packets: DataFrame, window: int = 4096) -> DataFrame:
    """feed, event ('deliver' or 'stats'), seq, line, payload, stats by the exact rules; packets in order of arrival_ix."""
    return fold(packets, "feed", "arrival_ix", ["arrival_ix", "seq", "line", "payload"], lambda: Arbitrator(window), "feed string, event string, seq long, line string, payload long, stats string")
