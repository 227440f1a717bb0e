"""The gate loop over logged conversations: a fold in which an answered read is a seen path for what comes after.

The part of a decision that needs no history (which tool, which file, how long) is a join. What is left, which paths have
been seen and how many turns were answered in a row, is a state of one conversation. Rows are dealt by conversation and
sorted by turn, and the fold runs over them as they stream by: a task holds one conversation's seen paths, never its turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from stratalens.operators.agent import MAX_INNER_TURNS
from stratalens.operators.fold import folded
from stratalens.operators.transcript import READ_TOOLS, VIRTUAL_PREFIX, asked_path

FINAL, FORWARD, ANSWER, TERMINAL = "final", "forward", "answer", "terminal"


class Gate:
    """One conversation's state: the paths whose summary it has, and the turns answered in a row."""

    def __init__(self, most: int, remember: bool):
        self.most, self.remember, self.given, self.seen, self.inner = most, remember, set(), set(), 0

    def give(self, paths: list) -> None:
        """Paths whose summary the conversation has from the start."""
        self.given.update(paths)
        self.seen.update(paths)

    def _end(self) -> None:
        """The host has control again; without remember its next request lacks what was answered here."""
        self.inner = 0
        if not self.remember:
            self.seen = set(self.given)

    def turn(self, n_calls: int, n_host: int, reads: list) -> tuple[int, str, list]:
        """(turns answered in a row, action, paths gated) for a turn with reads of these large files."""
        if self.inner == self.most:  # the budget's end closes the request, whatever the model says next
            self._end()
            return 0, TERMINAL, []
        if not n_calls:
            self._end()
            return 0, FINAL, []
        fresh = sorted(p for p in reads if p not in self.seen)
        if n_host or len(fresh) < len(reads):  # one call of the host's forwards them all
            self._end()
            return 0, FORWARD, fresh
        self.seen.update(fresh)
        self.inner += 1
        return self.inner, ANSWER, fresh


def _asked(calls: DataFrame, files: DataFrame, threshold: int) -> DataFrame:
    """calls with p, the path of a read, and large, whether the index has it and it is longer than the threshold."""
    path = F.when(F.lower("name").isin(*READ_TOOLS), asked_path(F.col("input")))
    long = files.where(F.col("line_count") > threshold).select(F.col("path").cast("string").alias("p")).distinct()
    return calls.withColumn("p", path).join(long.withColumn("large", F.lit(True)), "p", "left").withColumn("large", F.coalesce("large", F.lit(False)))


def gate_loop(turns: DataFrame, calls: DataFrame, files: DataFrame, summarized: DataFrame, threshold: int, most: int = MAX_INNER_TURNS, remember: bool = True) -> DataFrame:
    """(conv_id, turn, n_calls, inner, action, gated) of every turn of turns (conv_id, turn).

    calls (conv_id, turn, name, input), files (path, line_count), summarized (conv_id, path): the summaries that a
    conversation has from its start. A turn without calls is final. A turn with a call of the host's, a read of a seen
    path among them, is forwarded as a whole. Any other turn is answered, and its gated paths are seen from then on.
    After `most` answered turns in a row the next one is terminal, and the budget starts afresh, as it does after a
    final and a forwarded turn. With remember the answers stay in the conversation; without, they are gone once the
    host has control again, as for a host that logs its own messages only.
    """
    virtual = F.col("name").startswith(VIRTUAL_PREFIX)
    asked = _asked(calls, files, threshold)
    n = asked.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(~F.coalesce(virtual, F.lit(False)) & ~F.col("large")).alias("n_host"), F.collect_set(F.when(~virtual & F.col("large"), F.col("p"))).alias("reads"))
    of_turns = turns.select("conv_id", "turn").distinct().join(n, ["conv_id", "turn"], "left")
    before = summarized.select("conv_id", F.col("path").cast("string").alias("path")).distinct()
    rows = of_turns.unionByName(before.select("conv_id", F.lit(None).cast(of_turns.schema["turn"].dataType).alias("turn"), F.array("path").alias("reads")), allowMissingColumns=True)
    rows = rows.select("conv_id", "turn", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_host", F.lit(0)).alias("n_host"), F.coalesce("reads", F.array().cast("array<string>")).alias("reads"))
    out = StructType().add("conv_id", rows.schema["conv_id"].dataType).add("turn", rows.schema["turn"].dataType)
    out = out.add("n_calls", LongType()).add("inner", LongType()).add("action", StringType()).add("gated", ArrayType(StringType()))

    def start():
        gate = Gate(most, remember)

        def row(r):
            conv, turn, n_calls, n_host, reads = r
            if turn is None:
                gate.give(reads)
                return []
            return [(conv, turn, n_calls, *gate.turn(n_calls, n_host, reads))]

        return row

    return folded(rows, "conv_id", [F.asc_nulls_first("turn")], start, out)


def loop_calls(calls: DataFrame, files: DataFrame, loop: DataFrame, threshold: int) -> DataFrame:
    """calls with kind and action: virtual, gated or host, as the loop saw them at their turn."""
    x = _asked(calls, files, threshold).join(loop.select("conv_id", "turn", "action", "gated"), ["conv_id", "turn"])
    gated = F.col("large") & F.array_contains("gated", F.col("p"))
    kind = F.when(F.col("name").startswith(VIRTUAL_PREFIX), "virtual").when(F.coalesce(gated, F.lit(False)), "gated").otherwise("host")
    return x.withColumn("kind", kind).drop("p", "large", "gated")
