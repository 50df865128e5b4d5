"""Requests as streams: the newest generation and the newest age win, and late ones don't come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def latest_ages(requests: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """(session, window, age, token): the age of the largest token in each window of event time. Works on tables and on streams; on a stream state is dropped behind the watermark."""
    marked = requests.withWatermark("ts", late) if requests.isStreaming else requests
    by = marked.groupBy(F.window("ts", window), "session")
    return by.agg(F.max(F.struct("token", "age")).alias("last")).select("session", F.col("window.start").alias("window_start"), F.col("last.age").alias("age"), F.col("last.token").alias("token"))


def newest_generation(tasks: DataFrame) -> DataFrame:
    """Tasks of each session's largest generation; older ones are cancelled."""
    newest = tasks.groupBy("session").agg(F.max("generation").alias("generation"))
    return tasks.join(newest, ["session", "generation"], "left_semi")


def unique_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each result key once, so that equal requests in flight are worked on once."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"]) if requests.isStreaming else requests.dropDuplicates(["key"])


OUTCOME = "session string, generation long, key string, seq long, outcome string"


def _outcomes_of_table(requests: DataFrame) -> DataFrame:
    order = Window.partitionBy("session").orderBy("seq")
    starts = requests.filter("kind = 'start'").withColumn("_newest", F.max("generation").over(order))
    # A generation lasts from its first request until that of the next larger one.
    spans = starts.groupBy("session", F.col("_newest").alias("generation")).agg(F.min("seq").alias("_first"))
    spans = spans.withColumn("_superseded", F.lead("_first").over(Window.partitionBy("session").orderBy("generation"))).drop("_first")
    done = requests.filter("kind = 'done'").select("session", "generation", "key", F.col("seq").alias("_done"))
    keys = ["session", "generation", "key"]
    ended = starts.join(done, keys, "left").groupBy(*keys, "seq", "_newest").agg(F.min(F.when(F.col("_done") > F.col("seq"), F.col("_done"))).alias("_done"))
    both = ended.join(spans, ["session", "generation"], "left")
    stale = F.col("_newest") > F.col("generation")
    early = F.col("_done").isNotNull() & (F.col("_superseded").isNull() | (F.col("_done") < F.col("_superseded")))
    outcome = F.when(stale, "cancelled").when(early, "completed").when(F.col("_superseded").isNotNull(), "cancelled").otherwise("pending")
    return both.select(*keys, "seq", outcome.alias("outcome"))


def _tracked(key, batches, state: GroupState, patience_ms: int):
    """Outcomes of one session: its newest generation and what is pending of it are the state."""
    import pandas as pd

    out: list[tuple] = []
    newest, names, seqs = state.get if state.exists else (None, [], [])
    pending = dict(zip(names, seqs, strict=True))
    if state.hasTimedOut:
        out = [(key[0], newest, k, s, "expired") for k, s in pending.items()]
        state.remove()
    else:
        rows = pd.concat(batches).sort_values("seq", kind="stable")
        for r in rows.itertuples(index=False):
            if r.kind == "start":
                if newest is None or r.generation > newest:
                    out += [(key[0], newest, k, s, "cancelled") for k, s in pending.items()]
                    newest, pending = int(r.generation), {}
                if r.generation < newest:
                    out.append((key[0], int(r.generation), r.key, int(r.seq), "cancelled"))
                else:
                    pending.setdefault(r.key, int(r.seq))
            elif r.generation == newest and r.key in pending:
                out.append((key[0], newest, r.key, pending.pop(r.key), "completed"))
        state.update((newest, list(pending), list(pending.values())))
        if pending:
            until = max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + patience_ms
            state.setTimeoutTimestamp(until)
    yield pd.DataFrame(out, columns=["session", "generation", "key", "seq", "outcome"])


def token_outcomes(requests: DataFrame, late: str = "10 minutes", patience_seconds: int = 600) -> DataFrame:
    """(session, generation, key, seq, outcome) of requests (session, seq, generation, key, kind `start` or `done`, ts).

    A start of a larger generation cancels what is pending of smaller ones, and one of a smaller generation than has been seen is
    cancelled at once; a done completes the pending start of its generation and key. A key starts once a generation. On a table what
    is left is `pending`. A stream gives an outcome when it is known, keeps the newest generation and the pending keys of a session as its
    state, and a timer clears them, as `expired`, `patience_seconds` of event time after the session's last request."""
    if not requests.isStreaming:
        return _outcomes_of_table(requests)

    def tracked(key, batches, state):
        yield from _tracked(key, batches, state, patience_seconds * 1000)

    marked = requests.withWatermark("ts", late)
    return marked.groupBy("session").applyInPandasWithState(tracked, OUTCOME, "newest long, keys array<string>, seqs array<long>", "append", "EventTimeTimeout")
