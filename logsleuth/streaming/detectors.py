"""Structured Streaming versions of the operators (ST1–ST9).

- ST1 enrichment is the batch expression set applied to a stream (stateless,
  no shuffle): :func:`enrich_stream`.
- ST5/ST6 alarms are watermarked tumbling-window aggregates:
  :func:`tumbling_alarm`; their changes between OK and ALARM, missing periods
  included: :func:`alarm_state_stream`, in batch :func:`alarm_transitions`.
- ST9 duplicate delivery: :func:`dedupe_stream` (``dropDuplicatesWithinWatermark``).
- ST2 (entity profiles with time/action/source detection) keeps map state with
  ``transformWithState`` on RocksDB, ST3 (per-user escalation lookback) state of
  fixed size with ``applyInPandasWithState``; event time drops idle keys (ST2
  after the profile lookback if one is given, ST3 after the escalation lookback).
  Rows of a key are processed in (ts, event_id) order within a micro-batch;
  rows behind the watermark are dropped by Spark (ST8, a stated divergence
  from arrival-order processing).
- ST4 combination counters: running counts live in a state table written by
  ``foreachBatch`` (:func:`combination_batch_update`), so the global number
  of multi-entity events is exact across keys.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import behavior as B
from ..operators import enrich as EN
from ..sources import cloudtrail as CT


# ------------------------------------------------------------------ ST1 / ST9

def enrich_stream(messages: DataFrame, text_col: str = "value") -> DataFrame:
    """ST1: queue payloads → compliance rows of the valid messages; one bad
    message never fails the micro-batch.  :func:`message_errors` gives the rest."""
    return EN.enrich_cloudtrail(CT.route_messages(messages, text_col).where(F.col("status") == "valid"))


def message_errors(messages: DataFrame, text_col: str = "value") -> DataFrame:
    """ST1: the messages that gave no compliance row, for a sink of their own:
    ``status`` (skipped, rejected, invalid), ``errors`` and the columns of the
    message."""
    keep = [c for c in messages.columns if c != text_col]
    routed = CT.route_messages(messages, text_col).where(F.col("status") != "valid")
    return routed.select(*keep, "record_index", F.col("eventID").alias("event_id"), "status", "errors")


def dedupe_stream(events: DataFrame, key: str = "event_id", ts_col: str = "ts",
                  watermark: str = "30 minutes") -> DataFrame:
    """ST9 (opt-in): drop redelivered events with the same key within the
    watermark delay."""
    return events.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key])


# ------------------------------------------------------------------ ST5 / ST6

def tumbling_alarm(events: DataFrame, ts_col: str, metric: F.Column, period: str = "1 minute",
                   watermark: str = "5 minutes", threshold: float = 1.0) -> DataFrame:
    """ST5/ST6: sum ``metric`` per tumbling ``period``; ``alarm`` when the
    sum reaches ``threshold`` (periods without data emit nothing = OK)."""
    src = events.withWatermark(ts_col, watermark) if events.isStreaming else events
    agg = src.groupBy(F.window(ts_col, period).alias("w")).agg(F.sum(metric).alias("value"))
    return agg.select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
                      "value", (F.col("value") >= threshold).alias("alarm"))


def alarm_transitions(periods: DataFrame, period: str = "1 minute", threshold: float = 1.0, key: str | None = None) -> DataFrame:
    """ST5/ST6 in batch: ``alarm, at, state`` at every change between ``OK`` and
    ``ALARM`` of the tumbling periods of ``periods`` (``period_start``, ``value``).
    A period without data does not breach, so a run of breaching periods ends at the
    first one that is missing or below the threshold."""
    length = F.expr(f"INTERVAL {period}")
    w = Window.partitionBy("alarm").orderBy("period_start")
    x = periods.select((F.col(key) if key else F.lit("alarm")).alias("alarm"), "period_start", "value").where(F.col("value") >= threshold)
    x = x.select("alarm", "period_start", F.lag("period_start").over(w).alias("before"), F.lead("period_start").over(w).alias("next"))
    change = lambda at, state: F.struct(at.alias("at"), F.lit(state).alias("state"))
    after = F.col("period_start") + length
    return x.select("alarm", F.explode(F.array_compact(F.array(
        F.when(~F.col("before").eqNullSafe(F.col("period_start") - length), change(F.col("period_start"), "ALARM")),
        F.when(~F.col("next").eqNullSafe(after), change(after, "OK"))))).alias("c")).select("alarm", "c.*")


class AlarmState(StatefulProcessor):
    """State of one alarm: whether it is on, and its last breaching period.  Closed
    periods switch it; a timer at the end of the next period switches it off when
    that period brings no row."""

    def __init__(self, period_ms: int, threshold: float):
        self.period, self.threshold = period_ms, threshold

    def init(self, handle):
        self.handle = handle
        self.on = handle.getValueState("on", "last_ms long")

    def _rows(self, key, changes):
        if changes:
            yield pd.DataFrame({"alarm": [key[0]] * len(changes), "at": pd.to_datetime([t for t, _ in changes], unit="ms"),
                                "state": [s for _, s in changes]})

    def handleInputRows(self, key, rows, timerValues):
        found = [p for p in rows if len(p)]
        if not found:
            return
        closed = pd.concat(found).sort_values("start_ms")
        last, out = self.on.get()[0] if self.on.exists() else None, []
        for at, value in zip(closed["start_ms"].tolist(), closed["value"].tolist()):
            if last is not None and at > last + self.period:  # periods without data lie between
                out.append((last + self.period, "OK"))
                last = None
            if value is not None and value >= self.threshold:
                if last is None:
                    out.append((at, "ALARM"))
                last = at
            elif last is not None:
                out.append((at, "OK"))
                last = None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last is None:
            self.on.clear()
        else:
            self.on.update((int(last),))
            self.handle.registerTimer(int(last + 2 * self.period))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.on.exists():
            last = self.on.get()[0]
            self.on.clear()
            yield from self._rows(key, [(last + self.period, "OK")])

    def close(self):
        pass


def alarm_state_stream(events: DataFrame, ts_col: str, metric: F.Column, period: str = "1 minute",
                       watermark: str = "5 minutes", threshold: float = 1.0, key: str | None = None) -> DataFrame:
    """ST5/ST6 on a stream: the changes of :func:`alarm_transitions` once the
    watermark has closed the period.  Periods are summed first (partial aggregates),
    so an alarm's state sees one row a period, whatever the number of events."""
    millis = int(pd.Timedelta(period).total_seconds() * 1000)
    alarm = (F.col(key) if key else F.lit("alarm")).alias("alarm")
    sums = (events.withWatermark(ts_col, watermark).groupBy(F.window(ts_col, period), alarm)
                  .agg(F.sum(metric).cast("double").alias("value")))
    return (sums.select("window", "alarm", F.unix_millis("window.start").alias("start_ms"), "value").groupBy("alarm")
                .transformWithStateInPandas(AlarmState(millis, threshold), "alarm string, at timestamp, state string",
                                            "Append", "EventTime"))


# ----------------------------------------------------------------------- ST2

PROFILE_OUT = ("event_id long, entity_type string, entity_id string, anomaly_type string, "
               "score double, confidence double, factors array<string>")


class ProfileDetector(StatefulProcessor):
    """ST2 state of one (entity_type, entity_id): one value with the number of events,
    the events of each hour and the first ``INLINE`` actions and sources, read and
    written once a batch; what is seen beyond those is kept in two maps, of which an
    update touches the batch's own entries only, whatever the profile has collected."""

    INLINE = 128

    def __init__(self, mode: str, min_events: int, lookback_days: int | None):
        self.mode, self.min_events, self.lookback_ms = mode, min_events, lookback_days and lookback_days * 86_400_000
        self.risk = dict.fromkeys(B.HIGH_RISK_ACTIONS, B.HIGH_RISK_SCORE) | dict.fromkeys(B.MEDIUM_RISK_ACTIONS, B.MEDIUM_RISK_SCORE)
        self.default, self.source_score = B.DEFAULT_RISK_SCORE, B.NEW_SOURCE_SCORE

    def init(self, handle):
        self.handle = handle
        self.profile = handle.getValueState("profile", "n long, last_ms long, hours array<long>, actions array<string>, "
                                                       "sources array<string>")
        self.actions = handle.getMapState("actions", "action string", "seen boolean")
        self.sources = handle.getMapState("sources", "source string", "seen boolean")

    def _is_new(self, value, inline, seen, state):
        """Whether ``value`` was not seen before; it is kept from now on.  ``inline``
        goes back into the profile, ``seen`` holds what this batch has looked up."""
        if value in seen:
            return False
        seen.add(value)
        if len(inline) < self.INLINE:
            inline.append(value)
        elif state.containsKey((value,)):
            return False
        else:
            state.updateValue((value,), (True,))
        return True

    def handleInputRows(self, key, rows, timerValues):
        ev = []
        for p in rows:
            at = p["ts"].to_numpy().astype("datetime64[us]")
            if np.isnat(at).any():
                raise ValueError("an event has no time")
            ev += zip(at.astype(np.int64).tolist(), p["event_id"].tolist(), p["action"].tolist(), p["source"].tolist())
        if not ev:
            return
        missing = lambda x: x is None or x != x
        ev.sort(key=lambda e: (e[0], missing(e[1]), 0 if missing(e[1]) else e[1]))
        found = self.profile.get() if self.profile.exists() else None
        n, last, hours, actions, sources = found or (0, 0, [0] * 24, [], [])
        hours, actions, sources = list(hours), list(actions), list(sources)
        old_actions, old_sources = set(actions), set(sources)
        own = 1 if self.mode == "parity" else 0  # parity counts an event before it is judged
        who = (str(key[0]) if key[0] is not None else None, str(key[1]) if key[1] is not None else None)
        out = []
        for i, (at, event_id, action, source) in enumerate(ev):
            hour = at // 3_600_000_000 % 24
            total, count = n + i + own, hours[hour] + own
            hours[hour] += 1
            new_action = self._is_new(None if missing(action) else action, actions, old_actions, self.actions)
            new_source = not missing(source) and source != "" and self._is_new(source, sources, old_sources, self.sources)
            if total < self.min_events or total <= 0:
                continue
            share = count / total
            if share < 0.05 and count < 2:
                out.append((event_id, *who, "time_pattern_anomaly", min(8.0 - share * 100, 10.0), 0.8,
                            [f"Unusual activity hour: {hour:02d}:00", f"Historical frequency: {share:.1%}"]))
            if new_action and not own:
                out.append((event_id, *who, "behavioral_deviation", self.risk.get(action, self.default), 0.7,
                            [f"New action: {action}", "No historical precedent"]))
            if new_source and not own:
                out.append((event_id, *who, "behavioral_deviation", self.source_score, 0.6,
                            [f"New source IP: {source}", "No historical precedent"]))
        last = max(last, ev[-1][0] // 1000)
        self.profile.update((n + len(ev), last, hours, actions, sources))
        if self.lookback_ms:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.lookback_ms)
        if out:
            yield pd.DataFrame(out, columns=["event_id", "entity_type", "entity_id", "anomaly_type",
                                             "score", "confidence", "factors"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in (self.profile, self.actions, self.sources):
            state.clear()
        return iter(())

    def close(self):
        pass


def profile_detector_stream(ee: DataFrame, mode: str = "parity", min_events: int = 10,
                            lookback_days: int | None = None, watermark: str = "30 minutes") -> DataFrame:
    """ST2: keyed profile state per (entity_type, entity_id) with W3/W4
    detection; ``ee`` rows: event_id, ts, entity_type, entity_id, action, source.
    Rows of a key are taken in (ts, event_id) order within a micro-batch.  Profiles
    are never forgotten unless ``lookback_days`` is given: then an event-time timer
    clears a profile that long after its last event.  Needs the RocksDB state store
    (:func:`~logsleuth.streaming.runner.rocksdb_state`)."""
    src = ee.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "entity_type", "entity_id",
                    "action", "source")
    src = src.withWatermark("ts", watermark) if ee.isStreaming else src
    return src.groupBy("entity_type", "entity_id").transformWithStateInPandas(
        ProfileDetector(mode, min_events, lookback_days), PROFILE_OUT, "Append",
        "EventTime" if lookback_days is not None and ee.isStreaming else "None")


# ----------------------------------------------------------------------- ST3

ESC_STATE = "names array<string>, latest array<timestamp>, recent_ts array<timestamp>, recent_acts array<string>"
ESC_OUT = "event_id long, entity_id string, pattern string, score double, factors array<string>"


def _escalation_fn(patterns: dict, lookback_minutes: int):
    """State per user of fixed size: the latest time of each pattern action and
    the last four events.  A pattern holds while all its actions are inside the
    lookback; the window has three events when the one before the previous one
    is still inside it."""
    look = timedelta(minutes=lookback_minutes)
    watched = sorted({a for need, _ in patterns.values() for a in need})

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        latest, recent = {}, []
        if state.exists:
            names, times, recent_ts, recent_acts = state.get
            latest, recent = dict(zip(names, times)), list(zip(recent_ts, recent_acts))
        parts = [p for p in pdfs if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["ts", "event_id"])
        out = []
        for ts, event_id, action in zip(pdf["ts"], pdf["event_id"], pdf["action"]):
            cutoff = ts - look
            recent.append((ts, action))
            if action in watched:
                latest[action] = ts
            hits = [(n, base) for n, (need, base) in patterns.items()
                    if all(a in latest and latest[a] > cutoff for a in need)]
            if hits:
                bonus = 1.0 if len(recent) >= 3 and recent[-3][0] > cutoff else 0.0
                last = [a for t, a in recent[-5:] if t > cutoff]
                out += [(event_id, key[0], n, min(base + bonus, 10.0),
                         [f"Privilege escalation pattern: {n}", f"Recent actions: {last}"]) for n, base in hits]
            del recent[:-4]
        state.update((list(latest), list(latest.values()), [t for t, _ in recent], [a for _, a in recent]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(pd.Timestamp(recent[-1][0]).timestamp() * 1000))
                                  + lookback_minutes * 60_000)
        if out:
            yield pd.DataFrame(out, columns=["event_id", "entity_id", "pattern", "score", "factors"])
    return fn


def escalation_stream(events: DataFrame, user_col: str = "user_key", action_col: str = "action",
                      patterns: dict | None = None, lookback_minutes: int = 30,
                      watermark: str = "30 minutes") -> DataFrame:
    """ST3: per-user escalation state, see :func:`_escalation_fn`."""
    patterns = B.ESCALATION_PATTERNS if patterns is None else patterns
    src = (events.where(F.col(user_col).isNotNull())
                 .select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                         F.col(user_col).alias("user_key"), F.col(action_col).alias("action")))
    src = src.withWatermark("ts", watermark) if events.isStreaming else src
    return (src.groupBy("user_key")
               .applyInPandasWithState(_escalation_fn(patterns, lookback_minutes), ESC_OUT, ESC_STATE,
                                       "append", GroupStateTimeout.EventTimeTimeout))


# ----------------------------------------------------------------------- ST8

def late_split_batch(batch: DataFrame, batch_id: int, root: str, ts_col: str = "ts", delay: str = "30 minutes") -> None:
    """ST8 body for ``foreachBatch``: rows behind the watermark (the latest time of
    the batches before, less ``delay``) go to ``root/late``, all others to
    ``root/kept``, which a stateful stream reads.  None is lost: kept and late
    together are the input.  Each batch has its own folders and its own latest time,
    so a retried batch rewrites the same."""
    spark = batch.sparkSession
    try:
        seen = spark.read.schema("latest timestamp, batch long").parquet(f"{root}/latest")
        latest = seen.where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        latest = None
    batch.agg(F.max(F.col(ts_col).cast("timestamp")).alias("latest")) \
         .write.mode("overwrite").parquet(f"{root}/latest/batch={batch_id}")
    late = F.coalesce(F.col(ts_col).cast("timestamp") < F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
    batch.where(late).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
    batch.where(~late).write.mode("overwrite").parquet(f"{root}/kept/batch={batch_id}")


# ----------------------------------------------------------------------- ST4

COMBINATION_STATE = "family string, key string, count long"


COMPACT_EVERY = 16


def _batches(spark, folder: str, before: int) -> list[int]:
    """Batch ids below ``before`` that have a folder, from the listing's partitions."""
    try:
        seen = spark.read.schema(f"{COMBINATION_STATE}, batch long").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["batch"] for r in seen.where(F.col("batch") < before).select("batch").distinct().collect())


def combination_state(spark, state_root: str, before: int | None = None) -> DataFrame | None:
    """ST4: the counts of all batches (of those before ``before``): the latest
    compacted state and the deltas after it.  None if there is none."""
    before = 1 << 62 if before is None else before
    base = _batches(spark, f"{state_root}/base", before)[-1:]
    deltas = [b for b in _batches(spark, f"{state_root}/delta", before) if not base or b > base[0]]
    paths = [f"{state_root}/base/batch={b}" for b in base] + [f"{state_root}/delta/batch={b}" for b in deltas]
    if not paths:
        return None
    rows = spark.read.schema(COMBINATION_STATE).parquet(*paths)
    return rows.groupBy("family", "key").agg(F.sum("count").alias("count"))


def combination_batch_update(batch: DataFrame, batch_id: int, state_root: str,
                             entities_col: str = "entities", compact_every: int = COMPACT_EVERY) -> DataFrame:
    """ST4 body for ``foreachBatch``: fold one micro-batch of events into the
    combination-count state (family, key, count; family ``total`` holds the
    number of multi-entity events) and return the new state.

    A batch writes its own counts as a delta under its batch id in ``state_root`` (a
    folder in the shared checkpoint location), so what is written follows the batch,
    not the history; every ``compact_every``-th batch also folds all deltas into a
    compacted state.  A retried batch rewrites its own folders from the same input.
    Only a folder that does not exist counts as empty state; any other failure to
    read it fails the batch."""
    spark = batch.sparkSession
    counts = B.combination_counts(batch, entities_col)
    total = batch.agg(F.count_if(F.size(entities_col) >= 2).cast("long").alias("count")).select(
        F.lit("total").alias("family"), F.lit("").alias("key"), "count")
    new = counts.select("family", "key", F.col("count").cast("long")).unionByName(total)
    new.write.mode("overwrite").parquet(f"{state_root}/delta/batch={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        prior = combination_state(spark, state_root, batch_id)
        own = spark.read.schema(COMBINATION_STATE).parquet(f"{state_root}/delta/batch={batch_id}")
        rows = own if prior is None else prior.unionByName(own)
        rows.groupBy("family", "key").agg(F.sum("count").alias("count")) \
            .write.mode("overwrite").parquet(f"{state_root}/base/batch={batch_id}")
    return combination_state(spark, state_root, batch_id + 1)


def rare_pair_batch(batch: DataFrame, batch_id: int, state_root: str, out_root: str, entities_col: str = "entities",
                    rarity_threshold: float = 0.01, min_observations: int = 100) -> None:
    """ST4 with W5 on the stream, a body for ``foreachBatch``: score one
    micro-batch against the counts of all earlier ones plus the running counts
    inside it, then fold it into the state.  With micro-batches in event-time
    order the result is that of the batch operator.  Output and state are kept
    per batch id, so a repeated batch rewrites both."""
    prior = combination_state(batch.sparkSession, state_root, batch_id)
    hits = B.rare_combinations(batch, entities_col, rarity_threshold, min_observations, prior=prior)
    hits.write.mode("overwrite").parquet(f"{out_root}/batch={batch_id}")
    combination_batch_update(batch, batch_id, state_root, entities_col)
