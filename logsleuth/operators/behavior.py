"""Behavioural anomaly detectors as window/aggregate plans (A3, A4, A9, W3–W6,
J2, J3, J5–J7, U1, PF8, PF11, PF21, A8).

The original engine walks events one at a time and mutates four maps.  Here
"the state after event e" is a running aggregate in the total order
(ts, event_id):

- the count per entity comes from :func:`running_count`: a window per (key,
  segment of a bounded number of rows) plus a prefix sum over the small block
  table, so one hot entity or day is never a single task;
- first events per (entity, hour), (entity, action), (entity, source) are one
  partial aggregate (the smallest row), not running counts;
- pair counts and the number of multi-entity events are running totals of the
  same kind (the global total is a prefix sum over segments);
- the escalation lookback runs per (user, segment): the latest time of every
  pattern action and the last events before the segment are carried in, so a
  user's history is never one task.

``mode="parity"`` reproduces the original engine, which updates profiles
*before* detecting (so new-action / new-source never fire and the time
detector sees the current event, T2); ``mode="prior"`` detects against the
profile of earlier events only.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hof import explode_rows, let
from ..plans.keys import join_on
from ..plans.ranking import balanced_segments, running_count, running_total, running_totals
from ..session import as_table

# Action risk classes for new actions (default 4.0).
HIGH_RISK_ACTIONS = [
    "CreateRole", "AttachUserPolicy", "AttachRolePolicy", "PutUserPolicy",
    "CreateUser", "DeleteRole", "DeleteUser", "CreateAccessKey",
    "AssumeRole", "GetCredentialsForIdentity", "CreateLoginProfile",
]
MEDIUM_RISK_ACTIONS = [
    "ListUsers", "ListRoles", "GetUser", "GetRole", "ListAttachedUserPolicies",
    "ListAttachedRolePolicies", "DescribeInstances", "DescribeImages",
]
HIGH_RISK_SCORE, MEDIUM_RISK_SCORE, DEFAULT_RISK_SCORE = 9.0, 6.0, 4.0
NEW_SOURCE_SCORE = 6.0

# Escalation patterns (set containment, order ignored) and base scores.
ESCALATION_PATTERNS = {
    "iam_policy_creation": (["CreateRole", "AttachRolePolicy", "AssumeRole"], 9.0),
    "user_privilege_grant": (["CreateUser", "AttachUserPolicy", "CreateAccessKey"], 8.5),
    "admin_access": (["AttachUserPolicy", "AttachRolePolicy"], 9.5),
    "cross_account_assume": (["AssumeRole", "GetCredentialsForIdentity"], 8.0),
}
DEFAULT_PATTERN_SCORE = 7.0

# Detector weights by anomaly type (default 1.0).
DETECTOR_WEIGHTS = {
    "statistical_outlier": 0.2,
    "rare_entity_combination": 0.25,
    "behavioral_deviation": 0.3,
    "time_pattern_anomaly": 0.2,
    "privilege_escalation": 0.4,
    "lateral_movement": 0.35,
}

ANOMALY_COLS = ["event_id", "ts", "entity_id", "entity_type", "anomaly_type", "score",
                "confidence", "baseline_deviation", "factors", "det_rank", "sub_rank"]

SEGMENT_ROWS = 1_000_000
# Segments whose rows become many (the pairs of an event) are smaller.
EVENT_SEGMENT_ROWS = 100_000


def _lit_map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def action_risk(action: Column) -> Column:
    """Risk class of an action as a literal map lookup (no join)."""
    table = {a: HIGH_RISK_SCORE for a in HIGH_RISK_ACTIONS}
    table.update({a: MEDIUM_RISK_SCORE for a in MEDIUM_RISK_ACTIONS})
    return F.coalesce(F.element_at(_lit_map(table), action), F.lit(DEFAULT_RISK_SCORE))


def user_key(arn: Column, user_name: Column) -> Column:
    """PF11: identity ARN, else user name; empty strings count as missing."""
    return F.coalesce(F.nullif(arn, F.lit("")), F.nullif(user_name, F.lit("")))


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def _fmt_fixed(x: Column, digits: int) -> Column:
    """Fixed-point text rounded half-even on the binary value (Python's
    format rules); ``format_string`` would round half-up."""
    return F.format_number(x.cast("double"), digits)


def _py_list(arr: Column) -> Column:
    """Render array<string> like a Python list repr: ['a', 'b']."""
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(
        arr, lambda a: F.concat(F.lit("'"), a, F.lit("'")))), F.lit("]"))


# --------------------------------------------------------------------- profiles

def within_lookback(ee: DataFrame, lookback_days: int, as_of=None) -> DataFrame:
    """The events of the last ``lookback_days`` up to ``as_of`` (the latest
    event when not given)."""
    if as_of is None:
        as_of = ee.agg(F.max("ts").alias("t")).first()["t"]
    end = F.lit(as_of).cast(ee.schema["ts"].dataType)
    return ee.where((F.col("ts") > end - F.expr(f"INTERVAL {lookback_days} DAYS")) & (F.col("ts") <= end))


def entity_profiles(ee: DataFrame, lookback_days: int | None = None, as_of=None) -> DataFrame:
    """A3: final behaviour profile per (entity_type, entity_id), of all events or
    of those :func:`within_lookback`.

    ``ee`` has one row per (event, entity): event_id, ts, entity_type,
    entity_id, action, source, region.  Histograms are bounded (24 hours,
    the region domain); the source set can grow with the data, so it is
    reported as a count (see :func:`entity_sources` for the long form).
    """
    k = ["entity_type", "entity_id"]
    ee = ee if lookback_days is None else within_lookback(ee, lookback_days, as_of)
    base = ee.groupBy(*k).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("total_events"),
        F.array_sort(F.collect_set("action")).alias("unique_actions"),
        F.count_distinct(F.when(_truthy(F.col("source")), F.col("source"))).alias("n_sources"))
    hours = (ee.groupBy(*k, F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("c"))
               .groupBy(*k).agg(F.map_from_entries(F.array_sort(F.collect_list(
                   F.struct("h", "c")))).alias("time_patterns")))
    regions = (ee.groupBy(*k, F.col("region").alias("r")).agg(F.count(F.lit(1)).alias("c"))
                 .groupBy(*k).agg(F.map_from_entries(F.array_sort(F.collect_list(
                     F.struct("r", "c")))).alias("geo_patterns")))
    return base.join(hours, k).join(regions, k)


def entity_sources(ee: DataFrame) -> DataFrame:
    """Long form of the profile source sets: distinct (entity, source)."""
    return (ee.where(_truthy(F.col("source")))
              .select("entity_type", "entity_id", "source").distinct())


# ------------------------------------------------------------ W3 / W4 detectors

def _marks(prior: bool, *more) -> Column:
    """What an event counts for: its hour and, in prior mode, action and source."""
    mark = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    out = [*more, mark("hour", F.hour("ts").cast("string"))]
    if prior:
        out += [mark("action", F.col("action")), F.when(_truthy(F.col("source")), mark("source", F.col("source")))]
    return F.explode(F.array_compact(F.array(*out)))


def _sliding_firsts(ee: DataFrame, prior: bool, lookback_days: int, segment_rows: int):
    """The rows of :func:`_firsts` when an event is forgotten ``lookback_days``
    after it.  Every event adds one to its entity, hour, action and source and takes
    it back when it expires; running sums over data-following segments give the
    counts inside the lookback, so no entity is one task."""
    k = ["entity_type", "entity_id"]
    every = F.struct(F.lit("all").alias("kind"), F.lit("").alias("v"))
    x = ee.select(*k, "event_id", F.col("ts").cast("timestamp").alias("ts"), "ent_ord", *(["action", "source"] if prior else []))
    step = lambda at, w: F.struct(at.alias("_at"), F.lit(w).alias("_w"))
    x = x.withColumn("_s", F.explode(F.array(step(F.col("ts"), 1), step(F.col("ts") + F.expr(f"INTERVAL {lookback_days} DAYS"), -1))))
    # segments are found before an event is repeated for each of its marks
    marks = 4 if prior else 2
    x = as_table(balanced_segments(x.select("*", "_s.*").drop("_s"), "_at", rows=max(1, segment_rows // marks)), "lookback-steps")
    x = x.select(*k, "event_id", "ts", "ent_ord", "_at", "_w", "_bal", _marks(prior, every).alias("_m")).select("*", "_m.*").drop("_m")
    # what expires at an instant is gone before the events of that instant
    x = running_totals(x, [*k, "kind", "v"], ["_at", "_w", "event_id", "ent_ord"], F.col("_bal"), {"_c": F.col("_w")})
    x = as_table(x.where("_w = 1").drop("_w", "_at", "_bal"), "lookback-counts")
    event = [*k, "event_id", "ts", "ent_ord"]
    total = x.where("kind = 'all'").select(*event, F.col("_c").alias("_n"))
    rare = x.where((F.col("kind") == "hour") & (F.col("_c") < (3 if prior else 2))
                   | F.col("kind").isin("action", "source") & (F.col("_c") == 1))
    rare = join_on(rare, total, event).withColumn("_ev", F.struct("ts", "event_id", "ent_ord", "_n"))
    hours = rare.where("kind = 'hour'").select(*k, F.col("v").alias("_hour"), "_ev", (F.col("_c") - int(prior)).alias("_hc"))
    return hours, rare.where("kind <> 'hour'").select(*k, "kind", "v", "_ev")


def behavioral_anomalies(ee: DataFrame, mode: str = "parity", min_events: int = 10,
                         segment_rows: int = SEGMENT_ROWS, lookback_days: int | None = None) -> DataFrame:
    """W3 (unusual hour), W4 (new action, new source) for every (event, entity).

    An hour is unusual only while it was seen less than twice, so just the first
    two events of each (entity, hour) can fire, and W4 fires on the first event
    of an (entity, action) or (entity, source): all are smallest rows of a group.
    With ``lookback_days`` (T3, off by default) only the events after that many
    days before an event count, for the number of events too: an action or source
    is new again when its last event is as old as the lookback.
    Output follows :data:`ANOMALY_COLS`.
    """
    if mode not in ("parity", "prior"):
        raise ValueError("mode must be 'parity' or 'prior'")
    prior = mode == "prior"
    if lookback_days is None:
        hours, first = _firsts(ee, prior, segment_rows)
    else:
        hours, first = _sliding_firsts(ee, prior, lookback_days, segment_rows)
    return _anomaly_rows(hours, first, prior, min_events)


def _firsts(ee: DataFrame, prior: bool, segment_rows: int):
    """``(hours, first)``: the events that see their hour for the first (or second)
    time with the earlier count ``_hc``, and the first of each action and source."""
    k = ["entity_type", "entity_id"]
    x = ee.select(*k, "event_id", "ts", "ent_ord", *(["action", "source"] if prior else []))
    x = balanced_segments(as_table(x, "first-events"), "ts", rows=segment_rows)
    x = as_table(running_count(x, k, ["ts", "event_id", "ent_ord"], F.col("_bal"), "_n").drop("_bal"), "first-counts")
    x = x.withColumn("_hour", F.hour("ts").cast("string")).withColumn("_ev", F.struct("ts", "event_id", "ent_ord", "_n"))
    first = (x.select(*k, "_ev", _marks(prior).alias("_m")).select(*k, "_ev", "_m.*")
              .groupBy(*k, "kind", "v").agg(F.min("_ev").alias("_ev")))
    first = as_table(first, "firsts")
    hours = first.where("kind = 'hour'").select(*k, F.col("v").alias("_hour"), "_ev")
    if prior:
        later = join_on(x.select(*k, "_hour", F.col("_ev").alias("_e")), hours, k + ["_hour"]).where("_e > _ev")
        second = later.groupBy(*k, "_hour").agg(F.min("_e").alias("_ev"))
        hours = hours.withColumn("_hc", F.lit(0)).unionByName(second.withColumn("_hc", F.lit(1)))
    else:
        hours = hours.withColumn("_hc", F.lit(1))
    return hours, first


def _anomaly_rows(hours: DataFrame, first: DataFrame, prior: bool, min_events: int) -> DataFrame:
    n = F.col("_ev._n") - (1 if prior else 0)
    gate = (n >= F.lit(min_events)) & (n > 0)
    share = F.col("_hc") / n
    common = [F.col("_ev.event_id"), F.col("_ev.ts"), F.col("entity_id"), F.col("entity_type")]
    sub = lambda i: (F.col("_ev.ent_ord") * 3 + i).alias("sub_rank")
    time_rows = hours.where(gate & (share < 0.05)).select(
        *common, F.lit("time_pattern_anomaly").alias("anomaly_type"),
        F.least(F.lit(8.0) - share * 100, F.lit(10.0)).alias("score"),
        F.lit(0.8).alias("confidence"), (F.lit(1.0) - share).alias("baseline_deviation"),
        F.array(F.format_string("Unusual activity hour: %02d:00", F.col("_hour").cast("int")),
                F.concat(F.lit("Historical frequency: "),
                         _fmt_fixed(share * 100, 1), F.lit("%"))
                ).alias("factors"),
        F.lit(0).alias("det_rank"), sub(0))
    if not prior:  # profiles already hold the event: nothing is ever new
        return time_rows
    action_rows = first.where((F.col("kind") == "action") & gate).select(
        *common, F.lit("behavioral_deviation").alias("anomaly_type"),
        action_risk(F.col("v")).alias("score"), F.lit(0.7).alias("confidence"),
        F.lit(1.0).alias("baseline_deviation"),
        F.array(F.concat(F.lit("New action: "), F.col("v")),
                F.lit("No historical precedent")).alias("factors"),
        F.lit(0).alias("det_rank"), sub(1))
    source_rows = first.where((F.col("kind") == "source") & gate).select(
        *common, F.lit("behavioral_deviation").alias("anomaly_type"),
        F.lit(NEW_SOURCE_SCORE).alias("score"), F.lit(0.6).alias("confidence"),
        F.lit(1.0).alias("baseline_deviation"),
        F.array(F.concat(F.lit("New source IP: "), F.col("v")),
                F.lit("No historical precedent")).alias("factors"),
        F.lit(0).alias("det_rank"), sub(2))
    return time_rows.unionByName(action_rows).unionByName(source_rows)


# --------------------------------------------------------- A4 / W5 combinations

def _pair_list(types: Column) -> Column:
    """Sorted type pairs for all i < j of one event's entity list."""
    k = F.size(types)
    pair = lambda a, b: (F.when(a <= b, F.array(a, b)).when(b < a, F.array(b, a))
                          .otherwise(F.array_sort(F.array(a, b))))
    return F.when(k >= 2, F.flatten(F.transform(types, lambda a, i: F.transform(
        F.slice(types, i + 2, k), lambda b: pair(a, b))))).otherwise(F.array().cast("array<array<string>>"))


def _counted(pairs: Column) -> Column:
    """The distinct pairs of one event with their number ``m``: runs of the sorted
    list, so a row carries one pair and not the list it came from."""
    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~s[i].eqNullSafe(F.get(s, i - 1)))
        return F.when(n > 0, let(starts, lambda at: F.zip_with(
            at, F.concat(F.slice(at, F.lit(2), n), F.array(n)), lambda a, b: F.struct(s[a].alias("pair"), (b - a).alias("m")))))
    return let(F.sort_array(pairs), runs)


def combination_counts(events: DataFrame, entities_col: str = "entities",
                       action_col: str = "action") -> DataFrame:
    """A4: final counts of the three combination families, from events with
    at least two entities: ``types`` (sorted type pair, once per pair i<j),
    ``action`` (entity type + action), ``entity_action`` (entity id + action).
    One row per (family, key)."""
    ev = events.where(F.size(entities_col) >= 2)
    types = F.transform(F.col(entities_col), lambda e: e["entity_type"])
    pairs = explode_rows(ev, _pair_list(types), "p").select(
        F.lit("types").alias("family"),
        F.format_string("('%s', '%s')", F.col("p")[0], F.col("p")[1]).alias("key"))
    acts = explode_rows(ev.withColumn("a", F.col(action_col)), entities_col, "e", keep=["a"])
    by_type = acts.select(F.lit("action").alias("family"),
                          F.concat_ws(":", F.col("e.entity_type"), F.col("a")).alias("key"))
    by_id = acts.select(F.lit("entity_action").alias("family"),
                        F.concat_ws(":", F.col("e.entity_id"), F.col("a")).alias("key"))
    return (pairs.unionByName(by_type).unionByName(by_id)
                 .groupBy("family", "key").agg(F.count(F.lit(1)).alias("count")))


def rare_combinations(events: DataFrame, entities_col: str = "entities",
                      rarity_threshold: float = 0.01, min_observations: int = 100,
                      segment_rows: int = EVENT_SEGMENT_ROWS, prior: DataFrame | None = None) -> DataFrame:
    """For each event with >= 2 entities, each type pair (i < j) whose
    running count / running number of multi-entity events (both including
    this event, T18) is below ``rarity_threshold``, once the running number
    of multi-entity events reaches ``min_observations``.

    ``prior`` holds the counts of all earlier events (``family``, ``key``,
    ``count`` with family ``types``, and ``total``), to go on from them."""
    order = ["ts", "event_id"]
    types = F.transform(F.col(entities_col), lambda e: e["entity_type"])
    ev = events.where(F.size(entities_col) >= 2).select("event_id", "ts", _pair_list(types).alias("_pairs"))
    ev = balanced_segments(as_table(ev, "multi-entity-events"), "ts", rows=segment_rows)
    ev = running_count(ev.withColumn("_seg0", F.col("_bal")), [], order, F.col("_bal"), "_total")
    # one row per (event, distinct pair) with its multiplicity inside the event
    allp = explode_rows(ev, _counted(F.col("_pairs")), "_p", keep=["event_id", "ts", "_total", "_seg0"])
    allp = allp.select("event_id", "ts", "_total", "_seg0", F.col("_p.pair")[0].alias("_t1"), F.col("_p.pair")[1].alias("_t2"),
                       F.col("_p.m").alias("_m"))
    # pair counts include every multi-entity event, also those before the gate
    hit = running_total(as_table(allp, "event-pairs"), ["_t1", "_t2"], [*order, "_total"], F.col("_seg0"), F.col("_m"), "_count")
    if prior is not None:
        before = prior.where("family = 'total'").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("_t0"))
        pairs = prior.where("family = 'types'").select(F.col("key").alias("_key"), F.col("count").alias("_c0"))
        key = F.format_string("('%s', '%s')", "_t1", "_t2")
        hit = (hit.withColumn("_key", key).join(pairs, "_key", "left").crossJoin(F.broadcast(before))
                  .withColumn("_count", F.col("_count") + F.coalesce("_c0", F.lit(0)))
                  .withColumn("_total", F.col("_total") + F.col("_t0")))
    freq = F.col("_count") / F.col("_total")
    hit = hit.where((F.col("_total") >= min_observations) & (freq < rarity_threshold) & (F.col("_count") > 0))
    hit = hit.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("_m"))))
    return hit.select(
        "event_id", "ts",
        F.concat_ws("+", "_t1", "_t2").alias("entity_id"),
        F.lit("combination").alias("entity_type"),
        F.lit("rare_entity_combination").alias("anomaly_type"),
        F.least(F.lit(10.0) * (F.lit(1.0) - freq / rarity_threshold), F.lit(10.0)).alias("score"),
        F.lit(0.7).alias("confidence"), (F.lit(1.0) - freq).alias("baseline_deviation"),
        F.array(F.format_string("Rare entity type combination: ('%s', '%s')", "_t1", "_t2"),
                F.concat(F.lit("Frequency: "), _fmt_fixed(freq, 4))).alias("factors"),
        F.lit(1).alias("det_rank"), F.lit(0).alias("sub_rank"))


# ------------------------------------------------------- W6 privilege escalation

def privilege_escalation(events: DataFrame, user_col: str = "user_key", action_col: str = "action",
                         patterns: dict | None = None, lookback_minutes: int = 30,
                         segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Patterns whose every action occurs among the user's events in
    ``(t - lookback, t]`` up to this event in (ts, event_id) order (T17);
    score = base (+1 when the window holds >= 3 events), capped at 10;
    refires on every event while a pattern holds."""
    patterns = ESCALATION_PATTERNS if patterns is None else patterns
    look_us = lookback_minutes * 60 * 1_000_000
    ev = (events.where(F.col(user_col).isNotNull())
                .select("event_id", "ts", F.col(user_col).alias("_u"), F.col(action_col).alias("_act"))
                .withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))))
    ev = balanced_segments(as_table(ev, "user-events"), "ts", rows=segment_rows)
    actions = sorted({a for acts, _ in patterns.values() for a in acts})
    # what a segment needs from the user's earlier ones: the latest time of each
    # pattern action (prefix maximum) and the last four events
    blocks = ev.groupBy("_u", "_bal").agg(*[F.max(F.when(F.col("_act") == a, F.col("_t"))).alias(f"_m{i}")
                                            for i, a in enumerate(actions)], F.count(F.lit(1)).alias("_bn"))
    by_user = Window.partitionBy("_u").orderBy("_bal")
    earlier = by_user.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_u", "_bal", *[F.max(f"_m{i}").over(earlier).alias(f"_c{i}") for i in range(len(actions))],
                           F.array_compact(F.array(*[F.lead("_bal", d).over(by_user) for d in range(1, 5)])).alias("_next"))
    part = Window.partitionBy("_u", "_bal")
    tail = ev.withColumn("_rd", F.row_number().over(part.orderBy(F.desc("_t"), F.desc("event_id")))).where("_rd <= 4")
    context = (join_on(tail.drop("_rd"), blocks.select("_u", "_bal", "_next").where(F.size("_next") > 0), ["_u", "_bal"])
               .withColumn("_bal", F.explode("_next")).drop("_next").withColumn("_own", F.lit(False)))
    run = part.orderBy("_t", "event_id")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_own", F.lit(True)).unionByName(context).select(
        "*",
        *[F.max(F.when(F.col("_act") == a, F.col("_t"))).over(upto).alias(f"_s{i}") for i, a in enumerate(actions)],
        F.lag("_t", 2).over(run).alias("_third"),
        F.collect_list(F.struct("_t", "_act")).over(run.rowsBetween(-4, 0)).alias("_recent")).where(F.col("_own"))
    ev = join_on(ev, blocks.drop("_next"), ["_u", "_bal"])
    cutoff = F.col("_t") - F.lit(look_us)
    last5 = F.transform(F.filter("_recent", lambda r: r["_t"] > cutoff), lambda r: r["_act"])
    present = {a: F.coalesce(F.greatest(f"_s{i}", f"_c{i}") > cutoff, F.lit(False)) for i, a in enumerate(actions)}
    # three or more events in the window: the second one before is inside it
    crowded = F.coalesce(F.col("_third") > cutoff, F.lit(False))
    ev = as_table(ev, "user-windows")
    rows = []
    for rank, (name, (acts, base)) in enumerate(patterns.items()):
        cond = None
        for a in acts:
            cond = present[a] if cond is None else (cond & present[a])
        score = F.least(F.lit(float(base)) + F.when(crowded, 1.0).otherwise(0.0), F.lit(10.0))
        rows.append(ev.where(cond).select(
            "event_id", "ts", F.col("_u").alias("entity_id"),
            F.lit("user_behavior").alias("entity_type"),
            F.lit("privilege_escalation").alias("anomaly_type"), score.alias("score"),
            F.lit(0.8).alias("confidence"), F.lit(1.0).alias("baseline_deviation"),
            F.array(F.lit(f"Privilege escalation pattern: {name}"),
                    F.concat(F.lit("Recent actions: "), _py_list(last5))).alias("factors"),
            F.lit(2).alias("det_rank"), F.lit(rank).alias("sub_rank")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ------------------------------------------------------------------- the engine

def weighted_scores(anomalies: DataFrame, threshold: float = 5.0,
                    weights: dict | None = None) -> DataFrame:
    """J3 + PF21: weight by anomaly type (literal map, default 1.0), clamp to
    10, flag ``weighted >= threshold``."""
    w = _lit_map(DETECTOR_WEIGHTS if weights is None else weights)
    weighted = F.col("raw_score") * F.coalesce(F.element_at(w, F.col("anomaly_type")), F.lit(1.0))
    return (anomalies.withColumnRenamed("score", "raw_score")
                     .withColumn("_wt", weighted)
                     .withColumn("score", F.least(F.col("_wt"), F.lit(10.0)))
                     .withColumn("threshold", F.lit(float(threshold)))
                     .withColumn("is_anomaly", F.col("_wt") >= F.lit(float(threshold)))
                     .drop("_wt"))


def aggregate_scores(events: DataFrame, scored: DataFrame, id_col: str = "event_id") -> DataFrame:
    """A8 per event: max score x (1 + 0.2 (k - 1)) when k > 1 flagged, capped
    at 10; events without scores get 0.  Also the score list in detector order."""
    per = scored.groupBy(F.col("event_id").alias(id_col)).agg(
        F.max("score").alias("_max"), F.count_if(F.col("is_anomaly")).alias("n_anomalies"),
        F.count(F.lit(1)).alias("n_scores"),
        F.transform(F.array_sort(F.collect_list(F.struct(
            "det_rank", "sub_rank", "score", "factors", "threshold", "is_anomaly", "anomaly_type"))),
            lambda s: F.struct(s["score"].alias("score"), s["factors"].alias("factors"),
                               s["threshold"].alias("threshold"), s["is_anomaly"].alias("is_anomaly"),
                               s["anomaly_type"].alias("anomaly_type"))).alias("anomaly_scores"))
    mult = F.when(F.col("n_anomalies") > 1, F.lit(1.0) + (F.col("n_anomalies") - 1) * 0.2).otherwise(1.0)
    out = events.join(per, id_col, "left")
    empty = F.array().cast("array<struct<score:double,factors:array<string>,threshold:double,"
                           "is_anomaly:boolean,anomaly_type:string>>")
    # least() skips NULLs, so "no scores" must be tested explicitly
    return (out.withColumn("aggregate_score",
                           F.when(F.col("_max").isNull(), F.lit(0.0))
                            .otherwise(F.least(F.col("_max") * mult, F.lit(10.0))))
               .withColumn("anomaly_scores", F.coalesce("anomaly_scores", empty))
               .withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0)))
               .withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))
               .drop("_max"))


def score_events(events: DataFrame, entities_col: str = "entities", action_col: str = "action",
                 source_col: str = "source", region_col: str = "region", user_col: str = "user_key",
                 mode: str = "parity", threshold: float = 5.0, min_events: int = 10,
                 rarity_threshold: float = 0.01, min_observations: int = 100,
                 patterns: dict | None = None, lookback_minutes: int = 30) -> DataFrame:
    """All detectors over an event table (event_id, ts, entities array,
    action, source, region, user key) → weighted anomaly rows."""
    base = events.select("event_id", "ts", F.col(action_col).alias("action"),
                         F.col(source_col).alias("source"), F.col(region_col).alias("region"), entities_col)
    ee = (explode_rows(base, entities_col, "_e", keep=["event_id", "ts", "action", "source", "region"],
                       with_pos="ent_ord")
                .select("event_id", "ts", "action", "source", "region", "ent_ord",
                        F.col("_e.entity_type").alias("entity_type"),
                        F.col("_e.entity_id").alias("entity_id")))
    beh = behavioral_anomalies(ee, mode=mode, min_events=min_events)
    rare = rare_combinations(events.select("event_id", "ts", entities_col), entities_col,
                             rarity_threshold, min_observations)
    esc = privilege_escalation(events.select("event_id", "ts", F.col(user_col).alias("user_key"),
                                             F.col(action_col).alias("action")),
                               "user_key", "action", patterns, lookback_minutes)
    allr = beh.select(*ANOMALY_COLS).unionByName(rare.select(*ANOMALY_COLS)).unionByName(
        esc.select(*ANOMALY_COLS))
    return weighted_scores(allr, threshold)


def scoring_summary(events: DataFrame, entities_col: str = "entities",
                    action_col: str = "action", user_col: str = "user_key") -> DataFrame:
    """Profiles, multi-entity events, distinct combination keys, users."""
    ents = explode_rows(events, entities_col, "e").select("e.entity_type", "e.entity_id")
    profiles = ents.distinct().agg(F.count(F.lit(1)).alias("total_entity_profiles"))
    multi = events.agg(F.count_if(F.size(entities_col) >= 2).alias("total_combinations_observed"),
                       F.count_distinct(F.col(user_col)).alias("active_users_tracked"))
    combos = combination_counts(events, entities_col, action_col).agg(
        F.count(F.lit(1)).alias("unique_combinations"))
    return profiles.crossJoin(multi).crossJoin(combos)


# ------------------------------------------------------- audit-event adapters

def audit_detector_input(events: DataFrame, entities_col: str = "entities") -> DataFrame:
    """Shape parsed audit events (with F6 entities) for :func:`score_events`:
    action = eventName, source = sourceIPAddress, region = awsRegion, user
    key = identity ARN else user name (PF11)."""
    return events.select(
        F.col("eventID").alias("event_id"), F.col("eventTime").alias("ts"),
        F.col("eventName").alias("action"), F.col("sourceIPAddress").alias("source"),
        F.col("awsRegion").alias("region"),
        user_key(F.col("userIdentity.arn"), F.col("userIdentity.userName")).alias("user_key"),
        F.transform(entities_col, lambda e: F.struct(e["entity_type"].alias("entity_type"),
                                                     e["entity_id"].alias("entity_id"))).alias("entities"))


def detect_against_baseline(ee: DataFrame, profiles: DataFrame, sources: DataFrame,
                            min_events: int = 10) -> DataFrame:
    """Score new (event, entity) rows against a saved baseline
    (:func:`entity_profiles` + :func:`entity_sources`) instead of replaying
    history: unusual hour from the stored hour histogram, new action from the
    stored action set, new source from the stored source table.  The
    baseline join is an equi-join on (entity_type, entity_id); the source
    check is a left join on (entity, source)."""
    base = profiles.select(F.col("entity_type").alias("_pt"), F.col("entity_id").alias("_pi"), "total_events",
                           "time_patterns", "unique_actions")
    known_src = sources.select(F.col("entity_type").alias("_st"), F.col("entity_id").alias("_si"),
                               F.col("source").alias("_ks"), F.lit(True).alias("_known"))
    x = ee.withColumn("_hour", F.hour("ts")).join(
        base, (F.col("entity_type") == F.col("_pt")) & (F.col("entity_id") == F.col("_pi")))
    x = x.join(known_src, (F.col("entity_type") == F.col("_st")) & (F.col("entity_id") == F.col("_si"))
               & (F.col("source") == F.col("_ks")), "left")
    n = F.col("total_events")
    hc = F.coalesce(F.element_at(F.col("time_patterns"), F.col("_hour")), F.lit(0)).cast("long")
    share = hc / n
    gate = n >= min_events
    common = [F.col("event_id"), F.col("ts"), F.col("entity_id"), F.col("entity_type")]
    time_rows = x.where(gate & (share < 0.05) & (hc < 2)).select(
        *common, F.lit("time_pattern_anomaly").alias("anomaly_type"),
        F.least(F.lit(8.0) - share * 100, F.lit(10.0)).alias("score"), F.lit(0.8).alias("confidence"),
        (F.lit(1.0) - share).alias("baseline_deviation"),
        F.array(F.format_string("Unusual activity hour: %02d:00", F.col("_hour")),
                F.concat(F.lit("Historical frequency: "), _fmt_fixed(share * 100, 1), F.lit("%"))).alias("factors"),
        F.lit(0).alias("det_rank"), F.lit(0).alias("sub_rank"))
    act_rows = x.where(gate & ~F.array_contains("unique_actions", F.col("action"))).select(
        *common, F.lit("behavioral_deviation").alias("anomaly_type"), action_risk(F.col("action")).alias("score"),
        F.lit(0.7).alias("confidence"), F.lit(1.0).alias("baseline_deviation"),
        F.array(F.concat(F.lit("New action: "), F.col("action")), F.lit("No historical precedent")).alias("factors"),
        F.lit(0).alias("det_rank"), F.lit(1).alias("sub_rank"))
    src_rows = x.where(gate & _truthy(F.col("source")) & F.col("_known").isNull()).select(
        *common, F.lit("behavioral_deviation").alias("anomaly_type"), F.lit(NEW_SOURCE_SCORE).alias("score"),
        F.lit(0.6).alias("confidence"), F.lit(1.0).alias("baseline_deviation"),
        F.array(F.concat(F.lit("New source IP: "), F.col("source")), F.lit("No historical precedent")).alias("factors"),
        F.lit(0).alias("det_rank"), F.lit(2).alias("sub_rank"))
    return time_rows.unionByName(act_rows).unionByName(src_rows)


def save_engine_state(ee: DataFrame, events: DataFrame, path: str) -> None:
    """SC18: persist the baseline (profiles, source sets, combination counts)
    as parquet tables under ``path`` — the state itself, not just its size."""
    entity_profiles(ee).write.mode("overwrite").parquet(f"{path}/profiles")
    entity_sources(ee).write.mode("overwrite").parquet(f"{path}/sources")
    combination_counts(events).write.mode("overwrite").parquet(f"{path}/combinations")


def _merged_counts(profiles: DataFrame, name: str) -> Column:
    """Sum of the bounded histograms (hours, regions) of one entity's profiles."""
    entries = F.flatten(F.transform(F.col(name), F.map_entries))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    total = lambda k: F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("long"),
                                  lambda a, e: a + e["value"])
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), total(k).alias("value"))))


def merge_engine_state(spark, paths: list[str], path: str) -> None:
    """SC18: the baselines of several disjoint sets of events (days, say) saved by
    :func:`save_engine_state` as one, without their events.  Counts add up, times
    take the least and greatest, action, source and region sets unite; the merge is
    associative, so merging day by day equals one rebuild."""
    k = ["entity_type", "entity_id"]
    read = lambda name: spark.read.parquet(*[f"{p}/{name}" for p in paths])
    sources = read("sources").distinct()
    sources.write.mode("overwrite").parquet(f"{path}/sources")
    n_sources = spark.read.parquet(f"{path}/sources").groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    p = read("profiles")
    merged = p.groupBy(*k).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("total_events").alias("total_events"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("unique_actions")))).alias("unique_actions"),
        F.collect_list("time_patterns").alias("time_patterns"), F.collect_list("geo_patterns").alias("geo_patterns"))
    merged = join_on(merged, n_sources, k, "left").withColumns(
        {"n_sources": F.coalesce("_n", F.lit(0).cast("long")), "time_patterns": _merged_counts(p, "time_patterns"),
         "geo_patterns": _merged_counts(p, "geo_patterns")})
    merged.select(p.columns).write.mode("overwrite").parquet(f"{path}/profiles")
    (read("combinations").groupBy("family", "key").agg(F.sum("count").alias("count"))
     .write.mode("overwrite").parquet(f"{path}/combinations"))
