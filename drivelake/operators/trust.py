"""Trust checks that need no estimator state, as columns: each gives a reason, a severity and a factor of the confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import motion, tracks

#: The states from best to worst, and what each leaves of the confidence.
STATES = ("TRUSTED", "QUESTIONABLE", "REJECTED", "UNAVAILABLE")
BASE_CONFIDENCE = (1.0, 0.5, 0.05, 0.0)


def checks(latency_s: Column) -> list[tuple[Column, str, int, float]]:
    """(holds, reason, severity, factor) of each check, over the columns source, h_acc_m, is_mock."""
    acc, network, gnss = F.col("h_acc_m"), F.col("source") == "NETWORK", F.col("source").isin("GNSS", "FUSED")
    return [
        (F.col("is_mock"), "SYNTHETIC_INPUT", 2, 0.0),
        (network & (latency_s > 30), "STALE", 1, 0.5),
        (network & acc.isNull(), "NO_ACCURACY", 2, 1.0),
        (network & (acc > 5000), "POOR_ACCURACY", 2, 1.0),
        (gnss & (latency_s > 10), "STALE", 2, 1.0),
        (gnss & (latency_s > 2) & (latency_s <= 10), "STALE", 1, 0.7),
        (gnss & acc.isNull(), "NO_ACCURACY", 1, 0.5),
        (gnss & (acc > 150), "POOR_ACCURACY", 2, 1.0),
        (gnss & (acc > 30) & (acc <= 150), "POOR_ACCURACY", 1, 0.6),
    ]


def stateless_trust(fixes: DataFrame, latency_s: Column) -> DataFrame:
    """Adds state, confidence and reasons (sorted). The worst severity is the state; a synthetic fix has no other reasons."""
    all_checks = checks(latency_s)
    mock = F.coalesce(F.col("is_mock"), F.lit(False))
    hits = [(F.coalesce(c, F.lit(False)) & (F.lit(True) if r == "SYNTHETIC_INPUT" else ~mock), r, s, f) for c, r, s, f in all_checks]
    worst = F.greatest(*(F.when(c, s).otherwise(0) for c, _, s, _ in hits))
    base = reduce(lambda e, i: e.when(worst == i, BASE_CONFIDENCE[i]), range(1, 4), F.when(worst == 0, BASE_CONFIDENCE[0]))
    confidence = reduce(lambda e, h: e * F.when(h[0], h[3]).otherwise(1.0), hits, base)
    reasons = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(c, F.lit(r)) for c, r, _, _ in hits)), lambda x: x.isNotNull())))
    state = F.element_at(F.array(*map(F.lit, STATES)), worst + 1)
    return fixes.withColumns({"state": state, "confidence": confidence, "reasons": reasons})


def network_check(lat: str, lon: str, acc: str, t: str, max_age_s: float = 120.0) -> tuple[Column, Column]:
    """Distance and reason (null: none) of a fix against the last network fix in the columns named: null without one of max_age_s."""
    age = F.abs(F.col("t_ns") - F.col(t)) / F.lit(1e9)
    d = F.when(age <= max_age_s, geo.haversine_m(F.col(lat), F.col(lon), F.col("lat"), F.col("lon")))
    allowed = 2 * (F.coalesce(acc, F.lit(1000.0)) + F.coalesce("h_acc_m", F.lit(50.0))) + age * 30
    return d, F.when(d > allowed + 20000, "GEOGRAPHICALLY_IMPOSSIBLE").when(d > allowed, "NETWORK_DISAGREEMENT")


# Checks against other records, as columns. Each wants the other record's values as of the fix (tracks.as_of).


def provider_state(fixes: DataFrame, events: DataFrame, echo_s: float = 10.0, strict: bool = False) -> DataFrame:
    """Adds replaced (the fix's provider is overridden) and echo (a fused fix may repeat our output) to fixes (drive_id, t_ns, seq, source, provider).

    events: drive_id, t_ns, seq, provider, event. At equal times events come first, unless strict. A restore counts only for a provider that was overridden; for
    echo_s after the last one, and while any provider is overridden, fused fixes are echoes.
    """
    e = events.filter(F.col("event").isin("OVERRIDDEN", "RESTORED")).select("drive_id", "t_ns", "seq", "provider", (F.col("event") == "OVERRIDDEN").alias("_on"), F.lit(0).alias("_k"))
    own = Window.partitionBy("drive_id", "provider").orderBy("t_ns", "_k", "seq")
    before = F.coalesce(F.lag("_on").over(own), F.lit(False))
    e = e.withColumn("_change", F.when(F.col("_on") & ~before, 1).when(~F.col("_on") & before, -1).otherwise(0))
    rows = fixes.select("drive_id", "t_ns", "seq", "provider", F.struct(*fixes.columns).alias("_fix"), F.lit(-1 if strict else 1).alias("_k")).unionByName(e, allowMissingColumns=True)
    rows = rows.withColumn("replaced", F.coalesce(F.last("_on", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    every = Window.partitionBy("drive_id").orderBy("t_ns", "_k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.coalesce(F.sum("_change").over(every), F.lit(0))
    restored = F.max(F.when(F.col("_change") == -1, F.col("t_ns"))).over(every)
    mixed = (open_ > 0) | F.coalesce((F.col("t_ns") - restored) / F.lit(1e9) < echo_s, F.lit(False))
    rows = rows.withColumn("_mixed", mixed).filter("_k <> 0")
    return rows.select("_fix.*", "replaced", (F.coalesce(F.col("_fix.source") == "FUSED", F.lit(False)) & F.col("_mixed") & ~F.col("replaced")).alias("echo"))


def obd_mismatch(speed: Column, obd: Column, age_s: Column) -> Column:
    """A satellite speed that the car's own, 1.5 s old at most, contradicts; false where one is unknown."""
    return F.coalesce((age_s <= 1.5) & (F.abs(speed - obd) > 1.5 + 0.08 * obd), F.lit(False))


def satellite_hits(used: Column, std_db: Column, age_s: Column) -> tuple[Column, Column]:
    """Too few satellites in use, and signals too much alike, by a status of at most 2 s."""
    fresh = age_s <= 2
    return F.coalesce(fresh & (used < 4), F.lit(False)), F.coalesce(fresh & (used >= 6) & (std_db < 1), F.lit(False))


def moving_while_still(speed: Column, still_s: Column) -> Column:
    return F.coalesce((still_s >= 3) & (speed > 3), F.lit(False))


def course_mismatch(b0: Column, b1: Column, v0: Column, v1: Column, dt_s: Column, turn_rad: Column) -> Column:
    """A change of course between two fixes at 5 m/s or more that the gyroscope (turn_rad, clockwise) doesn't confirm; false where one is unknown."""
    diff = F.abs(geo.wrap_deg(geo.wrap_deg(b1 - b0) - F.degrees(turn_rad)))
    return F.coalesce((v0 >= 5) & (v1 >= 5) & (dt_s > 0) & (dt_s <= 5) & (diff > 25 + 10 * dt_s), F.lit(False))


def innovation_hit(value: Column, distance_m: Column) -> Column:
    """The gate's reason severity: 2 beyond 50 and 5 km, 1 beyond 13.8, else 0."""
    return F.when((value > 50) & (distance_m >= 5000), 2).when(value > 13.8, 1).otherwise(0)


def agrees_with_estimate(distance_m: Column, acc: Column, obd_age_s: Column) -> Column:
    """A fix of 30 m accuracy or better within 100 m of the prediction, without a car's speed of the last 10 s."""
    return F.coalesce((distance_m <= 100) & (acc <= 30) & (obd_age_s.isNull() | (obd_age_s > 10)), F.lit(False))


def source_states(ticks: DataFrame, verdicts: DataFrame, events: DataFrame, silent_s: float = 5.0, echo_s: float = 10.0) -> DataFrame:
    """drive_id, t_ns, source, state at each tick for the sources of its drive, from what came before the tick (not at it).

    verdicts: drive_id, t_ns, seq, source, provider, state, synthetic; events as in provider_state. Our own output (synthetic fixes, those of a
    replaced provider, echoes) leaves a source's state alone. The state is that of the last other verdict; it is UNAVAILABLE without one of the
    last silent_s, while the provider of that fix is replaced, and for fused sources while they may repeat our output. A null synthetic counts as
    false; an empty table gives an empty result.
    """
    sources = verdicts.select("drive_id", "source").distinct()
    seen = provider_state(verdicts, events, echo_s).filter(~F.coalesce("synthetic", F.lit(False)) & ~F.col("replaced") & ~F.col("echo"))
    t = ticks.select("drive_id", "t_ns").join(sources, "drive_id").withColumns({"_k": F.lit(0), "seq": F.lit(None).cast("long")})
    v = seen.select("drive_id", "t_ns", "seq", "source", F.struct("t_ns", "state", "provider").alias("_v"), F.lit(1).alias("_k"))
    w = Window.partitionBy("drive_id", "source").orderBy("t_ns", "_k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = v.unionByName(t, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_k = 0")
    at = both.select("drive_id", "t_ns", "seq", "source", F.col("_last.provider").alias("provider"), F.col("_last.t_ns").alias("_t"), F.col("_last.state").alias("_state"))
    at = provider_state(at, events, echo_s, strict=True)
    fresh = F.coalesce((F.col("t_ns") - F.col("_t")) / F.lit(1e9) <= silent_s, F.lit(False)) & ~F.col("replaced") & ~F.col("echo")
    return at.select("drive_id", "t_ns", "source", F.when(fresh, F.col("_state")).otherwise("UNAVAILABLE").alias("state"))


def coarse_votes(fixes: DataFrame, reckoned: DataFrame, voters: int = 3, most_s: float = 180.0) -> DataFrame:
    """What the last trusted coarse fixes of a drive say of each one: drive_id, seq, n_votes, weight_for, weight_against, disputed.

    fixes: drive_id, t_ns, seq, lat, lon, h_acc_m, trusted; reckoned as motion.dead_reckoning gives it. A voter is a trusted fix before (not at) the
    fix's time, one of the last `voters`, at most most_s old; it agrees where the way between both fixes is as long as the chord that the car drove, give or
    take three sigmas, a twentieth of the way and ten metres. Votes weigh one over the sum of both variances, 50 m at least. Voters without
    odometry or accuracy don't vote. Fixes without votes are not disputed.
    """
    w = Window.partitionBy("drive_id").orderBy("t_ns", "seq").rowsBetween(1 - voters, 0)
    names = ("t_ns", "lat", "lon", "h_acc_m")
    kept = fixes.filter("trusted").withColumn("_voters", F.collect_list(F.struct(*names)).over(w))
    asked = tracks.as_of(fixes.select("drive_id", "t_ns", "seq", "lat", "lon", "h_acc_m"), kept, {"_voters": F.col("_voters")}, strict=True)
    pairs = asked.select("*", F.posexplode("_voters").alias("_i", "_v")).filter((F.col("t_ns") - F.col("_v.t_ns")) / F.lit(1e9) <= most_s)
    pairs = pairs.withColumn("id", F.col("seq") * voters + F.col("_i"))
    odo = motion.way_between(pairs.select("drive_id", "id", F.col("_v.t_ns").alias("t1"), F.col("t_ns").alias("t2")), reckoned)
    s = [geo.sigma_of_r68(c) for c in (F.col("_v.h_acc_m"), F.col("h_acc_m"))]
    slack = 0.05 * F.col("way_m") + 10
    near = F.abs(geo.haversine_m(F.col("_v.lat"), F.col("_v.lon"), F.col("lat"), F.col("lon")) - F.col("chord_m")) <= 3 * F.sqrt(s[0] * s[0] + s[1] * s[1]) + slack
    floor = [F.greatest(x, F.lit(50.0)) for x in s]
    weight = 1 / (floor[0] * floor[0] + floor[1] * floor[1])
    told = pairs.join(odo, ["drive_id", "id"]).withColumns({"_agrees": near, "_w": weight}).filter("_agrees IS NOT NULL")
    sums = told.groupBy("drive_id", "seq").agg(F.count("*").alias("n_votes"), F.sum(F.when(F.col("_agrees"), F.col("_w")).otherwise(0.0)).alias("weight_for"), F.sum(F.when(F.col("_agrees"), 0.0).otherwise(F.col("_w"))).alias("weight_against"))
    out = fixes.select("drive_id", "seq").join(sums, ["drive_id", "seq"], "left").fillna(0, ["n_votes", "weight_for", "weight_against"])
    return out.withColumn("disputed", F.col("weight_against") > F.col("weight_for"))


def verdict_fixes(verdicts: DataFrame, fixes: DataFrame) -> DataFrame:
    """fixes with the state of the verdict of their time and source; the last fix of equal ones takes it, the others and those without a verdict have null."""
    last = Window.partitionBy("drive_id", "t_ns", "source").orderBy(F.desc("seq"))
    one = verdicts.groupBy("drive_id", "t_ns", "source").agg(F.max_by("state", "seq").alias("state"))
    rows = fixes.withColumn("_n", F.row_number().over(last)).join(one, ["drive_id", "t_ns", "source"], "left")
    return rows.select(*fixes.columns, F.when(F.col("_n") == 1, F.col("state")).alias("state"))
