"""Queries of training dynamics over events: a user is a sample, a day an epoch."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.operators import dynamics
from sampleworks.plans.register import query, table

_KEYS = ["user_id"]


def raw(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.datediff(F.col("ts").cast("date"), F.lit("2020-01-01").cast("date")).alias("epoch"), (F.col("event_type") != "error").alias("correct"), (F.col("value") / 1000).alias("p"))


def records(spark, sf_dir):
    return dynamics.deduplicated(raw(spark, sf_dir), _KEYS, "epoch", "event_id")


def found(spark, sf_dir):
    return dynamics.sample_dynamics(records(spark, sf_dir), _KEYS, "epoch", "correct", "p")


_RAW = "SELECT user_id, event_id, date_diff('day', DATE '2020-01-01', ts::date)::int AS epoch, event_type <> 'error' AS correct, value / 1000 AS p FROM events"
_DYNAMICS = f"""raw AS ({_RAW}), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_id DESC) AS n FROM raw) WHERE n = 1),
    m AS (SELECT *, lag(correct) OVER (PARTITION BY user_id ORDER BY epoch) AND NOT correct AS forgot, epoch - lag(epoch) OVER (PARTITION BY user_id ORDER BY epoch) AS gap,
        max(CASE WHEN NOT correct THEN epoch END) OVER (PARTITION BY user_id) AS wrong FROM r),
    d AS (SELECT user_id, count(*) AS observations, min(epoch) AS first_epoch, max(epoch) AS last_epoch, max(gap) AS max_gap, avg(p) AS mean_p, stddev_pop(p) AS std_p, avg(correct::int) AS correctness,
        min(epoch) FILTER (correct) AS first_correct, coalesce(sum(forgot::int), 0)::bigint AS forgetting, min(epoch) FILTER (wrong IS NULL OR epoch > wrong) AS learned_epoch FROM m GROUP BY 1)"""


@query(
    "sample_dynamics",
    f"""WITH {_DYNAMICS}, q AS (SELECT quantile_cont(learned_epoch, 0.25) AS a, quantile_cont(learned_epoch, 0.75) AS b FROM d)
        SELECT user_id, observations, first_epoch, last_epoch, max_gap, round(mean_p, 6) AS mean_p, round(std_p, 6) AS std_p, round(correctness, 6) AS correctness, first_correct, forgetting, learned_epoch, forgetting >= 2 AS unstable,
        CASE WHEN learned_epoch IS NULL THEN 'never' WHEN learned_epoch < a THEN 'early' WHEN learned_epoch > b THEN 'late' ELSE 'middle' END AS speed FROM d, q""",
)
def sample_dynamics(spark, sf_dir):
    return dynamics.with_speed(found(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_p", "std_p", "correctness")})


_CATEGORY = """g AS (SELECT *, CASE WHEN {empty} THEN 'empty' WHEN observations < 3 OR observations * 2 < max(observations) OVER () THEN 'insufficient' END AS c FROM d),
        q AS (SELECT quantile_cont(learned_epoch, 0.25) FILTER (c IS NULL AND forgetting < 2) AS a, quantile_cont(learned_epoch, 0.75) FILTER (c IS NULL AND forgetting < 2) AS b, max(learned_epoch) FILTER (c IS NULL AND forgetting < 2) AS e FROM g)
        SELECT user_id, CASE WHEN c IS NOT NULL THEN c WHEN first_correct IS NULL THEN 'never' WHEN learned_epoch IS NULL OR forgetting >= 2 THEN 'forgotten' WHEN learned_epoch <= a THEN 'early'
        WHEN learned_epoch > b OR (b > a AND b = e AND learned_epoch = b) THEN 'late' ELSE 'steady' END AS category FROM g, q"""


@query("image_learning", f"WITH {_DYNAMICS}, " + _CATEGORY.format(empty="false"))
def image_learning(spark, sf_dir):
    return dynamics.image_learning(found(spark, sf_dir)).select("user_id", "category")


@query(
    "epoch_summary",
    f"""WITH {_DYNAMICS}, s AS (SELECT epoch, count(*) AS evaluated, count(*) FILTER (p >= 0.05 AND correct) AS confident_correct, count(*) FILTER (NOT p >= 0.05) AS uncertain, count(*) FILTER (p >= 0.05 AND NOT correct) AS confident_wrong FROM raw GROUP BY 1)
        SELECT s.*, coalesce(n, 0) AS newly_learned FROM s LEFT JOIN (SELECT learned_epoch, count(*) AS n FROM d GROUP BY 1) l ON s.epoch = l.learned_epoch""",
)
def epoch_summary(spark, sf_dir):
    return dynamics.epoch_summary(raw(spark, sf_dir), found(spark, sf_dir), "epoch", "correct", "p", 0.05)


@query("competent_from", f"WITH r AS (SELECT epoch, avg(correct::int) AS recall FROM ({_RAW}) GROUP BY 1) SELECT min(epoch) AS epoch FROM r WHERE recall >= 0.9 * (SELECT max(recall) FROM r)")
def competent_from(spark, sf_dir):
    return dynamics.competent_from(raw(spark, sf_dir), "epoch", "correct")


@query(
    "trajectory_edges",
    f"""WITH r AS ({_RAW}), p AS (SELECT user_id, epoch, count(*) OVER (PARTITION BY user_id, epoch) AS n, lead(epoch) OVER w AS "to" FROM r WINDOW w AS (PARTITION BY user_id ORDER BY epoch)),
        k AS (SELECT *, lead(n) OVER (PARTITION BY user_id ORDER BY epoch) AS m FROM p) SELECT user_id, epoch AS "from", "to" FROM k WHERE n = 1 AND m = 1""",
)
def trajectory_edges(spark, sf_dir):
    return dynamics.trajectory_edges(raw(spark, sf_dir).select("user_id", "epoch"), "user_id", "epoch")


def _coarse(spark, sf_dir):
    """Few rounds, so that many samples are learned in the last one; a ninth of the samples has nothing in it."""
    e = raw(spark, sf_dir)
    return e.select("user_id", "event_id", F.floor(F.col("epoch") / 8).cast("int").alias("epoch"), F.when(F.col("event_id") % 31 == 0, None).otherwise(F.col("p")).alias("p"), (F.col("user_id") % 9 == 0).alias("nothing"))


_COARSE = f"(SELECT user_id, event_id, floor(epoch / 8)::int AS epoch, CASE WHEN event_id % 31 = 0 THEN NULL ELSE p END AS p, user_id % 9 = 0 AS nothing FROM ({_RAW}))"


@query(
    "image_learning_scored",
    f"""WITH r AS (SELECT *, p >= 0.02 AS correct FROM (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_id DESC) AS n FROM {_COARSE} WHERE p IS NOT NULL) WHERE n = 1),
        k AS (SELECT *, lag(correct) OVER (PARTITION BY user_id ORDER BY epoch) AND NOT correct AS forgot, max(CASE WHEN NOT correct THEN epoch END) OVER (PARTITION BY user_id) AS wrong FROM r),
        d AS (SELECT user_id, count(*) AS observations, min(epoch) FILTER (correct) AS first_correct, coalesce(sum(forgot::int), 0) AS forgetting, min(epoch) FILTER (wrong IS NULL OR epoch > wrong) AS learned_epoch, bool_and(nothing) AS nothing FROM k GROUP BY 1), """
    + _CATEGORY.format(empty="nothing"),
)
def image_learning_scored(spark, sf_dir):
    scored = dynamics.image_scores(_coarse(spark, sf_dir), _KEYS, "epoch", "p", 0.02)
    once = dynamics.deduplicated(scored, _KEYS, "epoch", "event_id")
    empty = once.groupBy(*_KEYS).agg(F.bool_and("nothing").alias("empty"))
    return dynamics.image_learning(dynamics.sample_dynamics(once, _KEYS, "epoch", "correct", "p").join(empty, _KEYS)).select("user_id", "category")


@query(
    "uncertain_predictions",
    f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN p * 4 < 0.25 WHEN p IS NOT NULL THEN p < 0.6 END AS uncertain FROM {_COARSE}",
)
def uncertain_predictions(spark, sf_dir):
    e, none = _coarse(spark, sf_dir), F.lit(None).cast("double")
    margin = F.when((F.col("event_id") % 3 > 0) & (F.col("event_id") % 2 == 0), F.coalesce(F.col("p") * 4, F.lit(float("nan")))).otherwise(none)
    confidence = F.when((F.col("event_id") % 3 > 0) & (F.col("event_id") % 2 == 1), F.col("p"))
    return e.select("event_id", dynamics.uncertainty(margin, confidence).alias("uncertain"))


@query("holds_from", f"WITH r AS ({_RAW}), k AS (SELECT *, max(CASE WHEN NOT p >= 0.03 THEN epoch END) OVER (PARTITION BY user_id) AS bad FROM r) SELECT user_id, min(epoch) FILTER (bad IS NULL OR epoch > bad) AS from_epoch FROM k GROUP BY 1")
def holds_from(spark, sf_dir):
    return dynamics.holds_from(raw(spark, sf_dir), _KEYS, "epoch", F.col("p") >= 0.03)


_BOXED = f"(SELECT *, event_id % 5 = 0 AND epoch < 25 AS boxed FROM ({_RAW}))"


@query(
    "evaluation_round",
    f"SELECT user_id, event_id, boxed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY boxed DESC, event_id DESC) AS n FROM {_BOXED} WHERE epoch = (SELECT coalesce(max(epoch) FILTER (boxed), max(epoch)) FROM {_BOXED})) WHERE n = 1",
)
def evaluation_round(spark, sf_dir):
    boxed = raw(spark, sf_dir).withColumn("boxed", (F.col("event_id") % 5 == 0) & (F.col("epoch") < 25))
    return dynamics.evaluation_round(boxed, _KEYS, "epoch", "boxed", "event_id").select("user_id", "event_id", "boxed")


@query("round_history", f"SELECT epoch, event_id, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY event_id DESC) AS n FROM ({_RAW}) WHERE user_id = 7) WHERE n = 1")
def round_history(spark, sf_dir):
    return dynamics.round_history(raw(spark, sf_dir), F.col("user_id") == 7, "epoch", "event_id").select("epoch", "event_id", F.round("p", 6).alias("p"))
