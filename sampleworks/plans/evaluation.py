"""Queries of evaluation and comparison over boxes made from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.operators import comparison, evaluation
from sampleworks.plans.detection import _ROWS, images
from sampleworks.plans.register import ORACLE_SQL, query, table


def match_sql(rows: str = _ROWS, *, class_aware: bool = True, confidence: float | None = None, threshold: float = 0.5, name: str = "", crowd: str = "false") -> str:
    """CTEs ``t`` (truth), ``q`` (predictions in order k) and ``m`` (image, k, the truth box that prediction k takes, or 0)."""
    n = name
    shown = "" if confidence is None else f" WHERE score >= {confidence}"
    return f"""t{n} AS (SELECT image, i, label, x0, y0, x1, y1, {crowd} AS crowd FROM {rows}),
        q{n} AS (SELECT image, i, plabel AS label, score, x0 + s AS x0, y0 + s AS y0, x1 + s AS x1, y1 + s AS y1, row_number() OVER (PARTITION BY image ORDER BY score DESC, i) AS k FROM {rows}{shown}),
        o{n} AS (SELECT *, (w * h) / (ta + pa - w * h) AS u FROM (SELECT q{n}.image, q{n}.k, t{n}.i, t{n}.crowd, t{n}.label AS tl, q{n}.label AS pl, greatest(least(t{n}.x1, q{n}.x1) - greatest(t{n}.x0, q{n}.x0), 0) AS w, greatest(least(t{n}.y1, q{n}.y1) - greatest(t{n}.y0, q{n}.y0), 0) AS h,
            (t{n}.x1 - t{n}.x0) * (t{n}.y1 - t{n}.y0) AS ta, (q{n}.x1 - q{n}.x0) * (q{n}.y1 - q{n}.y0) AS pa FROM q{n} JOIN t{n} ON q{n}.image = t{n}.image)),
        c{n} AS (SELECT image, k, list(i ORDER BY u DESC, i) AS options FROM o{n} WHERE u >= {threshold} AND NOT crowd {'AND tl = pl' if class_aware else ''} GROUP BY 1, 2),
        m{n} AS (SELECT DISTINCT image, 0::bigint AS k, []::bigint[] AS taken, 0::bigint AS pick FROM q{n} UNION ALL
            SELECT image, k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, coalesce(p, 0) FROM (SELECT m{n}.image, m{n}.k + 1 AS k, m{n}.taken, list_filter(coalesce(c{n}.options, []), lambda x: NOT list_contains(m{n}.taken, x))[1] AS p
            FROM m{n} JOIN q{n} ON q{n}.image = m{n}.image AND q{n}.k = m{n}.k + 1 LEFT JOIN c{n} ON c{n}.image = m{n}.image AND c{n}.k = m{n}.k + 1))"""


def outcome_sql(rows: str = _ROWS, confidence: float = 0.25, name: str = "") -> str:
    n = name
    return f"""{match_sql(rows, confidence=confidence, name=n)}, r{n} AS (
        SELECT q{n}.image, CASE WHEN pick > 0 THEN 'tp' ELSE 'fp' END AS kind, q{n}.label, q{n}.score, q{n}.x0, q{n}.y0, CASE WHEN pick > 0 THEN (lb.x1 - lb.x0) * (lb.y1 - lb.y0) END AS area, o{n}.u AS overlap FROM m{n} JOIN q{n} ON m{n}.image = q{n}.image AND m{n}.k = q{n}.k LEFT JOIN t{n} lb ON lb.image = m{n}.image AND lb.i = m{n}.pick LEFT JOIN o{n} ON o{n}.image = m{n}.image AND o{n}.k = m{n}.k AND o{n}.i = m{n}.pick
        UNION ALL SELECT image, 'fn', label, NULL, x0, y0, (x1 - x0) * (y1 - y0), NULL FROM t{n} WHERE NOT EXISTS (SELECT 1 FROM m{n} WHERE m{n}.image = t{n}.image AND m{n}.pick = t{n}.i))"""


ORACLE_SQL["greedy_match"] = f"WITH RECURSIVE {match_sql()} SELECT m.image, (q.i - 1)::int AS place, (m.pick - 1)::int AS truth FROM m JOIN q ON m.image = q.image AND m.k = q.k"
ORACLE_SQL["confusion"] = f"""WITH RECURSIVE {match_sql(class_aware=False)}, r AS (SELECT t.label AS truth_label, q.label AS predicted_label FROM m JOIN q ON m.image = q.image AND m.k = q.k LEFT JOIN t ON t.image = m.image AND t.i = m.pick
    UNION ALL SELECT label, NULL FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image = t.image AND m.pick = t.i)) SELECT truth_label, predicted_label, count(*) AS n FROM r GROUP BY 1, 2"""
ORACLE_SQL["nms"] = f"""WITH RECURSIVE {match_sql()}, p AS (SELECT a.image, a.k, list(b.k) AS hiding FROM q a JOIN q b ON a.image = b.image AND b.k < a.k AND a.label = b.label
        WHERE greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) > 0.5 GROUP BY 1, 2),
    n AS (SELECT DISTINCT image, 0::bigint AS k, []::bigint[] AS kept FROM q UNION ALL SELECT n.image, n.k + 1, CASE WHEN list_has_any(coalesce(p.hiding, []), n.kept) THEN n.kept ELSE list_append(n.kept, n.k + 1) END FROM n JOIN q ON q.image = n.image AND q.k = n.k + 1 LEFT JOIN p ON p.image = n.image AND p.k = n.k + 1),
    l AS (SELECT image, arg_max(kept, k) AS kept FROM n GROUP BY 1), u AS (SELECT image, unnest(kept) AS k, generate_subscripts(kept, 1) - 1 AS rank FROM l)
    SELECT u.image, u.rank::int AS rank, (q.i - 1)::int AS place FROM u JOIN q ON q.image = u.image AND q.k = u.k"""




@query(
    "image_counts",
    f"""WITH RECURSIVE {match_sql(crowd='label = 4')}, h AS (SELECT DISTINCT image, k FROM o WHERE crowd AND w * h / pa >= 0.5),
        s AS (SELECT m.image, count(*) FILTER (pick > 0) AS tp, count(*) FILTER (pick = 0 AND h.k IS NULL) AS fp FROM m LEFT JOIN h ON h.image = m.image AND h.k = m.k WHERE m.k > 0 GROUP BY 1),
        g AS (SELECT t.image, count(*) FILTER (NOT crowd) AS n, list(CASE WHEN crowd THEN -2 ELSE coalesce(m.k, 0) - 1 END ORDER BY t.i)::int[]::varchar AS gt_match FROM t LEFT JOIN m ON m.image = t.image AND m.pick = t.i AND m.k > 0 GROUP BY 1),
        f AS (SELECT s.image, tp, fp, n - tp AS fn, gt_match, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::double / (tp + fp) END AS p, CASE WHEN n = 0 THEN 1.0 ELSE tp::double / n END AS r FROM s JOIN g ON g.image = s.image)
        SELECT image, tp::int AS tp, fp::int AS fp, fn::int AS fn, gt_match, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM f""",
)
def image_counts(spark, sf_dir):
    found = evaluation.image_counts(images(spark, sf_dir), crowd=lambda t: t["label"] == 4)
    return found.select("image", "tp", "fp", "fn", F.col("gt_match").cast("string").alias("gt_match"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("outcomes", f"WITH RECURSIVE {outcome_sql()} SELECT image, kind, label, score, x0, y0, round(overlap, 6) AS overlap FROM r")
def outcomes(spark, sf_dir):
    return evaluation.outcomes(images(spark, sf_dir), ["image"]).select("image", "kind", "label", "score", "box.x0", "box.y0", F.round("overlap", 6).alias("overlap"))


@query("outcome_counts", f"WITH RECURSIVE {outcome_sql()} SELECT label, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM r WHERE label IN (1, 3) GROUP BY 1")
def outcome_counts(spark, sf_dir):
    return evaluation.outcome_counts(evaluation.outcomes(images(spark, sf_dir), ["image"], labels=[1, 3]), "label")


_CLASSES = f"{outcome_sql(confidence=0.05)}, v AS (SELECT label, count(*) AS support FROM t GROUP BY 1), s AS (SELECT label, score, kind = 'tp' AS hit FROM r WHERE kind <> 'fn')"


@query("class_matches", f"WITH RECURSIVE {_CLASSES} SELECT label, score, hit, count(*) AS n FROM s GROUP BY 1, 2, 3")
def class_matches(spark, sf_dir):
    return evaluation.class_matches(images(spark, sf_dir))[0].groupBy("label", "score", "hit").agg(F.count("*").alias("n"))


_TABLE = f"""{_CLASSES}, k AS (SELECT label, hit, row_number() OVER w AS k, sum(hit::int) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, hit DESC)),
    e AS (SELECT k.label, k, tp::double / support AS recall, max(tp::double / k) OVER (PARTITION BY k.label ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM k JOIN v ON v.label = k.label),
    b AS (SELECT *, coalesce(lag(recall) OVER (PARTITION BY label ORDER BY k), -1) AS before FROM e),
    ap AS (SELECT label, sum(envelope * len(list_filter([{', '.join(repr(g / 100) for g in range(101))}], lambda g: g <= recall AND g > before))) / 101 AS ap FROM b GROUP BY 1),
    n AS (SELECT label, count(*) AS predictions, count(*) FILTER (hit) AS tp FROM s WHERE score >= 0.75 GROUP BY 1),
    d AS (SELECT v.label, support, predictions, tp, predictions - tp AS fp, support - tp AS fn, tp::double / predictions AS precision, tp::double / support AS recall, 2.0 * tp / (predictions + support) AS f1, ap FROM v JOIN n ON n.label = v.label JOIN ap ON ap.label = v.label)"""


def _table(spark, sf_dir):
    scored, support = evaluation.class_matches(images(spark, sf_dir))
    return evaluation.class_table(scored, support, 0.75, [F.desc("hit")])


@query("class_table", f"WITH RECURSIVE {_TABLE} SELECT label, support, predictions, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ap, 6) AS ap FROM d")
def class_table(spark, sf_dir):
    return _table(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "ap")})


@query("detector_scores", f"WITH RECURSIVE {_TABLE}, z AS (SELECT avg(ap) AS map50, sum(tp) / sum(tp + fp) AS p, sum(tp) / sum(tp + fn) AS r FROM d) SELECT round(map50, 6) AS map50, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM z")
def detector_scores(spark, sf_dir):
    return evaluation.detector_scores(_table(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("map50", "precision", "recall", "f1")])


@query(
    "classification_scores",
    """WITH e AS (SELECT (user_id % 6)::int AS t, CASE WHEN event_id % 4 = 0 THEN (event_id % 7)::int ELSE (user_id % 6)::int END AS p, CASE WHEN event_id % 11 > 0 THEN value END AS l FROM events),
        c AS (SELECT l.label, count(*) FILTER (t = p AND t = l.label) AS tp, count(*) FILTER (t = l.label) AS a, count(*) FILTER (p = l.label) AS b FROM e, (SELECT t AS label FROM e UNION SELECT p FROM e) l GROUP BY 1)
        SELECT count(*) AS images, round(avg((t = p)::int), 6) AS accuracy, round(avg(l), 6) AS loss, round((SELECT avg(2.0 * tp / (a + b)) FROM c), 6) AS macro_f1 FROM e""",
)
def classification_scores(spark, sf_dir):
    t = (F.col("user_id") % 6).cast("int")
    e = table(spark, sf_dir, "events").select(t.alias("t"), F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 7).cast("int")).otherwise(t).alias("p"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("l"))
    return evaluation.classification_scores(e, "t", "p", "l").select("images", *[F.round(c, 6).alias(c) for c in ("accuracy", "loss", "macro_f1")])


@query(
    "semantic_scores",
    """WITH z AS (SELECT (l_partkey % 4)::int AS t, CASE WHEN l_suppkey % 3 = 0 THEN (l_suppkey % 4)::int ELSE (l_partkey % 4)::int END AS p FROM lineitem WHERE l_partkey % 4 <> 3),
        c AS (SELECT k AS class, count(*) FILTER (t = k AND p = k) AS i, count(*) FILTER (t = k OR p = k) AS u, count(*) FILTER (t = k) AS n FROM z, (SELECT unnest([0, 1, 2, 5]) AS k) GROUP BY 1)
        SELECT round(sum(i) / sum(n), 6) AS accuracy, round(avg(i::double / u) FILTER (u > 0), 6) AS mean_iou, count(*) FILTER (u > 0) AS classes FROM c""",
)
def semantic_scores(spark, sf_dir):
    t = (F.col("l_partkey") % 4).cast("int")
    pixel = F.struct(t.alias("t"), F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 4).cast("int")).otherwise(t).alias("p"))
    rasters = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(pixel).alias("z")).select("l_orderkey", "z.t", "z.p")
    counts = evaluation.pixel_counts(rasters, ["l_orderkey"], "t", "p", [0, 1, 2, 5], ignore=3)
    return evaluation.semantic_scores(counts).select(F.round("accuracy", 6).alias("accuracy"), F.round("mean_iou", 6).alias("mean_iou"), "classes")


@query(
    "ranking_scores",
    """WITH r AS (SELECT event_type = 'error' AS hit, row_number() OVER (ORDER BY value DESC, event_id) AS pos FROM events), h AS (SELECT pos, row_number() OVER (ORDER BY pos) AS n FROM r WHERE hit), w AS (SELECT count(*) AS hits FROM h)
        SELECT k, round(count(*) FILTER (pos <= k)::double / k, 6) AS precision, round(count(*) FILTER (pos <= k)::double / any_value(hits), 6) AS recall, round(sum(n::double / pos) / any_value(hits), 6) AS average_precision, min(pos) FILTER (n >= round(hits * 0.9)) AS effort FROM h, w, (SELECT unnest([10, 100, 500]) AS k) GROUP BY k""",
)
def ranking_scores(spark, sf_dir):
    from sampleworks.operators.facets import positioned

    ranked = positioned(table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "error").alias("hit")).orderBy(F.desc("value"), "event_id"))
    found = evaluation.ranking_scores(ranked.withColumn("at", F.col("position") + 1), "at", "hit", [10, 100, 500], 0.9)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "average_precision")})


@query("metrics_aggregated", "SELECT round(avg(value), 6) AS value, round(max(value), 6) AS value_max, round(avg((event_type = 'error')::int), 6) AS wrong, max((event_type = 'error')::int)::double AS wrong_max FROM events")
def metrics_aggregated(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("example_id"), "value", (F.col("event_type") == "error").alias("wrong"), "event_type", F.array("value").alias("embedding"))
    return evaluation.aggregated(m, ["mean", "max"]).select(*[F.round(c, 6).alias(c) for c in ("value", "value_max", "wrong", "wrong_max")])


@query(
    "landmark_summary",
    """WITH i AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount * 10 END AS o0, l_tax * 10 AS c0, CASE WHEN l_suppkey % 7 = 0 THEN 'NaN'::double ELSE l_tax END AS o1, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_discount END AS c1 FROM lineitem WHERE l_returnflag <> 'R'),
        p AS (SELECT 0 AS "index", o0 AS o, c0 AS c FROM i UNION ALL SELECT 1, CASE WHEN isnan(o1) THEN NULL ELSE o1 END, c1 FROM i)
        SELECT "index", count(o) AS scored, count(*) - count(o) AS unavailable, count(c) AS confidence_count, round(avg(o), 6) AS mean_oks, round(avg(c), 6) AS mean_confidence FROM p GROUP BY 1""",
)
def landmark_summary(spark, sf_dir):
    i = F.struct(
        F.when(F.col("l_partkey") % 5 > 0, F.col("l_discount") * 10).alias("keypoint_0_oks"), (F.col("l_tax") * 10).alias("keypoint_0_confidence"),
        F.when(F.col("l_suppkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("keypoint_1_oks"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_discount")).alias("keypoint_1_confidence"), "l_returnflag",
    )
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(i).alias("instances"))
    return evaluation.landmark_summary(rows, "instances", 2, lambda x: x["l_returnflag"] != "R").withColumns({c: F.round(c, 6) for c in ("mean_oks", "mean_confidence")})


_OLD = f"(SELECT * FROM {_ROWS} WHERE image % 7 > 0)"
_NEW = f"(SELECT * REPLACE (CASE WHEN i % 2 = 0 THEN plabel ELSE label END AS plabel, (s / 2) AS s) FROM {_ROWS} WHERE image % 5 > 0)"


def _runs(spark, sf_dir):
    """A run, and one that gets every other class right and boxes nearer; each lacks some images."""
    old = images(spark, sf_dir)
    shift = lambda p, t: F.struct(*[((p[c] + t[c]) / 2).alias(c) for c in ("x0", "y0", "x1", "y1")], p["label"].alias("label"), p["score"].alias("score"))
    nearer = F.transform(F.arrays_zip("truth", "predicted"), lambda z, i: F.when((i + 1) % 2 == 0, shift(z["predicted"], z["truth"])).otherwise(shift(z["predicted"], z["truth"]).withField("label", z["truth"]["label"])))
    return old.filter("image % 7 > 0"), old.filter("image % 5 > 0").withColumn("predicted", nearer)


_BOTH = "WHERE image % 7 > 0 AND image % 5 > 0"
_SIDES = f"""{outcome_sql(_OLD, name='0')}, {outcome_sql(_NEW, name='1')}, z AS (SELECT 'before' AS side, * FROM r0 {_BOTH} UNION ALL SELECT 'after', * FROM r1 {_BOTH})"""


@query(
    "class_slices_paired",
    f"""WITH RECURSIVE {_SIDES}, c AS (SELECT label, {', '.join(f"count(*) FILTER (side = '{s}' AND kind = '{k}') AS {k}_{s}" for s in ('before', 'after') for k in ('tp', 'fp', 'fn'))} FROM z GROUP BY 1),
        f AS (SELECT *, 2.0 * tp_before / (2 * tp_before + fp_before + fn_before) AS f1_before, 2.0 * tp_after / (2 * tp_after + fp_after + fn_after) AS f1_after, greatest(tp_before + fn_before, tp_after + fn_after) AS support FROM c)
        SELECT * REPLACE (round(f1_before, 6) AS f1_before, round(f1_after, 6) AS f1_after), support >= 30 AS conclusive, round(f1_after - f1_before, 4) AS delta FROM f""",
)
def class_slices_paired(spark, sf_dir):
    return comparison.class_slices(*_runs(spark, sf_dir), "image").withColumns({c: F.round(c, 6) for c in ("f1_before", "f1_after")})


@query(
    "size_slices_paired",
    f"""WITH RECURSIVE {_SIDES}, c AS (SELECT CASE WHEN area < 1024 THEN 'small' WHEN area < 9216 THEN 'medium' ELSE 'large' END AS band, {', '.join(f"count(*) FILTER (side = '{s}' AND kind = '{k}') AS {k}_{s}" for s in ('before', 'after') for k in ('tp', 'fn'))} FROM z WHERE kind <> 'fp' GROUP BY 1),
        f AS (SELECT *, tp_before::double / (tp_before + fn_before) AS recall_before, tp_after::double / (tp_after + fn_after) AS recall_after, greatest(tp_before + fn_before, tp_after + fn_after) AS support FROM c)
        SELECT * REPLACE (round(recall_before, 6) AS recall_before, round(recall_after, 6) AS recall_after), support >= 30 AS conclusive, round(recall_after - recall_before, 4) AS delta FROM f""",
)
def size_slices_paired(spark, sf_dir):
    return comparison.size_slices(*_runs(spark, sf_dir), "image").withColumns({c: F.round(c, 6) for c in ("recall_before", "recall_after")})


_F1 = "(SELECT image, CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM (SELECT l_orderkey AS image, count(*) FILTER (l_returnflag = 'N' AND l_suppkey % 2 = {0}) AS tp, count(*) FILTER (l_returnflag = 'A') AS fp, count(*) FILTER (l_returnflag = 'R') AS fn FROM lineitem WHERE l_orderkey % {1} > 0 GROUP BY 1))"


@query(
    "largest_moves",
    f"SELECT image, round(delta, 6) AS delta, (row_number() OVER (ORDER BY abs(delta) DESC NULLS LAST, image) - 1)::bigint AS position FROM (SELECT coalesce(a.image, b.image) AS image, b.f1 - a.f1 AS delta FROM {_F1.format(0, 11)} a FULL JOIN {_F1.format(1, 13)} b ON a.image = b.image)",
)
def largest_moves(spark, sf_dir):
    from sampleworks.operators import facets, joining

    def run(odd, missing):
        kinds = {"tp": (F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 2 == odd), "fp": F.col("l_returnflag") == "A", "fn": F.col("l_returnflag") == "R"}
        return table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % missing > 0).groupBy(F.col("l_orderkey").alias("image")).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])

    compared = joining.compare_samples(run(0, 11), run(1, 13), "image")
    return facets.positioned(comparison.largest_moves(compared, "image")).select("image", F.round("delta", 6).alias("delta"), "position")


_SCORES = "(SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size / 100.0 END AS a, CASE WHEN p_partkey % 14 = 0 THEN 'NaN'::double ELSE (p_size + p_partkey % 9 - 4) / 100.0 END AS b FROM part)"


@query(
    "headline",
    f"SELECT p_partkey, CASE WHEN ok THEN round(a, 4) END AS before, CASE WHEN ok THEN round(b, 4) END AS after, CASE WHEN ok THEN round(b - a, 4) END AS delta, CASE WHEN NOT ok THEN 'not recorded' WHEN abs(b - a) < 0.02 THEN 'too close to call' WHEN b > a THEN 'higher' ELSE 'lower' END AS verdict FROM (SELECT *, a IS NOT NULL AND NOT isnan(b) AS ok FROM (SELECT p_partkey, a::double AS a, b FROM {_SCORES}))",
)
def headline(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = F.when(F.col("p_partkey") % 9 > 0, F.col("p_size") / 100.0)
    b = F.when(F.col("p_partkey") % 14 == 0, F.lit(float("nan"))).otherwise((F.col("p_size") + F.col("p_partkey") % 9 - 4) / 100.0)
    return p.select("p_partkey", comparison.headline(a, b).alias("h")).select("p_partkey", "h.*")


def _sides(spark, sf_dir):
    """Suppliers as pairs of runs that agree or differ in this and that."""
    k = F.col("s_suppkey")
    word = lambda c: c.cast("string")
    recipe = lambda n: F.create_map(F.lit("framework"), F.lit("f"), F.lit("epochs"), word(n))
    classes = lambda n: F.create_map(F.lit("0"), F.lit("cat"), F.lit("1"), n)
    none = F.create_map().cast("map<string,string>")

    def side(set_, tab, evaluator, cls, rec, seed):
        return F.struct(set_.alias("set"), tab.alias("table"), evaluator.alias("evaluator"), cls.alias("classes"), rec.alias("recipe"), seed.cast("int").alias("seed"))

    rules = lambda n: F.create_map(F.lit("iou"), n)
    before = side(F.when(k % 11 > 0, F.lit("a/valid")), word(F.lit(1)), F.when(k % 6 == 0, none).otherwise(rules(F.lit("0.5"))), classes(F.lit("dog")), recipe(F.lit(3)), F.lit(7))
    after = side(F.when(k % 5 == 0, "a/test").otherwise("a/valid"), word(k % 2), rules(F.when(k % 7 == 0, "0.75").otherwise("0.5")), F.when(k % 3 == 0, none).when(k % 4 == 0, F.create_map(F.lit("0"), F.lit("cow"))).otherwise(classes(F.when(k % 2 == 0, "dog").otherwise("hen"))), recipe(3 + F.when(k % 8 == 0, 1).otherwise(0)), F.when(k % 9 > 0, k % 9))
    return table(spark, sf_dir, "supplier").select(k.alias("pair"), before.alias("before"), after.alias("after"))


_CHECKS = """c AS (SELECT s_suppkey AS pair, s_suppkey AS k, s_suppkey % 11 > 0 AND s_suppkey % 5 > 0 AS ok FROM supplier), h AS (SELECT pair, 'evaluation_set' AS "check", CASE WHEN ok THEN 'ok' ELSE 'blocked' END AS status FROM c
        UNION ALL SELECT pair, 'evaluation_version', CASE WHEN k % 2 = 1 THEN 'ok' ELSE 'warn' END FROM c WHERE ok
        UNION ALL SELECT pair, 'evaluator', CASE WHEN k % 6 = 0 THEN 'warn' WHEN k % 7 = 0 THEN 'blocked' ELSE 'ok' END FROM c WHERE ok
        UNION ALL SELECT pair, 'classes', CASE WHEN k % 3 = 0 THEN 'ok' WHEN k % 4 = 0 THEN 'blocked' WHEN k % 2 = 0 THEN 'ok' ELSE 'warn' END FROM c WHERE ok
        UNION ALL SELECT pair, 'training_recipe', CASE WHEN k % 8 = 0 THEN 'warn' ELSE 'ok' END FROM c WHERE ok
        UNION ALL SELECT pair, 'seeds', CASE WHEN k % 9 IN (0, 7) THEN 'warn' ELSE 'ok' END FROM c WHERE ok)"""


@query("compatibility", f"WITH {_CHECKS} SELECT * FROM h")
def compatibility(spark, sf_dir):
    return comparison.compatibility(_sides(spark, sf_dir))


@query(
    "interpretation",
    f"""WITH {_CHECKS}, g AS (SELECT pair, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'warn') AS warnings, max(status) FILTER ("check" = 'evaluation_version') AS v, max(status) FILTER ("check" = 'training_recipe') AS r, pair % 4 = 1 AS d FROM h GROUP BY 1)
        SELECT pair, warnings, CASE WHEN blocked > 0 THEN 'blocked' WHEN d OR v = 'warn' THEN 'observational' ELSE 'controlled' END AS kind, CASE WHEN blocked > 0 THEN NULL WHEN d AND r = 'warn' THEN 'data and settings' WHEN d THEN 'data' WHEN r = 'warn' THEN 'settings' ELSE 'repeat' END AS cause FROM g""",
)
def interpretation(spark, sf_dir):
    changed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair"), (F.col("s_suppkey") % 4 == 1).alias("data_changed"))
    return comparison.interpretation(comparison.compatibility(_sides(spark, sf_dir)), changed)


@query("run_cost", "SELECT user_id, count(*) AS rounds, CASE WHEN count(t) >= 2 THEN round((epoch_us(max(t)) - epoch_us(min(t))) / 1e6, 1) END AS seconds FROM (SELECT user_id, CASE WHEN event_id % 4 > 0 THEN ts END AS t FROM events) GROUP BY 1")
def run_cost(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("t"))
    return comparison.run_cost(e, "user_id", "t")


@query("task_comparison", "SELECT example_id, round(a, 6) AS before, round(b, 6) AS after, round(b - a, 6) AS delta, CASE WHEN b - a > 1e-12 THEN 'improved' WHEN b - a < -1e-12 THEN 'regressed' ELSE 'unchanged' END AS outcome FROM (SELECT p_partkey AS example_id, p_size / 50.0 AS a, (p_size + p_partkey % 3 - 1) / 50.0 AS b FROM part)")
def task_comparison(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda c: p.select(F.col("p_partkey").alias("example_id"), (c / 50.0).alias("score"))
    found = comparison.task_comparison(side(F.col("p_size")), side(F.col("p_size") + F.col("p_partkey") % 3 - 1), "score")
    return found.withColumns({c: F.round(c, 6) for c in ("before", "after", "delta")})


ORACLE_SQL["round_findings"] = f"""WITH RECURSIVE {match_sql(class_aware=True)}, {match_sql(class_aware=False, confidence=0.5, name='9')},
    b AS (SELECT m.image, q.label AS predicted, q.score, m.k FROM m JOIN q ON q.image = m.image AND q.k = m.k WHERE pick = 0 AND score >= 0.5),
    n AS (SELECT o.*, row_number() OVER (PARTITION BY image, k ORDER BY u DESC, i) AS rn FROM o),
    f AS (SELECT b.*, n.u, n.i, n.tl, CASE WHEN n.u < 0.1 THEN 'missing_label' WHEN n.u >= 0.5 AND n.tl <> b.predicted THEN 'wrong_class' WHEN n.u < 0.5 AND n.tl = b.predicted THEN 'loose_box' END AS rule FROM b JOIN n ON n.image = b.image AND n.k = b.k AND n.rn = 1)
    SELECT image, rule, CASE WHEN rule <> 'missing_label' THEN tl END AS label, predicted, CASE WHEN rule = 'missing_label' THEN -1 ELSE i - 1 END::int AS place, score FROM f WHERE rule IS NOT NULL
    UNION ALL SELECT image, 'missed', label, NULL, (i - 1)::int, 1.0 FROM t9 WHERE NOT EXISTS (SELECT 1 FROM m9 WHERE m9.image = t9.image AND m9.pick = t9.i)"""
ORACLE_SQL["finding_class_swaps"] = f"SELECT label, predicted, count(*) AS n FROM ({ORACLE_SQL['round_findings']}) WHERE rule = 'wrong_class' GROUP BY 1, 2 ORDER BY n DESC, label, predicted LIMIT 8"

