"""Queries of reviews, releases, health, edits and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleworks.operators import editing, governance, versions
from sampleworks.plans.register import query, table
from sampleworks.plans.versions import _edges

_STATUS = "CASE event_type WHEN 'error' THEN 'rework' WHEN 'click' THEN 'reviewed' WHEN 'view' THEN 'in_review' WHEN 'purchase' THEN 'unreviewed' END"
_LOG = f"(SELECT 'img' || (user_id % 997) AS sample, event_id AS seq, {_STATUS} AS status, CASE WHEN event_id % 4 = 0 THEN 'note' ELSE '' END AS comment, 'u' || (event_id % 5) AS author, 'f' || (event_id % 3) AS fingerprint FROM events)"


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", "rework").when(kind == "click", "reviewed").when(kind == "view", "in_review").when(kind == "purchase", "unreviewed")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return e.select(name("img", F.col("user_id") % 997).alias("sample"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_id") % 4 == 0, "note").otherwise("").alias("comment"), name("u", F.col("event_id") % 5).alias("author"), name("f", F.col("event_id") % 3).alias("fingerprint"))


_STATE = f"(SELECT sample, coalesce(arg_max(status, seq) FILTER (status IS NOT NULL), 'unreviewed') AS status, arg_max(author, seq) FILTER (status IS NOT NULL) AS author, arg_max(fingerprint, seq) FILTER (status IS NOT NULL) AS fingerprint, count(*) FILTER (comment <> '') AS comments FROM {_LOG} WHERE status IS NOT NULL OR comment <> '' GROUP BY 1)"


@query("qa_state", f"SELECT * FROM {_STATE}")
def qa_state(spark, sf_dir):
    return governance.qa_state(_log(spark, sf_dir))


@query("review_state", f"SELECT sample, arg_max(status, seq) AS status, arg_max(comment, seq) AS reason, arg_max(author, seq) AS reviewer FROM {_LOG} WHERE status IS NOT NULL GROUP BY 1 HAVING arg_max(status, seq) <> 'unreviewed'")
def review_state(spark, sf_dir):
    return governance.review_state(_log(spark, sf_dir).withColumnsRenamed({"comment": "reason", "author": "reviewer"}))


_VERSIONS = "(SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'valid' ELSE 'train' END AS \"set\", 'img' || (o_orderkey % 1200) AS sample FROM orders)"


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.when(F.col("o_orderkey") % 5 == 0, "valid").otherwise("train").alias("set"), F.concat(F.lit("img"), (F.col("o_orderkey") % 1200).cast("string")).alias("sample"))


@query("release_waiting", f"""SELECT "set", count(*) AS images, count(*) FILTER (status = 'reviewed') AS verified, count(*) FILTER (status IS DISTINCT FROM 'reviewed') AS waiting FROM {_VERSIONS} v LEFT JOIN {_STATE} s ON s.sample = v.sample GROUP BY 1""")
def release_waiting(spark, sf_dir):
    return governance.waiting(_versions(spark, sf_dir), governance.qa_state(_log(spark, sf_dir)))


@query(
    "images_enriched",
    f"""WITH i AS (SELECT DISTINCT sample AS image FROM {_VERSIONS}), t AS (SELECT sample, list_sort(list_distinct(list(comment)))::varchar AS tags FROM {_LOG} WHERE seq % 7 = 0 AND comment <> '' GROUP BY 1)
        SELECT i.image, coalesce(s.status, 'unreviewed') AS status, coalesce(comments, 0) AS comments, coalesce(tags, '[]') AS tags FROM i LEFT JOIN {_STATE} s ON s.sample = i.image LEFT JOIN t ON t.sample = i.image""",
)
def images_enriched(spark, sf_dir):
    log = _log(spark, sf_dir)
    tags = log.filter("seq % 7 = 0 AND comment <> ''").groupBy("sample").agg(F.array_sort(F.collect_set("comment")).alias("tags"))
    images = _versions(spark, sf_dir).select(F.col("sample").alias("image")).distinct()
    return governance.enriched(images, governance.qa_state(log), tags, "image").select("image", "status", "comments", F.col("tags").cast("string").alias("tags"))


@query(
    "shipments",
    """WITH l AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 3 > 0 THEN 'r' || s_suppkey END AS id, CASE WHEN s_suppkey % 6 = 0 THEN 'r' || (s_suppkey - 2) END AS deleted, CASE WHEN s_suppkey % 6 = 3 THEN 'r' || (s_suppkey - 1) END AS approved FROM supplier)
        SELECT id, seq, CASE WHEN id IN (SELECT approved FROM l WHERE approved IS NOT NULL) THEN 'approved' ELSE 'exploratory' END AS approval, (row_number() OVER (ORDER BY seq DESC) - 1)::int AS place FROM l WHERE id IS NOT NULL AND id NOT IN (SELECT deleted FROM l WHERE deleted IS NOT NULL)""",
)
def shipments(spark, sf_dir):
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    log = table(spark, sf_dir, "supplier").select(k.alias("seq"), F.when(k % 3 > 0, name(k)).alias("id"), F.when(k % 6 == 0, name(k - 2)).alias("deleted"), F.when(k % 6 == 3, name(k - 1)).alias("approved"))
    return governance.shipments(log).select("id", "seq", "approval", "place")


_CURRENT = "(SELECT 'img' || p_partkey % 1100 AS sample, 'f' || (p_partkey % 3) AS fingerprint FROM part)"


@query(
    "stale_reviews",
    f"""SELECT DISTINCT sample, reason FROM (SELECT c.sample, CASE WHEN n > 1 THEN 'repeated' WHEN s.status IS DISTINCT FROM 'reviewed' THEN 'not reviewed' WHEN s.fingerprint IS DISTINCT FROM c.fingerprint THEN 'changed since' END AS reason
        FROM (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM {_CURRENT}) c LEFT JOIN {_STATE} s ON s.sample = c.sample) WHERE reason IS NOT NULL""",
)
def stale_reviews(spark, sf_dir):
    k = F.col("p_partkey")
    current = table(spark, sf_dir, "part").select(F.concat(F.lit("img"), (k % 1100).cast("string")).alias("sample"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("fingerprint"))
    return governance.stale_reviews(current, governance.qa_state(_log(spark, sf_dir)))


@query(
    "changed_since_approval",
    """WITH a AS (SELECT p_partkey::varchar AS sample, p_size AS f FROM part WHERE p_partkey % 9 > 0), b AS (SELECT p_partkey::varchar AS sample, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS f FROM part WHERE p_partkey % 7 > 0)
        SELECT sample, state FROM (SELECT coalesce(a.sample, b.sample) AS sample, CASE WHEN b.sample IS NULL THEN 'missing' WHEN a.sample IS NULL THEN 'new' WHEN a.f <> b.f THEN 'changed' END AS state FROM a FULL JOIN b ON a.sample = b.sample) WHERE state IS NOT NULL""",
)
def changed_since_approval(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda rows, size: governance.fingerprints(rows.select(F.col("p_partkey").cast("string").alias("image"), size.alias("size"), "p_name"), "image")
    size = F.col("p_size")
    return governance.changed_since_approval(side(p.filter("p_partkey % 9 > 0"), size), side(p.filter("p_partkey % 7 > 0"), F.when(F.col("p_partkey") % 4 == 0, size + 1).otherwise(size)))


@query(
    "project_rollup",
    """WITH c AS (SELECT n_regionkey AS project, count(*) AS versions, count(DISTINCT n_nationkey % 3) AS datasets, max(n_nationkey)::varchar AS v FROM nation GROUP BY 1), s AS (SELECT s_nationkey % 6 AS project, sum(s_suppkey) AS images, sum(s_suppkey % 7) AS verified, sum(s_suppkey % 5) AS boxes FROM supplier GROUP BY 1),
        r AS (SELECT c_nationkey % 4 AS project, count(*) AS runs, max(c_custkey % 90)::varchar AS t FROM customer GROUP BY 1)
        SELECT coalesce(c.project, s.project, r.project)::int AS project, coalesce(versions, 0) AS versions, coalesce(datasets, 0) AS datasets, coalesce(images, 0)::bigint AS images, coalesce(verified, 0)::bigint AS verified, coalesce(boxes, 0)::bigint AS boxes, coalesce(runs, 0) AS runs, greatest(v, t) AS last_activity
        FROM c FULL JOIN s ON c.project = s.project FULL JOIN r ON r.project = coalesce(c.project, s.project)""",
)
def project_rollup(spark, sf_dir):
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    bodies = n.select(F.col("n_regionkey").alias("project"), (F.col("n_nationkey") % 3).alias("dataset"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("created"))
    bodies = n.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("top")).join(n, "n_regionkey").select(F.col("n_regionkey").alias("project"), (F.col("n_nationkey") % 3).alias("dataset"), F.col("top").cast("string").alias("created"))
    sets = s.select((F.col("s_nationkey") % 6).alias("project"), F.col("s_suppkey").alias("images"), (F.col("s_suppkey") % 7).alias("verified"), (F.col("s_suppkey") % 5).alias("boxes"))
    top = c.groupBy((F.col("c_nationkey") % 4).alias("project")).agg(F.max(F.col("c_custkey") % 90).cast("string").alias("created"))
    runs = c.select((F.col("c_nationkey") % 4).alias("project")).join(top, "project")
    return governance.project_rollup(bodies, sets, runs)


_K = "s_suppkey"
_SUMMARY = f"""s AS (SELECT {_K} AS dataset, {_K} * 10 AS images, CASE WHEN {_K} % 7 = 0 THEN NULL ELSE ({_K} * 37) % 300 END AS held, {_K} % 9 AS classes, CASE WHEN {_K} % 4 = 0 THEN 2 ELSE 0 END AS struggling, {_K} % 5 > 0 AS looked, {_K} % 3 AS leaks, {_K} % 13 AS redundant, {_K} % 17 * 3 AS alone,
    CASE WHEN {_K} % 6 = 0 THEN NULL ELSE {_K} % 4 END AS findings, CASE WHEN {_K} % 2 = 0 THEN {_K} % 11 ELSE 0 END AS drafted, {_K} * 20 AS boxes, {_K} * (3 + {_K} % 5) AS verified FROM supplier)"""
_HEALTH = f"""{_SUMMARY}, c AS (SELECT dataset, 'holdout' AS code, CASE WHEN held IS NULL THEN 'block' WHEN held < 100 THEN 'warn' ELSE 'ok' END AS severity, coalesce(held, 0) AS value FROM s
    UNION ALL SELECT dataset, 'classes', CASE WHEN classes = 0 OR struggling > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN classes = 0 THEN 0 WHEN struggling > 0 THEN struggling ELSE classes END FROM s
    UNION ALL SELECT dataset, 'leaks', CASE WHEN leaks > 0 THEN 'block' ELSE 'ok' END, leaks FROM s WHERE looked
    UNION ALL SELECT dataset, 'copies', CASE WHEN NOT looked OR redundant::double / images > 0.01 THEN 'warn' ELSE 'ok' END, CASE WHEN looked THEN redundant END FROM s
    UNION ALL SELECT dataset, 'outliers', 'warn', alone FROM s WHERE looked AND alone::double / images > 0.05
    UNION ALL SELECT dataset, 'findings', CASE WHEN findings = 0 THEN 'ok' ELSE 'warn' END, findings FROM s
    UNION ALL SELECT dataset, 'drafts', CASE WHEN drafted::double / boxes > 0.01 THEN 'warn' ELSE 'ok' END, drafted FROM s WHERE drafted > 0
    UNION ALL SELECT dataset, 'review', CASE WHEN verified::double / images >= 0.5 THEN 'ok' ELSE 'warn' END, verified FROM s WHERE images > 0),
    o AS (SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY CASE severity WHEN 'block' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, code) - 1)::int AS place FROM c)"""


def _health(spark, sf_dir):
    k = F.col(_K)
    held = F.create_map(F.lit("train"), k * 9, F.lit("removed"), F.lit(1).cast("long"))
    sets = F.when(k % 7 == 0, held).otherwise(F.map_concat(held, F.create_map(F.lit("valid"), (k * 37) % 300, F.lit("test"), F.lit(10_000).cast("long"))))
    graph = F.when(k % 5 > 0, F.struct((k % 3).alias("leaks"), (k % 13).alias("redundant"), (k % 17 * 3).alias("alone")))
    summary = table(spark, sf_dir, "supplier").select(
        k.alias("dataset"), (k * 10).alias("images"), sets.alias("sets"), (k % 9).alias("classes"), F.when(k % 4 == 0, 2).otherwise(0).alias("struggling"), graph.alias("graph"),
        F.when(k % 6 > 0, k % 4).alias("finding_images"), F.when(k % 2 == 0, k % 11).otherwise(0).alias("drafted_boxes"), (k * 20).alias("boxes"), (k * (3 + k % 5)).alias("verified"),
    )
    return governance.health(summary)


@query("health", f"WITH {_HEALTH} SELECT dataset, place, code, severity, value::bigint AS value FROM o")
def health(spark, sf_dir):
    return _health(spark, sf_dir)


@query("health_verdict", f"WITH {_HEALTH} SELECT dataset, CASE WHEN bool_or(severity = 'block') THEN 'block' WHEN bool_or(severity = 'warn') THEN 'warn' ELSE 'ok' END AS verdict FROM o GROUP BY 1")
def health_verdict(spark, sf_dir):
    return governance.health_verdict(_health(spark, sf_dir))


@query(
    "task_detection",
    """WITH a AS (SELECT l_orderkey AS image, l_partkey % 5 AS k, l_suppkey % 3 > 0 AS mask FROM lineitem), i AS (SELECT image, count(*) AS n, count(DISTINCT k) AS d, count(*) FILTER (mask) AS m FROM a GROUP BY 1)
        SELECT CASE WHEN sum(m) * 2 >= sum(n) THEN CASE WHEN count(*) FILTER (d < n) = 0 THEN 'semantic_segmentation' ELSE 'instance_segmentation' END ELSE 'object_detection' END AS task, sum(n)::bigint AS annotations, sum(m)::bigint AS mask, count(*) AS images, count(*) FILTER (d < n) AS repeated FROM i""",
)
def task_detection(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    no = F.lit(False)
    mask = governance.has_mask(F.when(F.col("l_suppkey") % 3 > 0, F.array(F.array(*[F.lit(float(x)) for x in range(6)]))), F.lit(None).cast("array<int>"))
    points = governance.has_keypoints(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)))
    whole = governance.covers_image(F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(10.0)), F.lit(100.0), F.lit(100.0))
    found = governance.detect_task(i.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 5).alias("category"), mask.alias("mask"), points.alias("keypoints"), no.alias("oriented"), no.alias("panoptic"), whole.alias("whole")))
    return found.select("task", "annotations", "mask", "images", "repeated")


@query(
    "apply_edits",
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 9 ELSE p_size % 4 END::int AS label, CASE WHEN p_partkey % 6 = 0 THEN 0.0 ELSE 1.0 END AS weight, CASE WHEN p_partkey % 8 = 0 THEN 'seen' ELSE 'new' END AS note FROM part""",
)
def apply_edits(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).cast("int").alias("label"), F.lit(1.0).cast("float").alias("weight"))
    cells = lambda every, value: p.filter(every).select("p_partkey", value.alias("value"))
    out = editing.apply_edits(
        p, new_columns={"note": ("string", "new")}, class_maps={"label": {0: "a", 1: "b", 2: "c", 3: "d", 9: "e"}}, row="p_partkey",
        values={"label": cells(k % 10 < 2, F.when(k % 10 == 1, 9)), "weight": cells(k % 6 == 0, F.lit(0.0)), "note": cells(k % 8 == 0, F.lit("seen"))},
    )
    return out.withColumn("weight", F.col("weight").cast("double"))


_EDITS = "(SELECT p_partkey % 97 AS row, 'c' || (p_partkey % 2) AS \"column\", (p_size % 5)::varchar AS before, (p_size % 7)::varchar AS after, p_partkey AS seq, p_partkey % 4 AS grp FROM part)"


@query(
    "revert_group",
    f"""WITH e AS (SELECT * FROM {_EDITS}), g AS (SELECT row, "column", arg_min(before, seq) AS after, arg_max(after, seq) AS before FROM e WHERE grp = 2 GROUP BY 1, 2)
        SELECT row, "column", before, after, seq FROM e UNION ALL SELECT row, "column", before, after, (SELECT max(seq) FROM e) + row_number() OVER (PARTITION BY "column" ORDER BY row) FROM g""",
)
def revert_group(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    edits = table(spark, sf_dir, "part").select((k % 97).alias("row"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("column"), (s % 5).cast("string").alias("before"), (s % 7).cast("string").alias("after"), k.alias("seq"), (k % 4).alias("grp"))
    return editing.reverted(edits, 2).drop("grp")


@query("displayed_rows", "SELECT event_id FROM events WHERE (user_id % 5, event_id % 50) IN (SELECT s_suppkey % 7, s_suppkey % 50 FROM supplier WHERE s_suppkey % 4 = 0)")
def displayed_rows(spark, sf_dir):
    joined = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("_src"), (F.col("event_id") % 50).alias("example_id"))
    targets = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select((F.col("s_suppkey") % 7).alias("_src"), (F.col("s_suppkey") % 50).alias("example_id"))
    return editing.displayed_rows(joined, targets).select("event_id")


_INST = "(SELECT o_orderkey AS _row, o_orderkey % 3 AS n, o_orderkey % 4 > 0 AS drafted FROM orders)"


@query(
    "prelabel_merge",
    f"""SELECT _row, CASE WHEN n = 0 AND drafted THEN 1 ELSE n END::int AS empty_total, CASE WHEN n = 2 OR (n = 0 AND drafted) THEN 1 ELSE 0 END::int AS empty_model, CASE WHEN NOT drafted THEN n WHEN n = 2 THEN 2 ELSE 1 + n END::int AS replace_total, CASE WHEN NOT drafted THEN CASE WHEN n = 2 THEN 1 ELSE 0 END ELSE 1 END::int AS replace_model FROM {_INST}""",
)
def prelabel_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    box = lambda source, **more: F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 5, 5))], F.lit(1).alias("label"), *([F.lit(source).cast("string").alias("source")] if source is not False else []), *[F.lit(v).alias(n) for n, v in more.items()])
    own = F.slice(F.array(box(None), box("model")), F.lit(1), (k % 3).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("_row"), own.alias("instances"))
    drafts = rows.filter("_row % 4 > 0").select("_row", F.array(box(False, score=0.9), box(False, score=0.1)).alias("instances"))
    out = {}
    for mode in ("empty", "replace"):
        made = editing.prelabelled(rows, drafts, mode=mode)
        out[mode] = made.select("_row", F.size("instances").alias(f"{mode}_total"), F.size(F.filter("instances", lambda i: i["source"] == "model")).alias(f"{mode}_model"))
    return out["empty"].join(out["replace"], "_row")


@query(
    "class_filtered_pull",
    """WITH i AS (SELECT 'img' || (l_orderkey % 900) AS image, (l_orderkey % 2)::int AS project, l_orderkey AS split, CASE l_partkey % 4 WHEN 0 THEN ' Car' WHEN 1 THEN 'van' WHEN 2 THEN 'CAR' ELSE 'dog' END AS name FROM lineitem), h AS (SELECT image, project, split, count(*) FILTER (lower(trim(name)) = 'car') AS cars FROM i GROUP BY 1, 2, 3)
        SELECT image, split, cars FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY project, split) AS n FROM h WHERE cars > 0) WHERE n = 1""",
)
def class_filtered_pull(spark, sf_dir):
    name = F.element_at(F.array(F.lit(" Car"), F.lit("van"), F.lit("CAR"), F.lit("dog")), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(name.alias("name"))).alias("instances"))
    rows = rows.select(F.concat(F.lit("img"), (F.col("l_orderkey") % 900).cast("string")).alias("image"), (F.col("l_orderkey") % 2).cast("int").alias("project"), F.col("l_orderkey").alias("split"), "instances")
    return editing.class_filtered(rows, ["car"], keep_others=False).select("image", "split", F.size("instances").cast("long").alias("cars"))


def _catalog(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("version"), F.lower("n_name").alias("name"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("created"), F.when(F.col("n_nationkey") % 5 == 4, "filter").when(F.col("n_nationkey") % 2 == 0, "edit").otherwise("set_values").alias("op"), F.col("n_regionkey").cast("string").alias("args"))
    return n.withColumn("row_count", F.when(F.col("version").cast("int") % 11 == 10, 9).otherwise(10))


_TREE = """e AS (SELECT n_nationkey AS child, n_nationkey // 2 AS parent, 0 AS place FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey - 3, 1 FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey > 3),
    c AS (SELECT n_nationkey AS version, CASE WHEN n_nationkey % 5 = 4 THEN 'filter' ELSE 'edit' END AS op, CASE WHEN n_nationkey % 11 = 10 THEN 9 ELSE 10 END AS n, (SELECT count(*) FROM e WHERE child = n_nationkey) AS parents FROM nation)"""


@query(
    "preserving_revision",
    f"""WITH RECURSIVE {_TREE}, g AS (SELECT e.* FROM e JOIN c ON c.version = e.child WHERE c.op = 'edit' AND c.n = 10 AND c.parents = 1),
        d AS (SELECT 1::bigint AS version, 0 AS depth UNION ALL SELECT g.child, d.depth + 1 FROM d JOIN g ON g.parent = d.version), m AS (SELECT version, max(depth) AS depth FROM d GROUP BY 1)
        SELECT version::varchar AS version, NULL::varchar AS reason FROM m ORDER BY depth DESC, m.version DESC LIMIT 1""",
)
def preserving_revision(spark, sf_dir):
    return editing.preserving_revision(spark, _edges(spark, sf_dir), _catalog(spark, sf_dir), "1")


@query("revision_by_name", "SELECT n_nationkey::varchar AS version FROM nation WHERE n_nationkey = 9")
def revision_by_name(spark, sf_dir):
    wanted = _catalog(spark, sf_dir).filter("version = '9'").first()["name"]
    return editing.revision(spark, _edges(spark, sf_dir), _catalog(spark, sf_dir), "1", name=wanted)


@query(
    "root_producer",
    f"""WITH RECURSIVE {_TREE}, u AS (SELECT 23::bigint AS version, 0 AS depth UNION ALL SELECT e.parent, u.depth + 1 FROM u JOIN e ON e.child = u.version AND e.place = 0)
        SELECT u.version::varchar AS version, n_regionkey::varchar AS args FROM u JOIN nation ON n_nationkey = u.version WHERE n_nationkey % 5 <> 4 AND n_nationkey % 2 = 0 ORDER BY depth LIMIT 1""",
)
def root_producer(spark, sf_dir):
    return editing.root_producer(spark, _edges(spark, sf_dir), _catalog(spark, sf_dir), "23", "edit")


@query(
    "commit_outcomes",
    """WITH r AS (SELECT c_custkey AS request, c_custkey % 20 AS dataset, c_custkey % 3 AS parent, 'p' || (c_custkey % 40) AS fp FROM customer), h AS (SELECT n_nationkey AS dataset, n_nationkey % 3 AS version, ['p' || n_nationkey, 'x'] AS done FROM nation WHERE n_nationkey < 15),
        b AS (SELECT r.*, coalesce(list_contains(done, fp), false) AS again, coalesce(version = parent, false) AS head FROM r LEFT JOIN h ON h.dataset = r.dataset), f AS (SELECT *, min(request) FILTER (head AND NOT again) OVER (PARTITION BY dataset) AS first FROM b)
        SELECT request, CASE WHEN again THEN 'done before' WHEN head AND request = first THEN 'commit' ELSE 'conflict' END AS outcome FROM f""",
)
def commit_outcomes(spark, sf_dir):
    k = F.col("c_custkey")
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    requests = table(spark, sf_dir, "customer").select(k.alias("request"), (k % 20).cast("int").alias("dataset"), (k % 3).cast("int").alias("parent"), p(k % 40).alias("fingerprint"), k.alias("seq"))
    n = F.col("n_nationkey")
    heads = table(spark, sf_dir, "nation").filter(n < 15).select(n.alias("dataset"), (n % 3).alias("version"), F.array(p(n), F.lit("x")).alias("fingerprints"))
    return editing.commit(heads, requests)


@query(
    "import_resolved",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS k, (l_partkey % 97)::double - 3 AS x, (l_suppkey % 89)::double AS y, CASE WHEN l_partkey % 53 = 0 THEN 0.0 WHEN l_partkey % 59 = 0 THEN -1.0 ELSE l_quantity END AS w, (l_linenumber * 5)::double AS h FROM lineitem),
        b AS (SELECT *, k = 8 AS gone, w < 0 AS bad, w = 0 AS flat, x < -1 OR y < -1 OR x + w > 101 OR y + h > 101 AS out FROM a)
        SELECT l_orderkey, l_linenumber, CASE WHEN k = 2 THEN 1 ELSE k END::bigint AS category_id, (k = 5)::int AS iscrowd, CASE WHEN gone THEN 'removed category' WHEN bad THEN 'invalid box' WHEN flat THEN 'zero area' WHEN out THEN 'clipped' WHEN k = 2 THEN 'merged' WHEN k = 5 THEN 'ignored region' END AS effect,
        round(CASE WHEN gone OR bad OR flat THEN NULL WHEN out THEN greatest(least(x + w, 100) - greatest(x, 0), 0) ELSE w END, 4) AS w FROM b""",
)
def import_resolved(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    width = F.when(F.col("l_partkey") % 53 == 0, F.lit(0.0)).when(F.col("l_partkey") % 59 == 0, F.lit(-1.0)).otherwise(F.col("l_quantity"))
    boxes = i.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 9).alias("category_id"), ((F.col("l_partkey") % 97).cast("double") - 3).alias("x"), (F.col("l_suppkey") % 89).cast("double").alias("y"), width.alias("w"), (F.col("l_linenumber") * 5).cast("double").alias("h"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    return editing.resolved(boxes, {}, [8], {2: 1}, [5]).select("l_orderkey", "l_linenumber", "category_id", "iscrowd", "effect", F.round("w", 4).alias("w"))


@query("merged_categories", "SELECT id, arg_min(name, split || name) AS name FROM (SELECT (c_custkey % 40) AS id, 's' || (c_custkey % 3) AS split, 'n' || (c_custkey % 7) AS name FROM customer) GROUP BY 1")
def merged_categories(spark, sf_dir):
    k = F.col("c_custkey")
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return editing.merged_categories(table(spark, sf_dir, "customer").select((k % 40).alias("id"), named("s", k % 3).alias("split"), named("n", k % 7).alias("name")))


_FILES = "(SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'valid' ELSE 'train' END AS split, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'cam' || (o_orderkey % 300) || '_0' || o_orderkey || '_jpg.rf.' || repeat('a1', 8) || '.jpg' ELSE 'cam' || (o_orderkey % 300) || '_1' || (o_orderkey % 9) || '.jpg' END AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'cam' || (o_orderkey % 300) || '_0' || o_orderkey END AS src FROM orders)"


def _files(spark, sf_dir):
    k = F.col("o_orderkey")
    cam = F.concat(F.lit("cam"), (k % 300).cast("string"))
    name = F.when(k % 2 == 0, F.concat(cam, F.lit("_0"), F.floor(k / 4).cast("string"), F.lit("_jpg.rf."), F.lit("a1" * 8), F.lit(".jpg"))).otherwise(F.concat(cam, F.lit("_1"), (k % 9).cast("string"), F.lit(".jpg")))
    return table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, "valid").otherwise("train").alias("split"), k.alias("id"), name.alias("file_name"))


_NAMED = _FILES.replace("'_0' || o_orderkey", "'_0' || o_orderkey // 4")


@query(
    "group_findings",
    f"""WITH f AS (SELECT * FROM {_NAMED}), q AS (SELECT *, regexp_extract(coalesce(src, file), '^([A-Za-z0-9]+)[_-][0-9]', 1) AS seq FROM f), d AS (SELECT split, id, CASE WHEN id % 3 = 0 THEN id // 9 ELSE -id END AS sha FROM f), h AS (SELECT sha, count(DISTINCT split) AS s FROM d GROUP BY 1 HAVING count(*) > 1)
        SELECT 'images.export_copies' AS code, 'info' AS severity, split, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY split, src) AS k FROM f WHERE src IS NOT NULL) WHERE k > 1 GROUP BY split
        UNION ALL SELECT 'split.shared_source', 'warn', split, count(*) FROM f WHERE src IN (SELECT src FROM f WHERE src IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1) GROUP BY split
        UNION ALL SELECT 'split.shared_sequence', 'warn', split, count(*) FROM q WHERE seq IN (SELECT seq FROM q WHERE seq <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1) GROUP BY split
        UNION ALL SELECT 'media.identical_files', CASE WHEN (SELECT max(s) FROM h) > 1 THEN 'warn' ELSE 'info' END, split, count(*) FROM d JOIN h ON h.sha = d.sha GROUP BY split""",
)
def group_findings(spark, sf_dir):
    files = _files(spark, sf_dir)
    digests = files.select("split", "id", F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 9)).otherwise(-F.col("id")).cast("string").alias("sha1"))
    return versions.group_findings(files, digests)


@query("source_key", f"SELECT id, coalesce(CASE WHEN id % 10 = 0 THEN 'made from' END, src, file) AS source FROM {_NAMED}")
def source_key(spark, sf_dir):
    return _files(spark, sf_dir).select("id", versions.source_key(F.concat(F.when(F.col("file_name").contains(".rf."), "a/folder\\").otherwise(""), F.col("file_name")), F.when(F.col("id") % 10 == 0, "made from")).alias("source"))


@query(
    "media_findings",
    """SELECT code, CASE WHEN code = 'media.size_mismatch' THEN 'warn' ELSE 'block' END AS severity, split, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'valid' ELSE 'train' END AS split,
        CASE WHEN o_orderkey % 31 = 0 THEN 'media.missing' WHEN o_orderkey % 29 = 0 THEN 'media.unreadable' WHEN o_orderkey % 23 = 0 THEN 'media.size_mismatch' END AS code FROM orders) WHERE code IS NOT NULL GROUP BY ALL""",
)
def media_findings(spark, sf_dir):
    files, k = _files(spark, sf_dir), F.col("id")
    images = files.withColumns({"width": F.lit(100.0), "height": F.lit(80.0)})
    seen = files.select("split", "id", (k % 31 > 0).alias("exists"), (k % 29 > 0).alias("readable"), F.when(k % 23 == 0, 101).otherwise(100).alias("width"), F.when(k % 7 > 0, 80).otherwise(80).alias("height"))
    return versions.media_findings(images, seen)


@query("split_replan", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN 'a' WHEN o_orderkey % 10 < 8 THEN 'b' ELSE 'c' END AS split, row_number() OVER (PARTITION BY CASE WHEN o_orderkey % 10 < 6 THEN 'a' WHEN o_orderkey % 10 < 8 THEN 'b' ELSE 'c' END ORDER BY o_orderkey) AS k, (SELECT count(*) FROM orders) AS t FROM orders),
        q AS (SELECT t, t * 1 // 7 AS a, t * 2 // 7 AS b, t * 4 // 7 AS c, t * 1 / 7 - t * 1 // 7 AS ra, t * 2 / 7 - t * 2 // 7 AS rb, t * 4 / 7 - t * 4 // 7 AS rc FROM (SELECT count(*) AS t FROM orders)),
        w AS (SELECT unnest(['a', 'b', 'c']) AS s, unnest([a, b, c]) AS n, unnest([ra, rb, rc]) AS r, t - a - b - c AS short FROM q), z AS (SELECT s, n + (row_number() OVER (ORDER BY r DESC, s DESC) <= short)::int AS n FROM w),
        h AS (SELECT split, count(*) AS have FROM o GROUP BY 1), m AS (SELECT z.s, z.n, have, greatest(z.n - have, 0) AS room FROM z JOIN h ON h.split = z.s), e AS (SELECT *, sum(room) OVER (ORDER BY s) AS edge FROM m),
        x AS (SELECT o.*, o.k - m.n AS over FROM o JOIN m ON m.s = o.split), y AS (SELECT *, row_number() OVER (ORDER BY split, k) AS place FROM x WHERE over > 0)
        SELECT target, count(*) AS n, sum(o_orderkey)::bigint AS keys FROM (SELECT split AS target, o_orderkey FROM x WHERE over <= 0 UNION ALL SELECT coalesce((SELECT min(s) FROM e WHERE e.edge >= y.place AND room > 0), 'c'), o_orderkey FROM y) GROUP BY 1""")
def split_replan(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 10 < 6, "a").when(k % 10 < 8, "b").otherwise("c").alias("split"))
    return versions.plan_splits(o, "split", "o_orderkey", {"a": 1, "b": 2, "c": 4}).groupBy("target").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
