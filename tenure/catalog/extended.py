"""Boosted model and streaming sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenure.catalog import register
from tenure.catalog.customers import GAP, feature_table
from tenure.catalog.views import rounded, scored, sql
from tenure.operators.boosted import BoostedCox
from tenure.plans.materialise import checkpoint_root, materialise
from tenure.sources import retail
from tenure.streaming.jobs import replay_sessions


@register("boosted_cox")
def _boosted(spark, sf_dir):
    """Training loss after each round of the default model on the whole feature matrix."""
    table, names = feature_table(spark, sf_dir)
    model = BoostedCox().fit(table, names, eval_set=table)
    rows = [(i + 1, loss) for i, loss in enumerate(model.losses)]
    return spark.createDataFrame(rows, "round int, loss double")


# The first tree by definition: all margins are 0, so a risk set's sum is its number of rows.
_TREE_FEATURES = ("frequency", "n_categories")
_LEAST, _LAMBDA = 5, 1


def _level_sql(rows: str, name: str) -> str:
    """The best split of every node of `rows` (path, f0, f1, g, h)."""
    return f"""
{name}_sums AS (
  SELECT path, f, v, sum(sum(g)) OVER w AS gl, sum(sum(h)) OVER w AS hl,
         sum(sum(g)) OVER (PARTITION BY path, f) AS gt, sum(sum(h)) OVER (PARTITION BY path, f) AS ht
  FROM (SELECT path, 0 AS f, f0 AS v, g, h FROM {rows} UNION ALL SELECT path, 1, f1, g, h FROM {rows})
  GROUP BY path, f, v WINDOW w AS (PARTITION BY path, f ORDER BY v)),
{name} AS (
  SELECT path, f, v FROM (
    SELECT *, gl * gl / (hl + {_LAMBDA}) + (gt - gl) ** 2 / (ht - hl + {_LAMBDA}) - gt * gt / (ht + {_LAMBDA}) AS gain
    FROM {name}_sums WHERE hl >= {_LEAST} AND ht - hl >= {_LEAST})
  WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, v) = 1)"""


def _moved_sql(rows: str, splits: str) -> str:
    return f"""SELECT path || CASE WHEN f IS NULL THEN '' WHEN (CASE f WHEN 0 THEN f0 ELSE f1 END) <= v THEN 'b' ELSE 'a' END AS path,
         f0, f1, g, h FROM {rows} LEFT JOIN {splits} USING (path)"""


_TREE_SQL = f"""risk AS (SELECT t, sum(d / s0) OVER (ORDER BY t) AS a, sum(d / s0 / s0) OVER (ORDER BY t) AS b
  FROM (SELECT duration AS t, sum(event::INT) AS d, sum(count(*)) OVER (ORDER BY duration DESC) AS s0 FROM scored GROUP BY duration)),
rows0 AS (SELECT '' AS path, {_TREE_FEATURES[0]} AS f0, {_TREE_FEATURES[1]} AS f1, a - event::INT AS g, a - b AS h
  FROM scored JOIN risk ON duration = t),{_level_sql("rows0", "split0")},
rows1 AS ({_moved_sql("rows0", "split0")}),{_level_sql("rows1", "split1")},
rows2 AS ({_moved_sql("rows1", "split1")})"""


def _tree_rows(depth: int) -> str:
    splits = " UNION ALL ".join(f"SELECT * FROM split{i}" for i in range(depth))
    return f"""SELECT path, CASE f WHEN 0 THEN '{_TREE_FEATURES[0]}' ELSE '{_TREE_FEATURES[1]}' END AS feature, v::DOUBLE AS threshold,
       NULL::DOUBLE AS value FROM ({splits})
UNION ALL SELECT path, NULL, NULL, round(-sum(g) / (sum(h) + {_LAMBDA}), 8) FROM rows{depth} GROUP BY path"""


def _first_tree(spark, sf_dir, depth: int):
    """Every node of the first tree: a split, or the value of a leaf; the path says which way (b: at most the threshold)."""
    table = scored(spark, sf_dir).select("duration", "event", *_TREE_FEATURES)
    spec = BoostedCox(n_estimators=1, max_depth=depth, subsample=1.0, colsample_bytree=1.0, min_child_weight=_LEAST, reg_lambda=_LAMBDA)
    tree = spec.fit(materialise(table, "table"), list(_TREE_FEATURES)).trees[0]
    path, rows = {0: ""}, []
    for _, node, f, threshold, below, above, value in tree.rows(0):
        if f < 0:
            rows.append((path[node], None, None, value))
            continue
        path |= {below: path[node] + "b", above: path[node] + "a"}
        rows.append((path[node], _TREE_FEATURES[f], threshold, None))
    nodes = spark.createDataFrame(rows, "path string, feature string, threshold double, value double")
    return rounded(nodes, 8, "value")


@register("boosted_stump", sql("", "scored").rstrip() + ",\n" + _TREE_SQL + "\n" + _tree_rows(1))
def _boosted_stump(spark, sf_dir):
    return _first_tree(spark, sf_dir, 1)


@register("boosted_first_tree", sql("", "scored").rstrip() + ",\n" + _TREE_SQL + "\n" + _tree_rows(2))
def _boosted_first_tree(spark, sf_dir):
    return _first_tree(spark, sf_dir, 2)


@register(
    "stream_sessions",
    sql(
        """SELECT customer_id, session_start, pages_per_session,
                   round(session_duration_s, 6) AS session_duration_s
            FROM (SELECT customer_id, min(event_timestamp) AS session_start, count(*) AS pages_per_session,
                         sum(time_on_page_seconds) AS session_duration_s
                  FROM clickstream GROUP BY customer_id, session_id)""",
        "clickstream",
    ),
)
def _stream_sessions(spark, sf_dir):
    """The event file as a stream, read to its end: every session, those still open then included."""
    schema = retail.table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    out = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    sessions = replay_sessions(retail.as_clicks(events), GAP, out)
    return rounded(
        sessions.select(
            "customer_id",
            F.col("session_start").cast("timestamp_ntz").alias("session_start"),
            "pages_per_session",
            "session_duration_s",
        ),
        6,
        "session_duration_s",
    )
