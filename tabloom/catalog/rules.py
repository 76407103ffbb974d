"""Column rules, scores and answers: S12, S13, H1-H7, H9-H11, K4, P7."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.kinds import drop_columns
from ..operators import profile, tally
from ..plans import ask as questions
from ..plans import heuristics, quality, run
from .base import GAPS_SQL, KINDS, SPIKED_SQL, gaps, numeric, query, rounded, spiked, stats_sql, table, union_sql
from .profile import _missing_sql, _outlier_sql

# Fixed values, written out again so that the twins do not follow the rules they check.
_NAME_TEST = """regexp_matches(name, '(^|_)id($|_)', 'i') OR regexp_matches(name, '_id$', 'i')
  OR regexp_matches(name, '^(uuid|guid|hash|token|key|sku|code|ref|reference)$', 'i')
  OR regexp_matches(name, '(tweet|user|post|comment|message|document|record|order|invoice|transaction|tracking)_?id', 'i')
  OR regexp_matches(name, '^(index|rowid|rownum)$', 'i')"""
_HINT_TEST = """regexp_matches(lower(name),
  'target|label|y|class|output|response|outcome|sentiment|category|churn|fraud|spam|risk|score')"""
_UNIQUE = "n_unique / greatest(n_rows, 1)"
_GONE = "n_missing / greatest(n_rows, 1)"


def _ids_sql(name: str, texts: list[str]) -> str:
    """An ``ids`` CTE over ``stats``; ``texts`` are the text columns whose values are looked at."""
    hashes = union_sql(
        [
            f"SELECT '{c}' AS name, avg(length({c})) >= 16 AND avg(CAST(regexp_full_match({c}, "
            f"'[A-Za-z0-9+/=_\\-]+') AS INT)) >= 0.9 AS is_hash FROM {name}"
            for c in texts
        ]
        or ["SELECT '' AS name, false AS is_hash"]
    )
    return f"""hashes AS ({hashes}), ids AS (
      SELECT position, name, CASE WHEN ({_NAME_TEST}) AND {_UNIQUE} >= 0.98 THEN 'name_and_unique'
        WHEN {_UNIQUE} >= 0.999 AND kind = 'numeric' THEN 'numeric_unique'
        WHEN {_UNIQUE} >= 0.999 AND kind = 'categorical' AND is_hash THEN 'hash_like' END AS reason
      FROM stats LEFT JOIN hashes USING (name)
    )"""


def _texts(name: str) -> list[str]:
    return [c for c, kind in KINDS[name] if kind == "categorical"]


def _id_query(name: str) -> str:
    return f"""WITH {stats_sql(name)}, {_ids_sql(name, _texts(name))}
    SELECT name AS "column", reason FROM ids WHERE reason IS NOT NULL"""


for _name in ("orders", "customer", "events", "lineitem"):

    @query(f"id_columns_{_name}", _id_query(_name))
    def _(spark, sf_dir, name=_name):
        return heuristics.id_columns_frame(table(spark, sf_dir, name))


@query(
    "id_columns_hashed",
    """WITH hashed AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS digest, left(md5(CAST(doc_id AS VARCHAR)), 12) AS short,
      source FROM documents),
    h AS (SELECT 'digest' AS name, digest AS v FROM hashed UNION ALL SELECT 'short', short FROM hashed
      UNION ALL SELECT 'source', source FROM hashed)
    SELECT name AS "column", 'hash_like' AS reason FROM h GROUP BY name
    HAVING count(DISTINCT v) / count(*) >= 0.999 AND avg(length(v)) >= 16
      AND avg(CAST(regexp_full_match(v, '[A-Za-z0-9+/=_\\-]+') AS INT)) >= 0.9""",
)
def _(spark, sf_dir):
    digest = F.md5(F.col("doc_id").cast("string"))
    hashed = table(spark, sf_dir, "documents").select(
        digest.alias("digest"), F.left(digest, F.lit(12)).alias("short"), "source"
    )
    return heuristics.id_columns_frame(hashed)


@query(
    "hash_like_shares",
    """SELECT lang, round(avg(length(text)), 4) AS mean_length,
    round(avg(CAST(regexp_full_match(text, '[A-Za-z0-9+/=_\\-]+') AS INT)), 6) AS share
    FROM documents GROUP BY lang""",
)
def _(spark, sf_dir):
    from ..functions.scalars import is_hash_like

    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(
            F.round(F.avg(F.length("text")), 4).alias("mean_length"),
            F.round(F.avg(is_hash_like(F.col("text")).cast("int")), 6).alias("share"),
        )
    )


@query(
    "constant_columns",
    f"""WITH narrow AS (SELECT l_returnflag, l_linestatus, l_linestatus = 'none' AS never,
      CASE WHEN l_linenumber > 100 THEN 1 END AS empty FROM lineitem),
    s AS (SELECT 'l_returnflag' AS name, count(DISTINCT l_returnflag) AS n FROM narrow
      UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM narrow
      UNION ALL SELECT 'never', count(DISTINCT never) FROM narrow
      UNION ALL SELECT 'empty', count(DISTINCT empty) FROM narrow)
    SELECT name AS "column" FROM s WHERE n <= 1""",
)
def _(spark, sf_dir):
    narrow = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        (F.col("l_linestatus") == "none").alias("never"),
        F.when(F.col("l_linenumber") > 100, 1).alias("empty"),
    )
    names = profile.constant_columns(tally.collect_tally(narrow))
    return spark.createDataFrame([(n,) for n in names], "column string")


def _type_parts(name: str) -> list[str]:
    return [
        f"""SELECT '{c}' AS target, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END
        AS problem_type FROM {name}"""
        for c, _ in KINDS[name]
    ]


@query(
    "problem_types",
    union_sql(_type_parts("orders")) + "\nUNION ALL SELECT 'none', 'time_series' FROM orders HAVING count(*) >= 0",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    known = tally.collect_tally(df)
    rows = [(c, heuristics.detect_problem_type(df, c, known).value) for c in df.columns]
    rows.append(("none", heuristics.detect_problem_type(df, None, known).value))
    return spark.createDataFrame(rows, "target string, problem_type string")


def _targets_sql(name: str) -> str:
    width = len(KINDS[name])
    parts = {
        "name_hint": (f"{_HINT_TEST}", 0.35),
        "last_column": (f"position = {width - 1}", 0.10),
        "near_last": (f"position < {width - 1} AND position >= {width - 3}", 0.04),
        "few_categories": ("n_unique <= 15 AND kind <> 'numeric'", 0.30),
        "few_numbers": ("n_unique <= 20 AND kind = 'numeric'", 0.20),
        "continuous": (f"n_unique > 20 AND kind = 'numeric' AND {_UNIQUE} > 0.05", 0.15),
        "low_cardinality": ("n_unique > 1 AND n_unique <= 5", 0.05),
        "many_missing": (f"{_GONE} > 0.30", -0.20),
    }
    points = " + ".join(f"CASE WHEN {test} THEN {p} ELSE 0 END" for test, p in parts.values())
    reasons = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, (test, _) in parts.items())
    return f"""scored AS (SELECT position, name AS "column",
      CASE WHEN kind = 'numeric' AND (n_unique > 20 OR {_UNIQUE} > 0.05) THEN 'regression'
        ELSE 'classification' END AS problem_type,
      CASE WHEN {_GONE} > 0.60 THEN -1.0 ELSE round(CAST({points} AS DOUBLE), 3) END AS score,
      concat_ws(',', {reasons}) AS reasons FROM stats),
    ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, position) AS rank FROM scored WHERE score > 0)
    SELECT CAST(rank AS INT) AS rank, "column", problem_type, score, reasons FROM ranked WHERE rank <= 5"""


for _name in ("orders", "events", "part"):

    @query(f"target_suggestions_{_name}", f"WITH {stats_sql(_name)}, {_targets_sql(_name)}")
    def _(spark, sf_dir, name=_name):
        return heuristics.target_frame(table(spark, sf_dir, name))


@query(
    "target_suggestions_gaps", f"WITH {GAPS_SQL}, {stats_sql('gaps')}, {_targets_sql('gaps')}"
)
def _(spark, sf_dir):
    return heuristics.target_frame(gaps(spark, sf_dir))


def _plan_sql(name: str, target: str | None, cte: str = "") -> str:
    wide = "'target'" if target else "'ordinal'"
    numbers = ", ".join(f"'{c}'" for c in numeric(name) if c != target)
    dates = union_sql(
        [f"""SELECT '{c}' AS "column", 'feature' AS action, 'date_features' AS value""" for c, k in KINDS[name] if k == "datetime"]
        or ["SELECT '' , '', '' WHERE false"]
    )
    return f"""WITH {cte}{stats_sql(name)}, {_ids_sql(name, _texts(name))},
    decided AS (SELECT s.*, coalesce(ids.reason,
        CASE WHEN n_unique <= 1 THEN 'constant'
             WHEN n_unique >= greatest(n_rows, 1) AND kind = 'numeric' THEN 'unique_per_row'
             WHEN {_GONE} > 0.95 THEN 'mostly_missing' END) AS gone
      FROM stats s LEFT JOIN ids USING (name) WHERE s.name <> '{target or ""}'),
    kept AS (SELECT * FROM decided WHERE gone IS NULL)
    SELECT name AS "column", 'drop' AS action, gone AS value FROM decided WHERE gone IS NOT NULL
    UNION ALL SELECT name, 'impute', CASE WHEN kind <> 'numeric' THEN 'most_frequent'
      WHEN n_missing > 0 THEN 'median' ELSE 'none' END FROM kept
    UNION ALL SELECT name, 'encode', CASE WHEN kind = 'numeric' THEN
        CASE WHEN n_unique > 2 AND n_unique <= 10 THEN 'ordinal' ELSE 'passthrough' END
      WHEN n_unique <= 10 THEN 'onehot' ELSE {wide} END FROM kept
    UNION ALL SELECT name, 'note', 'high_cardinality' FROM kept WHERE kind <> 'numeric' AND n_unique > 50
    UNION ALL SELECT NULL, 'scale', CASE WHEN count(*) > 0 THEN 'standard' ELSE 'none' END FROM kept
      WHERE name IN ({numbers})
    UNION ALL {dates}
    UNION ALL SELECT NULL, 'feature', 'ratios' FROM kept WHERE name IN ({numbers}) HAVING count(*) >= 3"""


@query("plan_customer", _plan_sql("customer", "c_mktsegment"))
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return heuristics.plan_frame(df, heuristics.suggest_plan(df, "c_mktsegment"))


@query("plan_events", _plan_sql("events", None))
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return heuristics.plan_frame(df, heuristics.suggest_plan(df))


@query("plan_gaps", _plan_sql("gaps", "l_discount", f"{GAPS_SQL}, "))
def _(spark, sf_dir):
    df = gaps(spark, sf_dir)
    return heuristics.plan_frame(df, heuristics.suggest_plan(df, "l_discount"))


def _penalties_sql(name: str, target: str) -> str:
    """Scoring rules over the facets; identifiers are not analysed."""
    every = ", ".join(c for c, _ in KINDS[name])
    return f"""{stats_sql(name)}, {_ids_sql(name, _texts(name))}, {_missing_sql(name)},
    named AS (SELECT * FROM ids WHERE reason IS NOT NULL),
    {_outlier_sql(name, numeric(name)).replace("outliers AS", "far AS", 1)},
    outliers AS (SELECT * FROM far WHERE "column" NOT IN (SELECT name FROM named)),
    total AS (SELECT count(*) AS n FROM {name}),
    copies AS (SELECT (SELECT n FROM total) - count(*) AS d FROM (SELECT DISTINCT {every} FROM {name})),
    classes AS (SELECT count(*) AS n FROM {name} GROUP BY {target}),
    balance AS (SELECT max(n) / min(n) AS ratio, count(*) AS k FROM classes),
    losses AS (
      SELECT position AS seq, CASE WHEN ratio > 0.5 THEN 12 WHEN ratio > 0.2 THEN 5 WHEN ratio > 0.05 THEN 2 ELSE 0
        END AS points, 'missing' AS code, "column" AS detail, CAST(ratio AS DOUBLE) AS measure FROM missing
      UNION ALL SELECT 1000, CASE WHEN d / n > 0.1 THEN 10 WHEN d / n > 0.01 THEN 3 ELSE 0 END, 'duplicates',
        CAST(d AS VARCHAR), round(d / n, 4) FROM copies, total
      UNION ALL SELECT 1001, least(8, 2 * count(*)), 'identifiers', coalesce(string_agg(name, ',' ORDER BY position), ''),
        count(*) FROM named
      UNION ALL SELECT 1002, least(15, 3 * count(*)), 'outliers',
        (SELECT string_agg("column", ',' ORDER BY n_outliers DESC, position) FROM
          (SELECT * FROM outliers ORDER BY n_outliers DESC, position LIMIT 3)), count(*) FROM outliers
      UNION ALL SELECT 1003, CASE WHEN ratio > 5 AND k > 1 THEN 5 ELSE 0 END, 'imbalance', '{target}',
        round(ratio, 4) FROM balance
    )"""


_GAP_PENALTIES = _penalties_sql("gaps", "l_returnflag")
_ORDER_PENALTIES = _penalties_sql("orders", "o_orderstatus")
_SPIKED_PENALTIES = _penalties_sql("spiked", "mark")
_BREAKDOWN = """SELECT CAST(row_number() OVER (ORDER BY points DESC, seq) AS INT) AS rank, CAST(points AS INT) AS points,
    code, detail, CAST(measure AS DOUBLE) AS measure FROM losses WHERE points > 0"""
_SCORE = """, score AS (SELECT greatest(0, least(100, 100 - coalesce(sum(points), 0))) AS s, count(*) AS k FROM losses
    WHERE points > 0)
    SELECT CAST(s AS INT) AS score, CASE WHEN s >= 85 THEN 'excellent' WHEN s >= 70 THEN 'good'
    WHEN s >= 50 THEN 'fair' ELSE 'poor' END AS grade, CAST(k AS INT) AS n_issues FROM score"""


@query("quality_breakdown", f"WITH {GAPS_SQL}, {_GAP_PENALTIES} {_BREAKDOWN}")
def _(spark, sf_dir):
    return quality.quality_breakdown(gaps(spark, sf_dir), "l_returnflag")


@query("quality_score", f"WITH {GAPS_SQL}, {_GAP_PENALTIES} {_SCORE}")
def _(spark, sf_dir):
    return quality.quality_score(gaps(spark, sf_dir), "l_returnflag")


@query("quality_orders", f"WITH {_ORDER_PENALTIES} {_SCORE}")
def _(spark, sf_dir):
    return quality.quality_score(table(spark, sf_dir, "orders"), "o_orderstatus")


def _insights_sql(target: str) -> str:
    return f""", found AS (
      SELECT 1 AS seq, 'identifiers' AS code, string_agg(name, ',' ORDER BY position) AS detail, count(*) AS measure
        FROM named HAVING count(*) > 0
      UNION ALL SELECT 2, 'missing', (SELECT string_agg("column", ',' ORDER BY n_missing DESC, position) FROM
        (SELECT * FROM missing ORDER BY n_missing DESC, position LIMIT 3)), sum(n_missing) FROM missing HAVING count(*) > 0
      UNION ALL SELECT 3, 'duplicates', CAST(d AS VARCHAR), d FROM copies WHERE d > 0
      UNION ALL SELECT 4, 'imbalance', '{target}', round(ratio, 4) FROM balance WHERE ratio > 5 AND k > 1
      UNION ALL SELECT 5, 'outliers', (SELECT string_agg("column", ',' ORDER BY n_outliers DESC, position) FROM
        (SELECT * FROM outliers ORDER BY n_outliers DESC, position LIMIT 3)), count(*) FROM outliers HAVING count(*) > 0
    )
    SELECT CAST(row_number() OVER (ORDER BY seq) AS INT) AS rank, code, detail, CAST(measure AS DOUBLE) AS measure
    FROM found"""


@query("insights", f"WITH {GAPS_SQL}, {_GAP_PENALTIES} {_insights_sql('l_returnflag')}")
def _(spark, sf_dir):
    return quality.insights(gaps(spark, sf_dir), "l_returnflag")


@query("insights_spiked", f"WITH {SPIKED_SQL}, {_SPIKED_PENALTIES} {_insights_sql('mark')}")
def _(spark, sf_dir):
    return quality.insights(spiked(spark, sf_dir), "mark")


@query("quality_breakdown_spiked", f"WITH {SPIKED_SQL}, {_SPIKED_PENALTIES} {_BREAKDOWN}")
def _(spark, sf_dir):
    return quality.quality_breakdown(spiked(spark, sf_dir), "mark")


@query("quality_spiked", f"WITH {SPIKED_SQL}, {_SPIKED_PENALTIES} {_SCORE}")
def _(spark, sf_dir):
    return quality.quality_score(spiked(spark, sf_dir), "mark")


@query(
    "outliers_spiked",
    f"""WITH {SPIKED_SQL}, {_outlier_sql('spiked', numeric('spiked'))}
    SELECT position, "column", n_outliers, ratio, round(lower_bound, 6) AS lower_bound,
    round(upper_bound, 6) AS upper_bound FROM outliers""",
)
def _(spark, sf_dir):
    return rounded(profile.outliers(spiked(spark, sf_dir)), "lower_bound", "upper_bound")


@query("id_columns_spiked", f"WITH {SPIKED_SQL}, {_id_query('spiked').removeprefix('WITH ')}")
def _(spark, sf_dir):
    return heuristics.id_columns_frame(spiked(spark, sf_dir))


# A measure that follows another one, so that some proposal fires.
_TIED_SQL = """tied AS (SELECT l_quantity, l_quantity * 3 + l_discount AS tripled, l_discount,
  l_quantity + l_discount * 300 AS mixed, l_returnflag FROM lineitem)"""


def _tied(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        (c("l_quantity") * 3 + c("l_discount")).alias("tripled"),
        "l_discount",
        (c("l_quantity") + c("l_discount") * 300).alias("mixed"),
        "l_returnflag",
    )


_TIED_COLUMNS = ["l_quantity", "tripled", "l_discount", "mixed"]


@query(
    "feature_proposals",
    f"""WITH {_TIED_SQL}, pairs AS ({union_sql([
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS c FROM tied"
        for i, a in enumerate(_TIED_COLUMNS) for b in _TIED_COLUMNS[i + 1:]])}),
    top AS (SELECT * FROM pairs ORDER BY c DESC, a, b LIMIT 3)
    SELECT 'product' AS kind, a, b, round(c, 6) AS value FROM top WHERE c >= 0.6
    UNION ALL SELECT 'degree_2', NULL, NULL, NULL FROM tied HAVING count(*) >= 200
    UNION ALL SELECT 'target_quantile_bins', 'mixed', NULL, NULL FROM tied HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    return rounded(heuristics.propose_features(_tied(spark, sf_dir), "mixed"), "value")


@query(
    "column_info",
    f"""SELECT CAST(position AS INT) AS position, "column", dtype, kind, n_unique, n_missing, example FROM (
    {union_sql([
        f'''SELECT {i} AS position, '{c}' AS "column", '{dtype}' AS dtype, '{kind}' AS kind,
        count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing, CAST(min({c}) AS VARCHAR) AS example
        FROM orders''' for i, ((c, kind), dtype) in enumerate(zip(KINDS['orders'],
        ['bigint', 'bigint', 'string', 'double', 'timestamp_ntz', 'string']))])})""",
)
def _(spark, sf_dir):
    return profile.column_info(table(spark, sf_dir, "orders"))


@query(
    "dataset_summary",
    """SELECT 'p1' AS dataset_id, 'part' AS name, count(*) AS n_rows, 6 AS n_columns, 6 AS n_infos,
    count(DISTINCT p_brand) AS brands, 'p_type' AS target, 'classification' AS problem_type FROM part""",
)
def _(spark, sf_dir):
    summary = run.dataset_summary(
        table(spark, sf_dir, "part"), "p1", "part", "p_type", heuristics.ProblemType.CLASSIFICATION
    )
    brand = F.filter("columns_info", lambda c: c["column"] == "p_brand")[0]["n_unique"]
    return summary.select(
        "dataset_id", "name", "n_rows", "n_columns", F.size("columns_info").alias("n_infos"),
        brand.alias("brands"), "target", "problem_type",
    )


# Questions in the language whose words route them; each one meets another branch.
_QUESTIONS = {
    "rows": (
        "Combien de lignes ?",
        "SELECT 'rows' AS topic, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM gaps "
        "UNION ALL SELECT 'rows', 'columns', 7.0",
    ),
    "missing": (
        "Des valeurs manquantes ?",
        """SELECT 'missing' AS topic, "column" AS item, CAST(n_missing AS DOUBLE) AS value FROM missing
        ORDER BY n_missing DESC, position LIMIT 5""",
    ),
    "duplicates": (
        "Y a-t-il des doublons ?",
        "SELECT 'duplicates' AS topic, 'duplicates' AS item, CAST((SELECT count(*) FROM gaps) - count(*) AS DOUBLE) "
        "AS value FROM (SELECT DISTINCT * FROM gaps)",
    ),
    "target": (
        "Quelle est la cible ?",
        """SELECT 'target' AS topic, l_returnflag AS item, CAST(count(*) AS DOUBLE) AS value FROM gaps
        WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY value DESC, item LIMIT 5""",
    ),
    "outliers": (
        "Quels outliers ?",
        """SELECT 'outliers' AS topic, "column" AS item, CAST(n_outliers AS DOUBLE) AS value FROM outliers
        ORDER BY position LIMIT 5""",
    ),
    "drop_columns": (
        "Quelle colonne supprimer ?",
        """SELECT 'drop_columns' AS topic, "column" AS item, CAST(ratio AS DOUBLE) AS value FROM
        (SELECT * FROM missing ORDER BY n_missing DESC, position LIMIT 1) WHERE ratio > 0.4""",
    ),
}

for _topic, (_question, _sql) in _QUESTIONS.items():

    @query(
        f"ask_{_topic}",
        f"WITH {GAPS_SQL}, {_missing_sql('gaps')}, {_outlier_sql('gaps', numeric('gaps'))} {_sql}",
    )
    def _(spark, sf_dir, question=_question):
        return questions.ask(gaps(spark, sf_dir), question, target="l_returnflag")


@query(
    "ask_correlations",
    f"""WITH {_TIED_SQL}, pairs AS ({union_sql([
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS c FROM tied"
        for i, a in enumerate(_TIED_COLUMNS) for b in _TIED_COLUMNS[i + 1:]])})
    SELECT 'correlations' AS topic, a || ',' || b AS item, round(c, 6) AS value FROM pairs
    ORDER BY pairs.c DESC, a, b LIMIT 3""",
)
def _(spark, sf_dir):
    return rounded(questions.ask(_tied(spark, sf_dir), "Des corrélations ?"), "value")


@query(
    "ask_numeric_target",
    """SELECT 'target' AS topic, unnest(['mean', 'median', 'std']) AS item,
    unnest([round(avg(o_totalprice), 4), round(median(o_totalprice), 4), round(stddev_samp(o_totalprice), 4)]) AS value
    FROM orders""",
)
def _(spark, sf_dir):
    answer = questions.ask(table(spark, sf_dir, "orders"), "target?", target="o_totalprice")
    return rounded(answer, "value", digits=4)


@query(
    "analysed_columns",
    f"""WITH {stats_sql('orders')}, {_ids_sql('orders', _texts('orders'))}
    SELECT s.name AS "column", n_unique FROM stats s LEFT JOIN ids USING (name) WHERE reason IS NULL""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return tally.n_unique(drop_columns(df, list(heuristics.id_reasons(df))))


@query(
    "ask_outliers_spiked",
    f"""WITH {SPIKED_SQL}, {_outlier_sql('spiked', [n for n in numeric('spiked') if n != 'row_id'])}
    SELECT 'outliers' AS topic, "column" AS item, CAST(n_outliers AS DOUBLE) AS value FROM outliers ORDER BY position LIMIT 5""",
)
def _(spark, sf_dir):
    return questions.ask(spiked(spark, sf_dir), "Quels outliers ?")


@query(
    "ask_columns",
    """SELECT 'columns' AS topic, unnest(['columns', 'numeric']) AS item, unnest([count(*),
    count(*) FILTER (WHERE data_type IN ('BIGINT', 'INTEGER', 'DOUBLE'))]) ::DOUBLE AS value
    FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE lineitem))""",
)
def _(spark, sf_dir):
    return questions.ask(table(spark, sf_dir, "lineitem"), "Combien de colonnes ?")


def _boards(spark, sf_dir):
    """Order priorities as models with their mean price as the score, and statuses as features with their share."""
    orders = table(spark, sf_dir, "orders")
    board = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("score"))
    board = board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"))))
    weights = orders.groupBy(F.col("o_orderstatus").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    return orders, board, weights


@query(
    "ask_best_model",
    """SELECT 'best_model' AS topic, o_orderpriority AS item, round(avg(o_totalprice), 4) AS value FROM orders
    GROUP BY o_orderpriority ORDER BY avg(o_totalprice) DESC LIMIT 1""",
)
def _(spark, sf_dir):
    orders, board, weights = _boards(spark, sf_dir)
    return rounded(questions.ask(orders, "Quel est le meilleur modèle ?", None, board, weights), "value", digits=4)


@query(
    "ask_importance",
    """SELECT 'importance' AS topic, o_orderstatus AS item, count(*)::DOUBLE AS value FROM orders
    GROUP BY o_orderstatus ORDER BY value DESC, item LIMIT 5""",
)
def _(spark, sf_dir):
    orders, board, weights = _boards(spark, sf_dir)
    return questions.ask(orders, "Quelles mesures sont importantes ?", None, board, weights)


@query(
    "ask_nothing",
    """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'empty' ELSE 'unknown' END AS topic, count(*) AS n FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    """Questions that no branch answers have a topic and no rows; their topics are counted over orders."""
    orders = table(spark, sf_dir, "orders")
    silent = [q for q in ("  ", "bonjour") if questions.ask(orders, q).isEmpty()]
    topics = [questions.topic_of(q) for q in silent]
    return orders.groupBy(F.when(F.col("o_orderkey") % 2 == 0, topics[0]).otherwise(topics[-1]).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
