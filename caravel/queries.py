"""Registered queries of the engine's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import serializers
from .operators import changelog
from .operators.filters import filter_eq
from .operators.identity import TableId, rename, union_renamed
from .plans.sqlgate import run_sql
from . import queries_delivery
from .queries_sql import DIALECT, SHARED
from .sources import generator, parsers

#: SQL that both engines read alike: name -> (table that is `input`, query, further relations).
SHARED_SQL: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "sql_project_filter": ("events", "SELECT user_id + event_id AS total, concat(event_type, '/', user_id) AS tag FROM input WHERE value < 12.5 OR event_type = 'signup'", ()),
    "sql_group_count": ("events", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM input GROUP BY user_id", ()),
    "sql_having_filter": ("events", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM input GROUP BY user_id HAVING count(*) > 5", ()),
    "sql_min_max_avg": ("lineitem", "SELECT l_returnflag, l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 4) AS mean, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM input GROUP BY l_returnflag, l_linestatus", ()),
    "sql_grouping_sets": ("customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM input GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())", ()),
    "sql_rollup": ("customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM input GROUP BY ROLLUP (c_mktsegment, c_nationkey)", ()),
    "sql_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM input GROUP BY CUBE (o_orderstatus, o_orderpriority)", ()),
    "sql_self_join": ("nation", "SELECT a.n_name AS one, b.n_name AS other FROM input a JOIN input b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", ()),
    "sql_left_join": ("customer", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM input c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey", ("orders",)),
    "sql_full_join": ("supplier", "SELECT s.s_suppkey, n.n_name FROM input s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey", ("nation",)),
    "sql_semi": ("customer", "SELECT c_custkey FROM input WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", ("orders",)),
    "sql_anti": ("customer", "SELECT c_custkey FROM input c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", ("orders",)),
    "sql_exists_correlated": ("orders", "SELECT o_orderkey FROM input o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)", ("lineitem",)),
    "sql_scalar_subquery": ("part", "SELECT p_partkey FROM input WHERE p_retailprice > (SELECT avg(p_retailprice) FROM input)", ()),
    "sql_theta_join": ("region", "SELECT a.r_name AS one, b.r_name AS other FROM input a JOIN input b ON a.r_regionkey < b.r_regionkey", ()),
    "sql_using_join": ("nation", "SELECT n_name, other FROM input JOIN (SELECT n_nationkey, n_regionkey + 1 AS other FROM input) x USING (n_nationkey)", ()),
    "sql_window_rank": ("events", "SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM input WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", ()),
    "sql_window_lag": ("events", "SELECT event_id, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_type, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM input", ()),
    "sql_window_frame": ("events", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM input", ()),
    "sql_topk": ("orders", "SELECT o_orderkey, o_totalprice FROM input ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10", ()),
    "sql_offset": ("part", "SELECT p_partkey FROM input ORDER BY p_partkey LIMIT 20 OFFSET 5", ()),
    "sql_union_all": ("nation", "SELECT n_name AS name FROM input UNION ALL SELECT r_name FROM region", ("region",)),
    "sql_intersect": ("customer", "SELECT c_nationkey AS k FROM input INTERSECT SELECT s_nationkey FROM supplier", ("supplier",)),
    "sql_except": ("nation", "SELECT n_nationkey AS k FROM input EXCEPT SELECT s_nationkey FROM supplier", ("supplier",)),
    "sql_intersect_all": ("customer", "SELECT c_nationkey AS k FROM input INTERSECT ALL SELECT s_nationkey FROM supplier", ("supplier",)),
    "sql_cte": ("orders", "WITH big AS (SELECT o_custkey, o_totalprice FROM input WHERE o_totalprice > 100000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey", ()),
    "sql_recursive_cte": ("region", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t", ()),
    "sql_values": ("region", "SELECT v.k, r.r_name FROM (VALUES (0, 'a'), (1, 'b')) AS v(k, x) JOIN input r ON r.r_regionkey = v.k", ()),
    "sql_string_fns": ("nation", "SELECT n_nationkey, lower(n_name) AS lo, reverse(n_name) AS rev, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, replace(n_name, 'A', 'z') AS rep, concat_ws('-', n_name, 'x') AS cw, substr(n_name, 2, 3) AS sub, translate(n_name, 'AEI', '123') AS tr, ascii(n_name) AS asc_, left(n_name, 2) AS l2, right(n_name, 2) AS r2 FROM input", ()),
    "sql_case_cast": ("part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS class, CAST(p_size AS BIGINT) + 1 AS more, coalesce(nullif(p_size, 1), 0) AS z, p_size BETWEEN 5 AND 9 AS among FROM input", ()),
    "sql_like": ("part", "SELECT p_partkey FROM input WHERE p_type LIKE '%A%' OR p_name ILIKE 'a%'", ()),
    "sql_bool_bit": ("events", "SELECT user_id, bool_and(value > 1) AS every_, bool_or(value > 90) AS some_, bit_xor(event_id) AS x FROM input GROUP BY user_id", ()),
    "sql_stats": ("lineitem", "SELECT l_returnflag, round(var_samp(l_quantity), 4) AS v, round(stddev_pop(l_quantity), 4) AS s, round(corr(l_quantity, l_extendedprice), 6) AS c, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM input GROUP BY l_returnflag", ()),
}

#: The same meaning in two dialects.
DIALECT_SQL: dict[str, tuple[str, str, str]] = {
    "sql_regex_fns": ("events", "SELECT event_id, regexp_like(event_type, '^c') AS m, regexp_replace(event_type, '[aeiou]', '_') AS r, regexp_count(event_type, 'i') AS n FROM input", "SELECT event_id, regexp_matches(event_type, '^c') AS m, regexp_replace(event_type, '[aeiou]', '_', 'g') AS r, CAST(len(regexp_extract_all(event_type, 'i')) AS INTEGER) AS n FROM events"),
    "sql_array_fns": ("embeddings", "SELECT vec_id, size(embedding) AS n, round(element_at(embedding, 1), 5) AS head, round(array_max(embedding), 5) AS top, size(slice(embedding, 1, 3)) AS three FROM input", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(embedding[1], 5) AS head, round(list_max(embedding), 5) AS top, CAST(len(embedding[1:3]) AS INTEGER) AS three FROM embeddings"),
    "sql_median": ("lineitem", "SELECT l_linestatus, round(median(l_quantity), 4) AS med FROM input GROUP BY l_linestatus", "SELECT l_linestatus, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY l_linestatus"),
    "sql_string_agg": ("nation", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM input GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
}


SHARED_SQL |= SHARED
DIALECT_SQL |= DIALECT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of their user; an update straight after a delete is a create."""
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "view", "r").when(F.col("event_type") == "error", "d").otherwise("u")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    raw = table(spark, sf_dir, "events").withColumn("op0", op).withColumn("pos", F.row_number().over(w).cast("long"))
    fixed = F.when((F.col("op0") == "u") & (F.lag("op0").over(w) == "d"), "c").otherwise(F.col("op0"))
    return raw.withColumn("op", fixed).select("user_id", "op", "pos", F.col("event_id").alias("version"), "event_type", "value")


CHANGES = """WITH raw AS (SELECT *, CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END AS op0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
ch AS (SELECT user_id, CASE WHEN op0 = 'u' AND lag(op0) OVER (PARTITION BY user_id ORDER BY pos) = 'd' THEN 'c' ELSE op0 END AS op, pos, event_id AS version, event_type, value FROM raw)"""


def _collapsed_sql(value_mask: str) -> str:
    return (
        f"{CHANGES}, col AS (SELECT user_id, arg_max(op, pos) AS lastop, coalesce(arg_max(op, pos) FILTER (WHERE op IN ('c', 'r')), 'u') AS made, arg_max(version, pos) AS version, max(pos) AS pos, "
        f"arg_max(event_type, pos) FILTER (WHERE op <> 'd') AS event_type, arg_max(value, pos) FILTER (WHERE op <> 'd' AND (op IN ('c', 'r') OR {value_mask})) AS value FROM ch GROUP BY user_id), "
        "done AS (SELECT user_id, CASE WHEN lastop = 'd' THEN 'd' ELSE made END AS op, CASE WHEN lastop <> 'd' THEN event_type END AS event_type, CASE WHEN lastop <> 'd' THEN value END AS value, version, pos FROM col)"
    )


def _collapse(spark: SparkSession, sf_dir: str, partial: bool = False) -> DataFrame:
    masks = {"value": F.col("event_type") == "purchase"} if partial else None
    return changelog.collapse(change_events(spark, sf_dir), ["user_id"], ["event_type", "value"], masks=masks)


def changelog_apply_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = spark.range(0, 100).select(F.col("id").alias("user_id"), F.lit("old").alias("event_type"), F.lit(0.0).alias("value"))
    return changelog.apply_to_state(state, _collapse(spark, sf_dir), ["user_id"], ["event_type", "value"])


def changelog_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.runs(change_events(spark, sf_dir), ["user_id"]).select("user_id", "pos", "op_class", F.col("run").cast("long").alias("run"))


COLUMNS = {"id": ("$.event_id", "bigint", False), "user": ("$.user_id", "bigint", False), "kind": ("$.event_type", "string", True)}


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse_json(generator.messages(table(spark, sf_dir, "events")).drop("event_id"), COLUMNS)[0].select("topic", "partition", "offset", "id", "user", "kind")


def json_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse_json(generator.messages(table(spark, sf_dir, "events")).drop("event_id"), COLUMNS)[1].select("raw_base64", "error_message", "partition", "offset")


def json_parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("props").cast("binary").alias("value"))
    return parsers.parse_json(events, {"k": ("$.k", "bigint", False)})[0]


def tskv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("tskv\tlevel="), F.col("event_type"), F.lit("\tcount="), F.col("event_id").cast("string"))
    return parsers.parse_tskv(table(spark, sf_dir, "events").select(text.cast("binary").alias("value")), {"level": "string", "count": "bigint"})


def max_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.messages(table(spark, sf_dir, "events")).groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def raw_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsers.raw_to_table(generator.messages(table(spark, sf_dir, "events")))
    return out.select("topic", "partition", "offset", "tombstone", F.get_json_object(F.col("value").cast("string"), "$.event_type").alias("kind"))


def raw_to_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages; malformed ones have no kind, and their bytes as they came."""
    out = parsers.raw_to_table(generator.messages(table(spark, sf_dir, "events")))
    kind = F.get_json_object(F.col("value").cast("string"), "$.event_type")
    return out.select("topic", "partition", "offset", "tombstone", kind.alias("kind"), F.when(kind.isNull(), F.base64("value")).alias("raw_base64"))


def table_union_by_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    parts = {TableId("raw", "events_click"): e.where("event_type = 'click'"), TableId("raw", "events_view"): e.where("event_type = 'view'")}
    named: dict[TableId, list[DataFrame]] = {}
    for k, v in parts.items():
        named.setdefault(rename(k, r"events_\w+$", "events"), []).append(v)
    (name, frames), *rest = named.items()
    assert not rest
    return union_renamed(frames).withColumn("table", F.lit(name.text()))


def record_time_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = serializers.record_time_path(F.col("ts"), 3600)
    return table(spark, sf_dir, "events").groupBy(path.alias("path")).agg(F.count("*").alias("n"))


def ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation")
    return t.select("n_nationkey", serializers.ndjson(t).alias("line"))


def debezium_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a change: deletes have no after image."""
    ch = change_events(spark, sf_dir)
    after = F.when(F.col("op") != "d", F.struct("user_id", "event_type"))
    line = serializers.debezium(F.col("op"), F.lit(None).cast("string"), after, F.col("version"))
    return ch.select("version", F.get_json_object(line, "$.op").alias("op"), F.get_json_object(line, "$.after.event_type").alias("kind"))


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in ("region", "nation", "events", "orders")]
    return union_renamed(frames)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then SQL over what is left."""
    return run_sql(filter_eq(table(spark, sf_dir, "events"), "event_type", "purchase"), "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM input GROUP BY user_id")


def _sql(source: str, sql: str, others: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: run_sql(table(spark, d, source), sql, **{t: table(spark, d, t) for t in others})


MSG = "WITH m AS (SELECT *, 'events' AS topic, user_id % 4 AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off FROM events) "

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "filter_eq": lambda s, d: filter_eq(table(s, d, "events"), "event_type", "click").select("event_id", "user_id", "event_type"),
    **{k: _sql(*v) for k, v in SHARED_SQL.items()},
    **{k: _sql(src, sql) for k, (src, sql, _) in DIALECT_SQL.items()},
    "changelog_collapse": _collapse,
    "changelog_collapse_partial": lambda s, d: _collapse(s, d, True),
    "changelog_apply_state": changelog_apply_state,
    "changelog_runs": changelog_runs,
    "json_parse": json_parse,
    "json_dlq": json_dlq,
    "json_parse_props": json_parse_props,
    "tskv_parse": tskv_parse,
    "raw_to_table": raw_to_table,
    "raw_to_table_all": raw_to_table_all,
    "max_offset": max_offset,
    "table_union_by_rename": table_union_by_rename,
    "record_time_partition": record_time_partition,
    "ndjson": ndjson,
    "debezium_emit": debezium_emit,
    "generator_numeric": lambda s, d: generator.numeric(s, 4, 1000, 5),
    "row_counts": row_counts,
}

ORACLES: dict[str, str] = {
    "flagship": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "filter_eq": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click'",
    **{k: f"WITH RECURSIVE {sql[15:]}" if sql.startswith("WITH RECURSIVE") else (f"WITH input AS (SELECT * FROM {src}), {sql[5:]}" if sql.startswith("WITH ") else f"WITH input AS (SELECT * FROM {src}) {sql}") for k, (src, sql, _) in SHARED_SQL.items()},
    **{k: sql for k, (_, _, sql) in DIALECT_SQL.items()},
    "changelog_collapse": f"{_collapsed_sql('TRUE')} SELECT user_id, op, event_type, value, version, pos FROM done",
    "changelog_collapse_partial": f"""{_collapsed_sql("event_type = 'purchase'")} SELECT user_id, op, event_type, value, version, pos FROM done""",
    "changelog_apply_state": f"""{_collapsed_sql('TRUE')}, st AS (SELECT range AS user_id FROM range(100)) SELECT coalesce(st.user_id, done.user_id) AS user_id, CASE WHEN done.op IS NULL THEN 'old' ELSE done.event_type END AS event_type, CASE WHEN done.op IS NULL THEN 0.0::DOUBLE ELSE done.value END AS value
FROM st FULL JOIN done ON st.user_id = done.user_id WHERE done.op IS NULL OR done.op IN ('c', 'r') OR (done.op = 'u' AND st.user_id IS NOT NULL)""",
    "changelog_runs": f"""{CHANGES}, k AS (SELECT *, CASE WHEN op IN ('c', 'r') THEN 'upsert' WHEN op = 'u' THEN 'update' ELSE 'delete' END AS op_class FROM ch), n AS (SELECT *, CASE WHEN lag(op_class) OVER (PARTITION BY user_id ORDER BY pos) = op_class THEN 0 ELSE 1 END AS nw FROM k)
SELECT user_id, pos, op_class, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS run FROM n""",
    "json_parse": MSG + 'SELECT topic, part AS partition, off AS "offset", event_id AS id, user_id AS "user", event_type AS kind FROM m WHERE event_id % 17 <> 0',
    "json_dlq": MSG + """SELECT to_base64(encode('{broken ' || event_id)) AS raw_base64, 'not a JSON document' AS error_message, part AS partition, off AS "offset" FROM m WHERE event_id % 17 = 0""",
    "json_parse_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "tskv_parse": 'SELECT event_type AS level, event_id AS "count" FROM events',
    "raw_to_table": MSG + """SELECT topic, part AS partition, off AS "offset", FALSE AS tombstone, CASE WHEN event_id % 17 <> 0 THEN event_type END AS kind FROM m""",
    "raw_to_table_all": MSG + """SELECT topic, part AS partition, off AS "offset", FALSE AS tombstone, CASE WHEN event_id % 17 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 17 = 0 THEN to_base64(encode('{broken ' || event_id)) END AS raw_base64 FROM m""",
    "max_offset": "SELECT 'events' AS topic, user_id % 4 AS partition, count(*) AS next_offset FROM events GROUP BY user_id % 4",
    "table_union_by_rename": "SELECT event_id, event_type, 'raw.events' AS \"table\" FROM events WHERE event_type IN ('click', 'view')",
    "record_time_partition": "SELECT strftime(date_trunc('hour', ts), '%Y/%m/%d/%H') AS path, count(*) AS n FROM events GROUP BY 1",
    "ndjson": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""",
    "debezium_emit": f"{CHANGES} SELECT version, op, CASE WHEN op <> 'd' THEN event_type END AS kind FROM ch",
    "generator_numeric": "SELECT range AS column_1, xor(range, 1) AS column_2, xor(range, 2) AS column_3, xor(range, 3) AS column_4 FROM range(5, 1005)",
    "row_counts": "SELECT 'region' AS \"table\", count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders",
}

QUERIES |= queries_delivery.QUERIES
ORACLES |= queries_delivery.ORACLES
