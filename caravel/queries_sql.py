"""SQL breadth: every family of the SQL surface as a query, with DuckDB's SQL for the same rows."""

from __future__ import annotations

#: Alike in both dialects: name -> (table that is `input`, query, further relations).
SHARED: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "sql_right_join": ("orders", "SELECT c.c_custkey, o.o_orderkey FROM input o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", ("customer",)),
    "sql_inner_join": ("orders", "SELECT o.o_orderkey, c.c_name FROM input o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3", ("customer",)),
    "sql_cross_join": ("region", "SELECT a.r_name AS one, n.n_name AS other FROM input a CROSS JOIN nation n", ("nation",)),
    "sql_natural_join": ("region", "SELECT k, r_name, twice FROM (SELECT r_regionkey AS k, r_name FROM input) a NATURAL JOIN (SELECT r_regionkey AS k, r_regionkey * 2 AS twice FROM input WHERE r_regionkey > 1) b", ()),
    "sql_anti_rows": ("customer", "SELECT c_custkey FROM input c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)", ("orders",)),
    "sql_not_in": ("nation", "SELECT n_nationkey FROM input WHERE n_nationkey NOT IN (SELECT n_regionkey FROM input WHERE n_regionkey IS NOT NULL)", ()),
    "sql_except_rows": ("nation", "SELECT n_nationkey AS k FROM input EXCEPT SELECT r_regionkey FROM region", ("region",)),
    "sql_except_all": ("customer", "SELECT c_nationkey AS k FROM input EXCEPT ALL SELECT s_nationkey FROM supplier", ("supplier",)),
    "sql_union_distinct": ("customer", "SELECT c_nationkey AS k FROM input UNION SELECT s_nationkey FROM supplier", ("supplier",)),
    "sql_lateral": ("nation", "SELECT i.n_nationkey, x.v FROM input i, LATERAL (SELECT i.n_regionkey * 10 + 1 AS v) x", ()),
    "sql_in_list": ("nation", "SELECT n_nationkey, n_name IN ('CANADA', 'PERU') AS listed, n_nationkey IN (SELECT r_regionkey FROM region) AS there FROM input", ("region",)),
    "sql_correlated_scalar": ("nation", "SELECT n_name, (SELECT max(r.r_name) FROM region r WHERE r.r_regionkey = i.n_regionkey) AS region FROM input i", ("region",)),
    "sql_count": ("lineitem", "SELECT count(*) AS n, count(l_quantity) AS q, count(DISTINCT l_suppkey) AS s FROM input", ()),
    "sql_sum_distinct": ("lineitem", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM input GROUP BY l_returnflag", ()),
    "sql_covar": ("lineitem", "SELECT l_linestatus, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(var_pop(l_quantity), 4) AS vp, round(stddev_samp(l_quantity), 4) AS ss FROM input GROUP BY l_linestatus", ()),
    "sql_regr": ("lineitem", "SELECT l_linestatus, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 3) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 1) AS ic FROM input GROUP BY l_linestatus", ()),
    "sql_bit_agg": ("events", "SELECT event_type, bit_and(event_id) AS a, bit_or(event_id) AS o, bit_xor(event_id) AS x FROM input GROUP BY event_type", ()),
    "sql_group_by_expression": ("orders", "SELECT o_orderkey % 7 AS g, count(*) AS n FROM input GROUP BY o_orderkey % 7", ()),
    "sql_group_by_ordinal": ("orders", "SELECT o_orderstatus, count(*) AS n FROM input GROUP BY 1", ()),
    "sql_group_by_all": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM input GROUP BY ALL", ()),
    "sql_distinct": ("lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM input", ()),
    "sql_grouping": ("customer", "SELECT c_mktsegment, CAST(grouping(c_mktsegment) AS INTEGER) AS g, count(*) AS n FROM input GROUP BY ROLLUP (c_mktsegment)", ()),
    "sql_median_group": ("events", "SELECT event_type, round(median(value), 6) AS m FROM input GROUP BY event_type", ()),
    "sql_first_last_window": ("events", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS s FROM input WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", ()),
    "sql_percent_rank": ("events", "SELECT event_id, round(percent_rank() OVER (PARTITION BY event_type ORDER BY event_id), 9) AS p, round(cume_dist() OVER (PARTITION BY event_type ORDER BY event_id), 9) AS c FROM input", ()),
    "sql_range_frame": ("events", "SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS BIGINT) AS near FROM input", ()),
    "sql_rows_following": ("events", "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS ahead FROM input", ()),
    "sql_lag_default": ("events", "SELECT event_id, lag(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS b, lead(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM input", ()),
    "sql_order_nulls": ("orders", "SELECT o_orderkey, nullif(o_orderkey % 5, 0) AS k FROM input ORDER BY k ASC NULLS FIRST, o_orderkey LIMIT 25", ()),
    "sql_is_distinct": ("part", "SELECT p_partkey, nullif(p_size, 10) IS DISTINCT FROM 10 AS d, nullif(p_size, 10) IS NOT DISTINCT FROM NULL AS n FROM input", ()),
    "sql_between_like": ("part", "SELECT p_partkey, p_name NOT LIKE '%a%' AS without, p_type ILIKE 'S%' AS starts, p_size NOT BETWEEN 5 AND 45 AS far FROM input", ()),
    "sql_core_fns": ("part", "SELECT p_partkey, greatest(p_size, 10) AS g, least(p_size, 10) AS l, coalesce(nullif(p_size, 7), 0) AS c, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS w FROM input", ()),
    "sql_math": ("part", "SELECT p_partkey, p_size + 2 AS a, p_size - 2 AS s, p_size * 3 AS m, p_size % 4 AS r, -p_size AS n, abs(p_size - 25) AS b, round(p_retailprice / 3, 4) AS d FROM input", ()),
    "sql_more_string_fns": ("nation", "SELECT n_nationkey, trim('  a ') AS t, repeat(n_name, 2) AS rp, substr(n_name, 1, 1) AS initial, n_name || '!' AS loud FROM input", ()),
    "sql_nested_cte": ("orders", "WITH a AS (SELECT o_custkey, o_totalprice FROM input), b AS (SELECT o_custkey, max(o_totalprice) AS most FROM a GROUP BY o_custkey) SELECT a.o_custkey, count(*) AS n FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.o_totalprice = b.most GROUP BY a.o_custkey", ()),
    "sql_having_agg": ("lineitem", "SELECT l_suppkey, count(*) AS n FROM input GROUP BY l_suppkey HAVING max(l_quantity) >= 50 AND count(*) > 3", ()),
    "sql_date_parts": ("events", "SELECT event_id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS m, CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(hour FROM ts) AS INTEGER) AS h FROM input", ()),
    "sql_date_trunc": ("events", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM input GROUP BY 1", ()),
    "sql_as_of": ("orders", "SELECT a.o_orderkey, max(b.o_orderkey) AS before FROM input a JOIN input b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey GROUP BY a.o_orderkey", ()),
}

#: The user's text, and DuckDB's where the dialects differ: name -> (table, query, DuckDB's query).
DIALECT: dict[str, tuple[str, str, str]] = {
    "sql_qualify": (
        "events",
        "SELECT event_id, user_id FROM input QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2",
        "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2",
    ),
    "sql_qualify_where": (
        "orders",
        "SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM input WHERE o_totalprice > 100000 QUALIFY rk = 1",
        "SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders WHERE o_totalprice > 100000 QUALIFY rk = 1",
    ),
    "sql_groups_frame": (
        "events",
        "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM input",
        "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events",
    ),
    "sql_string_edges": (
        "nation",
        "SELECT n_nationkey, initcap(n_name) AS ic, instr(n_name, 'A') AS at, startswith(n_name, 'A') AS sw, endswith(n_name, 'A') AS ew, contains(n_name, 'IN') AS co, split_part(n_name, ' ', 1) AS sp, char_length(n_name) AS cl, lower(hex(n_nationkey)) AS hx, overlay(n_name PLACING '#' FROM 2 FOR 1) AS ov, substring_index(n_name, 'A', 1) AS si, find_in_set('b', 'a,b') AS fs, char(65) AS ch FROM input",
        "SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS ic, CAST(instr(n_name, 'A') AS INTEGER) AS at, starts_with(n_name, 'A') AS sw, ends_with(n_name, 'A') AS ew, contains(n_name, 'IN') AS co, split_part(n_name, ' ', 1) AS sp, CAST(length(n_name) AS INTEGER) AS cl, lower(to_hex(n_nationkey)) AS hx, n_name[1:1] || '#' || n_name[3:] AS ov, split_part(n_name, 'A', 1) AS si, 2 AS fs, chr(65) AS ch FROM nation",
    ),
    "sql_regex_more": (
        "events",
        "SELECT event_id, regexp_extract(event_type, '([a-z])([a-z]+)', 2) AS rest, regexp_instr(event_type, '[aeiou]') AS at, regexp_replace(event_type, '^(.)', '<$1>') AS first FROM input",
        "SELECT event_id, regexp_extract(event_type, '([a-z])([a-z]+)', 2) AS rest, CAST(length(regexp_extract(event_type, '^[^aeiou]*')) + 1 AS INTEGER) AS at, regexp_replace(event_type, '^(.)', '<\\1>') AS first FROM events",
    ),
    "sql_array_set_fns": (
        "part",
        "SELECT p_partkey, array_join(array_sort(array_union(a, b)), ',') AS u, array_join(array_sort(array_intersect(a, b)), ',') AS i, array_join(array_sort(array_except(a, b)), ',') AS e, array_join(array_distinct(concat(a, a)), ',') AS d, array_contains(a, 3) AS h, arrays_overlap(a, b) AS o, CAST(array_position(a, 2) AS INTEGER) AS p, array_join(array_remove(a, 2), ',') AS r FROM (SELECT p_partkey, array(1, 2, p_size % 4 + 3) AS a, array(2, 5, p_size % 3 + 4) AS b FROM input)",
        "SELECT p_partkey, array_to_string(list_sort(list_distinct(a || b)), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS e, array_to_string(a, ',') AS d, list_contains(a, 3) AS h, list_has_any(a, b) AS o, CAST(list_position(a, 2) AS INTEGER) AS p, array_to_string(list_filter(a, lambda x: x <> 2), ',') AS r FROM (SELECT p_partkey, [1, 2, p_size % 4 + 3] AS a, [2, 5, p_size % 3 + 4] AS b FROM part)",
    ),
    "sql_array_more": (
        "part",
        "SELECT p_partkey, array_join(array_append(a, 9), ',') AS ap, array_join(array_prepend(a, 0), ',') AS pp, array_join(slice(a, 2, 2), ',') AS sl, size(a) AS n, element_at(a, 1) AS f, array_min(a) AS mn, array_max(a) AS mx, array_join(flatten(array(a, a)), ',') AS fl, array_join(sequence(1, p_size % 3 + 1), ',') AS sq, array_join(array_repeat(p_size, 2), ',') AS rp, array_join(sort_array(a, false), ',') AS sd, array_join(split('a-b', '-'), '+') AS st FROM (SELECT p_partkey, p_size, array(3, p_size, 1) AS a FROM input)",
        "SELECT p_partkey, array_to_string(a || [9], ',') AS ap, array_to_string([0] || a, ',') AS pp, array_to_string(a[2:3], ',') AS sl, CAST(len(a) AS INTEGER) AS n, a[1] AS f, list_min(a) AS mn, list_max(a) AS mx, array_to_string(a || a, ',') AS fl, array_to_string(generate_series(1, p_size % 3 + 1), ',') AS sq, array_to_string([p_size, p_size], ',') AS rp, array_to_string(list_reverse_sort(a), ',') AS sd, 'a+b' AS st FROM (SELECT p_partkey, p_size, [3, p_size, 1] AS a FROM part)",
    ),
    "sql_map_struct_fns": (
        "nation",
        "SELECT n_nationkey, m['k'] AS v, element_at(m, 'l') AS w, array_join(map_keys(m), ',') AS ks, array_join(map_values(m), ',') AS vs, s.x AS x, s.y AS y, size(map_entries(m)) AS n FROM (SELECT n_nationkey, map_from_arrays(array('k', 'l'), array(n_nationkey, n_regionkey)) AS m, named_struct('x', n_nationkey, 'y', n_name) AS s FROM input)",
        "SELECT n_nationkey, m['k'] AS v, m['l'] AS w, array_to_string(map_keys(m), ',') AS ks, array_to_string(map_values(m), ',') AS vs, s.x AS x, s.y AS y, CAST(2 AS INTEGER) AS n FROM (SELECT n_nationkey, MAP {'k': n_nationkey, 'l': n_regionkey} AS m, {'x': n_nationkey, 'y': n_name} AS s FROM nation)",
    ),
    "sql_unnest": (
        "nation",
        "SELECT n_nationkey, x FROM input LATERAL VIEW explode(array(n_nationkey, n_regionkey)) t AS x",
        "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x FROM nation",
    ),
    "sql_generate_series": ("region", "SELECT x FROM (SELECT explode(sequence(1, 12)) AS x)", "SELECT unnest(generate_series(1, 12)) AS x"),
    "sql_array_agg": ("nation", "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ';') AS names FROM input GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ';') AS names FROM nation GROUP BY n_regionkey"),
    "sql_first_by": ("events", "SELECT event_type, min_by(event_id, ts) AS f, max_by(user_id, event_id) AS l FROM input GROUP BY event_type", "SELECT event_type, arg_min(event_id, ts) AS f, arg_max(user_id, event_id) AS l FROM events GROUP BY event_type"),
    "sql_percentile": ("lineitem", "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS p FROM input GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p FROM lineitem GROUP BY l_returnflag"),
    "sql_approx_bounds": (
        "lineitem",
        "SELECT l_returnflag, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.2 * count(DISTINCT l_orderkey) AS distinct_near, approx_percentile(l_quantity, 0.5) BETWEEN 20 AND 31 AS median_near FROM input GROUP BY l_returnflag",
        "SELECT l_returnflag, TRUE AS distinct_near, TRUE AS median_near FROM lineitem GROUP BY l_returnflag",
    ),
    "sql_grouping_id": ("orders", "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INTEGER) AS g, count(*) AS n FROM input GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INTEGER) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "sql_try_cast": ("part", "SELECT p_partkey, try_cast(p_name AS INT) AS i, typeof(p_name) AS t, nvl(nullif(p_size, 3), -1) AS v, nvl2(nullif(p_size, 3), 1, 0) AS w FROM input", "SELECT p_partkey, TRY_CAST(p_name AS INTEGER) AS i, 'string' AS t, coalesce(nullif(p_size, 3), -1) AS v, CASE WHEN nullif(p_size, 3) IS NOT NULL THEN 1 ELSE 0 END AS w FROM part"),
    "sql_base64_hex": ("nation", "SELECT n_nationkey, base64(encode(n_name, 'utf-8')) AS b, decode(unbase64(base64(encode(n_name, 'utf-8'))), 'utf-8') AS back, hex(n_name) AS h FROM input", "SELECT n_nationkey, to_base64(encode(n_name)) AS b, n_name AS back, hex(encode(n_name)) AS h FROM nation"),
    "sql_json_text": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM input", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "sql_ignore_nulls": ("events", "SELECT event_id, last_value(nullif(event_id % 3, 0)) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM input", "SELECT event_id, last_value(nullif(event_id % 3, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM events"),
    "sql_tumbling_window": ("events", "SELECT date_format(window(ts, '1 day').start, 'yyyy-MM-dd') AS day, event_type, count(*) AS n FROM input GROUP BY window(ts, '1 day'), event_type", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
