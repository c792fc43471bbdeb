"""Queries over the dialect's operators, each with the DuckDB SQL that says what it must return.

A query is dialect SQL, or a script and the SELECT that shows its outcome, run by Database over the tables of a data folder.
"""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, oracle: str | None = None, script: str = "", pragma: str = "") -> None:
    """Registers a query; without an oracle of its own the same text runs on both sides."""

    def run(spark, sf_dir):
        from larkspur.api import Database

        db = Database(spark).attach_folder(sf_dir)
        if script:
            db.exec(script)
        return db.query(sql)

    _QUERIES[name] = run
    if oracle != "":
        _ORACLES[name] = oracle or sql


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


B = "CAST({} AS BIGINT)".format
D = "CAST({} AS DOUBLE)".format
LKEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# -- scans and projection
_add("pricing_summary",
     "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02 00:00:00' GROUP BY 1, 2 ORDER BY 1, 2",
     "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY 1, 2")
_add("select_where", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_discount >= 0.05 AND l_returnflag = 'R'")
_add("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_add("star_join_using", "SELECT * FROM (SELECT n_name, n_regionkey AS k FROM nation) JOIN (SELECT r_name, r_regionkey AS k FROM region) USING (k)",
     f"SELECT n_name, {B('k')} AS k, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) JOIN (SELECT r_name, r_regionkey AS k FROM region) USING (k)")
_add("values_clause", "SELECT a.column1 AS x, a.column2 AS y FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS a", f"SELECT {B('x')} AS x, y FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS a(x, y)")
_add("generate_series", "SELECT value AS v, value * value AS sq FROM generate_series(1, 100, 3)", f"SELECT {B('x')} AS v, {B('x * x')} AS sq FROM range(1, 101, 3) t(x)")
_add("view_scan", "SELECT r_name, n FROM big_regions ORDER BY 1", f"SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 1",
     script="CREATE VIEW big_regions(r_name, n) AS SELECT r_name, count(*) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) > 1")
_add("no_from", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, NULL IS NULL AS yes", f"SELECT {B('2')} AS two, 'ab' AS ab, {B('1')} AS yes")

# -- joins
_add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000")
_add("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey")
_add("join_right", "SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id", f"SELECT d.doc_id, {B('l.quality')} AS quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
_add("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_nationkey < 12")
_add("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
_add("join_comma_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_add("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
_add("join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)",
     f"SELECT {B('n_regionkey')} AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("join_natural_full", "SELECT * FROM (SELECT s_suppkey AS k, s_name FROM supplier) NATURAL FULL JOIN (SELECT c_custkey + 50 AS k, c_name FROM customer)",
     "SELECT coalesce(s_suppkey, c_custkey + 50) AS k, s_name, c_name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 50")
_add("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)",
     f"SELECT {B('n_regionkey')} AS k, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
_add("join_multiway", "SELECT r_name, n_name, count(*) AS orders, round(sum(l_extendedprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name")
_add("join_parenthesised", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey")
_add("join_null_keys", "SELECT a.doc_id, b.doc_id AS other FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) a JOIN (SELECT item_id AS doc_id, NULLIF(item_id, 1) AS q FROM benchmark) b ON a.q = b.q")
_add("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
_add("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
_add("not_in_null", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END FROM region)")
_add("not_in_projected", "SELECT n_nationkey, n_nationkey NOT IN (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END FROM region) AS x FROM nation",
     f"SELECT {B('n_nationkey')} AS n_nationkey, {B('n_nationkey NOT IN (SELECT CASE WHEN r_regionkey < 3 THEN r_regionkey END FROM region)')} AS x FROM nation")
_add("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name > b.n_name")
_add("join_tvf", "SELECT e.event_id, j.key, CAST(j.value AS INTEGER) AS v FROM events e, json_each(e.props) j", f"SELECT event_id, 'k' AS key, {B("json_extract_string(props, '$.k')")} AS v FROM events")

# -- aggregation
_add("agg_all", "SELECT o_orderstatus, count(*) AS n, count(o_totalprice) AS c, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY o_orderstatus")
_add("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, sum(l_linenumber) FILTER (WHERE l_discount > 0.05) AS s FROM lineitem GROUP BY l_returnflag",
     f"SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, {B('sum(l_linenumber) FILTER (WHERE l_discount > 0.05)')} AS s FROM lineitem GROUP BY 1")
_add("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey % 10) AS s FROM orders GROUP BY o_orderstatus", f"SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, {B('sum(DISTINCT o_custkey % 10)')} AS s FROM orders GROUP BY 1")
_add("agg_total", "SELECT o_orderstatus, round(total(o_totalprice), 2) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(coalesce(sum(o_totalprice), 0.0::double), 2) AS t FROM orders GROUP BY 1")
_add("agg_empty_input", "SELECT count(*) AS n, sum(o_custkey) AS s, total(o_custkey) AS t, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", f"SELECT count(*) AS n, {B('sum(o_custkey)')} AS s, {D('0')} AS t, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
_add("group_ordinal_alias", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment AS s2, count(*) FROM customer WHERE c_acctbal < 0 GROUP BY s2",
     "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*) FROM customer WHERE c_acctbal < 0 GROUP BY 1")
_add("group_expr", "SELECT l_partkey / 100 AS bucket, l_linenumber % 2 AS odd, count(*) AS n FROM lineitem GROUP BY l_partkey / 100, l_linenumber % 2", f"SELECT {B('l_partkey // 100')} AS bucket, {B('l_linenumber % 2')} AS odd, count(*) AS n FROM lineitem GROUP BY ALL")
_add("having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
_add("having_no_group", "SELECT max(o_totalprice) AS m FROM orders HAVING count(*) > 10", "SELECT max(o_totalprice) AS m FROM orders HAVING count(*) > 10")
_add("group_concat_ordered", "SELECT r_name, group_concat(n_name, '|' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
_add("group_concat_distinct", "SELECT o_orderstatus, group_concat(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1")
_add("json_group_array", "SELECT n_regionkey, json_group_array(n_nationkey ORDER BY n_nationkey) AS j FROM nation GROUP BY n_regionkey", f"SELECT {B('n_regionkey')} AS n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
_add("json_group_object", "SELECT n_regionkey, json_group_object(n_name, n_nationkey ORDER BY n_nationkey) AS j FROM nation GROUP BY n_regionkey",
     f"SELECT {B('n_regionkey')} AS n_regionkey, '{{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_nationkey) || '}}' AS j FROM nation GROUP BY n_regionkey")
_add("bare_column_max", "SELECT o_custkey, max(o_orderkey) AS m, o_orderstatus FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_orderkey) AS m, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
_add("group_nocase", "SELECT lower(n) AS k, count(*) AS c FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) GROUP BY n COLLATE NOCASE", "SELECT lower(p_name) AS k, count(*) AS c FROM part GROUP BY 1")
_add("count_null_outer", "SELECT lang, count(*) AS n, count(quality) AS q, sum(quality) AS s FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang", f"SELECT lang, count(*) AS n, count(quality) AS q, {B('sum(quality)')} AS s FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")

# -- windows
_W = "PARTITION BY o_custkey ORDER BY o_orderkey"
_add("win_ranking", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr FROM orders")
_add("win_ntile_cume", f"SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS nt, round(percent_rank() OVER ({_W}), 6) AS pr, round(cume_dist() OVER ({_W}), 6) AS cd FROM orders")
_add("win_lag_lead_default", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS a, lead(o_orderkey, 2, -1) OVER ({_W}) AS b FROM orders")
_add("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W}) AS f, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_W}) AS n FROM orders")
_add("win_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS c FROM orders")
_add("win_range_numeric", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c FROM orders")
_add("win_range_desc", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS c FROM orders")
_Y = "PARTITION BY o_custkey ORDER BY o_orderpriority"
_add("win_groups", f"SELECT o_orderkey, sum(o_orderkey) OVER ({_Y} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM orders", f"SELECT o_orderkey, {B(f'sum(o_orderkey) OVER ({_Y} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS s FROM orders")
_add("win_exclude_current", f"SELECT o_orderkey, sum(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS s FROM orders", f"SELECT o_orderkey, {B(f'sum(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)')} AS s FROM orders")
_add("win_exclude_group", f"SELECT o_orderkey, count(*) OVER ({_Y} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS c, min(o_orderkey) OVER ({_Y} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS m FROM orders")
_add("win_exclude_ties", f"SELECT o_orderkey, count(*) OVER ({_Y} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS c, max(o_orderkey) OVER ({_Y} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE NO OTHERS) > 0 AS m FROM orders",
     f"SELECT o_orderkey, count(*) OVER ({_Y} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS c, {B('max(o_orderkey) OVER (PARTITION BY o_custkey) > 0')} AS m FROM orders")
_add("win_filter", f"SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'O') OVER ({_W}) AS c FROM orders")
_add("win_distinct", "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS c FROM orders")
_add("win_named", "SELECT o_orderkey, row_number() OVER w AS a, sum(o_orderkey) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
     f"SELECT o_orderkey, row_number() OVER ({_W}) AS a, {B(f'sum(o_orderkey) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)')} AS b FROM orders")
_add("win_over_aggregate", "SELECT o_custkey, rank() OVER (ORDER BY count(*) DESC) AS r, sum(count(*)) OVER () AS t FROM orders GROUP BY o_custkey", f"SELECT o_custkey, rank() OVER (ORDER BY count(*) DESC) AS r, {B('sum(count(*)) OVER ()')} AS t FROM orders GROUP BY 1")
_add("win_group_concat", "SELECT n_name, group_concat(n_nationkey, '-') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS g FROM nation", "SELECT n_name, string_agg(CAST(n_nationkey AS VARCHAR), '-') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS g FROM nation")

# -- order and limit
_add("order_nulls", "SELECT doc_id, row_number() OVER (ORDER BY quality, doc_id) AS a, row_number() OVER (ORDER BY quality DESC, doc_id) AS d, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id) AS l FROM documents LEFT JOIN labels USING (doc_id)",
     "SELECT doc_id, row_number() OVER (ORDER BY quality NULLS FIRST, doc_id) AS a, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) AS d, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id) AS l FROM documents LEFT JOIN labels USING (doc_id)")
_add("order_nocase", "SELECT n, row_number() OVER (ORDER BY n COLLATE NOCASE, n) AS r FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part)",
     "SELECT n, row_number() OVER (ORDER BY lower(n), n) AS r FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part)")
_add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
_add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
_add("limit_negative", "SELECT r_name FROM region ORDER BY 1 LIMIT -1 OFFSET 2", "SELECT r_name FROM region ORDER BY 1 OFFSET 2")
_add("order_by_expr", "SELECT c_custkey FROM customer ORDER BY c_acctbal * -1, c_custkey LIMIT 25", "SELECT c_custkey FROM customer ORDER BY -c_acctbal, c_custkey LIMIT 25")

# -- set operations
_add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", f"SELECT {B('c_nationkey')} AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_add("union", "SELECT c_nationkey AS k, 'c' AS t FROM customer UNION SELECT s_nationkey, 's' FROM supplier", f"SELECT {B('c_nationkey')} AS k, 'c' AS t FROM customer UNION SELECT s_nationkey, 's' FROM supplier")
_add("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
_add("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_add("compound_left_assoc", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region UNION SELECT 2 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 9",
     f"SELECT {B('k')} AS k FROM (((SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region) UNION SELECT 2) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 9)")
_add("compound_order_limit", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x DESC LIMIT 7")
_add("union_mixed_numbers", "SELECT n_nationkey AS x FROM nation UNION SELECT 0.5", f"SELECT {D('n_nationkey')} AS x FROM nation UNION SELECT 0.5::double")

# -- subqueries and CTEs
_add("scalar_uncorrelated", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9::double FROM orders)")
_add("scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
_add("scalar_first_row", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS k FROM customer")
_add("cte_chain", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b(k, n) AS (SELECT * FROM a WHERE n > 5) SELECT c_mktsegment, count(*) AS c, sum(n) AS s FROM b JOIN customer ON c_custkey = k GROUP BY 1",
     f"WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT * FROM a WHERE n > 5) SELECT c_mktsegment, count(*) AS c, {B('sum(n)')} AS s FROM b JOIN customer ON c_custkey = k GROUP BY 1")
_add("cte_shadow", "WITH nation AS (SELECT 7 AS x) SELECT x FROM nation", f"SELECT {B('7')} AS x")
_add("recursive_series", "WITH RECURSIVE c(x, f) AS (VALUES (1, 1) UNION ALL SELECT x + 1, f * (x + 1) FROM c WHERE x < 15) SELECT x, f FROM c", f"WITH RECURSIVE c(x, f) AS (SELECT {B('1')}, {B('1')} UNION ALL SELECT x + 1, f * (x + 1) FROM c WHERE x < 15) SELECT x, f FROM c")
_add("recursive_tree", "WITH RECURSIVE t(k, depth, path) AS (SELECT 0, 0, '0' UNION ALL SELECT n_nationkey, depth + 1, path || '/' || n_nationkey FROM t JOIN nation ON (n_nationkey - 1) / 2 = t.k AND n_nationkey > 0) SELECT k, depth, path FROM t",
     f"WITH RECURSIVE t(k, depth, path) AS (SELECT {B('0')}, {B('0')}, '0' UNION ALL SELECT {B('n_nationkey')}, depth + 1, path || '/' || n_nationkey FROM t JOIN nation ON (n_nationkey - 1) // 2 = t.k AND n_nationkey > 0) SELECT k, depth, path FROM t")
_add("recursive_union_cycle", "WITH RECURSIVE r(x) AS (SELECT 0 UNION SELECT (x + 7) % 25 FROM r) SELECT x, n_name FROM r JOIN nation ON n_nationkey = x", f"WITH RECURSIVE r(x) AS (SELECT {B('0')} UNION SELECT (x + 7) % 25 FROM r) SELECT x, n_name FROM r JOIN nation ON n_nationkey = x")
_add("recursive_limit", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c LIMIT 12) SELECT x FROM c", f"SELECT {B('x')} AS x FROM range(1, 13) t(x)")
_add("nested_subqueries", "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000))")
_add("correlated_group", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 3) AS n FROM region")

# -- expressions
_add("int_div_mod_zero", f"SELECT {LKEY}, l_partkey / 7 AS d, l_partkey % 7 AS m, -l_partkey / 7 AS nd, l_partkey / (l_linenumber - l_linenumber) AS z, l_partkey % 0 AS zm FROM lineitem",
     f"SELECT l_orderkey, {B('l_linenumber')} AS l_linenumber, l_partkey, l_suppkey, {B('l_partkey // 7')} AS d, {B('l_partkey % 7')} AS m, {B('-(l_partkey // 7)')} AS nd, {B('NULL')} AS z, {B('NULL')} AS zm FROM lineitem")
_add("null_logic", "SELECT doc_id, quality = 1 OR toxic = 1 AS o, quality = 1 AND toxic = 1 AS a, NOT quality = 1 AS n, quality IS NULL AS i FROM documents LEFT JOIN labels USING (doc_id)",
     f"SELECT doc_id, {B('quality = 1 OR toxic = 1')} AS o, {B('quality = 1 AND toxic = 1')} AS a, {B('NOT quality = 1')} AS n, {B('quality IS NULL')} AS i FROM documents LEFT JOIN labels USING (doc_id)")
_add("is_distinct", "SELECT doc_id, quality IS toxic AS a, quality IS NOT 1 AS b, quality IS DISTINCT FROM toxic AS c FROM documents LEFT JOIN labels USING (doc_id)",
     f"SELECT doc_id, {B('quality IS NOT DISTINCT FROM toxic')} AS a, {B('quality IS DISTINCT FROM 1')} AS b, {B('quality IS DISTINCT FROM toxic')} AS c FROM documents LEFT JOIN labels USING (doc_id)")
_add("is_true_false", "SELECT doc_id, quality IS TRUE AS t, quality IS NOT TRUE AS nt, toxic IS FALSE AS f FROM documents LEFT JOIN labels USING (doc_id)", f"SELECT doc_id, {B('coalesce(quality <> 0, false)')} AS t, {B('NOT coalesce(quality <> 0, false)')} AS nt, {B('coalesce(toxic = 0, false)')} AS f FROM documents LEFT JOIN labels USING (doc_id)")
_add("between_in_case", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'mid' WHEN p_size IN (1, 2, 3) THEN 'tiny' ELSE 'other' END AS s, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS b FROM part WHERE p_size NOT IN (7, 8)",
     f"SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'mid' WHEN p_size IN (1, 2, 3) THEN 'tiny' ELSE 'other' END AS s, {B("CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END")} AS b FROM part WHERE p_size NOT IN (7, 8)")
_add("row_values", "SELECT count(*) AS a, sum((o_orderstatus, o_orderkey) >= ('O', 100)) AS b FROM orders WHERE (o_custkey, o_orderkey) < (500, 7) OR (o_custkey, o_orderstatus) = (700, 'F')",
     f"SELECT count(*) AS a, {B("sum(CAST(o_orderstatus > 'O' OR (o_orderstatus = 'O' AND o_orderkey >= 100) AS INT))")} AS b FROM orders WHERE (o_custkey < 500 OR (o_custkey = 500 AND o_orderkey < 7)) OR (o_custkey = 700 AND o_orderstatus = 'F')")
_add("bit_ops", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_partkey AS n FROM part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, p_partkey * 4 AS l, p_partkey // 2 AS r, -p_partkey - 1 AS n FROM part")
_add("like_escape", "SELECT p_partkey, p_name LIKE '%E_' AS a, p_brand LIKE 'brand!#1_' ESCAPE '!' AS b, p_name NOT LIKE 'a%' AS c FROM part", f"SELECT p_partkey, {B("p_name ILIKE '%E_'")} AS a, {B("p_brand ILIKE 'brand#1_'")} AS b, {B("NOT p_name ILIKE 'a%'")} AS c FROM part")
_add("glob", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[13]?' AND p_name NOT GLOB '*[A-Z]*'", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[13]?'")
_add("cast_matrix", "SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST(o_custkey AS TEXT) AS t, CAST(CAST(o_custkey AS TEXT) AS REAL) AS r, CAST('12ab' AS INTEGER) AS p, CAST(o_orderstatus AS INTEGER) AS z FROM orders",
     f"SELECT o_orderkey, {B('trunc(o_totalprice)')} AS i, CAST(o_custkey AS VARCHAR) AS t, {D('o_custkey')} AS r, {B('12')} AS p, {B('0')} AS z FROM orders")
_add("affinity_compare", "SELECT count(*) AS a, sum(o_custkey = '100') AS b, sum(o_orderstatus < 5) AS c, sum(o_custkey < 'x') AS d FROM orders", f"SELECT count(*) AS a, {B('sum(CAST(o_custkey = 100 AS INT))')} AS b, {B('sum(0)')} AS c, {B('count(*)')} AS d FROM orders")
_add("text_truthiness", "SELECT count(*) AS n, sum(CASE WHEN o_orderstatus THEN 1 ELSE 0 END) AS t, sum(CASE WHEN '0.5x' THEN 1 ELSE 0 END) AS h FROM orders", f"SELECT count(*) AS n, {B('sum(0)')} AS t, {B('count(*)')} AS h FROM orders")
_add("collate_rtrim", "SELECT count(*) AS n FROM nation WHERE n_name || '  ' = n_name COLLATE RTRIM", "SELECT count(*) AS n FROM nation")
_add("concat_numbers", "SELECT o_orderkey, o_custkey || '-' || o_orderstatus || '-' || 1.5 AS t FROM orders", "SELECT o_orderkey, o_custkey || '-' || o_orderstatus || '-1.5' AS t FROM orders")
_add("affinity_text_number", "SELECT count(*) AS n FROM events WHERE props ->> 'k' = 3 AND props ->> '$.k' < 4", "SELECT count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 3")

# -- text
_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_add("str_trim_substr_instr", "SELECT p_partkey, trim('  ' || p_name || ' ') AS t, substr(p_name, 3, 4) AS a, substr(p_name, -3) AS b, substr(p_name, -3, 2) AS c, instr(p_name, 'e') AS i, ltrim(p_brand, 'Bra') AS l FROM part",
     f"SELECT p_partkey, trim(p_name) AS t, substring(p_name, 3, 4) AS a, substring(p_name, -3) AS b, substring(p_name, -3, 2) AS c, {B("instr(p_name, 'e')")} AS i, ltrim(p_brand, 'Bra') AS l FROM part")
_add("str_upper_lower_ascii", "SELECT doc_id, upper(text) AS u, lower(text) AS l FROM documents", f"SELECT doc_id, translate(text, '{_LO}', '{_UP}') AS u, translate(text, '{_UP}', '{_LO}') AS l FROM documents")
_add("str_hex_quote_char", "SELECT n_name, hex(n_name) AS h, quote(n_name || '''') AS q, char(65, 66, 233) AS c, unicode(n_name) AS u, unhex('4142') = x'4142' AS b FROM nation", f"SELECT n_name, hex(n_name) AS h, '''' || n_name || '''''''' AS q, 'ABé' AS c, {B('78')} AS u, {B('1')} AS b FROM nation")
_add("str_concat_ws", "SELECT n_name, concat(n_name, NULL, n_regionkey) AS a, concat_ws('-', n_name, NULL, n_regionkey) AS b FROM nation", "SELECT n_name, n_name || n_regionkey AS a, n_name || '-' || n_regionkey AS b FROM nation")
_add("str_printf", "SELECT p_partkey, printf('%05d|%8.2f|%-12s|%x', p_partkey, p_retailprice, p_brand, p_size) AS f FROM part", "SELECT p_partkey, printf('%05d|%8.2f|%-12s|%x', p_partkey, p_retailprice, p_brand, p_size) AS f FROM part")
_add("str_replace_length", "SELECT doc_id, length(text) AS n, octet_length(text) AS o, length(replace(text, 'e', '')) AS r FROM documents", f"SELECT doc_id, {B('length(text)')} AS n, {B('octet_length(encode(text))')} AS o, {B("length(replace(text, 'e', ''))")} AS r FROM documents")
_add("scalar_min_max", "SELECT l_orderkey, max(l_partkey, l_suppkey, 100) AS a, min(l_partkey, l_suppkey) AS b, min(l_partkey, NULL) AS c FROM lineitem", f"SELECT l_orderkey, greatest(l_partkey, l_suppkey, 100) AS a, least(l_partkey, l_suppkey) AS b, {B('NULL')} AS c FROM lineitem")
_add("null_functions", "SELECT doc_id, coalesce(quality, toxic, -1) AS a, ifnull(quality, 5) AS b, nullif(quality, 1) AS c, iif(quality, 'y', 'n') AS d, typeof(quality) AS t FROM documents LEFT JOIN labels USING (doc_id)",
     f"SELECT doc_id, {B('coalesce(quality, toxic, -1)')} AS a, {B('ifnull(quality, 5)')} AS b, {B('nullif(quality, 1)')} AS c, CASE WHEN quality <> 0 THEN 'y' ELSE 'n' END AS d, CASE WHEN quality IS NULL THEN 'null' ELSE 'integer' END AS t FROM documents LEFT JOIN labels USING (doc_id)")

# -- numbers
_add("math_trig", "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(atan2(p_size, 3), 6) AS a, round(degrees(p_size), 6) AS d, acos(p_size + 1) AS n FROM part", f"SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(atan2(p_size, 3), 6) AS a, round(degrees(p_size), 6) AS d, {D('NULL')} AS n FROM part")
_add("math_log_pow", "SELECT p_partkey, round(ln(p_size), 6) AS l, round(log(p_size), 6) AS g, round(log(2, p_size), 6) AS t, round(pow(p_size, 1.5), 4) AS p, round(sqrt(p_size), 6) AS q, round(exp(p_size / 50.0), 6) AS e FROM part",
     "SELECT p_partkey, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS g, round(log2(p_size), 6) AS t, round(pow(p_size, 1.5), 4) AS p, round(sqrt(p_size), 6) AS q, round(exp(p_size / 50.0::double), 6) AS e FROM part")
_add("math_round_trunc_sign", "SELECT c_custkey, round(c_acctbal) AS r, trunc(c_acctbal) AS t, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, sign(c_acctbal) AS s, abs(c_acctbal) AS a FROM customer",
     f"SELECT c_custkey, round(c_acctbal) AS r, trunc(c_acctbal) AS t, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, {B('sign(c_acctbal)')} AS s, abs(c_acctbal) AS a FROM customer")
_add("ieee754", "SELECT n_nationkey, ieee754_mantissa(n_nationkey * 0.25) AS m, ieee754_exponent(n_nationkey * 0.25) AS e, ieee754(n_nationkey, -2) AS v FROM nation",
     f"WITH RECURSIVE h(k, m, e) AS (SELECT {B('n_nationkey')}, {B('n_nationkey')}, {B('CASE WHEN n_nationkey = 0 THEN 0 ELSE -2 END')} FROM nation UNION ALL SELECT k, m // 2, e + 1 FROM h WHERE m % 2 = 0 AND m > 0) SELECT k AS n_nationkey, m, e, {D('k * 0.25')} AS v FROM h WHERE m % 2 = 1 OR m = 0")

# -- dates
_add("dt_format", "SELECT event_id, date(ts) AS d, time(ts) AS t, datetime(ts) AS dt FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt FROM events")
_add("dt_julian", "SELECT event_id, round(julianday(ts), 3) AS j FROM events", "SELECT event_id, round(epoch(ts) / 86400.0::double + 2440587.5::double, 3) AS j FROM events")
_add("dt_unixepoch", "SELECT event_id, unixepoch(ts) AS u FROM events", f"SELECT event_id, {B('floor(epoch(ts))')} AS u FROM events")
_add("dt_strftime", "SELECT event_id, strftime('%Y/%m/%d %H-%M day %j dow %w%%', ts) AS s FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M day %j dow %w%%') AS s FROM events")
_add("dt_month_rollover", "SELECT event_id, date(ts, '+1 month') AS d FROM events", "SELECT event_id, strftime(date_trunc('month', ts) + interval 1 month + to_days(CAST(day(ts) - 1 AS INTEGER)), '%Y-%m-%d') AS d FROM events")
_add("dt_weekday", "SELECT event_id, date(ts, 'weekday 1') AS d FROM events", "SELECT event_id, strftime(ts + to_days(CAST(((1 - dayofweek(ts)) % 7 + 7) % 7 AS INTEGER)), '%Y-%m-%d') AS d FROM events")
_add("dt_start_of", "SELECT event_id, datetime(ts, 'start of month', '+36 hours') AS d, date(ts, 'start of year') AS y FROM events", "SELECT event_id, strftime(date_trunc('month', ts) + interval 36 hour, '%Y-%m-%d %H:%M:%S') AS d, '2024-01-01' AS y FROM events")
_add("dt_from_text", "SELECT o_orderkey, date(substr(o_orderdate, 1, 10), '-10 days') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate - interval 10 day, '%Y-%m-%d') AS d FROM orders")
_add("dt_timediff", "SELECT event_id, timediff(ts, '2024-01-01 00:00:00') AS d FROM events",
     "SELECT event_id, '+0000-00-' || lpad(CAST(day(ts) - 1 AS VARCHAR), 2, '0') || ' ' || strftime(ts, '%H:%M:%S') || '.' || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') AS d FROM events")

# -- JSON
_add("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events", f"SELECT event_id, {B("json_extract_string(props, '$.k')")} AS k FROM events")
_add("json_arrow", "SELECT event_id, props ->> 'k' AS a, props -> '$.k' AS b FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b FROM events")
_add("json_type_valid", "SELECT event_id, json_type(props) AS t, json_type(props, '$.k') AS k, json_valid(props) AS v, json_valid('{x') AS w FROM events", f"SELECT event_id, 'object' AS t, 'integer' AS k, {B('1')} AS v, {B('0')} AS w FROM events")
_add("json_array_length", "SELECT event_id, json_array_length(json_array(1, props, NULL)) AS n, json_array_length(props) AS z FROM events", f"SELECT event_id, {B('3')} AS n, {B('0')} AS z FROM events")
_add("json_set_remove_patch", """SELECT event_id, json_set(props, '$.a', 1) AS s, json_remove(props, '$.k') AS r, json_patch(props, '{"k":null,"z":[1]}') AS p FROM events""",
     """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"a":1}' AS s, '{}' AS r, '{"z":[1]}' AS p FROM events""")
_add("json_build", "SELECT n_name, json_object('name', n_name, 'k', n_nationkey, 'list', json_array(n_regionkey, NULL, 'x')) AS j FROM nation", """SELECT n_name, '{"name":"' || n_name || '","k":' || n_nationkey || ',"list":[' || n_regionkey || ',null,"x"]}' AS j FROM nation""")
_add("json_each", "SELECT e.event_id, j.key, j.value, j.type, j.fullkey, j.path FROM events e, json_each(e.props) j", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type, '$.k' AS fullkey, '$' AS path FROM events")
_add("json_tree", "SELECT e.event_id, count(*) AS n, max(j.fullkey) AS f FROM events e, json_tree(json_array(e.props, e.event_id)) j GROUP BY e.event_id", f"SELECT event_id, {B('3')} AS n, '$[1]' AS f FROM events")
_add("json_pretty_quote", "SELECT n_name, json_quote(n_name) AS q, json_pretty(json_array(n_nationkey)) AS p FROM nation", """SELECT n_name, '"' || n_name || '"' AS q, '[' || chr(10) || '    ' || n_nationkey || chr(10) || ']' AS p FROM nation""")

# -- full text
_FTS = "CREATE VIRTUAL TABLE d USING fts5(text, content='documents', content_rowid='doc_id', tokenize='{}')"
_TOK = f"regexp_extract_all(translate(text, '{_UP}', '{_LO}'), '[a-z0-9]+')"
_J = f"' ' || array_to_string({_TOK}, ' ') || ' '"
for _name, _query, _test in [
    ("fts_term", "the", f"list_contains({_TOK}, 'the')"),
    ("fts_prefix", "thereaf* OR onth*", f"contains({_J}, ' thereaf') OR contains({_J}, ' onth')"),
    ("fts_phrase", '"the and"', f"contains({_J}, ' the and ')"),
    ("fts_boolean", "(the OR der) AND of NOT with", f"(list_contains({_TOK}, 'the') OR list_contains({_TOK}, 'der')) AND list_contains({_TOK}, 'of') AND NOT list_contains({_TOK}, 'with')"),
    ("fts_near", "NEAR(the with, 2)", f"regexp_matches({_J}, ' the( [^ ]+){{0,2}} with ') OR regexp_matches({_J}, ' with( [^ ]+){{0,2}} the ')"),
]:
    _add(_name, f"SELECT rowid AS doc_id FROM d WHERE d MATCH '{_query}'", f"SELECT doc_id FROM documents WHERE {_test}", script=_FTS.format("ascii"))
_add("fts_trigram", "SELECT rowid AS doc_id FROM d WHERE d MATCH 'thathe'", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thathe')", script=_FTS.format("trigram"))
_add("fts_vocab", "SELECT term, doc, cnt FROM v", f"SELECT term, count(DISTINCT doc_id) AS doc, count(*) AS cnt FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1", script=_FTS.format("ascii") + "; CREATE VIRTUAL TABLE v USING fts5vocab(d, row)")
_add("fts_bm25", "SELECT rowid AS doc_id, round(bm25(d), 5) AS score FROM d WHERE d MATCH 'with'",
     f"WITH t AS (SELECT doc_id, {_TOK} AS a FROM documents), s AS (SELECT count(*) AS n, avg(len(a)) AS m, count(*) FILTER (WHERE list_contains(a, 'with')) AS df FROM t), x AS (SELECT doc_id, len(list_filter(a, lambda y: y = 'with')) AS tf, len(a) AS dl FROM t WHERE list_contains(a, 'with')) SELECT doc_id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2::double) / (tf + 1.2::double * (0.25 + 0.75 * dl / m)), 5) AS score FROM x, s", script=_FTS.format("ascii"))
_add("fts_highlight", "SELECT rowid AS doc_id, length(highlight(d, 0, '<', '>')) AS n FROM d WHERE d MATCH 'with'", f"SELECT doc_id, {B(f"length(text) + 2 * len(list_filter({_TOK}, lambda y: y = 'with'))")} AS n FROM documents WHERE list_contains({_TOK}, 'with')", script=_FTS.format("ascii"))
_add("fts_porter_rows", "SELECT rowid AS doc_id, snippet(d, 0, '[', ']', '...', 8) AS s FROM d WHERE d MATCH 'running OR licensed'", "", script=_FTS.format("porter ascii"))
_add("rtree_overlap", "SELECT id FROM boxes WHERE x1 >= 10 AND x0 <= 20 AND y1 >= 1000 AND y0 <= 1500", "SELECT p_partkey AS id FROM part WHERE p_size + 2 >= 10 AND p_size <= 20 AND p_retailprice + 10 >= 1000 AND p_retailprice <= 1500",
     script="CREATE VIRTUAL TABLE boxes USING rtree(id, x0, x1, y0, y1); INSERT INTO boxes SELECT p_partkey, p_size, p_size + 2, p_retailprice, p_retailprice + 10 FROM part")

# -- definitions and changes: the state that a script leaves
_COPY = "CREATE TABLE t(k INTEGER PRIMARY KEY, name TEXT, r INTEGER); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation;"
_BASE = f"SELECT {B('n_nationkey')} AS k, n_name AS name, {B('n_regionkey')} AS r FROM nation"
_add("ctas", "SELECT seg, n FROM t", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1", script="CREATE TABLE t AS SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1")
_add("dml_insert_select", "SELECT k, name, r FROM t", _BASE, script=_COPY)
_add("dml_update", "SELECT k, name, r FROM t", f"SELECT k, CASE WHEN k % 3 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN k % 3 = 0 THEN r + 10 ELSE r END AS r FROM ({_BASE})", script=_COPY + "UPDATE t SET name = name || '!', r = r + 10 WHERE k % 3 = 0")
_add("dml_delete", "SELECT k, name, r FROM t", f"SELECT * FROM ({_BASE}) WHERE NOT (r = 2 OR k > 20)", script=_COPY + "DELETE FROM t WHERE r = 2 OR k > 20")
_add("dml_upsert", "SELECT k, name, r FROM t", f"SELECT k, CASE WHEN k < 5 THEN name || '+' ELSE name END AS name, CASE WHEN k < 5 THEN r + k ELSE r END AS r FROM ({_BASE}) UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region",
     script=_COPY + "INSERT INTO t SELECT r_regionkey, r_name, r_regionkey FROM region WHERE true ON CONFLICT(k) DO UPDATE SET name = name || '+', r = r + excluded.r; INSERT INTO t SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
_add("dml_replace", "SELECT k, name, r FROM t", f"SELECT * FROM ({_BASE}) WHERE k >= 5 UNION ALL SELECT r_regionkey, r_name, -1 FROM region", script=_COPY + "REPLACE INTO t SELECT r_regionkey, r_name, -1 FROM region")
_add("dml_ignore", "SELECT k, name, r FROM t", f"{_BASE} UNION ALL SELECT 99, 'new', 0", script=_COPY + "INSERT OR IGNORE INTO t VALUES (3, 'x', 1), (99, 'new', 0), (99, 'again', 0)")
_add("dml_update_from", "SELECT k, name, r FROM t", f"SELECT k, r_name AS name, r FROM ({_BASE}) JOIN region ON r = r_regionkey", script=_COPY + "UPDATE t SET name = r_name FROM region WHERE r_regionkey = t.r")
_add("dml_generated", "SELECT k, d, v FROM g", f"SELECT {B('n_nationkey')} AS k, {B('n_nationkey * 2')} AS d, n_name || '/' || n_nationkey AS v FROM nation", script="CREATE TABLE g(k INTEGER, name TEXT, d INTEGER GENERATED ALWAYS AS (k * 2) STORED, v TEXT AS (name || '/' || k)); INSERT INTO g(k, name) SELECT n_nationkey, n_name FROM nation")
_add("dml_returning", "DELETE FROM t WHERE r = 1 RETURNING k, name || '?' AS n", f"SELECT k, name || '?' AS n FROM ({_BASE}) WHERE r = 1", script=_COPY)
_add("dml_fk_cascade", "SELECT c.k, c.p FROM c", f"SELECT {B('n_nationkey')} AS k, CASE WHEN n_regionkey = 2 THEN 20 ELSE {B('n_regionkey')} END AS p FROM nation WHERE n_regionkey <> 1",
     script="PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(k INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE CASCADE ON UPDATE CASCADE); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id = 1; UPDATE p SET id = 20 WHERE id = 2")
_add("txn_savepoint", "SELECT k, name, r FROM t", f"SELECT * FROM ({_BASE}) WHERE k <> 1", script=_COPY + "BEGIN; DELETE FROM t WHERE k = 1; SAVEPOINT a; DELETE FROM t; ROLLBACK TO a; COMMIT")
_add("trigger_audit", "SELECT msg FROM log", "SELECT 'region ' || r_name AS msg FROM region",
     script="CREATE TABLE q(k INTEGER PRIMARY KEY, name TEXT); CREATE TABLE log(id INTEGER PRIMARY KEY AUTOINCREMENT, msg TEXT); CREATE TRIGGER a AFTER INSERT ON q BEGIN INSERT INTO log(msg) VALUES ('region ' || new.name); END; INSERT INTO q SELECT r_regionkey, r_name FROM region")
_add("alter_table", "SELECT id, name, r, x FROM t2", f"SELECT k AS id, name, r, {B('4')} AS x FROM ({_BASE})", script=_COPY + "ALTER TABLE t RENAME COLUMN k TO id; ALTER TABLE t ADD COLUMN x INTEGER DEFAULT 4; ALTER TABLE t RENAME TO t2")
_add("pragma_table_info", 'SELECT cid, name, type, "notnull" AS nn, pk FROM pragma_table_info(\'t\')', f"SELECT {B('cid')} AS cid, name, type, {B('nn')} AS nn, {B('pk')} AS pk FROM (VALUES (0, 'k', 'INTEGER', 0, 1), (1, 'name', 'TEXT', 0, 0), (2, 'r', 'INTEGER', 0, 0)) v(cid, name, type, nn, pk)", script=_COPY)
_add("schema_table", "SELECT type, name, tbl_name FROM sqlite_schema", "SELECT * FROM (VALUES ('table', 't', 't'), ('index', 'i', 't'), ('view', 'w', 'w')) v(type, name, tbl_name)", script=_COPY + "CREATE INDEX i ON t(name); CREATE VIEW w AS SELECT k FROM t")
_add("rowid_scan", "SELECT rowid AS i, name FROM u", "SELECT row_number() OVER (ORDER BY r_name) AS i, r_name AS name FROM region", script="CREATE TABLE u(name TEXT); INSERT INTO u SELECT r_name FROM region ORDER BY r_name")
_add("attach", "SELECT r_name FROM other.t", "SELECT r_name FROM region", script="ATTACH 'x' AS other; CREATE TABLE other.t AS SELECT r_name FROM region")


def _ordered_recursion(spark, sf_dir):
    from larkspur.api import Database
    from pyspark.sql import functions as F

    db = Database(spark).attach_folder(sf_dir)
    df = db.query(
        "WITH RECURSIVE t(k, depth) AS (SELECT 0, 0 UNION ALL SELECT r_regionkey, depth + 1 FROM t JOIN region ON (r_regionkey - 1) / 2 = t.k AND r_regionkey > 0 ORDER BY 2 DESC, 1) SELECT k, depth FROM t"
    )
    return df.withColumn("pos", F.row_number().over(_in_order()).cast("bigint"))


def _in_order():
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    return Window.orderBy(F.monotonically_increasing_id())


_QUERIES["recursive_dfs_order"] = _ordered_recursion
_ORACLES["recursive_dfs_order"] = "SELECT CAST(k AS BIGINT) AS k, CAST(depth AS BIGINT) AS depth, CAST(pos AS BIGINT) AS pos FROM (VALUES (0, 0, 1), (1, 1, 2), (3, 2, 3), (4, 2, 4), (2, 1, 5)) v(k, depth, pos)"


def _snapshot(spark, sf_dir):
    from larkspur.api import Database

    db = Database(spark).attach_folder(sf_dir)
    db.exec(_COPY + "CREATE VIEW w AS SELECT k, name FROM t WHERE r = 1")
    kept = db.snapshot()
    db.exec("DELETE FROM t")
    return kept.open().query("SELECT k, name FROM w")


_QUERIES["snapshot_open"] = _snapshot
_ORACLES["snapshot_open"] = f"SELECT k, name FROM ({_BASE}) WHERE r = 1"


def _mixed_order(spark, sf_dir):
    from larkspur.operators import mixed
    from larkspur.session import table
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    orders = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 4 == 0, mixed.tag(F.col("o_totalprice"), "number"))
    value = value.when(F.col("o_orderkey") % 4 == 1, mixed.tag(F.col("o_orderpriority"), "text"))
    value = value.when(F.col("o_orderkey") % 4 == 2, mixed.tag(F.encode("o_orderstatus", "UTF-8"), "blob"))
    rows = orders.select("o_orderkey", value.alias("v"))
    rank = F.row_number().over(Window.orderBy(mixed.ascending(F.col("v")), "o_orderkey")).cast("bigint")
    return rows.select("o_orderkey", mixed.kind(F.col("v")).alias("kind"), rank.alias("pos"))


_QUERIES["order_mixed_class"] = _mixed_order
_ORACLES["order_mixed_class"] = """SELECT o_orderkey, CASE m WHEN 3 THEN 'null' WHEN 0 THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN 'integer' ELSE 'real' END WHEN 1 THEN 'text' ELSE 'blob' END AS kind,
row_number() OVER (ORDER BY CASE m WHEN 3 THEN 0 ELSE m + 1 END, CASE WHEN m = 0 THEN o_totalprice END, CASE WHEN m = 1 THEN o_orderpriority WHEN m = 2 THEN o_orderstatus END, o_orderkey) AS pos
FROM (SELECT *, o_orderkey % 4 AS m FROM orders)"""


def _snapshot_folder(spark, sf_dir):
    """A database written as a folder and read back."""
    from larkspur.api import Database, Snapshot
    from larkspur.operators.recursion import shared_folder

    db = Database(spark).attach_folder(sf_dir)
    db.exec(_COPY + "CREATE UNIQUE INDEX i ON t(name); CREATE VIEW w AS SELECT k, name FROM t WHERE r <> 1")
    return Snapshot.decode(spark, db.snapshot().encode(shared_folder(spark, "snapshot"))).open().query("SELECT k, name FROM w")


_QUERIES["snapshot_roundtrip"] = _snapshot_folder
_ORACLES["snapshot_roundtrip"] = f"SELECT k, name FROM ({_BASE}) WHERE r <> 1"

# -- operators that the queries above leave out

_LABELLED = "FROM documents LEFT JOIN labels USING (doc_id)"
_add("is_null_words", f"SELECT doc_id, quality ISNULL AS a, quality NOTNULL AS b, toxic NOT NULL AS c {_LABELLED}", f"SELECT doc_id, {B('quality IS NULL')} AS a, {B('quality IS NOT NULL')} AS b, {B('toxic IS NOT NULL')} AS c {_LABELLED}")
_add("regexp", "SELECT p_partkey, p_name REGEXP '^[a-m].*e' AS r, regexp('1$', p_brand) AS f FROM part", f"SELECT p_partkey, {B("regexp_matches(p_name, '^[a-m].*e')")} AS r, {B("regexp_matches(p_brand, '1$')")} AS f FROM part")
_add("precedence", "SELECT p_partkey, 2 + 3 * p_size - 4 AS a, NOT p_size = 3 AND p_size < 20 OR p_size = 50 AS b, p_size & 6 | 1 << 2 AS c, p_size || '-' || -p_size AS d, p_size = 4 = 0 AS e FROM part",
     f"SELECT p_partkey, 2 + 3 * {B('p_size')} - 4 AS a, {B('((NOT p_size = 3) AND p_size < 20) OR p_size = 50')} AS b, {B('((p_size & 6) | 1) * 4')} AS c, p_size || '-' || (-p_size) AS d, {B('p_size <> 4')} AS e FROM part")
_add("join_range", "SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_nationkey BETWEEN b.r_regionkey * 5 AND b.r_regionkey * 5 + 3")
_add("string_agg", "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
_add("jsonb_group", "SELECT n_regionkey, typeof(jsonb_group_array(n_nationkey)) AS t, json(jsonb_group_array(n_nationkey ORDER BY n_nationkey)) AS a, json(jsonb_group_object(n_name, n_nationkey ORDER BY n_nationkey)) AS o FROM nation GROUP BY n_regionkey",
     f"SELECT {B('n_regionkey')} AS n_regionkey, 'blob' AS t, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS a, '{{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_nationkey) || '}}' AS o FROM nation GROUP BY n_regionkey")
_add("early_stop", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 7)", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 7)")
_add("cte_materialized", "WITH a AS MATERIALIZED (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1), b AS NOT MATERIALIZED (SELECT k FROM a WHERE s > 500000) SELECT count(*) AS n, max(k) AS m FROM b", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT count(*) AS n, max(k) AS m FROM a WHERE s > 500000")
_add("indexed_by", "SELECT k, name FROM t INDEXED BY i WHERE name > 'I' AND k IN (SELECT k FROM t NOT INDEXED WHERE r = 2)", f"SELECT k, name FROM ({_BASE}) WHERE name > 'I' AND r = 2", script=_COPY + "CREATE INDEX i ON t(name)")
_add("int_overflow_constant", "SELECT 9223372036854775807 + 1 AS a, -9223372036854775807 - 10 AS b, 3037000500 * 3037000500 AS c, 5 * 7 AS d", f"SELECT {D('9223372036854775808')} AS a, {D('-9223372036854775817')} AS b, {D('9223372037000250000')} AS c, {B('35')} AS d")

# -- windows with EXCLUDE, over the pieces of a frame
for _n, _f in [("rows", "ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW"), ("groups", "GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP"), ("ties", "GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES"), ("after", "ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING EXCLUDE CURRENT ROW")]:
    _P = "PARTITION BY o_custkey ORDER BY o_orderkey" if "ROWS" in _f else "PARTITION BY o_orderstatus ORDER BY o_orderpriority"
    _add(f"win_exclude_{_n}_all", f"SELECT o_orderkey, count(*) OVER ({_P} {_f}) AS c, CAST(sum(o_custkey) OVER ({_P} {_f}) AS BIGINT) AS s, round(avg(o_custkey) OVER ({_P} {_f}), 6) AS a, min(o_orderkey) OVER ({_P} {_f}) AS lo, max(o_totalprice) OVER ({_P} {_f}) AS hi FROM orders")
_add("win_exclude_current_peers", "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS s, total(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS t FROM orders",
     f"SELECT o_orderkey, {B('sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)')} AS s, {D('coalesce(sum(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0)')} AS t FROM orders")
_add("not_in_projected_rows", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS a, o_custkey NOT IN (SELECT CASE WHEN c_acctbal < 0 THEN c_custkey END FROM customer) AS b, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey < 0) AS c FROM orders",
     f"SELECT o_orderkey, {B('o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)')} AS a, {B('o_custkey NOT IN (SELECT CASE WHEN c_acctbal < 0 THEN c_custkey END FROM customer)')} AS b, {B('0')} AS c FROM orders")

# -- functions
_add("fn_unistr_like_glob", r"SELECT p_partkey, unistr('aé' || p_size) AS u, like('%e%', p_name) AS l, glob('*e*', p_name) AS g, likely(p_size) AS k, unlikely(p_size > 5) AS m, likelihood(p_size, 0.5) AS h, typeof(random()) AS r, length(randomblob(9)) AS b, hex(zeroblob(3)) AS z, subtype(json('[1]')) AS s FROM part",
     f"SELECT p_partkey, 'aé' || p_size AS u, {B("p_name ILIKE '%e%'")} AS l, {B("contains(p_name, 'e')")} AS g, {B('p_size')} AS k, {B('p_size > 5')} AS m, {B('p_size')} AS h, 'integer' AS r, {B('9')} AS b, '000000' AS z, {B('74')} AS s FROM part")
_add("fn_uuid", "SELECT n_nationkey, uuid_str(unhex('00112233445566778899aabbccddeeff')) AS s, hex(uuid_blob('00112233-4455-6677-8899-aabbccddeeff')) AS b, length(uuid()) AS n, uuid() GLOB '????????-????-4???-a???-????????????' AS v FROM nation",
     f"SELECT n_nationkey, '00112233-4455-6677-8899-aabbccddeeff' AS s, '00112233445566778899AABBCCDDEEFF' AS b, {B('36')} AS n, {B('1')} AS v FROM nation")
_add("fn_hyperbolic", "SELECT p_partkey, round(sinh(p_size / 10.0), 5) AS a, round(cosh(p_size / 10.0), 5) AS b, round(tanh(p_size / 10.0), 6) AS c, round(asinh(p_size), 6) AS d, round(acosh(p_size + 1), 6) AS e, round(atanh(1.0 / (p_size + 1)), 6) AS f, round(tan(p_size / 50.0), 6) AS g, round(asin(1.0 / p_size), 6) AS h, round(acos(1.0 / p_size), 6) AS i, round(atan(p_size), 6) AS j, round(radians(p_size), 6) AS k, round(pi(), 6) AS l, round(log2(p_size), 6) AS m, round(mod(p_size, 7.5), 6) AS n, mod(p_size, 0) AS o FROM part",
     "SELECT p_partkey, round(sinh(p_size / 10.0::double), 5) AS a, round(cosh(p_size / 10.0::double), 5) AS b, round(tanh(p_size / 10.0::double), 6) AS c, round(asinh(p_size), 6) AS d, round(acosh(p_size + 1), 6) AS e, round(atanh(1.0::double / (p_size + 1)), 6) AS f, round(tan(p_size / 50.0::double), 6) AS g, round(asin(1.0::double / p_size), 6) AS h, round(acos(1.0::double / p_size), 6) AS i, round(atan(p_size), 6) AS j, round(radians(p_size), 6) AS k, round(pi(), 6) AS l, round(log2(p_size), 6) AS m, round(p_size % 7.5::double, 6) AS n, NULL::double AS o FROM part")
_add("fn_ieee754_blob", "SELECT n_nationkey, hex(ieee754_to_blob(n_nationkey * 0.0 + 1.0)) AS b, ieee754_from_blob(ieee754_to_blob(n_nationkey * 1.5)) AS f, ieee754_inc(1.0, 1) > 1.0 AS g, ieee754_inc(ieee754_inc(n_nationkey + 0.5, 3), -3) AS i FROM nation",
     f"SELECT n_nationkey, '3FF0000000000000' AS b, n_nationkey * 1.5::double AS f, {B('1')} AS g, n_nationkey + 0.5::double AS i FROM nation")
_add("fn_now", "SELECT current_date AS d, current_time AS t, current_timestamp AS s, date('now', '+1 day') AS n, sqlite_compileoption_used('X') AS c", f"SELECT '2000-01-01' AS d, '00:00:00' AS t, '2000-01-01 00:00:00' AS s, '2000-01-02' AS n, {B('0')} AS c")
_add("dt_timediff_months", "SELECT event_id, timediff('2024-06-15 00:00:00', ts) LIKE '+0000-0_-__ __:__:__.___' AS f, timediff(ts, '2026-03-20') LIKE '-000_-%' AS b, timediff(datetime(ts, 'start of day'), datetime(ts, 'start of day', '-2 years')) AS y FROM events",
     f"SELECT event_id, {B('1')} AS f, {B('1')} AS b, '+0002-00-00 00:00:00.000' AS y FROM events")
_add("json_change", """SELECT event_id, json(' { "a" : ' || props || ' } ') AS m, json_insert(props, '$.k', 9, '$.n', 8) AS i, json_replace(props, '$.k', 9, '$.n', 8) AS r, json_array_insert('[1,3]', '$[1]', event_id) AS a, json_error_position('{"a":1,}x') > 0 AS e, json(jsonb(props)) AS b, typeof(jsonb(props)) AS t FROM events""",
     f"""SELECT event_id, '{{"a":{{"k":' || json_extract_string(props, '$.k') || '}}}}' AS m, '{{"k":' || json_extract_string(props, '$.k') || ',"n":8}}' AS i, '{{"k":9}}' AS r, '[1,' || event_id || ',3]' AS a, {B('1')} AS e, '{{"k":' || json_extract_string(props, '$.k') || '}}' AS b, 'blob' AS t FROM events""")
_NESTED = """'{"id":' || n_nationkey || ',"tags":["' || n_name || '",null,true,2.5],"in":{"r":' || n_regionkey || '}}'"""
_add("json_nested_paths", f"SELECT n_nationkey, json_extract(j, '$.tags[0]') AS a, json_extract(j, '$.tags[#-1]') AS b, j -> 'in' AS c, j ->> '$.in.r' AS d, json_extract(j, '$.id', '$.tags[2]') AS e, json_type(j, '$.tags[3]') AS f, json_type(j, '$.none') AS g, json_array_length(j, '$.tags') AS h, json_remove(j, '$.tags', '$.in.r') AS i FROM (SELECT n_nationkey, {_NESTED} AS j FROM nation)",
     f"""SELECT n_nationkey, n_name AS a, '2.5' AS b, '{{"r":' || n_regionkey || '}}' AS c, CAST(n_regionkey AS VARCHAR) AS d, '[' || n_nationkey || ',true]' AS e, 'real' AS f, NULL::VARCHAR AS g, {B('4')} AS h, '{{"id":' || n_nationkey || ',"in":{{}}}}' AS i FROM nation""")
_add("json_tree_nested", f"SELECT n.n_nationkey, j.key, j.value, j.type, j.atom, j.fullkey, j.path FROM (SELECT n_nationkey, {_NESTED} AS doc FROM nation) n, json_tree(n.doc) j",
     f"""WITH d AS (SELECT n_nationkey, n_name, n_regionkey, {_NESTED} AS doc, '["' || n_name || '",null,true,2.5]' AS tags, '{{"r":' || n_regionkey || '}}' AS inner_ FROM nation)
SELECT n_nationkey, NULL AS key, doc AS value, 'object' AS type, NULL AS atom, '$' AS fullkey, '$' AS path FROM d UNION ALL SELECT n_nationkey, 'id', CAST(n_nationkey AS VARCHAR), 'integer', CAST(n_nationkey AS VARCHAR), '$.id', '$' FROM d
UNION ALL SELECT n_nationkey, 'tags', tags, 'array', NULL, '$.tags', '$' FROM d UNION ALL SELECT n_nationkey, '0', n_name, 'text', n_name, '$.tags[0]', '$.tags' FROM d UNION ALL SELECT n_nationkey, '1', NULL, 'null', NULL, '$.tags[1]', '$.tags' FROM d
UNION ALL SELECT n_nationkey, '2', '1', 'true', '1', '$.tags[2]', '$.tags' FROM d UNION ALL SELECT n_nationkey, '3', '2.5', 'real', '2.5', '$.tags[3]', '$.tags' FROM d
UNION ALL SELECT n_nationkey, 'in', inner_, 'object', NULL, '$.in', '$' FROM d UNION ALL SELECT n_nationkey, 'r', CAST(n_regionkey AS VARCHAR), 'integer', CAST(n_regionkey AS VARCHAR), '$.in.r', '$.in' FROM d""")
_add("json_each_path", f"SELECT n.n_nationkey, j.key, j.value, j.type, j.fullkey FROM (SELECT n_nationkey, {_NESTED} AS doc FROM nation) n, json_each(n.doc, '$.tags') j",
     "SELECT n_nationkey, k AS key, CASE k WHEN '0' THEN n_name WHEN '2' THEN '1' WHEN '3' THEN '2.5' END AS value, t AS type, '$.tags[' || k || ']' AS fullkey FROM nation, (VALUES ('0', 'text'), ('1', 'null'), ('2', 'true'), ('3', 'real')) v(k, t)")

# -- full text
_UTOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{M}\p{N}]+')"
_add("fts_unicode61", "SELECT rowid AS doc_id FROM d WHERE d MATCH 'CIÓN OR para'", f"SELECT doc_id FROM documents WHERE list_contains({_UTOK}, 'cion') OR list_contains({_UTOK}, 'para')", script=_FTS.format("unicode61"))
_BM = f"WITH t AS (SELECT doc_id, {_TOK} AS a FROM documents), s AS (SELECT count(*) AS n, avg(len(a)) AS m, count(*) FILTER (WHERE list_contains(a, 'with')) AS df FROM t), x AS (SELECT doc_id, len(list_filter(a, lambda y: y = 'with')) AS tf, len(a) AS dl FROM t WHERE list_contains(a, 'with')), r AS (SELECT doc_id, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2::double) / (tf + 1.2::double * (0.25 + 0.75 * dl / m)) AS score FROM x, s)"
_add("fts_rank", "SELECT rowid AS doc_id, round(rank, 5) AS score FROM d WHERE d MATCH 'with' ORDER BY rank", f"{_BM} SELECT doc_id, round(score, 5) AS score FROM r", script=_FTS.format("ascii"))
_add("fts_rank_bound", "SELECT count(*) AS n FROM d WHERE d MATCH 'with' AND rank < 0", f"{_BM} SELECT count(*) AS n FROM r WHERE score < 0", script=_FTS.format("ascii"))
_add("fts_offsets", "SELECT rowid AS doc_id, (length(offsets(d)) - length(replace(offsets(d), ' ', '')) + 1) / 4 AS n FROM d WHERE d MATCH 'with'", f"SELECT doc_id, {B(f"len(list_filter({_TOK}, lambda y: y = 'with'))")} AS n FROM documents WHERE list_contains({_TOK}, 'with')", script=_FTS.format("ascii"))
_add("fts_matchinfo", "SELECT rowid AS doc_id, hex(matchinfo(d, 'pc')) AS m, hex(matchinfo(d, 'y')) = hex(matchinfo(d, 'y')) AS y FROM d WHERE d MATCH 'with the'", f"SELECT doc_id, '0200000001000000' AS m, {B('1')} AS y FROM documents WHERE list_contains({_TOK}, 'with') AND list_contains({_TOK}, 'the')", script=_FTS.format("ascii"))
_add("fts_highlight_text", "SELECT rowid AS doc_id, replace(replace(highlight(d, 0, '<~', '~>'), '<~', ''), '~>', '') = text AS same, (length(highlight(d, 0, '~', '')) - length(text)) AS n FROM d WHERE d MATCH 'onto OR with'",
     f"SELECT doc_id, {B('1')} AS same, {B(f"len(list_filter({_TOK}, lambda y: y = 'with' OR y = 'onto'))")} AS n FROM documents WHERE list_contains({_TOK}, 'with') OR list_contains({_TOK}, 'onto')", script=_FTS.format("ascii"))
_add("fts_computed", "SELECT rowid AS doc_id FROM d WHERE d MATCH 'wi' || (SELECT 'th')", f"SELECT doc_id FROM documents WHERE list_contains({_TOK}, 'with')", script=_FTS.format("ascii"))
_add("fts_by_row", "SELECT q.k, count(*) AS n FROM (VALUES (1, 'with'), (2, '\"the and\"'), (3, 'thereaf* OR onth*'), (4, 'NEAR(the with, 2)')) AS v JOIN d JOIN (SELECT 1 AS k, 'with' AS q UNION ALL SELECT 2, '\"the and\"' UNION ALL SELECT 3, 'thereaf* OR onth*') AS q ON v.column1 = q.k AND d MATCH q.q GROUP BY q.k",
     f"SELECT {B('k')} AS k, count(*) AS n FROM documents, (VALUES (1), (2), (3)) v(k) WHERE CASE k WHEN 1 THEN list_contains({_TOK}, 'with') WHEN 2 THEN contains({_J}, ' the and ') ELSE contains({_J}, ' thereaf') OR contains({_J}, ' onth') END GROUP BY k", script=_FTS.format("ascii"))
_add("fts_near_six", "SELECT rowid AS doc_id FROM d WHERE d MATCH 'NEAR(the the the the the the, 1000000)'", f"SELECT doc_id FROM documents WHERE len(list_filter({_TOK}, lambda y: y = 'the')) >= 6", script=_FTS.format("ascii"))
_add("fts_vocab_col", "SELECT term, col, doc, cnt FROM v", f"SELECT term, 'text' AS col, count(DISTINCT doc_id) AS doc, count(*) AS cnt FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1", script=_FTS.format("ascii") + "; CREATE VIRTUAL TABLE v USING fts5vocab(d, col)")
_add("fts_vocab_instance", 'SELECT term, doc, col, "offset" AS o FROM v WHERE term GLOB \'the*\'', f"SELECT term, doc_id AS doc, 'text' AS col, {B('pos - 1')} AS o FROM (SELECT doc_id, unnest({_TOK}) AS term, unnest(range(1, len({_TOK}) + 1)) AS pos FROM documents) WHERE starts_with(term, 'the')", script=_FTS.format("ascii") + "; CREATE VIRTUAL TABLE v USING fts5vocab(d, instance)")
_NOTES = "CREATE VIRTUAL TABLE m USING {}(a, b); INSERT INTO m(rowid, a, b) SELECT n_nationkey, n_name, 'in region ' || r_name FROM nation JOIN region ON r_regionkey = n_regionkey;"
_add("fts4_query", "SELECT rowid AS k, a FROM m WHERE m MATCH 'b:region asia'", "SELECT n_nationkey AS k, n_name AS a FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'", script=_NOTES.format("fts4"))
_add("fts_column_filter", "SELECT rowid AS k FROM m WHERE m MATCH 'a : ^i* NOT b : asia'", "SELECT n_nationkey AS k FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_name LIKE 'I%' AND r_name <> 'ASIA'", script=_NOTES.format("fts5"))
_add("fts_changes", "SELECT rowid AS k, b FROM m WHERE m MATCH 'europe OR changed'", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'changed row' ELSE 'in region EUROPE' END AS b FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 7 AND (r_name = 'EUROPE' OR n_nationkey % 5 = 0)",
     script=_NOTES.format("fts5") + "UPDATE m SET b = 'changed row' WHERE rowid % 5 = 0; DELETE FROM m WHERE rowid = 7; INSERT INTO m(m) VALUES ('optimize'); INSERT INTO m(m) VALUES ('integrity-check')")
_add("fts_delete_all", "SELECT count(*) AS n FROM m", "SELECT 0::bigint AS n", script=_NOTES.format("fts5") + "INSERT INTO m(m) VALUES ('delete-all')")
_add("rtree_helpers", "SELECT rtreecheck('boxes') AS c, count(*) AS n FROM boxes WHERE x0 BETWEEN 5 AND 9", "SELECT 'ok' AS c, count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 9", script="CREATE VIRTUAL TABLE boxes USING rtree(id, x0, x1); INSERT INTO boxes SELECT p_partkey, p_size, p_size + 2 FROM part")

# -- changes to large tables
_ORDERS = "CREATE TABLE o(k INTEGER PRIMARY KEY, c INTEGER, s TEXT, p REAL); INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders;"
_OBASE = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p FROM orders"
_add("dml_orders_insert", "SELECT k, c, s, p FROM o", _OBASE, script=_ORDERS)
_add("dml_orders_update", "SELECT k, c, s, p FROM o", f"SELECT k, c, CASE WHEN s = 'P' THEN 'pending' ELSE s END AS s, CASE WHEN s = 'P' THEN p * 1.1::double ELSE p END AS p FROM ({_OBASE})", script=_ORDERS + "UPDATE o SET s = 'pending', p = p * 1.1 WHERE s = 'P'")
_add("dml_orders_delete", "SELECT k, c, s, p FROM o", f"SELECT * FROM ({_OBASE}) WHERE NOT (c IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))", script=_ORDERS + "DELETE FROM o WHERE c IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
_add("dml_orders_upsert", "SELECT k, c, s, round(p, 2) AS p FROM o", f"SELECT k, c, CASE WHEN k % 4 = 0 THEN 'again' ELSE s END AS s, round(CASE WHEN k % 4 = 0 THEN p + 1 ELSE p END, 2) AS p FROM ({_OBASE}) UNION ALL SELECT -o_orderkey, 0, 'new', 0 FROM orders WHERE o_orderkey % 4 = 1",
     script=_ORDERS + "INSERT INTO o SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE -o_orderkey END, 0, 'new', 0.0 FROM orders WHERE o_orderkey % 4 < 2 ON CONFLICT(k) DO UPDATE SET s = 'again', p = p + 1")
_add("dml_orders_replace", "SELECT k, c, s, p FROM o", f"SELECT k, CASE WHEN k % 3 = 0 THEN -1 ELSE c END AS c, CASE WHEN k % 3 = 0 THEN 'R' ELSE s END AS s, CASE WHEN k % 3 = 0 THEN 0 ELSE p END AS p FROM ({_OBASE})", script=_ORDERS + "INSERT OR REPLACE INTO o SELECT o_orderkey, -1, 'R', 0.0 FROM orders WHERE o_orderkey % 3 = 0")
_add("dml_orders_update_from", "SELECT k, s FROM o", f"SELECT k, c_mktsegment AS s FROM ({_OBASE}) JOIN customer ON c = c_custkey", script=_ORDERS + "UPDATE o SET s = c_mktsegment FROM customer WHERE c_custkey = o.c")
_add("dml_lineitem_numbered", "SELECT count(*) AS n, count(DISTINCT rowid) AS d, min(rowid) AS lo, max(rowid) AS hi, sum(q) AS q FROM l", f"SELECT count(*) AS n, count(*) AS d, {B('1')} AS lo, count(*) AS hi, {B('sum(l_linenumber)')} AS q FROM lineitem", script="CREATE TABLE l(q INTEGER, f TEXT); INSERT INTO l SELECT l_linenumber, l_returnflag FROM lineitem")
_add("dml_many_inserts", "SELECT k, v FROM m", f"SELECT {B('x')} AS k, 'row ' || x AS v FROM range(1, 9) t(x)", script="CREATE TABLE m(k INTEGER PRIMARY KEY, v TEXT);" + "".join(f"INSERT INTO m(v) VALUES ('row {i}');" for i in range(1, 9)))
_add("dml_default_values", "SELECT k, a, b FROM e", f"SELECT {B('x')} AS k, {B('7')} AS a, 'none' AS b FROM range(1, 3) t(x)", script="CREATE TABLE e(k INTEGER PRIMARY KEY, a INTEGER DEFAULT 7, b TEXT DEFAULT 'none'); INSERT INTO e DEFAULT VALUES; INSERT INTO e DEFAULT VALUES")
_add("dml_cte", "SELECT k, name, r FROM t", f"SELECT k, CASE WHEN r = 2 THEN 'Z' ELSE name END AS name, r FROM ({_BASE}) WHERE r <> 1 UNION ALL SELECT r_regionkey + 50, r_name, 9 FROM region",
     script=_COPY + "WITH x AS (SELECT k FROM t WHERE r = 1) DELETE FROM t WHERE k IN (SELECT k FROM x); WITH x(a, b) AS (SELECT r_regionkey + 50, r_name FROM region) INSERT INTO t SELECT a, b, 9 FROM x; WITH x AS (SELECT 2 AS y) UPDATE t SET name = 'Z' WHERE r = (SELECT y FROM x)")
_add("dml_counters", "SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS l", f"SELECT {B('5')} AS c, {B('36')} AS t, {B('77')} AS l", script=_COPY + "INSERT INTO t VALUES (77, 'x', 0); DELETE FROM t WHERE k IN (0, 1, 2, 3, 4, 5) AND k > 0 OR k = 77 AND r = 5; UPDATE t SET r = 3 WHERE k IN (10, 11, 12, 13, 14)")
_add("dml_constraints_ignore", "SELECT k, u, c FROM q", f"SELECT {B('n_nationkey')} AS k, n_name AS u, {B('n_regionkey')} AS c FROM nation WHERE n_regionkey > 0",
     script="CREATE TABLE q(k INTEGER PRIMARY KEY, u TEXT NOT NULL UNIQUE, c INTEGER CHECK (c > 0)); INSERT OR IGNORE INTO q SELECT n_nationkey, n_name, n_regionkey FROM nation; INSERT OR IGNORE INTO q SELECT n_nationkey + 100, n_name, 1 FROM nation WHERE n_regionkey > 0; INSERT OR IGNORE INTO q VALUES (500, NULL, 1)")
_add("view_instead_of", "SELECT k, name, r FROM t", f"SELECT k, CASE WHEN k = 3 THEN 'three' ELSE name END AS name, r FROM ({_BASE}) WHERE k <> 4 UNION ALL SELECT 200, 'added', 0",
     script=_COPY + "CREATE VIEW w AS SELECT k, name FROM t; CREATE TRIGGER wi INSTEAD OF INSERT ON w BEGIN INSERT INTO t VALUES (new.k, new.name, 0); END; CREATE TRIGGER wu INSTEAD OF UPDATE ON w BEGIN UPDATE t SET name = new.name WHERE k = old.k; END; CREATE TRIGGER wd INSTEAD OF DELETE ON w BEGIN DELETE FROM t WHERE k = old.k; END; INSERT INTO w VALUES (200, 'added'); UPDATE w SET name = 'three' WHERE k = 3; DELETE FROM w WHERE k = 4")
_add("trigger_when_update_of", "SELECT k, was, now FROM log", f"SELECT {B('n_nationkey')} AS k, {B('n_regionkey')} AS was, {B('n_regionkey + 10')} AS now FROM nation WHERE n_nationkey < 6 AND n_regionkey > 1",
     script=_COPY + "CREATE TABLE log(k INTEGER, was INTEGER, now INTEGER); CREATE TRIGGER a AFTER UPDATE OF r ON t WHEN old.r > 1 BEGIN INSERT INTO log VALUES (old.k, old.r, new.r); END; UPDATE t SET r = r + 10 WHERE k < 6; UPDATE t SET name = 'x' WHERE k < 3")
_add("trigger_raise_ignore", "SELECT k, name, r FROM t", f"SELECT * FROM ({_BASE}) WHERE r <> 3 OR k > 20", script=_COPY + "CREATE TRIGGER b BEFORE DELETE ON t WHEN old.k > 20 BEGIN SELECT RAISE(IGNORE); END; DELETE FROM t WHERE r = 3")
_FK = "PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(k INTEGER PRIMARY KEY, p INTEGER DEFAULT 0 REFERENCES p(id) {}); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation;"
_add("fk_set_null", "SELECT k, p FROM c", f"SELECT {B('n_nationkey')} AS k, {B('CASE WHEN n_regionkey = 2 THEN 20 WHEN n_regionkey <> 1 THEN n_regionkey END')} AS p FROM nation", script=_FK.format("ON DELETE SET NULL ON UPDATE CASCADE") + "DELETE FROM p WHERE id = 1; UPDATE p SET id = 20 WHERE id = 2")
_add("fk_set_default", "SELECT k, p FROM c", f"SELECT {B('n_nationkey')} AS k, {B('CASE WHEN n_regionkey = 3 THEN 0 ELSE n_regionkey END')} AS p FROM nation", script=_FK.format("ON DELETE SET DEFAULT") + "DELETE FROM p WHERE id = 3")
_add("drop_objects", "SELECT type, name FROM sqlite_schema", "SELECT 'table' AS type, 't' AS name", script=_COPY + "CREATE TABLE z(a); CREATE VIEW w AS SELECT k FROM t; CREATE INDEX i ON t(name); CREATE TRIGGER g AFTER INSERT ON t BEGIN SELECT 1; END; DROP TRIGGER g; DROP INDEX i; DROP VIEW w; DROP TABLE z; DROP TABLE IF EXISTS nowhere")
_add("index_kinds", "SELECT name FROM sqlite_schema WHERE type = 'index'", "SELECT unnest(['i1', 'i2', 'i3', 'i4']) AS name", script=_COPY + "CREATE UNIQUE INDEX i1 ON t(name COLLATE NOCASE DESC, r); CREATE INDEX i2 ON t(lower(name)); CREATE INDEX i3 ON t(r) WHERE r > 2; CREATE INDEX IF NOT EXISTS i4 ON t(k, r); REINDEX; VACUUM; ANALYZE")
_add("strict_without_rowid", "SELECT a, b FROM s", "SELECT n_name AS a, n_nationkey AS b FROM nation", script="CREATE TABLE s(a TEXT PRIMARY KEY, b INTEGER) STRICT, WITHOUT ROWID; INSERT INTO s SELECT n_name, n_nationkey FROM nation; CREATE TEMP TABLE IF NOT EXISTS x(a); DROP TABLE x")
_add("detach", "SELECT name FROM pragma_database_list", "SELECT 'main' AS name", script="ATTACH 'x' AS other; CREATE TABLE other.t(a); DETACH other")
_add("pragma_index_list", 'SELECT name, "unique" AS u, partial AS p FROM pragma_index_list(\'t\')', f"SELECT name, {B('u')} AS u, {B('p')} AS p FROM (VALUES ('i2', 0, 1), ('i1', 1, 0)) v(name, u, p)", script=_COPY + "CREATE UNIQUE INDEX i1 ON t(name); CREATE INDEX i2 ON t(r) WHERE r > 1")
_add("pragma_index_info", "SELECT seqno, name FROM pragma_index_info('i')", f"SELECT {B('s')} AS seqno, name FROM (VALUES (0, 'r'), (1, 'name')) v(s, name)", script=_COPY + "CREATE INDEX i ON t(r, name)")
_add("pragma_foreign_key_list", 'SELECT "table" AS t, "from" AS f, "to" AS o, on_delete AS d FROM pragma_foreign_key_list(\'c\')', "SELECT 'p' AS t, 'p' AS f, 'id' AS o, 'SET NULL' AS d", script=_FK.format("ON DELETE SET NULL"))
_add("txn_nested", "SELECT k, name, r FROM t", f"SELECT k, CASE WHEN k = 2 THEN 'two' ELSE name END AS name, r FROM ({_BASE})", script=_COPY + "BEGIN; DELETE FROM t; ROLLBACK; BEGIN IMMEDIATE; UPDATE t SET name = 'two' WHERE k = 2; SAVEPOINT a; DELETE FROM t WHERE k = 2; SAVEPOINT b; DELETE FROM t; ROLLBACK TO a; RELEASE a; COMMIT")
_add("dbstat", "SELECT name, ncell FROM st", "SELECT 't' AS name, count(*) AS ncell FROM nation", script=_COPY + "CREATE VIRTUAL TABLE st USING dbstat")


def _steps(name: str, oracle: str, run: Callable) -> None:
    """Registers a query over the host API: run gets a Database over the data folder."""

    def made(spark, sf_dir):
        from larkspur.api import Database

        return run(Database(spark).attach_folder(sf_dir))

    _QUERIES[name] = made
    _ORACLES[name] = oracle


def _refused(db, sql: str) -> None:
    from larkspur.errors import SqlError

    try:
        db.exec(sql)
    except SqlError:
        return
    raise AssertionError(f"not refused: {sql}")


def _after(*steps: str, show: str = "SELECT k, name, r FROM t"):
    """Runs statements, of which those that begin with ! must be refused, and shows what they leave."""

    def run(db):
        for s in steps:
            _refused(db, s[1:]) if s.startswith("!") else db.exec(s)
        return db.query(show)

    return run


_steps("param_positional", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'", lambda db: db.query("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?2", [200000, "O"]))
_steps("param_named", f"SELECT o_orderkey, {B('7')} AS x FROM orders WHERE o_custkey BETWEEN 10 AND 90", lambda db: db.query("SELECT o_orderkey, $x AS x FROM orders WHERE o_custkey BETWEEN :lo AND @hi", {"lo": 10, "hi": 90, "x": 7}))
_steps("prepared_again", f"SELECT {B('20')} AS n", lambda db: _prepared(db))
_steps("or_abort", _BASE, _after(_COPY, "!INSERT INTO t VALUES (900, 'a', 0), (3, 'b', 0)"))
_steps("or_fail", _BASE, _after(_COPY, "!INSERT OR FAIL INTO t VALUES (3, 'b', 0)"))
_steps("or_rollback", _BASE, _after(_COPY, "BEGIN; DELETE FROM t WHERE k = 5", "!INSERT OR ROLLBACK INTO t VALUES (3, 'b', 0)"))
_steps("constraints_refused", f"SELECT {B('1')} AS k, 'a' AS u", _after("CREATE TABLE q(k INTEGER PRIMARY KEY, u TEXT NOT NULL UNIQUE CHECK (length(u) < 3)); INSERT INTO q VALUES (1, 'a')", "!INSERT INTO q VALUES (1, 'b')", "!INSERT INTO q VALUES (2, 'a')", "!INSERT INTO q VALUES (2, NULL)", "!INSERT INTO q VALUES (2, 'long')", "!UPDATE q SET u = NULL", show="SELECT k, u FROM q"))
_steps("fk_restrict", "SELECT CAST(r_regionkey AS BIGINT) AS id FROM region", _after(_FK.format("ON DELETE RESTRICT"), "!DELETE FROM p WHERE id = 1", "!INSERT INTO c VALUES (900, 77)", show="SELECT id FROM p"))
_steps("fk_no_action", "SELECT CAST(r_regionkey AS BIGINT) AS id FROM region", _after(_FK.format(""), "!DELETE FROM p WHERE id = 2", show="SELECT id FROM p"))
_steps("trigger_raise_abort", _BASE, _after(_COPY, "CREATE TRIGGER b BEFORE DELETE ON t WHEN old.k = 7 BEGIN SELECT RAISE(ABORT, 'kept'); END", "!DELETE FROM t"))
_steps("refused_statements", f"SELECT {B('1')} AS ok", _after("!SELECT 1 UNION SELECT 1, 2", "!SELECT nosuch FROM nation WHERE 1 = 0", "!SELECT sum(row_number() OVER ()) FROM nation WHERE row_number() OVER () > 1", "!SELECT count(*) FROM nosuch", "!SELECT nosuch(1)", "!SELECT abs(1, 2)", show="SELECT 1 AS ok"))
_steps("pragma_user_version", f"SELECT {B('7')} AS user_version", lambda db: (db.exec("PRAGMA user_version = 7"), db.query("PRAGMA user_version"))[1])
_steps("api_transaction", f"SELECT * FROM ({_BASE}) WHERE k <> 1", lambda db: _transacted(db))


def _prepared(db):
    db.exec(_COPY)
    q = db.prepare("SELECT count(*) AS n FROM t WHERE k >= ?")
    before = q.get(0)["n"], q.get(0)["n"], q.get(20)["n"]
    db.prepare("DELETE FROM t WHERE k >= ?").run(20)
    if before != (25, 25, 5):
        raise AssertionError(before)
    return q.result(0)


def _transacted(db):
    db.exec(_COPY)
    with db.transaction():
        db.exec("DELETE FROM t WHERE k = 1")
        try:
            with db.transaction():
                db.exec("DELETE FROM t")
                raise KeyError
        except KeyError:
            pass
    return db.query("SELECT k, name, r FROM t")
