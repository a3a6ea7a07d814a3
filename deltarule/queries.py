"""Queries over the test tables, one or more for each operator of the rule language, with the same in SQL.

Each is rule text, the table columns that feed its relations, the relation that is
returned and the names of its columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from deltarule.functions.registry import Functions
from deltarule.operators.order import first_seen, ordered
from deltarule.program import Program
from deltarule.programs import library

#: Input relations: the table and its columns, as SQL expressions.
TABLES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "region": ("relation region(i32, String);", "region", ("r_regionkey", "r_name")),
    "nation": ("relation nation(i32, String, i32);", "nation", ("n_nationkey", "n_name", "n_regionkey")),
    "customer": ("relation customer(i64, i32, String, f64);", "customer", ("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")),
    "supplier": ("relation supplier(i64, i32, f64);", "supplier", ("s_suppkey", "s_nationkey", "s_acctbal")),
    "part": ("relation part(i64, String, String, i32);", "part", ("p_partkey", "p_name", "p_brand", "p_size")),
    "orders": ("relation orders(i64, i64, String, String, f64);", "orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")),
    "line": ("relation line(i64, i64, i64, i32, String, f64);", "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")),
    "dated": ("relation dated(i64, i64, String, f64);", "orders", ("o_orderkey", "o_custkey", "date_format(o_orderdate, 'yyyy-MM-dd')", "o_totalprice")),
    "event": ("relation event(i64, i64, String, f64);", "events", ("event_id", "user_id", "event_type", "value")),
    "turn": ("relation turn(i64, i64, String);", "conversations", ("conv_id", "turn", "role")),
    "vector": ("relation vector(i64, Vec<f32>);", "embeddings", ("vec_id", "embedding")),
}


@dataclass(frozen=True)
class RuleQuery:
    rules: str
    columns: str
    sql: str | None
    inputs: tuple[str, ...]
    output: str = "out"
    functions: Callable[[], Functions] = field(default=Functions)
    finish: Callable[[DataFrame], DataFrame] | None = None

    def program(self) -> Program:
        return Program.parse(" ".join(TABLES[i][0] for i in self.inputs) + self.rules, functions=self.functions())

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {i: spark.read.parquet(f"{sf_dir}/{TABLES[i][1]}.parquet").selectExpr(*TABLES[i][2]) for i in self.inputs}
        found = self.program().run(spark, tables, [self.output])[self.output].toDF(*self.columns.split())
        return self.finish(found) if self.finish else found


QUERIES: dict[str, RuleQuery] = {}


def add(name: str, inputs: str, rules: str, columns: str, sql: str | None, **more) -> None:
    QUERIES[name] = RuleQuery(rules, columns, sql, tuple(inputs.split()), **more)


# Scans, projection, filters.
add("copy", "region", "relation out(i32, String); out(k, n) :- region(k, n);", "k n", "SELECT r_regionkey AS k, r_name AS n FROM region")
add("facts", "region", "relation out(i32, String); out(1, 'one'), out(2, 'two'); out(1, 'one');", "k n", "SELECT 1 AS k, 'one' AS n UNION SELECT 2, 'two'")
add("inline_facts_with_input", "region", "relation seen(i32); relation out(i32); seen(k) :- region(k, _); seen(77); out(k) :- seen(k);", "k", "SELECT r_regionkey AS k FROM region UNION SELECT 77")
add("scan_project_distinct", "orders", "relation out(String, String); out(s, p) :- orders(_, _, s, p, _);", "status priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
add("const_filter", "line", "relation out(i64, i32); out(o, n) :- line(o, _, _, n, 'R', q), if q < 10;", "o n", "SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10")
for _name, _sign in {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}.items():
    add(f"compare_{_name}", "part", f"relation out(i64, i32); out(k, s) :- part(k, _, _, s), if s {_sign} 25;", "k s", f"SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size {_sign} 25")
add("compare_expr", "part", "relation out(i64); out(k) :- part(k, _, _, s), if k + s >= 1000;", "k", "SELECT p_partkey AS k FROM part WHERE p_partkey + p_size >= 1000")
add("match_negated", "part", "relation out(i64, String); out(k, n) :- part(k, n, b, _), if n rlike '^s', if !contains(b, '1');", "k n", "SELECT p_partkey AS k, p_name AS n FROM part WHERE regexp_matches(p_name, '^s') AND NOT contains(p_brand, '1')")
add("repeated_var", "nation", "relation out(i32, String); out(k, n) :- nation(k, n, k);", "k n", "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey = n_regionkey")
add("let_expr", "customer", "relation out(i64, i64, i32); out(c, h, n) :- customer(c, k, _, _), let h = c * 2 + 1, let (a, n) = (h, k + 1);", "c h n", "SELECT c_custkey AS c, c_custkey * 2 + 1 AS h, (c_nationkey + 1)::INT AS n FROM customer")
add("if_let_option", "orders", "relation maybe(i64, Option<f64>); relation out(i64, f64); maybe(o, CASE WHEN p > 200000 THEN p END) :- orders(o, _, _, _, p); out(o, p) :- maybe(o, v), if let Some(p) = v;", "o p", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 200000")
add("none_equals_none", "nation", "relation kind(i32, Option<i32>); relation out(i32, i32); kind(k, CASE WHEN r > 2 THEN r END) :- nation(k, _, r); out(a, b) :- kind(a, v), kind(b, v), if a < b;", "a b",
    "WITH k AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 2 THEN n_regionkey END AS v FROM nation) SELECT x.k AS a, y.k AS b FROM k x JOIN k y ON x.v IS NOT DISTINCT FROM y.v AND x.k < y.k")
add("enum_variants", "event", "enum Kind { Money(f64), Other(String) } relation kind(i64, Kind); relation out(i64, f64); kind(e, Kind::Money(v)) :- event(e, _, 'purchase', v); kind(e, Kind::Other(t)) :- event(e, _, t, _), if t <> 'purchase'; out(e, v) :- kind(e, k), if let Kind::Money(v) = k;", "e v",
    "SELECT event_id AS e, value AS v FROM events WHERE event_type = 'purchase'")
# Functions.
add("int_arith", "part", "relation out(i64, i64, i64, i64, i64); out(k, k + s, k - 2 * s, k div (s + 1), (k - 500) % 7) :- part(k, _, _, s);", "k a b c d",
    "SELECT p_partkey AS k, p_partkey + p_size AS a, p_partkey - 2 * p_size AS b, p_partkey // (p_size + 1) AS c, (p_partkey - 500) % 7 AS d FROM part")
add("string_fns", "part", "relation out(i64, i32, String, String, String); out(k, strlen(n), cat(n, cat('-', b)), upper(substring(n, 1, 3)), reverse(replace(b, '#', ''))) :- part(k, n, b, _);", "k len full pre rev",
    "SELECT p_partkey AS k, length(p_name)::INT AS len, p_name || '-' || p_brand AS full, upper(substr(p_name, 1, 3)) AS pre, reverse(replace(p_brand, '#', '')) AS rev FROM part")
add("float_arith", "supplier", "relation out(i64, f64, f64); out(k, b + 0.5D, b * 2D) :- supplier(k, _, b);", "k a m", "SELECT s_suppkey AS k, s_acctbal + 0.5 AS a, s_acctbal * 2 AS m FROM supplier")
add("to_string_number", "part", "relation out(i64, i32); out(k, to_number(cat(to_string(s), '0'))) :- part(k, _, _, s);", "k v", "SELECT p_partkey AS k, (p_size || '0')::INT AS v FROM part")
# Joins.
add("join2", "customer orders", "relation out(i64, i64); out(o, c) :- customer(c, 3, _, _), orders(o, c, _, _, _);", "o c", "SELECT o_orderkey AS o, c_custkey AS c FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3")
add("join3", "region nation supplier", "relation out(i64, String); out(s, r) :- supplier(s, n, _), nation(n, _, k), region(k, r);", "s r", "SELECT s_suppkey AS s, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("join5", "region nation customer orders line", "relation out(String, i64); out(r, p) :- region(k, r), nation(n, _, k), customer(c, n, _, _), orders(o, c, 'F', _, _), line(o, p, _, _, 'R', _);", "r p",
    "SELECT DISTINCT r_name AS r, l_partkey AS p FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
add("self_join_theta", "supplier", "relation out(i64, i64); out(a, b) :- supplier(a, n, _), supplier(b, n, _), if a < b;", "a b", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
add("cross_join", "region", "relation out(i32, i32); out(a, b) :- region(a, _), region(b, _);", "a b", "SELECT x.r_regionkey AS a, y.r_regionkey AS b FROM region x, region y")
add("join_computed_key", "nation region", "relation out(String, String); out(n, r) :- nation(k, n, _), region(k % 5, r);", "n r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_nationkey % 5 = r_regionkey")
add("tuple_field_join", "orders customer", "relation pair(i64, (i64, String)); relation out(i64, String); pair(o, (c, s)) :- orders(o, c, s, _, _); out(o, m) :- pair(o, t), customer(t.0, _, m, _), if t.1 = 'P';", "o m",
    "SELECT o_orderkey AS o, c_mktsegment AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
add("tuple_key_join", "nation supplier customer", "relation a(i64, (i32, i32)); relation b(i64, (i32, i32)); relation out(i64, i64); a(s, (n, r)) :- supplier(s, n, _), nation(n, _, r); b(c, (n, r)) :- customer(c, n, 'BUILDING', _), nation(n, _, r); out(s, c) :- a(s, t), b(c, t);", "s c",
    "SELECT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'")
add("semi", "customer orders", "relation out(i64); out(c) :- customer(c, _, _, _), orders(_, c, 'P', _, _);", "c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
add("anti", "customer orders", "relation rich(i64); relation out(i64); rich(c) :- orders(_, c, _, _, p), if p > 450000; out(c) :- customer(c, _, _, _), !rich(c);", "c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
add("anti_const", "customer orders", "relation out(i64); out(c) :- customer(c, _, _, _), !orders(_, c, 'F', '1-URGENT', _);", "c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
add("anti_expr", "supplier", "relation out(i64); out(s) :- supplier(s, n, _), !supplier(s + 1, n, _);", "s", "SELECT s_suppkey AS s FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey = a.s_suppkey + 1 AND b.s_nationkey = a.s_nationkey)")
add("anti_chain", "nation supplier customer", "relation out(i32); out(n) :- nation(n, _, _), !nation(_, _, n), !supplier(7, n, _), !customer(5, n, _, _);", "n",
    "SELECT n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT n_regionkey FROM nation) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey = 5)")
add("anti_nullary", "region part", "relation big(); relation huge(); relation out(i32); big() :- part(_, _, _, s), if s > 40; huge() :- part(_, _, _, s), if s > 4000; out(r) :- region(r, _), big(), !huge();", "r", "SELECT r_regionkey AS r FROM region")
add("anti_stratified", "customer orders", "relation active(i64); relation idle(i64); relation out(i64); active(c) :- orders(_, c, _, _, p), if p > 100000; idle(c) :- customer(c, _, _, _), !active(c); out(c) :- customer(c, _, _, b), !idle(c), if b > 0;", "c",
    "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
# Sets.
add("union_rules", "event", "relation out(i64); out(u) :- event(_, u, 'click', _); out(u) :- event(_, u, 'purchase', v), if v > 50;", "u", "SELECT user_id AS u FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50")
add("disjunction", "event", "relation out(i64); out(u) :- (event(_, u, 'error', _) ; event(_, u, 'signup', _));", "u", "SELECT DISTINCT user_id AS u FROM events WHERE event_type IN ('error', 'signup')")
add("intersect", "event", "relation a(i64); relation b(i64); relation out(i64); a(u) :- event(_, u, 'error', _); b(u) :- event(_, u, 'purchase', _); out(u) :- a(u), b(u);", "u", "SELECT user_id AS u FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
add("difference", "event", "relation a(i64); relation b(i64); relation out(i64); a(u) :- event(_, u, 'error', _); b(u) :- event(_, u, 'purchase', v), if v > 60; out(u) :- a(u), !b(u);", "u", "SELECT user_id AS u FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60")
add("multi_head", "nation", "relation out(i32, i32); out(a, b), out(b, a) :- nation(a, _, b);", "a b", "SELECT n_nationkey AS a, n_regionkey AS b FROM nation UNION SELECT n_regionkey, n_nationkey FROM nation")
# Aggregates grouped by their head: each distinct value of a group counts once.
for _op, _sql in {"min": "min(l_linenumber)", "max": "max(l_linenumber)", "sum": "sum(DISTINCT l_linenumber)::INT", "count": "count(DISTINCT l_linenumber)::INT", "mean": "(sum(DISTINCT l_linenumber) // count(DISTINCT l_linenumber))::INT"}.items():
    add(f"agg_direct_{_op}", "line", f"relation out(i64, i32); out(s, m) :- agg m = {_op}(n) in line(_, _, s, n, _, _);", "s m", f"SELECT l_suppkey AS s, {_sql} AS m FROM lineitem GROUP BY l_suppkey")
add("agg_direct_expr", "part", "relation out(String, i32, i64); out(b, s % 3, m) :- agg m = sum(k + s) in part(k, _, b, s);", "b s m", "SELECT p_brand AS b, (p_size % 3)::INT AS s, sum(DISTINCT p_partkey + p_size)::BIGINT AS m FROM part GROUP BY ALL")
add("agg_direct_two_rules", "supplier customer", "relation out(i32, i64); out(n, m) :- agg m = max(s) in supplier(s, n, _); out(n, m) :- agg m = max(c) in customer(c, n, _, _);", "n m",
    "SELECT n, max(k) AS m FROM (SELECT s_nationkey AS n, s_suppkey AS k FROM supplier UNION ALL SELECT c_nationkey, c_custkey FROM customer) GROUP BY n")
# Aggregates after atoms: over the rows of the source, joined back.
for _op, _sql, _type in (("min", "min(o_totalprice)", "f64"), ("max", "max(o_totalprice)", "f64"), ("sum", "sum(o_orderkey)::BIGINT", "i64"), ("mean", "avg(o_orderkey)", "f64"), ("count", "count(*)", "i64")):
    _value = {"count": "", "sum": "o", "mean": "o"}.get(_op, "p")
    add(f"agg_generic_{_op}", "customer orders", f"relation out(i64, {_type}); out(c, m) :- customer(c, _, 'BUILDING', _), agg m = {_op}({_value}) in orders(o, c, _, _, p);", "c m", f"SELECT c_custkey AS c, {_sql} AS m FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey")
add("agg_generic_two", "customer orders", "relation out(i64, i64, f64); out(c, n, m) :- customer(c, _, _, _), agg n = count() in orders(_, c, _, _, _), agg m = max(p) in orders(_, c, 'O', _, p);", "c n m",
    "SELECT c_custkey AS c, count(*) AS n, max(o_totalprice) FILTER (o_orderstatus = 'O') AS m FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) FILTER (o_orderstatus = 'O') > 0")
add("agg_global", "orders", "relation out(i64, i64); out(n, m) :- agg n = count() in orders(_, _, _, _, _), agg m = max(o) in orders(o, _, _, _, _);", "n m", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders")
add("agg_global_empty", "orders", "relation none(i64); relation out(i64); none(o) :- orders(o, _, 'NO SUCH', _, _); out(m) :- agg m = count() in none(_);", "m", "SELECT count(*) AS m FROM orders WHERE o_orderstatus = 'NO SUCH' HAVING count(*) > 0")
add("agg_chained", "orders", "relation total(i64, i64); relation out(i64); total(c, m) :- agg m = count(o) in orders(o, c, _, _, _); out(m) :- agg m = max(t) in total(_, t);", "m", "SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
add("rank_by_count", "supplier", "relation le(i64, i64); relation out(i64, i64); le(a, b) :- supplier(a, n, x), supplier(b, n, y), if y <= x; out(a, r) :- supplier(a, _, _), agg r = count() in le(a, _);", "a r",
    "SELECT x.s_suppkey AS a, count(*) AS r FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND y.s_acctbal <= x.s_acctbal GROUP BY x.s_suppkey")
# Generators.
add("generator_range", "part", "relation out(i64, i32); out(k, i) :- part(k, _, _, s), for i in s - 3..s;", "k i", "SELECT p_partkey AS k, unnest(range(p_size - 3, p_size))::INT AS i FROM part")
add("generator_nested", "region", "relation out(i32, i32, i32); out(r, x, y) :- region(r, _), for x in 0..r, for y in x + 1..r;", "r x y", "SELECT r_regionkey AS r, x::INT AS x, y::INT AS y FROM region, range(0, 5) a(x), range(0, 5) b(y) WHERE x < r_regionkey AND y > x AND y < r_regionkey")
add("generator_array", "vector", "relation out(i64, f32); out(k, x) :- vector(k, v), for x in v, if x > 0;", "k x", "SELECT DISTINCT vec_id AS k, x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0")
# Functions of the host.


def _sized() -> Functions:
    made = Functions().sql("size_class", {"s": "INT"}, "STRING", "CASE WHEN s < 10 THEN 'small' WHEN s < 30 THEN 'medium' ELSE 'large' END")

    @made.scalar("is_prime", "boolean")
    def is_prime(n: int) -> bool:
        return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))

    return made


add("udf_head", "part", "relation out(i64, String); out(k, size_class(s)) :- part(k, _, _, s);", "k c", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c FROM part", functions=_sized)
add("udf_predicate", "part", "relation out(i64, i32); out(k, s) :- part(k, _, _, s), if is_prime(s), if !is_prime(s + 2);", "k s",
    "WITH p AS (SELECT n FROM range(2, 60) a(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 60) b(d) WHERE d < n AND n % d = 0)) SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size IN (SELECT n FROM p) AND p_size + 2 NOT IN (SELECT n FROM p)", functions=_sized)
add("udf_aggregate", "part", "relation out(String, i64); out(size_class(s), m) :- agg m = count(k) in part(k, _, _, s);", "c m", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c, count(*) AS m FROM part GROUP BY 1", functions=_sized)
# Recursion. GRAPH: edges from part k to parts (2k + 1) mod n and (3k + 1) mod n, weighted by size.
GRAPH = "relation size(i64); relation edge(i64, i64, i64); size(n) :- agg n = count() in part(_, _, _, _); edge(k, (2 * k + 1) % n, s) :- part(k, _, _, s), size(n); edge(k, (3 * k + 1) % n, s) :- part(k, _, _, s), size(n);"
EDGES = "n AS (SELECT count(*) AS n FROM part), edge AS (SELECT p_partkey AS x, (2 * p_partkey + 1) % n AS y, p_size::BIGINT AS w FROM part, n UNION SELECT p_partkey, (3 * p_partkey + 1) % n, p_size FROM part, n)"
TURNS = "relation next(i64, i64, i64); next(c, t, t + 1) :- turn(c, t, _), turn(c, t + 1, _);"
add("reach", "part", GRAPH + "relation out(i64); out(1); out(y) :- out(x), edge(x, y, _);", "x", f"WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT AS x UNION SELECT y FROM r JOIN edge USING (x)) SELECT x FROM r")
add("tc", "turn", TURNS + library.closure("out(c, a, b)", "next(c, a, b)", "i64, i64, i64"), "c a b", "SELECT DISTINCT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn")
add("tc_nonlinear", "turn", TURNS + "relation out(i64, i64, i64); out(c, a, b) :- next(c, a, b); out(c, a, b) :- out(c, a, m), out(c, m, b);", "c a b", "SELECT DISTINCT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn")
add("symmetric_closure", "turn", "relation out(i64, i64, i64); relation next(i64, i64, i64); next(c, t, t + 1) :- turn(c, t, _), turn(c, t + 1, _); out(c, a, b) :- next(c, a, b); out(c, b, a) :- out(c, a, b); out(c, a, b) :- out(c, a, m), out(c, m, b);", "c a b",
    "SELECT DISTINCT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id WHERE (SELECT count(*) FROM conversations z WHERE z.conv_id = x.conv_id) > 1")
add("same_generation", "region nation supplier", "relation up(String, String); relation out(String, String); up(cat('n', string(n)), cat('r', string(r))) :- nation(n, _, r); up(cat('s', string(s)), cat('n', string(n))) :- supplier(s, n, _); out(x, y) :- up(x, p), up(y, p), if x <> y; out(x, y) :- up(x, p), out(p, q), up(y, q);", "x y",
    "WITH RECURSIVE up AS (SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS p FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), r AS (SELECT a.x, b.x AS y FROM up a JOIN up b USING (p) WHERE a.x <> b.x UNION SELECT a.x, b.x FROM r JOIN up a ON a.p = r.x JOIN up b ON b.p = r.y) SELECT x, y FROM r")
add("mutual_even_odd", "turn", "relation even(i64, i64); relation odd(i64, i64); relation out(i64, i64); relation next(i64, i64, i64); next(c, t, t + 1) :- turn(c, t, _), turn(c, t + 1, _); even(c, 0) :- turn(c, 0, _); odd(c, y) :- even(c, x), next(c, x, y); even(c, y) :- odd(c, x), next(c, x, y); out(c, t) :- odd(c, t);", "c t",
    "WITH RECURSIVE w AS (SELECT conv_id AS c, 0::BIGINT AS t FROM conversations WHERE turn = 0 UNION SELECT c, turn FROM w JOIN conversations ON conv_id = c AND turn = t + 1) SELECT c, t FROM w WHERE t % 2 = 1")
add("bipartite", "part", GRAPH + "relation zero(i64); relation one(i64); relation out(i64); zero(1); one(y) :- edge(x, y, _), zero(x); zero(y) :- edge(x, y, _), one(x); out(x) :- zero(x), one(x);", "x",
    f"WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT AS x, 0 AS c UNION SELECT y, 1 - c FROM r JOIN edge USING (x)) SELECT x FROM r GROUP BY x HAVING count(*) = 2")
_BEST = "WITH RECURSIVE {edges}, b(x, c) USING KEY (x) AS (SELECT 1::BIGINT, 0::BIGINT UNION (SELECT e.y, min(b.c + {w}) FROM b JOIN edge e ON e.x = b.x LEFT JOIN recurring.b o ON o.x = e.y WHERE o.x IS NULL OR b.c + {w} < o.c GROUP BY e.y)) SELECT x, c FROM b"
add("sssp", "part", GRAPH + library.SHORTEST.format(relation="out", seed="1", step="d + w"), "x c", _BEST.format(edges=EDGES, w="e.w"))
add("bfs_dist", "part", GRAPH + library.SHORTEST.format(relation="out", seed="1", step="d + 1"), "x c", _BEST.format(edges=EDGES, w="1"))
add("cc", "part", GRAPH + "relation arc(i64, i64); relation out(i64, i64); arc(x, y), arc(y, x) :- edge(x, y, w), if w < 25; out(x, m) :- agg m = min(x) in arc(x, _); out(y, m) :- out(x, c), agg m = min(c) in arc(x, y);", "x m",
    f"WITH RECURSIVE {EDGES}, arc AS (SELECT x, y FROM edge WHERE w < 25 UNION SELECT y, x FROM edge WHERE w < 25), r(x, m) USING KEY (x) AS (SELECT DISTINCT x, x FROM arc UNION (SELECT arc.y, min(r.m) FROM r JOIN arc ON arc.x = r.x JOIN recurring.r o ON o.x = arc.y WHERE r.m < o.m GROUP BY arc.y)) SELECT x, m FROM r")
add("longest_path", "turn", TURNS + "relation out(i64, i64, i64); out(c, 0, 0) :- turn(c, 0, _); out(c, y, m) :- out(c, x, d), agg m = max(d + 1) in next(c, x, y);", "c t d",
    "WITH RECURSIVE w AS (SELECT conv_id AS c, 0::BIGINT AS t FROM conversations WHERE turn = 0 UNION SELECT c, turn FROM w JOIN conversations ON conv_id = c AND turn = t + 1) SELECT c, t, t AS d FROM w")
add("neg_in_recursion", "part", GRAPH + "relation blocked(i64); relation out(i64); blocked(k) :- part(k, _, _, s), if s > 42, if k > 40; out(1); out(y) :- out(x), edge(x, y, _), !blocked(y);", "x",
    f"WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT AS x UNION SELECT y FROM r JOIN edge USING (x) WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = y AND p_size > 42 AND p_partkey > 40)) SELECT x FROM r")
add("multi_stratum", "part", GRAPH + "relation reached(i64); relation left(i64); relation out(i64); reached(3); reached(y) :- reached(x), edge(x, y, w), if w > 20; left(k) :- part(k, _, _, _), !reached(k); out(m) :- agg m = count() in left(_);", "m",
    f"WITH RECURSIVE {EDGES}, r AS (SELECT 3::BIGINT AS x UNION SELECT y FROM r JOIN edge USING (x) WHERE w > 20) SELECT count(*) AS m FROM part WHERE p_partkey NOT IN (SELECT x FROM r)")
add("hybrid_input", "region", "relation link(i32, i32); relation out(i32, i32); link(0, 1); link(1, 2); link(2, 0); link(b, a) :- link(a, b); link(a, c) :- link(a, b), link(b, c); out(a, b) :- link(a, b), region(a, _);", "a b",
    "SELECT a::INT AS a, b::INT AS b FROM range(0, 3) x(a), range(0, 3) y(b)")
add("reach_hops", "part", GRAPH + library.SHORTEST.format(relation="dist", seed="1", step="d + 1") + "relation out(i64); out(d) :- dist(150, d); out(-1) :- size(_), !dist(150, _);", "hops",
    "WITH RECURSIVE " + EDGES + ", b(x, c) USING KEY (x) AS (SELECT 1::BIGINT, 0::BIGINT UNION (SELECT e.y, min(b.c + 1) FROM b JOIN edge e ON e.x = b.x LEFT JOIN recurring.b o ON o.x = e.y WHERE o.x IS NULL OR b.c + 1 < o.c GROUP BY e.y)) SELECT coalesce((SELECT c FROM b WHERE x = 150), -1) AS hops")
add("points_to", "line", library.POINTS_TO + "addr(o * 10 + 1, o * 10 + n) :- line(o, _, _, n, 'R', _); assign(o * 10 + n, o * 10 + n - 1) :- line(o, _, _, n, _, _), if n > 1; load(o * 10 + 8, o * 10 + n) :- line(o, _, _, n, 'N', _); store(o * 10 + n, o * 10 + 1) :- line(o, _, _, n, 'A', _);", "x o",
    "WITH RECURSIVE l AS (SELECT l_orderkey * 10 AS o, l_linenumber AS n, l_returnflag AS f FROM lineitem), assign AS (SELECT o + n AS a, o + n - 1 AS b FROM l WHERE n > 1), load AS (SELECT o + 8 AS a, o + n AS b FROM l WHERE f = 'N'), store AS (SELECT o + n AS a, o + 1 AS b FROM l WHERE f = 'A'), "
    "q(x, o) USING KEY (x, o) AS (SELECT o + 1, o + n FROM l WHERE f = 'R' UNION (SELECT DISTINCT x, o FROM (SELECT a AS x, o FROM assign JOIN recurring.q ON b = x UNION SELECT a, r.o FROM load JOIN recurring.q p ON p.x = b JOIN recurring.q r ON r.x = p.o UNION SELECT p.o, r.o FROM store JOIN recurring.q p ON p.x = a JOIN recurring.q r ON r.x = b) c WHERE NOT EXISTS (SELECT 1 FROM recurring.q h WHERE h.x = c.x AND h.o = c.o))) SELECT x, o FROM q", output="points")  # fmt: skip
add("null_flow", "part", GRAPH + "relation null_edge(i64, i64); relation out(i64, i64); null_edge(x, y) :- edge(x, y, w), if w > 48; out(x, y) :- null_edge(x, y); out(x, y) :- out(x, m), edge(m, y, w), if w > 30;", "x y",
    f"WITH RECURSIVE {EDGES}, r AS (SELECT x, y FROM edge WHERE w > 48 UNION SELECT r.x, edge.y FROM r JOIN edge ON r.y = edge.x WHERE w > 30) SELECT x, y FROM r")

# Order, first rows and first appearance, put on a result.
add("order_by", "customer", "relation out(i64, f64); out(c, b) :- customer(c, 7, _, b);", "c b", "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_nationkey = 7 ORDER BY b DESC, c", finish=lambda rows: ordered(rows, "b desc"))
add("order_limit", "orders", "relation out(i64, f64); out(o, p) :- orders(o, _, 'F', _, p);", "o p", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F' ORDER BY p DESC, o LIMIT 3", finish=lambda rows: ordered(rows, "p desc", limit=3))
add("order_tuple_limit", "supplier", "relation out(i32, f64, i64); out(n, b, s) :- supplier(s, n, b);", "n b s", "SELECT s_nationkey AS n, s_acctbal AS b, s_suppkey AS s FROM supplier ORDER BY n, b DESC, s LIMIT 12", finish=lambda rows: ordered(rows, "n", "b desc", "s", limit=12))
add("first_seen_ordinals", "event", "relation out(i64, i64); out(u, e) :- event(e, u, _, _);", "u e", "SELECT u, row_number() OVER (ORDER BY e) - 1 AS ord FROM (SELECT user_id AS u, min(event_id) AS e FROM events GROUP BY user_id)", finish=lambda rows: first_seen(rows, "u", "e"))
# More functions and patterns.
add("int_fns", "part", "relation out(i64, i32, i32, i32, i32, i32, i64); out(k, min(s, 20), max(s, 20), clamp(s, 10, 30), abs(s - 25), wrapping_abs(s - 40), round(k / 7)) :- part(k, _, _, s);", "k lo hi mid dist wdist q",
    "SELECT p_partkey AS k, least(p_size, 20) AS lo, greatest(p_size, 20) AS hi, greatest(10, least(30, p_size)) AS mid, abs(p_size - 25) AS dist, abs(p_size - 40) AS wdist, round(p_partkey / 7)::BIGINT AS q FROM part")
add("bytes_and_emptiness", "part", "relation out(i64, i32, bool); out(k, octet_length(n), length(replace(b, 'Brand', '')) = 0) :- part(k, n, b, _), if length(n) > 0;", "k bytes bare", "SELECT p_partkey AS k, strlen(p_name)::INT AS bytes, length(replace(p_brand, 'Brand', '')) = 0 AS bare FROM part WHERE length(p_name) > 0")
add("iso_dates", "dated", "relation out(i64, String); out(o, d) :- dated(o, _, d, _), if d >= '1995-03-01', if d < '1996-01-15';", "o d", "SELECT o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-01-15'")
add("vec_literals", "part", "relation bag(i64, Vec<i32>); relation out(i64, i32, i32); bag(k, [s, s % 7, k % 3]) :- part(k, _, _, s); out(k, len(v), element_at(v, 2)) :- bag(k, v);", "k n second", "SELECT p_partkey AS k, 3 AS n, (p_size % 7)::INT AS second FROM part")
add("slice_patterns", "part", "relation bag(i64, Vec<i32>); relation out(i64, i32, i32); bag(k, [s, s % 7, s % 3]) :- part(k, _, _, s); out(k, a, c) :- bag(k, v), if let [a, 0..=3, c] = v; out(k, c, a) :- bag(k, v), if let [a @ 40.., .., c] = v;", "k a c",
    "SELECT p_partkey AS k, p_size AS a, (p_size % 3)::INT AS c FROM part WHERE p_size % 7 <= 3 UNION SELECT p_partkey, (p_size % 3)::INT, p_size FROM part WHERE p_size >= 40")
add("range_and_at_patterns", "part", "relation out(i64, i32, String); out(k, n, 'low') :- part(k, _, _, s), if let n @ 1..10 = s; out(k, n, 'top') :- part(k, _, _, s), if let n @ 45..=50 = s;", "k n c",
    "SELECT p_partkey AS k, p_size AS n, CASE WHEN p_size < 10 THEN 'low' ELSE 'top' END AS c FROM part WHERE p_size BETWEEN 1 AND 9 OR p_size BETWEEN 45 AND 50")
add("field_patterns", "part", "relation item(i64, struct<size:int,brand:string>); relation out(i64, i32, String); item(k, named_struct('size', s, 'brand', b)) :- part(k, _, b, s); out(k, size, b) :- item(k, i), if let Item { size, brand: b } = i, if size > 30;", "k size b", "SELECT p_partkey AS k, p_size AS size, p_brand AS b FROM part WHERE p_size > 30")
add("agg_wrapped", "part", "relation out(String, i32); out(b, round(m)) :- agg m = mean(s) in part(_, _, b, s);", "b m", "SELECT p_brand AS b, (sum(DISTINCT p_size) // count(DISTINCT p_size))::INT AS m FROM part GROUP BY p_brand")
add("let_block", "part", "relation out(i64, String); out(k, c) :- part(k, _, _, s), let twice = s * 2, let c = CASE WHEN twice > 60 THEN 'over' WHEN twice = 60 THEN 'even' ELSE 'under' END;", "k c", "SELECT p_partkey AS k, CASE WHEN p_size > 30 THEN 'over' WHEN p_size = 30 THEN 'even' ELSE 'under' END AS c FROM part")
add("generator_function", "part", "relation out(i64, String); out(k, w) :- part(k, n, _, _), for w in split(n, ' ');", "k w", "SELECT DISTINCT p_partkey AS k, unnest(string_split(p_name, ' ')) AS w FROM part")
# Longer programs, over graphs that orders and conversations make.
add("messages_of_neighbours", "customer dated part line", "relation asker(i64, String); relation near(i64, i64); relation note(i64, i64, String); relation title(i64, String); relation out(i64, String, i64, String, String);"
    "asker(1, '1997-06-30'); near(a, b) :- asker(a, _), customer(a, n, _, _), customer(b, n, _, _), if a <> b;"
    "note(o, p, CASE WHEN f = 'N' THEN '' ELSE f END) :- line(o, p, _, _, f, _); title(p, n) :- part(p, n, _, _);"
    "out(c, m, o, d, d) :- asker(a, last), near(a, c), dated(o, c, d, v), customer(c, _, m, _), if v > 400000, if d < last;"
    "out(c, m, o, x, d) :- asker(a, last), near(a, c), dated(o, c, d, _), note(o, _, x), customer(c, _, m, _), if length(x) > 0, if d < last;"
    "out(c, m, o, n, d) :- asker(a, last), near(a, c), dated(o, c, d, _), note(o, p, x), title(p, n), customer(c, _, m, _), if length(x) = 0, if d < last;", "c segment o content day",
    "WITH n AS (SELECT b.c_custkey AS c, b.c_mktsegment AS segment FROM customer a JOIN customer b USING (c_nationkey) WHERE a.c_custkey = 1 AND b.c_custkey <> 1), o AS (SELECT c, segment, o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS v FROM n JOIN orders ON o_custkey = c WHERE o_orderdate < TIMESTAMP '1997-06-30') "
    "SELECT c, segment, o, day AS content, day FROM o WHERE v > 400000 UNION SELECT c, segment, o, l_returnflag, day FROM o JOIN lineitem ON l_orderkey = o WHERE l_returnflag <> 'N' UNION SELECT c, segment, o, p_name, day FROM o JOIN lineitem ON l_orderkey = o JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N'")  # fmt: skip
_KNOWN = "WHERE NOT EXISTS (SELECT 1 FROM recurring.q h WHERE h.k = c.k AND h.x = c.x AND h.y = c.y)"
add("aliases", "line", library.ALIASES + "copies(o * 10 + n, o * 10 + n - 1) :- line(o, _, _, n, 'R', _), if n > 1; deref(o * 10 + n div 3, o * 10 + n) :- line(o, _, _, n, 'A', _);", "x y",
    "WITH RECURSIVE cp AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS x, l_orderkey * 10 + l_linenumber - 1 AS y FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 1), dr AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber // 3 AS p, l_orderkey * 10 + l_linenumber AS v FROM lineitem WHERE l_returnflag = 'A'), "
    "named AS (SELECT x FROM cp UNION SELECT y FROM cp UNION SELECT p FROM dr UNION SELECT v FROM dr), q(k, x, y) USING KEY (k, x, y) AS (SELECT 'f', x, x FROM named UNION ALL SELECT 'f', x, y FROM cp UNION (SELECT DISTINCT k, x, y FROM ("
    "SELECT 'f' AS k, a.x, b.y FROM recurring.q a JOIN recurring.q b ON a.k = 'f' AND b.k = 'f' AND a.y = b.x UNION SELECT 'f', cp.x, m.y FROM cp JOIN recurring.q m ON m.k = 'm' AND m.x = cp.y "
    "UNION SELECT 'm', a.v, b.v FROM dr a JOIN recurring.q w ON w.k = 'v' AND w.x = a.p JOIN dr b ON b.p = w.y UNION SELECT 'v', a.x, b.x FROM recurring.q a JOIN recurring.q b ON a.k = 'f' AND b.k = 'f' AND a.y = b.y "
    "UNION SELECT 'v', a.x, b.x FROM recurring.q a JOIN recurring.q m ON a.k = 'f' AND m.k = 'm' AND m.x = a.y JOIN recurring.q b ON b.k = 'f' AND b.y = m.y) c " + _KNOWN + ")) SELECT x, y FROM q WHERE k = 'v'", output="same_value")  # fmt: skip
add("balanced_brackets", "line", library.BALANCED + "open(1, 2); open(3, 4); edge(o * 10 + n, o * 10 + n + 1, CASE WHEN f = 'A' THEN 1 WHEN f = 'R' THEN 2 WHEN q > 25 THEN 3 ELSE 4 END) :- line(o, _, _, n, f, q);", "x y",
    "WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS x, l_orderkey * 10 + l_linenumber + 1 AS y, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_quantity > 25 THEN 3 ELSE 4 END AS b FROM lineitem), p AS (SELECT 1 AS a, 2 AS b UNION SELECT 3, 4), "
    "q(k, x, y) USING KEY (k, x, y) AS (SELECT DISTINCT 'b', s.x, t.y FROM e s JOIN p ON s.b = p.a JOIN e t ON t.x = s.y AND t.b = p.b UNION (SELECT DISTINCT k, x, y FROM (SELECT 'b' AS k, s.x, t.y FROM e s JOIN p ON s.b = p.a JOIN recurring.q m ON m.x = s.y JOIN e t ON t.x = m.y AND t.b = p.b "
    "UNION SELECT 'b', a.x, b.y FROM recurring.q a JOIN recurring.q b ON a.y = b.x) c " + _KNOWN + ")) SELECT x, y FROM q", output="match")  # fmt: skip
add("ontology", "nation supplier region", "relation is_a(i64, i64); relation has(i64, i32, i64); relation narrower(i32, i32); relation chain(i32, i32, i32); relation some(i32, i64, i64); relation both(i64, i64, i64); relation out(i64, i64);"
    "is_a(1000 + s, 100 + n) :- supplier(s, n, _); is_a(100 + n, r) :- nation(n, _, r); has(1000 + s, 1, 100 + s % 25) :- supplier(s, _, _); has(100 + n, 2, r) :- nation(n, _, r);"
    "narrower(1, 3); chain(3, 2, 4); some(4, r, 50 + r) :- region(r, _); both(50 + r, 100 + n, 70 + r) :- nation(n, _, r);"
    "is_a(x, z) :- is_a(x, y), is_a(y, z); is_a(x, z) :- is_a(x, y), is_a(x, w), both(y, w, z); is_a(x, z) :- has(x, r, y), some(r, y, z);"
    "has(x, r, z) :- is_a(x, y), has(y, r, z); has(x, s, y) :- has(x, r, y), narrower(r, s); has(x, t, z) :- has(x, r, y), has(y, s, z), chain(r, s, t); out(x, y) :- is_a(x, y);", "x y",
    "WITH RECURSIVE b AS (SELECT DISTINCT 50 + n_regionkey AS y, 100 + n_nationkey AS w, 70 + n_regionkey AS z FROM nation), q(k, x, y) USING KEY (k, x, y) AS (SELECT 0, 1000 + s_suppkey, 100 + s_nationkey FROM supplier UNION ALL SELECT 0, 100 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1, 1000 + s_suppkey, 100 + s_suppkey % 25 FROM supplier UNION ALL SELECT 2, 100 + n_nationkey, n_regionkey FROM nation "
    "UNION (SELECT DISTINCT k, x, y FROM (SELECT d.k, a.x, d.y FROM recurring.q a JOIN recurring.q d ON a.k = 0 AND a.y = d.x UNION SELECT 0, a.x, b.z FROM recurring.q a JOIN recurring.q d ON a.k = 0 AND d.k = 0 AND a.x = d.x JOIN b ON b.y = a.y AND b.w = d.y UNION SELECT 0, x, 50 + y FROM recurring.q WHERE k = 4 AND y IN (SELECT r_regionkey FROM region) "
    "UNION SELECT 3, x, y FROM recurring.q WHERE k = 1 UNION SELECT 4, a.x, d.y FROM recurring.q a JOIN recurring.q d ON a.k = 3 AND d.k = 2 AND a.y = d.x) c " + _KNOWN + ")) SELECT x, y FROM q WHERE k = 0")  # fmt: skip
add("sequence_order", "turn", "relation child(i64, i64, i64); relation younger(i64, i64, i64); relation between(i64, i64, i64); relation beside(i64, i64, i64); relation first(i64, i64, i64); relation above(i64, i64, i64); relation after(i64, i64, i64); relation shown(i64, i64); relation skip(i64, i64, i64); relation out(i64, i64, i64);"
    "child(c, t, (t - 1) div 2) :- turn(c, t, _), if t > 0; younger(c, a, b) :- child(c, a, p), child(c, b, p), if a > b; between(c, a, b) :- younger(c, a, m), younger(c, m, b);"
    "beside(c, a, b) :- younger(c, a, b), !between(c, a, b); first(c, p, a) :- child(c, a, p), !younger(c, _, a);"
    "above(c, a, b) :- beside(c, a, b); above(c, a, b) :- child(c, a, p), !beside(c, a, _), above(c, p, b); after(c, p, a) :- first(c, p, a); after(c, a, b) :- turn(c, a, _), !first(c, a, _), above(c, a, b);"
    "shown(c, t) :- turn(c, t, r), if r <> 'assistant'; skip(c, a, b) :- after(c, a, b); skip(c, a, d) :- skip(c, a, b), !shown(c, b), after(c, b, d); out(c, a, b) :- shown(c, a), skip(c, a, b), shown(c, b);", "c a b",
    "WITH RECURSIVE w AS (SELECT conv_id AS c, turn AS t, role, [0::BIGINT] AS path FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, turn, x.role, list_append(path, -turn) FROM w JOIN conversations x ON conv_id = c AND turn > 0 AND (turn - 1) // 2 = t), v AS (SELECT c, t AS a, lead(t) OVER (PARTITION BY c ORDER BY path) AS b FROM w WHERE role <> 'assistant') SELECT c, a, b FROM v WHERE b IS NOT NULL")
add("loans", "line", "relation at(i64, i64); relation issue(i64, i64, i64); relation step(i64, i64); relation sub(i64, i64, i64); relation killed(i64, i64); relation alive(i64, i64); relation ends(i64, i64); relation holds(i64, i64, i64); relation out(i64, i64);"
    "at(o * 10 + n, o) :- line(o, _, _, n, _, _); step(p, p + 1) :- at(p, o), at(p + 1, o); issue(s % 4, o * 10 + n, o * 10 + n) :- line(o, _, s, n, 'A', _); sub(s % 4, (s + 1) % 4, o * 10 + n) :- line(o, _, s, n, 'R', _);"
    "killed(l, o * 10 + n) :- issue(_, l, _), at(l, o), line(o, _, _, n, _, q), if q > 45; alive(r, p) :- at(p, _), for r in 0..4, if (p + r) % 5 <> 0; ends(l, o * 10 + n) :- issue(_, l, _), at(l, o), line(o, _, _, n, 'N', _);"
    "holds(r, l, p) :- issue(r, l, p); holds(s, l, p) :- holds(r, l, p), sub(r, s, p); holds(r, l, q) :- holds(r, l, p), !killed(l, p), step(p, q), alive(r, q); out(l, p) :- holds(_, l, p), ends(l, p);", "l p",
    "WITH RECURSIVE li AS (SELECT l_orderkey * 10 + l_linenumber AS p, l_orderkey AS o, l_suppkey % 4 AS s, (l_suppkey + 1) % 4 AS s2, l_returnflag AS f, l_quantity AS q FROM lineitem), spot AS (SELECT DISTINCT p, o FROM li), issue AS (SELECT DISTINCT s AS r, p AS l, o FROM li WHERE f = 'A'), killed AS (SELECT DISTINCT l, p FROM issue JOIN li USING (o) WHERE q > 45), "
    "h AS (SELECT r, l, l AS p FROM issue UNION (SELECT n.r, n.l, n.p FROM (SELECT li.s2 AS r, h.l, h.p FROM h JOIN li ON li.p = h.p AND li.f = 'R' AND li.s = h.r UNION SELECT h.r, h.l, b.p FROM h JOIN spot a ON a.p = h.p JOIN spot b ON b.p = h.p + 1 AND b.o = a.o WHERE (b.p + h.r) % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM killed k WHERE k.l = h.l AND k.p = h.p)) n)) "
    "SELECT DISTINCT l, h.p FROM h JOIN li ON li.p = h.p AND li.f = 'N' JOIN spot ON spot.p = l AND spot.o = li.o")  # fmt: skip
add("lists_in_recursion", "region", "relation grown(Vec<i32>, i32); relation out(i32, i32, i32); grown([r], 0) :- region(r, _); grown(concat(l, [h + 1]), h + 1) :- grown(l, h), if h < 5; out(element_at(l, 1), len(l), h) :- grown(l, h);", "r n h", "SELECT r_regionkey AS r, (h + 1)::INT AS n, h::INT AS h FROM region, range(0, 6) t(h)")
add("generator_in_recursion", "nation", "relation out(i32, i32); out(n, n % 3) :- nation(n, _, _); out(n, y) :- out(n, x), for y in x + 2..x + 4, if y < 15;", "n y", "WITH RECURSIVE w AS (SELECT n_nationkey AS n, (n_nationkey % 3)::INT AS y FROM nation UNION SELECT n, (y + d)::INT FROM w, range(2, 4) t(d) WHERE y + d < 15) SELECT n, y FROM w")
add("least_of_all_paths", "turn", "relation way(i64, i64, i64); relation out(i64, i64, i64); way(c, 0, 0) :- turn(c, 0, _); way(c, y, d + (x * 3 + 2) % 5) :- way(c, x, d), turn(c, x + 1, _), let y = x + 1; way(c, y, d + (x * 2 + 4) % 7) :- way(c, x, d), turn(c, x + 2, _), let y = x + 2; out(c, t, m) :- agg m = min(d) in way(c, t, d);", "c t m",
    "WITH RECURSIVE w AS (SELECT conv_id AS c, 0::BIGINT AS t, 0::BIGINT AS d FROM conversations WHERE turn = 0 UNION SELECT c, turn, d + CASE turn - t WHEN 1 THEN (t * 3 + 2) % 5 ELSE (t * 2 + 4) % 7 END FROM w JOIN conversations ON conv_id = c AND turn - t IN (1, 2)) SELECT c, t, min(d) AS m FROM w GROUP BY c, t")


def queries() -> dict[str, RuleQuery]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in QUERIES.items() if q.sql}
