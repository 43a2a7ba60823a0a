"""Programs over the driver's tables, with DuckDB SQL of the same result.

Programs run as DataFrame plans over whole tables; a few read a JSON text column
or run per row as documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import compile
from .functions.catalogue import functions as function_catalogue
from .operators.shape_ops import observed_type
from .sources import parquet_tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: name: (program over tables, SQL)
PROGRAMS: dict[str, tuple[str, str]] = {
    "proj_object": ("orders[] | {k: .o_orderkey, p: .o_totalprice}", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders"),
    "filter_select": (
        "lineitem[] | select(.l_quantity > 45 and .l_discount >= 0.05) | {k: .l_orderkey, q: .l_quantity, d: .l_discount}",
        "SELECT l_orderkey AS k, l_quantity AS q, l_discount AS d FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05",
    ),
    "map_arith": ("lineitem[] | {k: .l_orderkey, r: (.l_extendedprice * (1 - .l_discount))}", "SELECT l_orderkey AS k, l_extendedprice * (1 - l_discount) AS r FROM lineitem"),
    "mod_neg": ("orders[] | (.o_orderkey % 7), -.o_orderkey", "SELECT o_orderkey % 7 AS value FROM orders UNION ALL SELECT -o_orderkey FROM orders"),
    "comma_union": ("nation[] | .n_name, (.n_nationkey | tostring)", "SELECT n_name AS value FROM nation UNION ALL SELECT n_nationkey::VARCHAR FROM nation"),
    "if_elif": (
        'part[] | {k: .p_partkey, size: (.p_size | if . < 10 then "small" elif . < 30 then "medium" else "large" end)}',
        "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part",
    ),
    "alternative": (
        "customer[] | {k: .c_custkey, b: ((if .c_acctbal > 0 then .c_acctbal else null end) // 0)}",
        "SELECT c_custkey AS k, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0)::DOUBLE AS b FROM customer",
    ),
    "type_of": (
        "orders[] | {k: .o_orderkey, a: (.o_orderkey | type), b: (.o_orderstatus | type), c: ([.o_orderkey] | type), d: (null | type), e: ((.o_orderkey > 5) | type)}",
        "SELECT o_orderkey AS k, 'number' AS a, 'string' AS b, 'array' AS c, 'null' AS d, 'boolean' AS e FROM orders",
    ),
    "iter_embedding": ("embeddings[] | .vec_id as $i | .embedding[] | {i: $i, x: .}", "SELECT vec_id AS i, unnest(embedding) AS x FROM embeddings"),
    "map_embedding": ("embeddings[] | {i: .vec_id, s: (.embedding | map(. * 2) | length), f: (.embedding | map(. * 2) | .[0])}", "SELECT vec_id AS i, len(embedding)::BIGINT AS s, embedding[1]::DOUBLE * 2 AS f FROM embeddings"),
    "norm_reduce": (
        "embeddings[] | {i: .vec_id, n: (reduce .embedding[] as $x (0; . + $x * $x) | . * 1000 | round)}",
        "SELECT vec_id AS i, round(list_reduce([0::DOUBLE] || list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b) * 1000) AS n FROM embeddings",
    ),
    "index_neg": ("embeddings[] | {i: .vec_id, x: .embedding[-1]}", "SELECT vec_id AS i, embedding[-1] AS x FROM embeddings"),
    "slice_vec": ("embeddings[] | {i: .vec_id, x: (.embedding[1:4] | map(tostring | length) | length), y: .embedding[1:4][2]}", "SELECT vec_id AS i, 3::BIGINT AS x, embedding[4] AS y FROM embeddings"),
    "any_all_vec": (
        "embeddings[] | {i: .vec_id, a: any(.embedding[]; . > 0.25), b: all(.embedding[]; . > -0.25)}",
        "SELECT vec_id AS i, len(list_filter(embedding, lambda x: x > 0.25)) > 0 AS a, len(list_filter(embedding, lambda x: x > -0.25)) = len(embedding) AS b FROM embeddings",
    ),
    "group_sum": (
        "lineitem | group_by(.l_returnflag) | map({f: .[0].l_returnflag, s: (map(.l_quantity) | add), n: length, m: (map(.l_extendedprice * (1 - .l_discount)) | add | round)})",
        "SELECT l_returnflag AS f, sum(l_quantity) AS s, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount))) AS m FROM lineitem GROUP BY 1",
    ),
    "group_stats": (
        "orders | group_by(.o_orderpriority) | map({p: .[0].o_orderpriority, lo: (map(.o_totalprice) | min), hi: (map(.o_totalprice) | max), big: (map(select(.o_totalprice > 150000)) | length), customers: (map(.o_custkey) | unique | length), any_f: any(.o_orderstatus == \"F\"), all_pos: all(.o_totalprice > 0)})",
        "SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) FILTER (o_totalprice > 150000) AS big, count(DISTINCT o_custkey) AS customers, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 0) AS all_pos FROM orders GROUP BY 1",
    ),
    "avg_idiom": ("part | group_by(.p_brand) | map({b: .[0].p_brand, avg: ((map(.p_size) | add) / length)})", "SELECT p_brand AS b, sum(p_size)::DOUBLE / count(*) AS avg FROM part GROUP BY 1"),
    "table_length": ("lineitem | length", "SELECT count(*) AS value FROM lineitem"),
    "table_add": ("orders | map(.o_custkey) | add", "SELECT sum(o_custkey)::BIGINT AS value FROM orders"),
    "min_max_idiom": ("part | {lo: (map(.p_retailprice) | min), hi: (map(.p_retailprice) | max), n: length}", "SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) AS n FROM part"),
    "unique_vals": ("orders | map(.o_orderpriority) | unique", "SELECT DISTINCT o_orderpriority AS value FROM orders"),
    "unique_by_cust": (
        "orders | sort_by(.o_orderkey) | unique_by(.o_custkey) | map({c: .o_custkey, k: .o_orderkey})",
        "SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY 1",
    ),
    "min_max_by": (
        "orders | group_by(.o_custkey) | map({c: .[0].o_custkey, hi: (max_by(.o_totalprice, .o_orderkey) | .o_orderkey), lo: (min_by(.o_totalprice, .o_orderkey) | .o_orderkey)})",
        "SELECT o_custkey AS c, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS hi, arg_min(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS lo FROM orders GROUP BY 1",
    ),
    "sort_topk": (
        "orders | sort_by(.o_totalprice, .o_orderkey) | reverse | .[:10] | map({k: .o_orderkey, p: .o_totalprice})",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10",
    ),
    "first_sorted": ("orders | sort_by(.o_totalprice, .o_orderkey) | first | {k: .o_orderkey}", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1"),
    "join_bind": (
        "customer[] as $c | orders[] as $o | select($c.c_custkey == $o.o_custkey) | {n: $c.c_name, k: $o.o_orderkey, p: $o.o_totalprice}",
        "SELECT c_name AS n, o_orderkey AS k, o_totalprice AS p FROM customer JOIN orders ON c_custkey = o_custkey",
    ),
    "join_three": (
        "nation[] as $n | customer[] as $c | select($c.c_nationkey == $n.n_nationkey) | orders[] as $o | select($o.o_custkey == $c.c_custkey and $o.o_totalprice > 100000) | {nation: $n.n_name, k: $o.o_orderkey}",
        "SELECT n_name AS nation, o_orderkey AS k FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    ),
    "join_group": (
        "[customer[] as $c | orders[] as $o | select($c.c_custkey == $o.o_custkey) | {s: $c.c_mktsegment, p: $o.o_totalprice}] | group_by(.s) | map({s: .[0].s, t: (map(.p) | add | round), n: length})",
        "SELECT c_mktsegment AS s, round(sum(o_totalprice)) AS t, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
    "semi_any": (
        "customer[] | .c_custkey as $c | select(any(orders[]; .o_custkey == $c)) | {c: $c}",
        "SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    ),
    "anti_not_any": (
        "customer[] | .c_custkey as $c | select(any(orders[]; .o_custkey == $c) | not) | {c: $c}",
        "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    ),
    "freq_join": (
        "(events | group_by(.event_type) | map({v: .[0].event_type, c: length}) | .[]) as $f | events[] as $e | select($e.event_type == $f.v and $e.value > 50) | {id: $e.event_id, w: ($e.value * $f.c | floor)}",
        "WITH f AS (SELECT event_type AS v, count(*) AS c FROM events GROUP BY 1) SELECT event_id AS id, floor(value * c) AS w FROM events JOIN f ON v = event_type WHERE value > 50",
    ),
    "union_tables": ("(customer | map({k: .c_nationkey, b: .c_acctbal})) + (supplier | map({k: .s_nationkey, b: .s_acctbal}))", "SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier"),
    "array_difference": ("(customer | map(.c_custkey)) - (orders | map(.o_custkey))", "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "str_split_join": (
        'documents[] | {i: .doc_id, s: (.text | split(" ") | .[:5] | join("-"))}',
        "SELECT doc_id AS i, array_to_string(string_split(text, ' ')[1:5], '-') AS s FROM documents",
    ),
    "str_split_join_whole": (
        'documents[] | {i: .doc_id, s: (.text | split(" ") | join("-"))}',
        "SELECT doc_id AS i, array_to_string(string_split(text, ' '), '-') AS s FROM documents",
    ),
    "str_tests": (
        'documents[] | {i: .doc_id, a: (.text | startswith("The")), b: (.text | endswith(".")), c: (.text | test("[0-9]{3}")), d: (.text | contains("license")), e: (.text | test("LICENSE"; "i"))}',
        "SELECT doc_id AS i, starts_with(text, 'The') AS a, ends_with(text, '.') AS b, regexp_matches(text, '[0-9]{3}') AS c, contains(text, 'license') AS d, regexp_matches(text, 'LICENSE', 'i') AS e FROM documents",
    ),
    "str_trim_repl": (
        'documents[] | {i: .doc_id, s: (.text | ltrimstr("The ") | rtrimstr(".") | gsub("[0-9]+"; "#"))}',
        "SELECT doc_id AS i, regexp_replace(CASE WHEN ends_with(t, '.') THEN t[:-2] ELSE t END, '[0-9]+', '#', 'g') AS s FROM (SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN text[5:] ELSE text END AS t FROM documents)",
    ),
    "str_sub": ('orders[] | {k: .o_orderkey, s: (.o_orderpriority | sub("[A-Z]+"; "x"))}', "SELECT o_orderkey AS k, regexp_replace(o_orderpriority, '[A-Z]+', 'x') AS s FROM orders"),
    "str_capture": ('orders[] | {k: .o_orderkey} + (.o_orderpriority | capture("(?<n>[0-9])-(?<w>.*)"))', "SELECT o_orderkey AS k, regexp_extract(o_orderpriority, '([0-9])-(.*)', 1) AS n, regexp_extract(o_orderpriority, '([0-9])-(.*)', 2) AS w FROM orders"),
    "str_len_case": (
        "documents[] | {i: .doc_id, n: (.text | length), l: (.lang | ascii_upcase), r: (.source | reverse)}",
        "SELECT doc_id AS i, length(text) AS n, upper(lang) AS l, reverse(source) AS r FROM documents",
    ),
    "str_interpolation": ('nation[] | "\\(.n_nationkey): \\(.n_name)"', "SELECT n_nationkey || ': ' || n_name AS value FROM nation"),
    "str_repeat_concat": ('region[] | {s: (.r_name + "-" + .r_name), t: (.r_name * 2)}', "SELECT r_name || '-' || r_name AS s, repeat(r_name, 2) AS t FROM region"),
    "json_props": ("events[] | {i: .event_id, k: (.props | fromjson | .k + 0)}", "SELECT event_id AS i, (props->>'$.k')::DOUBLE AS k FROM events"),
    "json_filter": (
        'events[] | select(.event_type == "click" and (.props | fromjson | .k) > 50) | {user_id, value, k: (.props | fromjson | .k + 0)}',
        "SELECT user_id, value, (props->>'$.k')::DOUBLE AS k FROM events WHERE event_type = 'click' AND (props->>'$.k')::DOUBLE > 50",
    ),
    "entries": (
        "region[] | .r_regionkey as $r | {k: .r_regionkey, n: .r_regionkey} | to_entries[] | {r: $r, key: .key, v: .value}",
        "SELECT r_regionkey AS r, unnest(['k', 'n']) AS key, r_regionkey AS v FROM region",
    ),
    "vec_entries": ("embeddings[] | .vec_id as $i | .embedding[:3] | to_entries[] | {i: $i, k: .key, v: .value}", "SELECT vec_id AS i, unnest([0, 1, 2])::INT AS k, unnest(embedding[1:3]) AS v FROM embeddings"),
    "vec_entries_whole": ("embeddings[] | .vec_id as $i | .embedding | to_entries[] | {i: $i, k: .key, v: .value}", "SELECT vec_id AS i, unnest(range(len(embedding)))::INT AS k, unnest(embedding) AS v FROM embeddings"),
    "pow_floor": (
        "part[] | {k: .p_partkey, a: (.p_size | pow(.; 2) | floor), b: (.p_retailprice | sqrt | floor), c: (.p_retailprice | round), d: (-.p_retailprice | trunc), e: (.p_retailprice | ceil), f: (.p_size / 7 | floor)}",
        "SELECT p_partkey AS k, floor(pow(p_size, 2)) AS a, floor(sqrt(p_retailprice)) AS b, round(p_retailprice) AS c, trunc(-p_retailprice) AS d, ceil(p_retailprice) AS e, floor(p_size / 7) AS f FROM part",
    ),
    "abs_div": ("customer[] | {k: .c_custkey, a: (.c_acctbal | abs), z: (1 / (.c_custkey - .c_custkey) | isinfinite)}", "SELECT c_custkey AS k, abs(c_acctbal) AS a, true AS z FROM customer"),
    "def_inline": (
        "def net(rate): .l_extendedprice * (1 - rate); lineitem[] | {k: .l_orderkey, n: .l_linenumber, v: net(.l_discount + 0.01)}",
        "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice * (1 - (l_discount + 0.01)) AS v FROM lineitem",
    ),
    "sort_array": ("embeddings[] | {i: .vec_id, lo: (.embedding | sort | first), hi: (.embedding | sort | last), u: (.embedding | unique | length), m: (.embedding | max)}", "SELECT vec_id AS i, list_min(embedding) AS lo, list_max(embedding) AS hi, len(list_distinct(embedding))::BIGINT AS u, list_max(embedding) AS m FROM embeddings"),
    "range_rows": ("region[] | .r_regionkey as $k | range(2; 5) | {k: $k, i: .}", "SELECT r_regionkey AS k, unnest([2, 3, 4])::BIGINT AS i FROM region"),
    "map_select": ("embeddings[] | {i: .vec_id, n: (.embedding | map(select(. > 0)) | length), s: ([.embedding[] | select(. > 0) | . * 0 + 1] | add)}", "SELECT vec_id AS i, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n, nullif(len(list_filter(embedding, lambda x: x > 0)), 0)::DOUBLE AS s FROM embeddings"),
    "group_first_sorted": (
        "orders | sort_by(.o_orderkey) | group_by(.o_custkey) | map({c: .[0].o_custkey, k: .[0].o_orderkey, s: .[0].o_orderstatus})",
        "SELECT o_custkey AS c, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1",
    ),
    "date_text": ("orders[] | {k: .o_orderkey, y: (.o_orderdate | .[0:4]), m: (.o_orderdate | split(\"-\") | .[1] | tonumber)}", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y') AS y, month(o_orderdate)::DOUBLE AS m FROM orders"),
    "null_arith": ("customer[] | {k: .c_custkey, a: (null + .c_acctbal), b: ((if .c_acctbal < 0 then .c_acctbal else null end) + 1)}", "SELECT c_custkey AS k, c_acctbal AS a, coalesce(CASE WHEN c_acctbal < 0 THEN c_acctbal END, 0) + 1 AS b FROM customer"),
    "array_cycle": ("region[] | {k: .r_regionkey, a: ([1, 2, 3] * 5 | add), b: ([1, 2, 2, 3] - [2] | length)}", "SELECT r_regionkey AS k, 9::BIGINT AS a, 2::BIGINT AS b FROM region"),
    # -- parts of tables, folds and windows
    "limit_rows": (
        "limit(7; (orders | sort_by(.o_totalprice, .o_orderkey))[]) | {k: .o_orderkey}",
        "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7",
    ),
    "slice_rows": ("(orders | sort_by(.o_orderkey))[3:9] | map({k: .o_orderkey, p: .o_totalprice})", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_orderkey LIMIT 6 OFFSET 3"),
    "nth_row": ("nth(4; (orders | sort_by(.o_totalprice, .o_orderkey))[]) | {k: .o_orderkey}", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 4"),
    "reduce_rows": (
        "reduce (lineitem[] | select(.l_discount > 0.04)) as $l (1000; . + $l.l_quantity)",
        "SELECT 1000 + sum(l_quantity) AS value FROM lineitem WHERE l_discount > 0.04",
    ),
    "reduce_extremes": (
        "reduce orders[] as $o (null; if $o.o_totalprice > . then $o.o_totalprice else . end)",
        "SELECT max(o_totalprice) AS value FROM orders",
    ),
    "running_in_groups": (
        "orders | group_by(.o_custkey) | map(sort_by(.o_orderkey) | foreach .[] as $o (0; . + $o.o_orderkey; {k: $o.o_orderkey, s: .}))",
        "SELECT o_orderkey AS k, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS s FROM orders",
    ),
    "running_rows": (
        "foreach (nation | sort_by(.n_name))[] as $n (0; . + $n.n_nationkey; {n: $n.n_name, s: .})",
        "SELECT n_name AS n, (sum(n_nationkey) OVER (ORDER BY n_name))::BIGINT AS s FROM nation",
    ),
    "neighbor_events": (
        "events | group_by(.user_id) | map(sort_by(.event_id) as $e | range(($e | length) - 1) as $i | {id: $e[$i].event_id, gap: ($e[$i + 1].event_id - $e[$i].event_id), same: ($e[$i + 1].event_type == $e[$i].event_type)})",
        "SELECT * FROM (SELECT event_id AS id, lead(event_id) OVER w - event_id AS gap, lead(event_type) OVER w = event_type AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE gap IS NOT NULL",
    ),
    "flatten_rows": ("embeddings | map(.embedding[0:3]) | flatten", "SELECT unnest(embedding[1:3]) AS value FROM embeddings"),
    "entries_of_rows": ("nation | sort_by(.n_name) | to_entries | map({i: .key, n: .value.n_name})", "SELECT row_number() OVER (ORDER BY n_name) - 1 AS i, n_name AS n FROM nation"),
    "group_lists": (
        'orders | sort_by(.o_orderkey) | group_by(.o_custkey) | map({c: .[0].o_custkey, ks: (map(.o_orderkey | tostring) | join(","))})',
        "SELECT o_custkey AS c, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1",
    ),
    "groups_one_by_one": ("part | group_by(.p_brand)[] | {b: .[0].p_brand, n: length}", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1"),
    # -- joins with aggregates and by nearness
    "aggregate_beside": (
        "customer[] as $c | {c: $c.c_custkey, n: ([orders[] | select(.o_custkey == $c.c_custkey and .o_totalprice > 150000)] | length), last: ([orders[] | select(.o_custkey == $c.c_custkey) | .o_orderkey] | max)}",
        "SELECT c_custkey AS c, count(o_orderkey) FILTER (o_totalprice > 150000) AS n, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "as_of": (
        "events[] as $e | {id: $e.event_id, o: ([orders[] | select(.o_custkey == $e.user_id and .o_orderkey <= $e.event_id)] | max_by(.o_orderkey) | .o_orderkey)}",
        "SELECT event_id AS id, max(o_orderkey) AS o FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderkey <= event_id GROUP BY 1",
    ),
    "as_of_next": (
        "orders[] as $o | {k: $o.o_orderkey, next: ([orders[] | select(.o_custkey == $o.o_custkey and .o_orderkey > $o.o_orderkey)] | min_by(.o_orderkey) | .o_orderkey)}",
        "SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders",
    ),
    "anti_some": (
        "customer[] | .c_custkey as $c | select(any(orders[]; .o_custkey == $c and .o_totalprice > 300000) | not) | {c: $c}",
        "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "difference_some": (
        "(customer | map(.c_custkey)) - ([orders[] | select(.o_totalprice > 300000) | .o_custkey])",
        "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    # -- values of rows
    "type_of_some": (
        "orders[] | {k: .o_orderkey, t: ((if .o_orderkey % 3 == 0 then null else .o_totalprice end) | type), e: (((if .o_orderkey % 5 == 0 then null else .o_orderkey end) > 7) | type)}",
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE 'number' END AS t, 'boolean' AS e FROM orders",
    ),
    "range_of_rows": ("nation[] | .n_nationkey as $k | range(.n_regionkey; .n_nationkey) | {k: $k, i: .}", "SELECT n_nationkey AS k, unnest(range(n_regionkey, n_nationkey)) AS i FROM nation"),
    "cycles_of_rows": (
        "nation[] | {k: .n_nationkey, a: ([1, 2, 3] * .n_regionkey | length), b: ([.n_regionkey, 1, 2] - [2] | length), c: (\"ab\" * .n_regionkey | length)}",
        "SELECT n_nationkey AS k, n_regionkey::BIGINT AS a, CASE WHEN n_regionkey = 2 THEN 1 ELSE 2 END::BIGINT AS b, 2 * n_regionkey::BIGINT AS c FROM nation",
    ),
    "maths_of_rows": (
        "part[] | {k: .p_partkey, a: (.p_retailprice | logb), b: (.p_retailprice | significand), c: (.p_size | negate), d: (.p_size % 5 | pow10), e: scalb(.p_retailprice; 3), f: (.p_retailprice | isnormal), g: ((.p_size - .p_size) / 0 | isnan), h: (.p_size / 0 | isfinite), i: (infinite > .p_size), j: (nan < .p_size)}",
        "SELECT p_partkey AS k, floor(log2(p_retailprice)) AS a, p_retailprice / pow(2, floor(log2(p_retailprice))) AS b, -p_size AS c, pow(10, p_size % 5) AS d, p_retailprice * 8 AS e, true AS f, true AS g, p_size = 0 AND false AS h, true AS i, true AS j FROM part",
    ),
    "is_kind": (
        "orders[] | (if .o_orderkey % 2 == 0 then null else .o_orderkey end) as $x | {k: .o_orderkey, a: ($x | isnumber), b: ($x | isnull), c: (.o_orderstatus | isstring), d: ($x == null | isboolean), e: ([$x] | isarray), f: ({x: $x} | isobject)}",
        "SELECT o_orderkey AS k, o_orderkey % 2 <> 0 AS a, o_orderkey % 2 = 0 AS b, true AS c, true AS d, true AS e, true AS f FROM orders",
    ),
    "filters_by_kind": (
        "orders[] | .o_orderkey as $k | [(if $k % 2 == 0 then null else $k end), $k] | {k: $k, a: (map(values) | length), b: (map(nulls) | length), c: (map(numbers) | length), d: (map(scalars) | length), e: (map(strings) | length)}",
        "SELECT o_orderkey AS k, 2 - (o_orderkey % 2 = 0)::BIGINT AS a, (o_orderkey % 2 = 0)::BIGINT AS b, 2 - (o_orderkey % 2 = 0)::BIGINT AS c, 2::BIGINT AS d, 0::BIGINT AS e FROM orders",
    ),
    "strings_of_rows": (
        'orders[] | {k: .o_orderkey, a: (.o_orderpriority | split("-"; null) | length), b: ([.o_orderpriority | scan("[A-Z]")] | length), c: ([.o_orderpriority | splits("-")] | .[0]), d: (.o_orderpriority | @base64), e: (.o_orderpriority | @uri), f: (.o_orderpriority | @json), g: (.o_orderkey | @text), h: (.o_orderpriority | explode | .[0])}',
        "SELECT o_orderkey AS k, len(string_split(o_orderpriority, '-'))::BIGINT AS a, length(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g')) AS b, string_split(o_orderpriority, '-')[1] AS c, base64(encode(o_orderpriority)) AS d, url_encode(o_orderpriority) AS e, '\"' || o_orderpriority || '\"' AS f, o_orderkey::VARCHAR AS g, ascii(o_orderpriority)::BIGINT AS h FROM orders",
    ),
    "assigned": (
        "nation[] | (.n_regionkey += 10) | (.n_name |= ascii_downcase) | (.extra = .n_nationkey * 2) | del(.n_nationkey) | {r: .n_regionkey, n: .n_name, x: .extra, ks: (keys | length)}",
        "SELECT n_regionkey::BIGINT + 10 AS r, lower(n_name) AS n, n_nationkey::BIGINT * 2 AS x, 3::BIGINT AS ks FROM nation",
    ),
    "destructured": (
        "embeddings[] | . as {vec_id: $i, embedding: [$a, $b]} | {i: $i, a: $a, b: $b}",
        "SELECT vec_id AS i, embedding[1] AS a, embedding[2] AS b FROM embeddings",
    ),
    "arrays_of_rows": (
        "nation[] | [.n_nationkey, .n_regionkey] as $p | {k: .n_nationkey, a: ([$p, [1, 2]] | transpose | .[1] | add), b: ([$p, [7]] | flatten | length), c: ($p | to_entries | map(.key + .value) | add), d: ([$p[] | select(. > 3)] | length), e: (isempty($p[] | select(. > 3))), f: ($p | first), g: ($p | del(.[0]) | .[0]), h: (first($p[] | select(. > 3)) // -1), i: ([limit(1; $p[])] | length), j: ($p | has(1)), l: ({a: $p[0]} | map_values(. + 1) | .a)}",
        "SELECT n_nationkey AS k, n_regionkey::BIGINT + 2 AS a, 3::BIGINT AS b, n_nationkey::BIGINT + n_regionkey + 1 AS c, (n_nationkey > 3)::BIGINT + (n_regionkey > 3)::BIGINT AS d, NOT (n_nationkey > 3 OR n_regionkey > 3) AS e, n_nationkey AS f, n_regionkey AS g, CASE WHEN n_nationkey > 3 THEN n_nationkey WHEN n_regionkey > 3 THEN n_regionkey ELSE -1 END AS h, 1::BIGINT AS i, true AS j, n_nationkey::BIGINT + 1 AS l FROM nation",
    ),
    "dates_of_rows": (
        "orders[] | {k: .o_orderkey, a: (.o_orderkey * 86400 | todate), b: (.o_orderkey * 1000 | todate | fromdate)}",
        "SELECT o_orderkey AS k, strftime(make_timestamp(o_orderkey * 86400 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS a, o_orderkey * 1000 AS b FROM orders",
    ),
    "empty_rows": ("orders[] | if .o_orderkey % 4 == 0 then .o_orderkey else empty end", "SELECT o_orderkey AS value FROM orders WHERE o_orderkey % 4 = 0"),
}


def _over_tables(name: str) -> Callable[[SparkSession, str], DataFrame]:
    program = compile(PROGRAMS[name][0])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return program.over(parquet_tables(spark, sf_dir, list(TABLES)))

    return run


# -- per-document programs
COLLATZ = "[.o_orderkey % 30 + 1, 0] | until(.[0] == 1; if .[0] % 2 == 0 then [.[0] / 2, .[1] + 1] else [.[0] * 3 + 1, .[1] + 1] end) | .[1]"


def collatz_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive program per row: the interpreter tier in Arrow batches."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return compile(COLLATZ).run(orders, keys=["o_orderkey"]).select("o_orderkey", F.col("value").cast("double").alias("steps"))


def collatz_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from each key plus 1 (keys start at 0, which never comes to 1), so that every row has an input of its own."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return compile(COLLATZ.replace(" % 30", "")).run(orders, keys=["o_orderkey"]).select("o_orderkey", F.col("value").cast("double").alias("steps"))


#: name: (program per row of orders, SQL of key, value as text, code and message); rows that fail give errors in every tier.
ERRORS: dict[str, tuple[str, str]] = {
    "errors_of_arithmetic": (
        "(if .o_orderkey % 3 == 0 then null else .o_orderkey end) * 2 | tostring",
        "SELECT o_orderkey AS k, (o_orderkey * 2)::VARCHAR AS value, NULL AS code, NULL AS message FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL, 'operands', 'null and 2 cannot be multiplied' FROM orders WHERE o_orderkey % 3 = 0",
    ),
    "errors_of_numbers": (
        '(if .o_orderkey % 2 == 0 then "7.5" else .o_orderstatus end) | tonumber | . * 2 | tostring',
        "SELECT o_orderkey AS k, '15' AS value, NULL AS code, NULL AS message FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, 'argument', '\"' || o_orderstatus || '\" cannot be parsed as a number' FROM orders WHERE o_orderkey % 2 <> 0",
    ),
    "errors_of_dates": (
        '(if .o_orderkey % 2 == 0 then "1970-01-02T00:00:00Z" else .o_orderpriority end) | fromdate | tostring',
        "SELECT o_orderkey AS k, '86400' AS value, NULL AS code, NULL AS message FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, 'argument', 'date \"' || o_orderpriority || '\" does not match format %Y-%m-%dT%H:%M:%SZ' FROM orders WHERE o_orderkey % 2 <> 0",
    ),
    "errors_behind_conditions": (
        "if .o_orderkey % 3 == 0 then (.o_orderstatus | tonumber | tostring) else (.o_custkey | tostring) end",
        "SELECT o_orderkey AS k, o_custkey::VARCHAR AS value, NULL AS code, NULL AS message FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL, 'argument', '\"' || o_orderstatus || '\" cannot be parsed as a number' FROM orders WHERE o_orderkey % 3 = 0",
    ),
    "errors_beside_outputs": (
        "(.o_custkey | tostring), ((if .o_orderkey % 2 == 0 then null else .o_orderkey end) - 1 | tostring)",
        "SELECT o_orderkey AS k, o_custkey::VARCHAR AS value, NULL AS code, NULL AS message FROM orders UNION ALL SELECT o_orderkey, (o_orderkey - 1)::VARCHAR, NULL, NULL FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, NULL, 'operands', 'null and 1 cannot be subtracted' FROM orders WHERE o_orderkey % 2 = 0",
    ),
    "errors_caught": (
        '((.o_orderstatus | tonumber)? // -1) | tostring',
        "SELECT o_orderkey AS k, '-1' AS value, NULL AS code, NULL AS message FROM orders",
    ),
    "errors_raised": (
        'if .o_orderkey % 5 == 0 then error("bad " + .o_orderstatus) elif .o_orderkey % 5 == 1 then try error("x") catch "caught \\(.)" else .o_orderstatus end',
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '\"caught x\"' ELSE '\"' || o_orderstatus || '\"' END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'error' END AS code, CASE WHEN o_orderkey % 5 = 0 THEN 'bad ' || o_orderstatus END AS message FROM orders",
    ),
}


def _with_errors(name: str) -> Callable[[SparkSession, str], DataFrame]:
    program = compile(ERRORS[name][0])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        return program.run(orders, keys=["o_orderkey"]).select(F.col("o_orderkey").alias("k"), "value", "error.code", "error.message")

    return run


#: name: (program per row of nation in the interpreter, SQL expression of its output as JSON text with n for n_nationkey and r for n_regionkey).
INTERPRETED: dict[str, tuple[str, str]] = {
    "recurse_f": ("[.n_nationkey | recurse(if . < 50 then . * 2 + 1 else empty end)] | length", "CASE WHEN n >= 50 THEN 1 ELSE 2 + floor(log2(49.5 / (n + 1)) + 1e-9)::INT + (CASE WHEN (n + 1) * pow(2, 1 + floor(log2(49.5 / (n + 1)) + 1e-9)) - 1 < 50 THEN 1 ELSE 0 END) END"),
    "recurse_all": ("[{a: [.n_nationkey, {b: .n_regionkey}]} | .. | numbers] | tojson", "'\"[' || n || ',' || r || ']\"'"),
    "while_loop": ("[.n_regionkey | while(. < 5; . + 1)] | add // 0", "(SELECT coalesce(sum(i), 0)::INT FROM range(r, 5) t(i))"),
    "until_loop": (".n_nationkey | until(. > 100; . + 7)", "n + 7 * ((100 - n) // 7 + 1)"),
    "repeat_limit": ("[.n_regionkey | limit(4; repeat(. + 3))] | add", "4 * r + 18"),
    "label_break": ("[label $out | range(.n_nationkey + 1) | if . > 5 then ., break $out else . end] | length", "least(n + 1, 7)"),
    "alternative_patterns": ('(if .n_regionkey % 2 == 0 then [.n_nationkey, 1] else {a: .n_nationkey} end) as [$x] ?// {a: $x} | $x', "n"),
    "match_offset": ('.n_name | match("_?([0-9]+)") | [.offset, .string, .captures[0].string] | tojson', "NULL"),
    "dynamic_paths": ('{x: {}} | .x["k\\(1 + 1)"] = 5 | .x.k2', "5"),
    "foreach_extract": ("[foreach range(.n_nationkey) as $i (0; . + $i; [$i, .])] | length", "n"),
    "with_entries": ("{a: .n_nationkey, b: .n_regionkey} | with_entries(.value += 1) | .a + .b", "n + r + 2"),
    "next_toward": ("nexttoward(.n_nationkey; 100) > .n_nationkey", "true"),
    "gamma_of": (".n_regionkey + 1 | gamma | round", "CASE r WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 ELSE 24 END"),
    "format_row": ('[.n_nationkey, null, "x"] | map(fmt_row("-"; "s")) | join(" ")', "'\"' || n || ' - s\"'"),
    "walked": ("[[.n_nationkey], .n_regionkey] | walk(if type == \"number\" then . + 1 else . end) | flatten | add", "n + r + 2"),
    "paths_of": ("[{a: [.n_nationkey, 2], b: {c: null}} | paths] | length", "5"),
    "hole_part": ("try (1 | ??) catch \"hole\"", "NULL"),
}


def interpreted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only the interpreter runs, one program after the other over all nations: name, key and output."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    every = ", ".join(f"([{p}] | tojson)" for p, sql in INTERPRETED.values() if sql != "NULL")
    names = F.array(*[F.lit(n) for n, (_, sql) in INTERPRETED.items() if sql != "NULL"])
    out = compile(every).run(nations, keys=["n_nationkey"], tier="interpreter")
    return out.select(F.get(names, F.col("ord")).alias("name"), "n_nationkey", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("output"), F.col("error.message").alias("failed"))


INTERPRETED_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, n AS n_nationkey, '[' || ({sql})::VARCHAR || ']' AS output, NULL AS failed FROM (SELECT n_nationkey AS n, n_regionkey AS r FROM nation)" for name, (_, sql) in INTERPRETED.items() if sql != "NULL"
)


def shape_partly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a third have text where a number is needed, and some are no JSON."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('"}'))).when(F.col("event_id") % 7 == 0, F.lit('{"k": ')).otherwise(F.col("props"))
    return compile(".k - 1").check(events.select("event_id", made.alias("props")), keys=["event_id"], json="props").select("event_id", "path", "expected", "got")


def neighbor_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between neighbours of an array, with indexes from a range."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    program = compile(".embedding as $a | range($a | length - 1) | . as $i | $a[$i + 1] - $a[$i]")
    return program.run(rows, keys=["vec_id"]).select("vec_id", "ord", F.col("value").alias("diff"))


def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program per JSON document, read with the schema that its inferred shape asks for."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return compile("{double: (.k * 2), odd: (.k % 2 == 1)}").run(events, keys=["event_id"], json="props").select("event_id", "value.double", "value.odd")


def recursive_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive definition with a closure parameter."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    program = compile("def fib(x): if x < 2 then x else fib(x - 1) + fib(x - 2) end; .n_nationkey % 12 as $n | fib($n)")
    return program.run(rows, keys=["n_nationkey"]).select("n_nationkey", F.col("value").cast("double").alias("fib"))


def shape_check_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties the program couldn't work on (.k must be text here, so all of them)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return compile('.k + "x"').check(events, keys=["event_id"], json="props")


def shape_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against a shape: o_totalprice is no text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return compile(".o_totalprice | startswith(\"1\")").check(orders, keys=["o_orderkey"]).select("o_orderkey", "path", "expected")


def shape_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that all events conform to: an empty report."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return compile(".k + 1").check(events, keys=["event_id"], json="props")


def schema_infer_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_type(spark.read.parquet(f"{sf_dir}/events.parquet"), "props")


def infer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both methods infer for a few programs."""
    texts = (".[] | .price, .tag | {v: .net}", "1 - .a", "map(. * 2)", ". + 1", "if . != 5 then 1 else error end", ".a | .b")
    rows = [(t, m, str(i), ", ".join(map(str, o))) for t in texts for m in ("direct", "constraint") for i, o in [compile(t).infer(m)]]
    return spark.createDataFrame(rows, "program string, method string, input string, outputs string")


def shape_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations on shapes, each on small operands: name and result."""
    from .lang import parse
    from .shapes.algebra import BOOL, NULL, NUMBER, STRING, Arr, Neg, Obj, Tup, Union, canonical, disjoint, literal, subtype, to_ddl, widened
    from .shapes.check import check, ill_typed
    from .shapes.constraint import ConstraintInference, constant
    from .shapes.direct import DirectInference

    a, ab = Obj((("a", NUMBER),)), Obj((("a", NUMBER), ("b", STRING)))
    merged = DirectInference().merged
    rows = [
        ("literal", f"{literal(1.0)} {literal('x')} {literal(None)} {literal([1.0])} {literal({'k': True})}"),
        ("subtype", [subtype(x, y) for x, y in ((NUMBER, Union(NUMBER, NULL)), (Union(NUMBER, NULL), NUMBER), (literal(2.0), NUMBER), (ab, a), (a, ab), (Tup((NUMBER, NUMBER)), Arr(NUMBER)))]),
        ("disjoint", [disjoint(x, y) for x, y in ((NUMBER, STRING), (NUMBER, literal(1.0)), (literal(1.0), literal(2.0)), (Neg(NUMBER), NUMBER))]),
        ("merge", f"{merged(a, Obj((('b', STRING),)))} {merged(literal(1.0), NUMBER)} {merged(Union(NUMBER, NULL), NUMBER)} {merged(Arr(NUMBER), Tup((literal(1.0),)))}"),
        ("clash", f"{ill_typed(merged(NUMBER, STRING)) is not None} {ill_typed(a) is not None}"),
        ("canonical", f"{canonical(Union(literal(True), literal(False)))} {canonical(Union(literal(1.0), NUMBER))} {canonical(Neg(Neg(STRING)))}"),
        ("widened", f"{widened(literal(1.0), literal(2.0))} {widened(NUMBER, STRING)} {widened(ab, Obj((('a', literal(1.0)), ('c', BOOL))))}"),
        ("constant", [constant(parse(p)) for p in ("1 + 2", ".a + 1", "[1 + 2]", "{k: .x}", "if true then 1 else 2 end")]),
        ("solved", [str(ConstraintInference().infer(p)[0]) for p in (".a + 1 | . - 2", "if . == 1 then . else error end", ".a.b")]),
        ("check", [str(check(DirectInference().infer(p)[0], v)) for p, v in ((". + 1", "x"), ("1 - .a", {"a": 2.0}), ("map(. * 2)", ["q", True]), (".[] | .price, .tag | {v: .net}", [{"tag": {"net": 1.0}, "price": 25.0}]))]),
        ("read_schema", f"{to_ddl(ab)} {to_ddl(Union(NUMBER, NULL))} {to_ddl(Union(NUMBER, STRING))} {to_ddl(Arr(a))}"),
    ]
    return spark.createDataFrame([(name, found if isinstance(found, str) else ", ".join(str(x).lower() if isinstance(x, bool) else x for x in found)) for name, found in rows], "name string, result string")


def builtin_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_catalogue(spark)


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "collatz_until": (
        collatz_until,
        """WITH RECURSIVE c AS (SELECT o_orderkey, (o_orderkey % 30 + 1)::BIGINT AS x, 0 AS n FROM orders
           UNION ALL SELECT o_orderkey, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, n + 1 FROM c WHERE x <> 1)
           SELECT o_orderkey, n::DOUBLE AS steps FROM c WHERE x = 1""",
    ),
    "collatz_keys": (
        collatz_keys,
        """WITH RECURSIVE c AS (SELECT o_orderkey, (o_orderkey + 1)::BIGINT AS x, 0 AS n FROM orders
           UNION ALL SELECT o_orderkey, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, n + 1 FROM c WHERE x <> 1)
           SELECT o_orderkey, n::DOUBLE AS steps FROM c WHERE x = 1""",
    ),
    "neighbor_diff": (
        neighbor_diff,
        "SELECT vec_id, i::INT AS ord, embedding[i + 2]::DOUBLE - embedding[i + 1]::DOUBLE AS diff FROM (SELECT vec_id, embedding, unnest(range(len(embedding) - 1)) AS i FROM embeddings)",
    ),
    "document_json": (document_json, """SELECT event_id, (props->>'$.k')::DOUBLE * 2 AS "double", (props->>'$.k')::DOUBLE % 2 = 1 AS odd FROM events"""),
    "recursive_def": (
        recursive_def,
        """WITH RECURSIVE f AS (SELECT 0 AS i, 0 AS a, 1 AS b UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 12)
           SELECT n_nationkey, a::DOUBLE AS fib FROM nation JOIN f ON i = n_nationkey % 12""",
    ),
    "shape_check_events": (shape_check_events, "SELECT event_id, '.k' AS path, '(<string> | <null>)' AS expected, props->>'$.k' AS got FROM events"),
    "shape_check_rows": (shape_check_rows, "SELECT o_orderkey, '.o_totalprice' AS path, '<string>' AS expected FROM orders"),
    "shape_clean": (shape_clean, "SELECT event_id, '' AS path, '' AS expected, '' AS got FROM events WHERE props IS NULL"),
    "shape_partly": (
        shape_partly,
        """SELECT event_id, '.k' AS path, '<number>' AS expected, '"' || event_type || '"' AS got FROM events WHERE event_id % 3 = 0
           UNION ALL SELECT event_id, '.', '{k: <number>}', '{"k": ' FROM events WHERE event_id % 3 <> 0 AND event_id % 7 = 0""",
    ),
    "interpreted": (interpreted, INTERPRETED_SQL),
    "schema_infer_agg": (schema_infer_agg, "SELECT 'OBJECT<k: BIGINT>' AS type"),
    "infer_shapes": (
        infer_shapes,
        """SELECT program, method, input, outputs FROM (VALUES
             ('.[] | .price, .tag | {v: .net}', '[{price: {net: <T4>}, tag: {net: <T5>}}]', '{v: <T4>}, {v: <T5>}'), ('1 - .a', '{a: <number>}', '<number>'),
             ('map(. * 2)', '[(<number> | <string>)]', '[(<number> | <string>)]'), ('. + 1', '(<number> | <null>)', '<number>'),
             ('if . != 5 then 1 else error end', '(!5)', '1'), ('.a | .b', '{a: {b: <T2>}}', '<T2>')) t(program, input, outputs), (VALUES ('direct'), ('constraint')) m(method)""",
    ),
    "shape_algebra": (
        shape_algebra,
        """SELECT name, result FROM (VALUES
             ('literal', '1 "x" <null> [1] {k: true}'), ('subtype', 'true, false, true, true, false, true'), ('disjoint', 'true, false, true, true'),
             ('merge', '{a: <number>, b: <string>} 1 <number> [1]'), ('clash', 'True False'), ('canonical', '<bool> <number> <string>'),
             ('widened', '<number> (<number> | <string>) {a: <number>}'), ('constant', 'true, false, true, false, true'),
             ('solved', '{a: (<number> | <null>)}, 1, {a: {b: <T2>}}'),
             ('check', 'at ., expected (<number> | <null>), got "x", None, at [1], expected (<number> | <string>), got true, at [0].price, expected {net: <>}, got 25'),
             ('read_schema', 'STRUCT<`a`: DOUBLE, `b`: STRING> DOUBLE VARIANT ARRAY<STRUCT<`a`: DOUBLE>>')) t(name, result)""",
    ),
    "builtin_catalogue": (builtin_catalogue, None),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _over_tables(name) for name in PROGRAMS} | {name: _with_errors(name) for name in ERRORS} | {name: f for name, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in (PROGRAMS | ERRORS).items()} | {name: sql for name, (_, sql) in OTHERS.items() if sql}


def entry(spark: SparkSession) -> DataFrame:
    """Clicks with a large property."""
    return QUERIES["json_filter"](spark, "/root/testdata/sf0.001")
