"""The queries that the driver runs over its tables, and the SQL to hold each against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Engine
from .sinks.render import logfmt_column, write_json
from .sources.shared import shared_dir


@dataclass(frozen=True)
class Case:
    table: str
    query: str
    sql: str | None
    how: dict = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        how = dict(self.how)
        prepare = how.pop("prepare", None)
        df = Engine(spark).query(self.query, prepare(rows) if prepare else rows, **how).df(ordered=False)
        # sums of floats depend on the order of the rows in their last digits
        shown = {"double": lambda c: F.round(c, 4), "timestamp": lambda c: c.cast("timestamp_ntz")}
        return df.select(*(shown.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes))


def _lines(df: DataFrame) -> DataFrame:
    """orders as logfmt lines, one value in quotes."""
    q = F.lit('"')
    return df.select("o_orderkey", F.concat(F.lit("key="), "o_orderkey", F.lit(" status="), "o_orderstatus", F.lit(" prio="), q, "o_orderpriority", q, F.lit(" flag price="), F.col("o_totalprice").cast("decimal(18,2)")).alias("line"))


def _access(df: DataFrame) -> DataFrame:
    """orders as lines of an access log."""
    parts = ["10.0.0.", F.pmod("o_custkey", F.lit(250)).cast("string"), ' - u [01/Jan/2024:00:00:00 +0000] "GET /', F.col("o_orderkey").cast("string"), ' HTTP/1.1" ', F.when(F.col("o_orderstatus") == "F", "500").otherwise("200"), " ", F.pmod("o_orderkey", F.lit(5000)).cast("string")]
    return df.select("o_orderkey", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("line"))


def _nested(df: DataFrame) -> DataFrame:
    """events as nested JSON."""
    inner = F.struct(F.col("user_id").alias("id"), F.array(F.col("event_id"), F.lit(7).cast("bigint")).alias("list"), F.col("event_type").alias("the kind"))
    return df.select("event_id", F.to_json(F.struct(inner.alias("a"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("value")).alias("v"))).alias("line"))


def _when(df: DataFrame) -> dict:
    return {"status": F.when(F.col("o_orderstatus") == "F", "500").otherwise("200"), "key": F.col("o_orderkey").cast("string"), "size": F.pmod("o_orderkey", F.lit(5000)).cast("string")}


def _joined(df: DataFrame, *parts) -> DataFrame:
    return df.select("o_orderkey", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("line"))


def _nginx(df: DataFrame) -> DataFrame:
    """orders as lines of another access log."""
    w = _when(df)
    took = (F.pmod("o_custkey", F.lit(1000)) / 1000).cast("string")
    return _joined(df, "10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] \"GET /", w["key"], " HTTP/1.1\" ", w["status"], " ", w["size"], ' "http://a/" "agent 1" "', took, '"')


def _ingress(df: DataFrame) -> DataFrame:
    """orders as lines of an ingress controller."""
    w = _when(df)
    return _joined(df, "10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] \"GET /", w["key"], " HTTP/1.1\" ", w["status"], " ", w["size"], ' "-" "agent 1" 100 0.01 [web-80] [] 10.1.0.1:80 ', w["size"], " 0.01 ", w["status"], " abc")


def _mixed(df: DataFrame) -> DataFrame:
    """orders as JSON in which v is a number, a text, true or null."""
    v = {0: F.col("o_orderkey").cast("string"), 1: (F.col("o_orderkey") / 2).cast("string"), 2: F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), 3: F.lit("true")}
    kind = F.pmod("o_orderkey", F.lit(5))
    text = F.lit("null")
    for k, c in v.items():
        text = F.when(kind == k, c).otherwise(text)
    return df.select("o_orderkey", F.concat(F.lit('{"kind": '), kind.cast("string"), F.lit(', "v": '), text, F.lit("}")).alias("line"))


def _dates(df: DataFrame) -> DataFrame:
    """The dates of orders as people write them."""
    forms = ("yyyy-MM-dd", "d/MMM/yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd", "yyyyMMdd", "EEE, d MMM yyyy", "MMMM d yyyy")
    text = F.date_format("o_orderdate", forms[0])
    for k, form in enumerate(forms[1:], 1):
        pattern = form.removeprefix("EEE, ")
        written = F.date_format("o_orderdate", pattern)
        text = F.when(F.pmod("o_orderkey", F.lit(len(forms))) == k, F.concat(F.date_format("o_orderdate", "E"), F.lit(", "), written) if form != pattern else written).otherwise(text)
    return df.select("o_orderkey", text.alias("line"))


def _broken(df: DataFrame) -> DataFrame:
    """orders as JSON, of which some isn't any and some lacks v or has a text in its place."""
    kind = F.pmod("o_orderkey", F.lit(7))
    whole = F.to_json(F.struct(F.col("o_custkey").alias("c"), F.when(kind != 2, F.when(kind == 3, "high").otherwise("1")).alias("v")))
    return df.select("o_orderkey", F.when(kind == 1, "no json").otherwise(whole).alias("line"))


T = {"raw": "text"}
L = {"raw": "l_comment"}
KEY = {"order_by": "o_orderkey"}
CASES: dict[str, Case] = {
    "flagship": Case("events", "* | json from props | where value > 10 | count, sum(k) as sum_k, avg(value) as avg_value by event_type",
        "SELECT event_type, count(*) AS _count, round(sum(json_extract(props, '$.k')::DOUBLE), 4) AS sum_k, round(avg(value), 4) AS avg_value FROM events WHERE value > 10 GROUP BY event_type", {"schema": "k bigint"}),
    "json_from": Case("events", "* | json from props | fields event_id, k", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events", {"types": {"k": "bigint", "event_id": "bigint"}}),
    "json_discovered": Case("events", "* | json from props | fields except ts, user_id, event_type, value, props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "filter_keyword": Case("conversations", "the | count by role", "SELECT role, count(*) AS _count FROM conversations WHERE text ILIKE '%the%' GROUP BY role", T),
    "filter_wildcard": Case("conversations", "th*ing | count by role", "SELECT role, count(*) AS _count FROM conversations WHERE regexp_matches(text, 'th.*?ing', 'i') GROUP BY role", T),
    "filter_quoted": Case("documents", '"of the" | count by lang', "SELECT lang, count(*) AS _count FROM documents WHERE regexp_matches(text, 'of\\sthe', 'i') GROUP BY lang", T),
    "filter_and_or_not": Case("documents", "(the AND and) OR (und NOT license) NOT token | count by lang",
        "SELECT lang, count(*) AS _count FROM documents WHERE ((text ILIKE '%the%' AND text ILIKE '%and%') OR (text ILIKE '%und%' AND NOT text ILIKE '%license%')) AND NOT text ILIKE '%token%' GROUP BY lang", T),
    "where_cmp": Case("lineitem", "* | where l_quantity >= 30 | where l_discount < 0.05 | where l_returnflag != \"N\" | fields l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'N'"),
    "where_logical": Case("lineitem", '* | where (l_returnflag == "R" and l_quantity > 45) or l_linenumber == 7 | fields l_orderkey, l_linenumber', "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 45) OR l_linenumber = 7"),
    "where_not": Case("orders", '* | where !(o_orderstatus == "F") && o_totalprice <= 100000 | count', "SELECT count(*) AS _count FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice <= 100000"),
    "where_mixed_types": Case("orders", '* | where o_orderpriority > 5 | count', "SELECT count(*) AS _count FROM orders"),
    "fields_only": Case("orders", "* | fields o_orderkey, o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders"),
    "fields_except": Case("customer", "* | fields except c_acctbal, c_nationkey", "SELECT c_custkey, c_name, c_mktsegment FROM customer"),
    "field_expr_arith": Case("lineitem", "* | l_extendedprice * (1 - l_discount) as net | l_orderkey + l_linenumber * 2 - 1 as n | l_quantity / 4 as q | fields net, n, q",
        "SELECT round(l_extendedprice * (1 - l_discount), 4) AS net, l_orderkey + l_linenumber * 2 - 1 AS n, round(l_quantity / 4, 4) AS q FROM lineitem"),
    "if_op": Case("lineitem", '* | if(l_quantity > 25, "many", "few") as size | count by size, l_returnflag', "SELECT CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size, l_returnflag, count(*) AS _count FROM lineitem GROUP BY ALL"),
    "count_all": Case("orders", "* | count", "SELECT count(*) AS _count FROM orders"),
    "count_cond": Case("labels", "* | count(quality == 1) as good, count(toxic == 1) as bad, count", "SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad, count(*) AS _count FROM labels"),
    "count_by": Case("orders", "* | count by o_orderstatus, o_orderpriority", "SELECT o_orderstatus, o_orderpriority, count(*) AS _count FROM orders GROUP BY ALL"),
    "count_by_expr": Case("lineitem", "* | count by l_linenumber * 2", 'SELECT l_linenumber * 2::BIGINT AS "l_linenumber * 2", count(*) AS _count FROM lineitem GROUP BY 1'),
    "count_empty": Case("orders", "* | where o_totalprice < 0 | count", "SELECT 1::BIGINT AS _count WHERE false"),
    "sum_avg_min_max_by": Case("lineitem", "* | sum(l_quantity), avg(l_extendedprice), average(l_tax) as tax, min(l_discount), max(l_extendedprice) by l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS _sum, round(avg(l_extendedprice), 4) AS _average, round(avg(l_tax), 4) AS tax, round(min(l_discount), 4) AS _min, round(max(l_extendedprice), 4) AS _max FROM lineitem GROUP BY ALL"),
    "count_distinct_by": Case("orders", "* | count_distinct(o_custkey) by o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS _countDistinct FROM orders GROUP BY ALL"),
    "percentile_by": Case("lineitem", "* | p50(l_quantity), pct95(l_extendedprice), percentile999(l_extendedprice) as p999 by l_returnflag",
        "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, round(quantile_disc(l_extendedprice, 0.95), 4) AS pct95, round(quantile_disc(l_extendedprice, 0.999), 4) AS p999 FROM lineitem GROUP BY ALL", {"exact_percentiles": True}),
    "agg_of_agg": Case("events", "* | count by user_id, event_type | count, max(_count) as most by event_type", "SELECT event_type, count(*) AS _count, max(c)::DOUBLE AS most FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY event_type"),
    "agg_where": Case("events", "* | count by user_id | where _count > 60 | _count * 2 as twice | fields - _count", "SELECT user_id, count(*) * 2 AS twice FROM events GROUP BY user_id HAVING count(*) > 60"),
    "sort_limit": Case("orders", "* | sort by o_totalprice desc | limit 20 | fields o_orderkey, o_totalprice", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM (SELECT * FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20)"),
    "sort_by_expr": Case("part", "* | sort by p_size * 2, p_retailprice / 10 | limit 15 | fields p_partkey, p_size", "SELECT p_partkey, p_size::BIGINT AS p_size FROM part ORDER BY part.p_size, p_retailprice, p_partkey LIMIT 15"),
    "limit_head": Case("orders", "* | limit 25 | fields o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25", KEY),
    "limit_tail": Case("orders", "* | limit -25 | fields o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25", KEY),
    "topk_implicit": Case("orders", "* | count, sum(o_totalprice) as total by o_custkey | limit 10", "SELECT o_custkey, count(*) AS _count, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, sum(o_totalprice) DESC, o_custkey LIMIT 10"),
    "limit_agg_tail": Case("events", "* | count by event_type | limit -2", "SELECT event_type, count(*) AS _count FROM events GROUP BY event_type ORDER BY 2, event_type DESC LIMIT 2"),
    "total_running": Case("orders", "* | total(o_custkey) as run | fields o_orderkey, run", "SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS run FROM orders", KEY),
    "total_after_agg": Case("events", "* | count by event_type | sort by event_type | total(_count)", "SELECT event_type, c AS _count, sum(c) OVER (ORDER BY event_type)::DOUBLE AS _total FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1)"),
    "timeslice_5m": Case("events", "* | timeslice(ts) 5m | count by _timeslice", "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS _timeslice, count(*) AS _count FROM events GROUP BY 1"),
    "timeslice_1w": Case("events", "* | timeslice(ts) 1w as week | count, avg(value) by week", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, count(*) AS _count, round(avg(value), 4) AS _average FROM events GROUP BY 1"),
    "date_diff_where": Case("events", '* | ts - parseDate("2024-01-10 00:00:00") as age | where age > 36h | where age < 1w | fields event_id', "SELECT event_id FROM events WHERE ts - TIMESTAMP '2024-01-10' > INTERVAL 36 HOUR AND ts - TIMESTAMP '2024-01-10' < INTERVAL 7 DAY"),
    "date_plus": Case("events", "* | ts + 90m as later | fields event_id, later", "SELECT event_id, (ts + INTERVAL 90 MINUTE) AS later FROM events"),
    "parse_wildcard": Case("pages", '* | parse "*://*.example.*/*" as scheme, host, tld, rest | fields page_id, scheme, host, tld, rest',
        "SELECT page_id, unnest(regexp_extract(url, '^(.*?)://(.*?)\\.example\\.(.*?)/(.*)$', ['scheme', 'host', 'tld', 'rest'])) FROM pages WHERE regexp_matches(url, '^(.*?)://(.*?)\\.example\\.(.*?)/(.*)$')",
        {"raw": "url"}),
    "parse_noconvert": Case("pages", '* | parse "example.*/" as tld noconvert | count by tld', "SELECT regexp_extract(url, 'example\\.(.*?)/', 1) AS tld, count(*) AS _count FROM pages WHERE regexp_matches(url, 'example\\.(.*?)/') GROUP BY 1", {"raw": "url"}),
    "parse_regex": Case("pages", '* | parse regex "/(?P<lang>[a-z]{2})/(?P<n>[0-9]+)" | count, sum(n) by lang', "SELECT regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, count(*) AS _count, sum(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2)::DOUBLE) AS _sum FROM pages WHERE regexp_matches(url, '/([a-z]{2})/([0-9]+)') GROUP BY 1", {"raw": "url"}),
    "parse_nodrop": Case("pages", '* | parse "?page=*&" as page nodrop | count by page', "SELECT nullif(regexp_extract(url, '\\?page=(.*?)&', 1), '') AS page, count(*) AS _count FROM pages GROUP BY 1", {"raw": "url"}),
    "parse_optional_group": Case("pages", '* | parse regex "^https?://(?P<m>m[.])?" | count by m', "SELECT CASE WHEN regexp_matches(url, '^https?://m[.]') THEN 'm.' END AS m, count(*) AS _count FROM pages WHERE regexp_matches(url, '^https?://') GROUP BY 1", {"raw": "url"}),
    "split_index": Case("pages", '* | split(url) on "/" as parts | parts[1] as host | length(parts) as n | fields page_id, host, n', "SELECT page_id, p[2] AS host, len(p)::BIGINT AS n FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)"),
    "logfmt_lines": Case("orders", "* | logfmt | fields key, status, prio, price", "SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS prio, round(o_totalprice, 2) AS price FROM orders", {"raw": "line", "prepare": _lines, "types": {"key": "bigint", "price": "double"}}),
    "alias_apache": Case("orders", "500 | apache | count, sum(contentlength) as bytes by status, method", "SELECT status, 'GET' AS method, count(*) AS _count, sum(o_orderkey % 5000)::DOUBLE AS bytes FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN '500' ELSE '200' END AS status FROM orders) WHERE concat('10.0.0.', o_custkey % 250, ' - u [01/Jan/2024:00:00:00 +0000] \"GET /', o_orderkey, ' HTTP/1.1\" ', status, ' ', o_orderkey % 5000) LIKE '%500%' GROUP BY 1, 2", {"raw": "line", "prepare": _access}),
    "alias_nginx": Case("orders", "* | nginx | count, sum(bytes_sent) as bytes, max(gzip_ratio) as ratio by status, method", "SELECT CASE WHEN o_orderstatus = 'F' THEN '500' ELSE '200' END AS status, 'GET' AS method, count(*) AS _count, sum(o_orderkey % 5000)::DOUBLE AS bytes, round(max((o_custkey % 1000) / 1000), 4) AS ratio FROM orders GROUP BY 1", {"raw": "line", "prepare": _nginx}),
    "alias_k8singressnginx": Case("orders", "* | k8singressnginx | count, sum(body_bytes_sent) as bytes by upstream_status", "SELECT CASE WHEN o_orderstatus = 'F' THEN '500' ELSE '200' END AS upstream_status, count(*) AS _count, sum(o_orderkey % 5000)::DOUBLE AS bytes FROM orders GROUP BY 1", {"raw": "line", "prepare": _ingress}),
    "percentile_sketch": Case("lineitem", "* | p50(l_quantity), p90(l_quantity), p99(l_linenumber) by l_returnflag",
        "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90, quantile_disc(l_linenumber, 0.99)::DOUBLE AS p99 FROM lineitem GROUP BY ALL"),
    "duplicate_names": Case("orders", "* | count, count(o_totalprice > 100000), sum(o_custkey) as x, max(o_custkey) as x by o_orderstatus", "SELECT o_orderstatus, count(*) AS _count, count(*) FILTER (o_totalprice > 100000) AS _count_2, sum(o_custkey)::DOUBLE AS x, max(o_custkey)::DOUBLE AS x_2 FROM orders GROUP BY ALL"),
    "sort_places": Case("orders", "* | count, sum(o_totalprice) as spent by o_custkey | sort by _count, spent, o_custkey desc | 1 as one | total(one) as place | fields o_custkey, place", "SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, sum(o_totalprice) DESC, o_custkey DESC)::DOUBLE AS place FROM orders GROUP BY o_custkey"),
    "compare_mixed_types": Case("orders", "* | json | where v > 2000 | where v != 5001 | count, count_distinct(v) as many by kind",
        "SELECT kind, count(*) AS _count, count(DISTINCT CASE kind WHEN 1 THEN (o_orderkey / 2)::VARCHAR WHEN 2 THEN o_orderpriority ELSE o_orderkey::VARCHAR END) AS many FROM (SELECT *, (o_orderkey % 5)::VARCHAR AS kind0, o_orderkey % 5 AS kind FROM orders) WHERE (kind = 0 AND o_orderkey > 2000 AND o_orderkey <> 5001) OR (kind = 1 AND o_orderkey / 2 > 2000 AND o_orderkey / 2 <> 5001) OR kind = 2 GROUP BY kind",
        {"raw": "line", "prepare": _mixed, "types": {"kind": "bigint"}}),
    "predicates_by_row": Case("orders", "* | json | isNull(v) as a | isEmpty(v) as b | isBlank(v) as c | isNumeric(v) as d | count by kind, a, b, c, d",
        "SELECT kind, kind = 4 AS a, kind = 4 AS b, kind = 4 AS c, kind IN (0, 1) OR (kind = 2 AND regexp_matches(o_orderpriority, '[0-9]')) AS d, count(*) AS _count FROM (SELECT *, o_orderkey % 5 AS kind FROM orders) GROUP BY ALL", {"raw": "line", "prepare": _mixed, "types": {"kind": "bigint"}}),
    "parse_date_text": Case("orders", "* | parseDate(line) as d | fields o_orderkey, d", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders", {"raw": "line", "prepare": _dates}),
    "parse_hex_column": Case("orders", "* | parseHex(line) as n | fields o_orderkey, n", "SELECT o_orderkey, o_orderkey AS n FROM orders", {"raw": "line", "prepare": lambda d: d.select("o_orderkey", F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey"))).alias("line"))}),
    "where_none": Case("lineitem", "* | where l_quantity < 30 and l_orderkey > 100 or 0.09 <= l_discount | where some < 3 or some != 3 | count by some", 'SELECT "some", count(*) AS _count FROM (SELECT *, CASE WHEN l_linenumber > 2 THEN l_linenumber::BIGINT END AS "some" FROM lineitem) WHERE ((l_quantity < 30 AND l_orderkey > 100) OR l_discount >= 0.09) AND ("some" IS NULL OR "some" <> 3) GROUP BY ALL', {"prepare": lambda d: d.withColumn("some", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")))}),
    "nested_path": Case("events", '* | json | a.list[-1] as last | a.["the kind"] as kind | sum(a.list[0]) as s, sum(last) as seven, count(v > 50) as high by kind',
        "SELECT event_type AS kind, sum(event_id)::DOUBLE AS s, count(*) * 7.0::DOUBLE AS seven, count(*) FILTER (event_id % 3 = 0 AND value > 50) AS high FROM events GROUP BY 1", {"raw": "line", "prepare": _nested}),
    "math_fns": Case("customer", "* | abs(c_acctbal) as abs_ | ceil(c_acctbal) as ceil_ | floor(c_acctbal) as floor_ | round(c_acctbal) as round_ | sqrt(abs_) as sqrt_ | cbrt(c_acctbal) as cbrt_ | log(abs_ + 1) as log_ | log10(abs_ + 1) as log10_ | log1p(abs_) as log1p_ | hypot(c_custkey, 3) as hypot_ | atan2(c_acctbal, 100) as atan2_ | toRadians(c_acctbal) as rad_ | toDegrees(c_custkey / 1000) as deg_ | fields + c_custkey, abs_, ceil_, floor_, round_, sqrt_, cbrt_, log_, log10_, log1p_, hypot_, atan2_, rad_, deg_",
        "SELECT c_custkey, round(abs(c_acctbal), 4) AS abs_, ceil(c_acctbal) AS ceil_, floor(c_acctbal) AS floor_, round(c_acctbal) AS round_, round(sqrt(abs(c_acctbal)), 4) AS sqrt_, round(cbrt(c_acctbal), 4) AS cbrt_, round(ln(abs(c_acctbal) + 1), 4) AS log_, round(log10(abs(c_acctbal) + 1), 4) AS log10_, round(ln(1 + abs(c_acctbal)), 4) AS log1p_, round(sqrt(c_custkey * c_custkey + 9), 4) AS hypot_, round(atan2(c_acctbal, 100), 4) AS atan2_, round(radians(c_acctbal), 4) AS rad_, round(degrees(c_custkey / 1000), 4) AS deg_ FROM customer"),
    "trig_fns": Case("part", "* | p_size / 60 as x | sin(x) as sin_ | cos(x) as cos_ | tan(x) as tan_ | asin(x) as asin_ | acos(x) as acos_ | atan(x) as atan_ | sinh(x) as sinh_ | cosh(x) as cosh_ | tanh(x) as tanh_ | exp(x) as exp_ | expm1(x) as expm1_ | num(p_size) as num_ | fields p_partkey, sin_, cos_, tan_, asin_, acos_, atan_, sinh_, cosh_, tanh_, exp_, expm1_, num_",
        "SELECT p_partkey, round(sin(x), 4) AS sin_, round(cos(x), 4) AS cos_, round(tan(x), 4) AS tan_, round(asin(x), 4) AS asin_, round(acos(x), 4) AS acos_, round(atan(x), 4) AS atan_, round(sinh(x), 4) AS sinh_, round(cosh(x), 4) AS cosh_, round(tanh(x), 4) AS tanh_, round(exp(x), 4) AS exp_, round(exp(x) - 1, 4) AS expm1_, p_size::DOUBLE AS num_ FROM (SELECT *, p_size / 60 AS x FROM part)"),
    "string_fns": Case("part", '* | toUpperCase(p_name) as up | toLowerCase(p_brand) as low | length(p_name) as n | substring(p_type, 2, 6) as mid | substring(p_type, 3) as rest | concat(p_brand, "-", p_size, "/", p_partkey) as tag | contains(p_name, "a") as has | fields p_partkey, up, low, n, mid, rest, tag, has',
        "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS n, substr(p_type, 3, 4) AS mid, substr(p_type, 4) AS rest, concat(p_brand, '-', p_size, '/', p_partkey) AS tag, contains(p_name, 'a') AS has FROM part"),
    "predicate_fns": Case("supplier", '* | isNull(s_name) as a | isEmpty(s_name) as b | isBlank("  ") as c | isNumeric(s_name) as d | isNumeric(s_acctbal) as e | parseHex("0xff") as f | isEmpty("") as g | isNull(null) as h | fields s_suppkey, a, b, c, d, e, f, g, h',
        "SELECT s_suppkey, false AS a, false AS b, true AS c, regexp_matches(s_name, '[0-9]') AS d, true AS e, 255::BIGINT AS f, true AS g, true AS h FROM supplier"),
    "parse_date": Case("orders", '* | parseDate(o_orderdate) as d | where d >= parseDate("1995-06-17") | count', "SELECT count(*) AS _count FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-17'"),
}


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/region.parquet")
    return Engine(spark).query("* | now() as t | where t > parseDate(\"2020-01-01\") | fields r_regionkey", rows).df(ordered=False)


def _row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong in the rows that a query drops."""
    rows = _broken(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    found = Engine(spark).query("* | json | v + c as w | where w > 0 | fields w", rows, raw="line").errors()
    return found.groupBy("operator", "error").agg(F.count(F.lit(1)).alias("rows"))


def _logfmt_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = Engine(spark).query("* | count by o_orderstatus, o_orderpriority", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return result.state.df.select(logfmt_column(result).alias("line"))


def _json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON files and read again."""
    import uuid

    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    write_json(Engine(spark).query("* | where c_acctbal < 0 | fields c_custkey, c_name, c_acctbal", spark.read.parquet(f"{sf_dir}/customer.parquet")), path)
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").json(path)


def _text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as lines of text and read again as files."""
    import uuid

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.regexp_replace("text", "\n", " ").alias("value")).write.text(path)
    return Engine(spark).query_text('* | parse "the * " as w noconvert | count by w', path).df(ordered=False)


def _text_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum over lines of a file."""
    import uuid

    path = f"{shared_dir(spark)}/numbers-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("value")).coalesce(1).sortWithinPartitions(F.col("value").cast("long")).write.text(path)
    return Engine(spark).query_text('* | parse "*" as k | total(k) as run | fields k, run', path, types={"k": "bigint"}).df(ordered=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: case.run for name, case in CASES.items()} | {"now_fn": _now, "text_source": _text_source, "text_total": _text_total, "row_errors": _row_errors, "logfmt_sink": _logfmt_sink, "json_sink": _json_sink}
ORACLES: dict[str, str] = {name: case.sql for name, case in CASES.items() if case.sql} | {
    "now_fn": "SELECT r_regionkey::BIGINT AS r_regionkey FROM region",
    "text_source": "SELECT regexp_extract(t, '(?i)the (.*?) ', 1) AS w, count(*) AS _count FROM (SELECT trim(replace(text, chr(10), ' ')) AS t FROM conversations) WHERE regexp_matches(t, '(?i)the (.*?) ') GROUP BY 1",
    "text_total": "SELECT o_orderkey AS k, sum(o_orderkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS run FROM orders",
    "row_errors": "SELECT operator, error, count(*) AS rows FROM (SELECT CASE WHEN o_orderkey % 7 = 1 THEN 'json' ELSE 'as w' END AS operator, CASE o_orderkey % 7 WHEN 1 THEN 'Expected JSON, found no json' WHEN 2 THEN 'No value for key \"v\"' ELSE 'Expected numeric operands, found high + ' || o_custkey END AS error FROM orders WHERE o_orderkey % 7 IN (1, 2, 3)) GROUP BY ALL",
    "logfmt_sink": "SELECT '_count=' || count(*) || ' o_orderpriority=' || o_orderpriority || ' o_orderstatus=' || o_orderstatus AS line FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "json_sink": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0",
}
