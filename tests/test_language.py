"""Rows in, rows out, for each operator; inputs are our own."""

import math
from datetime import datetime

import pytest

from loglattice.errors import PlanError, QueryError
from loglattice.session import Engine
from loglattice.sinks import render


@pytest.fixture(scope="module")
def run(spark):
    engine = Engine(spark)

    def run(query, lines, **how):
        return [tuple(r) for r in engine.query_lines(query, lines, **how).df(ordered=True).collect()]

    run.engine = engine
    return run


@pytest.fixture(scope="module")
def out(run):
    return lambda query, lines, mode="legacy", template="", **how: list(render.lines(run.engine.query_lines(query, lines, **how), mode, template))


LOG = ['{"lv": "info", "n": 10}', '{"lv": "error", "n": "1,000.5"}', "no json", '{"lv": "info"}', '{"lv": null, "n": 2.5}', '{"lv": "error", "n": "abc"}']


def test_search(run):
    lines = ["Alpha *x* beta", "beta gamma", "alpha", "be\tta"]
    assert run("alpha", lines) == [("Alpha *x* beta",), ("alpha",)]
    assert run('"*x*"', lines) == [("Alpha *x* beta",)]
    assert run('"be ta"', lines) == [("be\tta",)]
    assert run("a*a AND NOT gamma OR be*ta", lines) == [("Alpha *x* beta",), ("beta gamma",), ("alpha",), ("be\tta",)]
    assert run("(alpha OR gamma) NOT beta", lines) == [("alpha",)]


def test_json_and_aggregates(run):
    rows = run("* | json | count, count_distinct(n), sum(n), min(n), max(n), avg(n) by lv", LOG)
    assert rows == [("error", 2, 2, 1000.5, 1000.5, 1000.5, 1000.5), ("info", 2, 1, 10.0, 10.0, 10.0, 10.0), (None, 1, 1, 2.5, 2.5, 2.5, 2.5)]
    none = run("* | json | where lv == \"nothing\" | count", LOG)
    assert none == []
    empty = run('* | json | avg(zz), min(zz), sum(zz) by lv | limit 1', LOG)[0]
    assert math.isnan(empty[1]) and empty[2] is None and empty[3] == 0.0


def test_missing_is_not_null(run):
    lines = ['{"a": null}', "{}", '{"a": 1}']
    assert run("* | json | isNull(a) as b | fields b", lines) == [(True,), (False,)]
    assert run("* | json | count_distinct(a)", lines) == [(2,)]
    assert run("* | json | where a == null | count", lines) == [(1,)]
    assert sorted(run("* | json | count by a", lines), key=str) == [("1", 1), (None, 2)]


def test_types_of_text(run):
    values = ["09", " 1 ", "1.0", "1.5", "true", "True", "1e3", "+5", "5.", "abc ", "inf"]
    rows = run('* | parse "*" as v | fields v', values)
    assert [r[0] for r in rows] == ["9", "1", "1", "1.5", "true", "True", "1000", "5", "5", "abc", "Infinity"]


def test_arithmetic(run):
    line = ['{"i": 7, "f": 0.5, "s": "1,5x", "z": 0}']
    q = lambda e: run(f"* | json | {e} as r | fields r", line)
    assert q("i + 1 * 2") == [("9",)] and q("f + f") == [("1",)] and q("i / 2") == [("3.5",)] and q("s + i") == [("22",)]
    assert q("i / z") == [("Infinity",)] and q("i + lv") == [] and q('i + "abc"') == [] and q("-3 * i") == [("-21",)]


def test_equality_and_order(run):
    line = ['{"a": 5, "b": "5", "c": null, "d": [1], "e": true}']
    q = lambda e: run(f"* | json | {e} as r | fields r", line)[0][0]
    assert q("a == 5") and not q("a == b") and q("b > 99999") and q("c < false") and q("d > b") and q("e < a") and q("c == null")


def test_logic_short_circuits(run):
    lines = ['{"a": true}', '{"a": false, "b": true}', '{"a": 1, "b": true}']
    assert run("* | json | where a || b | fields a", lines) == [("true",), ("false",)]
    assert run("* | json | where !a | fields a", lines) == [("false",)]
    with pytest.raises(PlanError):
        run("* | where 5", lines)


def test_mixed_sort(run):
    lines = [f'{{"v": {v}}}' for v in ('"b"', "2", "null", "10", "2.5", '"a"', "true", "[1]", '{"x": 1}')]
    assert [r[0] for r in run("* | json | sort by v", lines)] == [None, "true", "2", "2.5", "10", "a", "b", "[1]", '{"x":1}']
    assert [r[0] for r in run("* | json | sort by v desc | limit 2", lines)] == ['{"x":1}', "[1]"]


def test_nested(run):
    line = ['{"a": {"b": [1, {"c d": "x"}], "k.l": 3}}']
    q = lambda e: run(f"* | json | {e} as r | fields r", line)
    assert q('a.b[-1].["c d"]') == [("x",)] and q('a.["k.l"]') == [("3",)] and q("a.b[5]") == [] and q("a.b.c") == [] and q("length(a.b)") == [(2,)]


def test_parse(run):
    lines = ["GET /x  in 5ms", "POST /y in 7ms", "bad"]
    assert run('* | parse "* * in *ms" as m, u, t | fields m, u, t', lines) == [("GET", "/x", "5"), ("POST", "/y", "7")]
    assert run('* | parse "* /" as m nodrop | fields m', lines) == [("GET",), ("POST",), (None,)]
    assert run('* | parse regex "in (?P<t>\\d+)(?P<u>s)?" | fields t, u', lines) == [("5", None), ("7", None)]
    assert run('* | parse "in *" as t noconvert | fields t', ["in 09"]) == [("09",)]
    assert run('* | parse "a*" as x | parse "*-*" from x as y, z | fields y, z', ["a1-2"]) == [("1", "2")]
    for bad in ('* | parse "* *" as a', '* | parse regex "(a)"', '* | parse regex "("', '* | parse regex "a"'):
        with pytest.raises(PlanError):
            run(bad, lines)


def test_split(run):
    assert run('* | split on "-"', ['a---b-"c-d"-5', "'x"]) == [('["a","b","c-d",5]',), ("[\"'x\"]",)]
    assert run('* | json | split(l) on "." as n.m[0].p | fields n', ['{"l": "1.b", "n": {"m": [{"q": 1}]}}', '{"l": "1", "n": {"m": 5}}']) == [('{"m": [{"q": 1, "p": [1, "b"]}]}',)]


def test_logfmt(run):
    assert run("* | logfmt | fields a, b, c, d", ['a=1 b="x \\"y\\"" c d=']) == [("1", 'x "y"', None, "")]


def test_limit_total_order(run):
    lines = [f'{{"n": {k}}}' for k in range(1, 8)]
    assert run("* | json | limit 2", lines) == [("1",), ("2",)] and run("* | json | limit -2", lines) == [("6",), ("7",)]
    assert [r[0] for r in run("* | json | total(n) as t | fields t", lines)] == [1.0, 3.0, 6.0, 10.0, 15.0, 21.0, 28.0]
    assert run("* | json | sort by n desc | total(n) as t | limit 2 | fields n, t", lines) == [("7", 7.0), ("6", 13.0)]
    assert run("* | json | sort by n desc | limit 2", lines, compat_sort_order=True) == [("2",), ("1",)]
    for bad in ("* | limit 0", "* | limit 1.5"):
        with pytest.raises(PlanError):
            run(bad, lines)


def test_implicit_sort_and_snapshots(run):
    lines = [f'{{"k": "{k}"}}' for k in "aabbbc"]
    assert run("* | json | count by k", lines) == [("b", 3), ("a", 2), ("c", 1)]
    assert run("* | json | count by k | limit -1", lines) == [("c", 1)]
    assert run("* | json | count by k | where _count > 1 | total(_count) | fields k, _total", lines) == [("b", 3.0), ("a", 5.0)]
    assert run("* | json | count by k | count as n, count as n", lines) == [(3, 3)]


def test_percentiles_are_elements_of_their_rank(run, spark):
    n = 90_000
    df = spark.range(n, numPartitions=7).selectExpr("id * 7919 % 90000 AS x", "id % 3 AS k", "CASE WHEN id % 2 = 0 THEN id % 7919 * 0.5 - 100 END AS y")
    want, k3 = {}, []
    for i in range(n):
        want.setdefault(i % 3, []).append((i * 7919 % n, i % 7919 * 0.5 - 100 if i % 2 == 0 else None))
    for k, rows in want.items():
        xs, ys = sorted(x for x, _ in rows), sorted(y for _, y in rows if y is not None)
        at = lambda v, num, den: float(v[-(-len(v) * num // den) - 1])
        k3.append((k, at(xs, 1, 2), at(xs, 9, 10), at(ys, 1, 2), len(rows), sum(x < 1000 for x in xs), len(ys), len(set(ys)) + 1, float(min(xs)), at(xs, 999, 1000)))
    query = "* | p50(x), p90(x), p50(y) as y50, count, count(x < 1000) as few, count(y > -1000) as ys, count_distinct(y) as many, min(x), p999(x) by k | sort by k"
    assert [tuple(r) for r in run.engine.query(query, df).df().collect()] == k3
    assert [tuple(r) for r in run.engine.query("* | p50(x), p1(x)", df).df().collect()] == [(n // 2 - 1.0, n // 10 - 1.0)]
    assert run.engine.query("* | where x < 0 | p50(x), count", df).df().collect() == run.engine.query("* | where x < 0 | p50(x) by k", df).df().collect() == []


def test_percentiles_of_odd_values(run):
    lines = ['{"k": "a", "v": -0.0}', '{"k": "a", "v": -5}', '{"k": null, "v": 1e300}', '{"v": "7"}', '{"k": 1, "v": "no"}', '{"k": 1}', '{"k": "a", "v": 1e-300}', '{"k": "a", "v": -1e300}', '{"k": null, "v": 3}']
    assert sorted(run("* | json | p50(v), count, avg(v) by k", lines), key=str) == [("1", None, 2, pytest.approx(math.nan, nan_ok=True)), ("a", -5.0, 4, pytest.approx(-2.5e299)), (None, 7.0, 3, pytest.approx(1e300 / 3))]
    assert run("* | json | p75(v), p99(v), p01(v)", lines) == [(7.0, 1e300, -1e300)]


def test_dates(run):
    lines = ['{"t": "2014-01-01T10:20:30Z"}', '{"t": "21/Jan/2014 14:18:17"}', '{"t": "abc"}', '{"t": "10/Oct/2000:13:55:36 -0700"}']
    assert [r[0] for r in run("* | json | parseDate(t) as d | fields d", lines)] == [datetime(2014, 1, 1, 10, 20, 30), datetime(2014, 1, 21, 14, 18, 17), datetime(2000, 10, 10, 13, 55, 36)]
    assert run("* | json | timeslice(parseDate(t)) 1h | count by _timeslice", lines)[0] == (datetime(2000, 10, 10, 13), 1)
    assert run('* | json | parseDate(t) - parseDate("2014-01-01 10:00:00") as d | where d < 1h && d > 0s | count', lines) == [(1,)]
    with pytest.raises(PlanError):
        run("* | timeslice(t)", lines)


def test_functions(run):
    line = ['{"s": "héllo", "n": -2.5, "e": "", "z": null, "h": " 0xFF "}']
    q = lambda e: run(f"* | json | {e} as r | fields r", line)
    assert q("substring(s, 1, 3)") == [("él",)] and q("substring(s, 3, 1)") == [] and q("length(s)") == [(5,)] and q("concat(s, z, 1)") == [("hélloNone1",)]
    assert q("round(n)") == [(-3.0,)] and q("parseHex(h)") == [(255,)] and q("isEmpty(e)") == [(True,)] and q("isBlank(z)") == [(True,)] and q("isNumeric(s)") == [(False,)]
    assert q("toUpperCase(s)") == [("HÉLLO",)] and q("log(0)") == [(float("-inf"),)] and q("sqrt(1, 2)") == [] and q("contains(s, \"ll\")") == [(True,)]
    with pytest.raises(QueryError, match="did you mean 'length'"):
        q("lenght(s)")


def test_aliases_and_functions_can_be_added(run):
    line = ['10.0.0.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 23']
    assert run("* | apache | fields ip, status, contentlength", line) == [("10.0.0.1", "200", "23")]
    run.engine.register_alias("lv", "json | count by lv")
    assert len(run("* | lv", LOG)) == 3
    run.engine.register_function("double", lambda x: x * 2)
    assert run("* | json | double(n) as d | fields d", ['{"n": 4}']) == [(8.0,)]


def test_case_of_names(run):
    assert run("* | json | fields A, a", ['{"A": 1, "a": 2}']) == [("1", "2")]


def test_rendering(out):
    assert out("* | json", ['{"level": "info", "n": 1.5}', '{"level": "info", "o": {"b": [1, null]}}']) == ["[level=info]         [n=1.50]", "[level=info]" + " " * 25 + "[o={b:[1, None]}]"]
    assert out("* | json | count by k", ['{"k": "a"}', "{}"]) == ["k           _count\n" + "-" * 26 + "\nNone        1\na           1"]
    assert out("* | json | where k == 5 | count", ["{}"]) == ["No data"]
    assert out("* | json | count by k", ['{"k": "a"}'], "json") == ['[{"k":"a","_count":1}]']
    assert out("* | json", ['{"b": 1, "a": null}'], "json") == ['{"a":null,"b":1}']
    assert out("* | json", ['{"b": 1.5, "a": "x"}'], "logfmt") == ["a=x b=1.50"]
    assert out("* | json", ['{"b": 1.5, "a": "x"}'], "format", "{a:<4}|{b:>8.3}|{c}") == ["x   |   1.500|None"]
    assert out("x", ["x y  ", "z"]) == ["x y"]
    with pytest.raises(PlanError):
        out("*", ["x"], "format", "{a:")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo \xff\nthree")
    engine = Engine(spark)
    rows = [r[0] for r in engine.query_text("*", str(tmp_path / "a.log")).df(ordered=True).collect()]
    assert rows == ["one\r", "two �", "three"]


def pushed(df):
    return df._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[-1].split("\n")[0]


def test_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, k / 2, None if k % 3 == 0 else f"s{k}") for k in range(20)], "i int, f double, s string").write.parquet(path)
    df, engine = spark.read.parquet(path), Engine(spark)

    def found(query):
        out = engine.query(f"* | {query} | fields i", df).df(ordered=False)
        return sorted(r.i for r in out.collect()), pushed(out)

    rows, plan = found('where i >= 5 and f < 9 | where 12 > i')
    assert rows == list(range(5, 12)) and "GreaterThanOrEqual(i,5)" in plan and "LessThan(i,12)" in plan and "LessThan(f,9.0)" in plan
    rows, plan = found('where s < "s2" or s == "s5"')  # a null is an explicit None and comes first
    assert rows == sorted({0, 3, 6, 9, 12, 15, 18, 1, 10, 11, 13, 14, 16, 17, 19, 5}) and "IsNull(s)" in plan
    assert found('where !(s > "s2") and s != null')[0] == found('where s <= "s2" and s != null')[0]
    assert found('where s != "s4"')[0] == [k for k in range(20) if k != 4] and found("where i < null")[0] == []


def test_head_limit_stops_early(spark):
    out = Engine(spark).query("* | limit 3", spark.range(1000)).df(ordered=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in out.collect()] == [0, 1, 2] and "TakeOrdered" not in plan and "Limit" in plan


def test_row_errors(run):
    lines = ['{"a": 1}', "oops", '{"b": "x", "n": {"k": [1]}}', '{"a": "y", "b": true}']
    errors = lambda q: [(r.line, r.operator, r.error) for r in run.engine.query_lines(q, lines).errors().collect()]
    assert errors("* | json | a + 1 as c") == [("oops", "json", "Expected JSON, found oops"), (lines[2], "as c", 'No value for key "a"'), (lines[3], "as c", "Expected numeric operands, found y + 1")]
    assert errors("* | json | where b | count")[1:] == [(lines[0], "where", 'No value for key "b"'), (lines[2], "where", "Expected boolean, found x")]
    assert (lines[2], "as c", "Index 3 out of range") in errors("* | json | n.k[3] as c")
    assert (lines[0], "as c", "The 'sqrt' function expects 1 arguments, found 2") in errors("* | json | sqrt(a, a) as c")
    assert (lines[0], "timeslice", "Expected date, found '1'.  Use parseDate() to convert a value to a date") in errors("* | json | timeslice(a) 5m")
    assert (lines[3], "split", "Expected string, found true") in errors("* | json | split(b)")
    assert errors("* | count | x as y") == []


def test_fuzzy_dates(run):
    lines = ["Mon, January 21st 2014 at 5:30 pm", "on the 3rd of feb, 2001", "12:05:06 AM 9 Sep 1999", "no date", "Jan 99 2014"]
    assert [r[0] for r in run('* | parse "*" as t noconvert | parseDate(t) as d | fields d', lines)] == [datetime(2014, 1, 21, 17, 30), datetime(2001, 2, 3), datetime(1999, 9, 9, 0, 5, 6)]


def test_total_of_lines_of_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("\n".join(str(n) for n in range(k * 5, k * 5 + 5)))
    rows = Engine(spark).query_text('* | parse "*" as n | total(n) as t | fields n, t', str(tmp_path), types={"n": "int"}).df(ordered=True).collect()
    assert [(r.n, r.t) for r in rows] == [(k, sum(range(k + 1))) for k in range(15)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import os

    from loglattice.__main__ import main

    path = tmp_path / "a.log"
    path.write_text('{"k": "a", "n": 1}\noops\n{"k": "b", "n": 2}\n')
    assert main(["* | json | count by k", "-f", str(path), "-o", "json"]) == 0
    out = capsys.readouterr()
    assert out.out == '[{"k":"a","_count":1},{"k":"b","_count":1}]\n' and out.err == "error: Expected JSON, found oops\n"
    assert main(["* | json | where n > 1", "-f", str(path), "-m", "{k}={n}"]) == 0 and capsys.readouterr().out == "b=2\n"
    assert main(["* | nothing", "-f", str(path)]) == 1 and "error: " in capsys.readouterr().err
    for bad in (["*", "-o", "xml"], ["*", "-o", "json", "-m", "{a}"], []):
        with pytest.raises(SystemExit):
            main(bad)
    capsys.readouterr()
    for query, want in (("* | json | n + 1 as m | fields m", "[m=2]\n[m=3]\n"), ("* | json | sum(n)", "_sum\n" + "-" * 12 + "\n3\n")):
        read, write = os.pipe()
        os.write(write, path.read_bytes())
        os.close(write)
        with os.fdopen(read) as stdin:
            monkeypatch.setattr("sys.stdin", stdin)
            assert main([query]) == 0
        assert capsys.readouterr().out == want


def test_live(spark, tmp_path):
    from loglattice.sources import text
    from loglattice.streaming import live

    source = tmp_path / "in"
    source.mkdir()
    lines = [f'{{"k": "{k}", "v": {len(k)}}}' for k in ("a", "bb", "a", "ccc")]
    (source / "1.log").write_text("\n".join(lines))
    engine, seen = Engine(spark), []
    query = "* | json | count, count_distinct(v) by k | sort by k | limit 2"
    q = live.start(engine, query, text.stream(spark, str(source)), lambda r: seen.append([tuple(x) for x in r.df().collect()]), trigger={"availableNow": True})
    q.awaitTermination(120)
    assert seen[-1] == [tuple(r) for r in engine.query_lines(query, lines).df().collect()] == [("a", 2, 1), ("bb", 1, 1)]
    seen.clear()
    q = live.start(engine, "* | json | fields k | limit 3", text.stream(spark, str(source)), lambda r: seen.extend(x[0] for x in r.df().collect()), trigger={"availableNow": True})
    q.awaitTermination(120)
    assert len(seen) == 3
    with pytest.raises(PlanError):
        live.start(engine, "* | json | total(v)", text.stream(spark, str(source)), print)
