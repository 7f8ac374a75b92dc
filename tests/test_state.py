from pyspark.sql import functions as F

from offerlake import queries
from offerlake.operators import diff, discovery
from offerlake.plans import query_plan
from offerlake.sources import history, providers
from offerlake.sources.market_search import MarketSearchSource

G = "search_id string, key string, label string, minPrice double, place long"
O = "search_id string, key string, url string, title string, price double, place long"


def test_alerts_in_order(spark):
    old_g = spark.createDataFrame([("s", "A", "A", 100.0, 1)], G)
    old_o = spark.createDataFrame([("s", "A", "u1", "t1", 100.0, 1)], O)
    g = spark.createDataFrame([("s", "A", "A", 90.0, 1), ("s", "B", "B", None, 2)], G)
    o = spark.createDataFrame([("s", "A", "u1", "t1", 90.0, 1), ("s", "A", "u2", "t2", 95.0, 2), ("s", "B", "u3", "t3", None, 1)], O)
    got = diff.snapshot_alerts(g, o, old_g, old_o).orderBy("groupPlace", "kindPlace", "offerPlace").collect()
    assert [(a["type"], a["groupKey"], a["url"]) for a in got] == [("price_drop", "A", None), ("new_offer", "A", "u2"), ("new_group", "B", None)]
    assert got[0]["message"] == "Price dropped for A: 100 -> 90"
    # Nothing for a group that vanishes or whose price rises.
    assert diff.snapshot_alerts(old_g, old_o, g, o).count() == 0
    first = diff.snapshot_alerts(g, o, old_g.limit(0), old_o.limit(0)).collect()
    assert {a["message"] for a in first} == {"Initial match: A", "Initial match: B"}


def test_alert_message(spark):
    alerts = spark.createDataFrame([("s", "new_offer", f"m{i}", "k", None, None, float(i), 1, 2, i) for i in range(10)], "search_id string, type string, message string, groupKey string, url string, previousPrice double, currentPrice double, groupPlace long, kindPlace int, offerPlace long")
    groups = spark.createDataFrame([("s", "L", 5.0, "UAH", "u", 1)], "search_id string, label string, minPrice double, currency string, bestUrl string, place long")
    searches = spark.createDataFrame([("s", "n", "q")], "id string, name string, query string")
    message = diff.alert_message(alerts, groups, searches).first()["message"]
    assert message.startswith("Saved search: n\nQuery: q\nAlerts: 10\n\n- new_offer: m0\n- new_offer: m1 (1)")
    assert "- ...and 2 more\n\nBest price: L - 5 UAH\nu" in message


def test_history_file(spark, tmp_path):
    f = tmp_path / "h.jsonl"
    f.write_text('{"timestamp":"1","savedSearchId":"a","groups":[],"alerts":[]}\n\n{"timestamp":"2","savedSearchId":"b","groups":[],"alerts":[]}\n')
    read = lambda **k: [r["timestamp"] for r in history.read_history(spark, str(f), **k).collect()]
    assert read() == ["2", "1"]
    assert read(limit=1) == ["2"]
    assert read(limit=0) == ["2", "1"]
    assert read(saved_search="a") == ["1"]
    f.write_text(f.read_text() + "{broken\n")
    assert read() == []
    assert history.read_history(spark, str(tmp_path / "none")).count() == 0


def test_appended_history_keeps_its_order(spark, tmp_path):
    folder = str(tmp_path / "h")
    for i in range(4):
        # Later appends are smaller files.
        history.append_history(spark.createDataFrame([(str(i), "a", "n" * 99 * (4 - i), "q", [], [])], history.HISTORY), folder)
    assert [r["timestamp"] for r in history.read_history(spark, folder).collect()] == ["3", "2", "1", "0"]
    assert [r["timestamp"] for r in history.read_history(spark, folder, limit=2).collect()] == ["3", "2"]
    records = history.read_history(spark, folder)
    history.export_csv(records, str(tmp_path / "csv"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[0] == ",".join(history.CSV_COLUMNS) and len(lines) == 5
    history.export_json(records, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_saved_searches(spark, tmp_path):
    path, columns = str(tmp_path / "s"), "id string, name string, query string"
    assert history.read_searches(spark, path).count() == 0
    history.write_searches(spark.createDataFrame([("1", "a", "q"), ("2", "b", "q")], columns), path)
    known = history.read_searches(spark, path).select("id", "name", "query")
    changed = spark.createDataFrame([("2", "new", "q"), ("3", "unknown", "q")], columns)
    assert sorted(tuple(r) for r in history.update_searches(known, changed).collect()) == [("1", "a", "q"), ("2", "new", "q")]
    assert history.upsert_searches(known, changed).count() == 3


def test_csv(spark):
    empty = spark.createDataFrame([("1", "a", 'n"', "q", [], [])], history.HISTORY)
    line = history.csv_lines(empty).first()["value"]
    assert line == '1,a,"n""",q,,,,,,,,,,,0,,'


def test_usable_page(spark):
    a = spark.createDataFrame([("u", 1, False, "blocked"), ("u", 3, True, "late"), ("u", 2, True, "good"), ("v", 1, False, "x")], "url string, ordinal int, usable boolean, text string")
    assert [tuple(r) for r in discovery.usable_page(a).collect()] == [("u", "good")]


def test_provider_answers(spark):
    body = {
        "exa": '{"results":[{"url":"http://a","highlights":["x","y"]},{"url":""}]}',
        "ibis-api": '{"results":{"items":[{"name":"n","url":"http://old.example/p?x=1","price":12345,"currency":"грн","is_presence":true}]}}',
        "serpapi": '{"organic_results":[{"title":"o","link":"http://o","snippet":"s"}],"shopping_results":[{"title":"s","link":"http://s","source":"shop","price":"5"}]}',
        "bing-html": '<li class="b_algo"><h2><a href="https://www.bing.com/ck?u=a1aHR0cHM6Ly9hLmV4YW1wbGUvcA">T</a></h2><div class="b_caption"><p>S</p></div></li>',
        "duckduckgo-html": '<div class="result"><h2 class="result__title"><a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fb.example%2F">T</a></h2></div>',
    }
    answers = spark.createDataFrame([(p, "q", b) for p, b in body.items()], "provider string, query string, body string")
    got = {(r["sourceProvider"], r["url"]): r for r in providers.all_candidates(answers).collect()}
    assert got[("exa", "http://a")]["snippet"] == "x y"
    assert got[("ibis-api", "https://ibis-gear.com/p?x=1")]["snippet"] == "123 UAH | in stock"
    assert got[("serpapi:shopping", "http://s")]["snippet"] == "shop - 5"
    assert ("bing-html", "https://a.example/p") in got
    assert ("duckduckgo-html", "https://b.example/") in got


def test_direct_catalog(spark):
    q = spark.createDataFrame([("tict ic-69p OR site:x used",), ("спінінг",)], "query string")
    got = providers.direct_candidates(q).groupBy("query").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect()
    assert {r["query"]: (r["n"], r["r"]) for r in got} == {"tict ic-69p OR site:x used": (24, 24), "спінінг": (19, 19)}
    assert value_of(spark, providers.encoded(F.lit("a b!~'()*+"))) == "a%20b!~'()*%2B"


def test_direct_catalog_takes_every_part(spark):
    sf_dir = "/root/testdata/sf0.001"
    titles = queries.titled_parts(spark, sf_dir).select("title").distinct().count()
    assert queries.direct_catalog(spark, sf_dir).select("query").distinct().count() == titles


def test_fan_out_takes_every_provider(spark):
    plans = query_plan.plan_query(spark, "tict ice cube ic-69p")
    named = spark.range(1003).select(F.concat(F.lit("p"), "id").alias("provider"))
    assert query_plan.fan_out(plans, named).count() == 15 * 1003
    assert query_plan.fan_out(plans, named.limit(2)).count() == 15 * 2


def value_of(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_data_source(spark):
    spark.dataSource.register(MarketSearchSource)
    assert spark.read.format("market_search").option("queries", "a|b").load().count() == 38
