"""Whole searches and runs of saved searches."""

import pytest
from pyspark.sql import functions as F

from offerlake.operators import ranking
from offerlake.plans.options import SearchSettings
from offerlake.plans.run import run_search
from offerlake.plans.search import with_verdicts
from offerlake.sources import history
from offerlake.sources.pages import PAGE
from offerlake.streaming import saved

CANDIDATE = "seq long, title string, url string, snippet string, sourceProvider string, rank int"
DIRECT = "ukrainian-market-search:hotline"
LD = '<script type="application/ld+json">{"@type":"Product","name":"Tict Ice Cube IC-69P","url":"/p/1","offers":{"price":"9000","priceCurrency":"UAH"}}</script>'
CARD = '<div class="list-item"><a class="item-title" href="/ua/p7/">Tict Ice Cube IC-69P rod</a><span>8 500 грн</span></div>'


def page(url, html="", text="", title="t", status=200, fetcher="http"):
    return (url, url, title, html, None, text, status, fetcher)


def inputs(spark):
    rows = [
        (1, "Tict IC-69P", "https://shop.example/l/1", None, "brave", 1),
        (2, "Tict IC-69P", "https://hotline.ua/ua/sr/?q=a", None, DIRECT, 2),
        (3, "Tict IC-69P", "https://empty.example/d/", None, DIRECT, 3),
        (4, "Tict IC-69P", "https://plain.example/p/4", None, "brave", 4),
        (5, "Tict IC-69P", "https://blocked.example/p/5", None, "brave", 5),
        (6, "Tict IC-69P", "https://never.example/p/6", None, "brave", 6),
    ]
    attempts = [
        page("https://shop.example/l/1", LD),
        page("https://hotline.ua/ua/sr/?q=a", CARD),
        page("https://empty.example/d/", "<p>Tict Ice Cube IC-69P</p>", "Tict Ice Cube IC-69P\nЦіна 700 грн", "Tict Ice Cube IC-69P"),
        page("https://plain.example/p/4", "<p>Tict Ice Cube IC-69P</p>", "Tict Ice Cube IC-69P\nЦіна 700 грн", "Tict Ice Cube IC-69P"),
        page("https://blocked.example/p/5", "captcha", "", "Just a moment", 403),
        page("https://blocked.example/p/5", LD, fetcher="browser"),
        page("https://other.example/p/9", LD),
    ]
    return spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame(attempts, PAGE)


def test_each_page_goes_to_one_reader(spark):
    run = run_search(*inputs(spark), "tict ic-69p")
    routes = {r["url"].split("/")[2]: (r["reader"], r["n_offers"]) for r in run.routes.collect()}
    assert routes == {
        "shop.example": ("json-ld", 1), "hotline.ua": ("cards", 1), "empty.example": ("skipped", 0), "plain.example": ("page", 1), "blocked.example": ("json-ld", 1), "never.example": ("unread", 0),
    }
    assert sorted(r["place"] for r in run.routes.collect()) == [1, 2, 3, 4, 5, 6]
    prices = sorted(r["price"] for r in run.offers.collect())
    assert prices == [700.0, 8500.0, 9000.0, 9000.0]
    assert [r["key"] for r in run.groups.collect()] == ["model:tict:ic-69p"]
    assert run.plan.count() == 1 and run.candidates.count() == 6


def test_budgets_and_sources(spark):
    candidates, attempts = inputs(spark)
    run = run_search(candidates, attempts, "tict ic-69p", SearchSettings(max_pages=2))
    assert run.routes.count() == 2 and run.candidates.count() == 6
    only = run_search(candidates, attempts, "tict ic-69p", SearchSettings(sources="hotline"))
    assert sorted(r["reader"] for r in only.routes.collect()) == ["cards", "skipped"]
    nothing = run_search(candidates.limit(0), attempts, "tict ic-69p")
    assert nothing.offers.count() == nothing.groups.count() == nothing.routes.count() == 0


def test_same_run_on_any_number_of_partitions(spark):
    candidates, attempts = inputs(spark)
    seen = []
    for n in (1, 2, 8):
        run = run_search(candidates.repartition(n), attempts.repartition(n), "tict ic-69p")
        seen.append(sorted((r["seq"], r["url"], r["price"]) for r in run.offers.collect()))
    assert seen[0] == seen[1] == seen[2]


def ranked(spark, n):
    rows = [(i, f"Tict IC-69P {i}", f"https://x/{i}", 100.0 + i, 0.9) for i in range(n)]
    offers = spark.createDataFrame(rows, "seq long, title string, url string, price double, confidence double")
    return offers.withColumn("relevanceScore", 1 - F.col("seq") / 100).withColumn("warnings", F.array().cast("array<string>"))


def test_verdicts_are_asked_for_the_best_only(spark):
    asked = []

    def judge(best):
        asked.append(best.count())
        return best.select("url", F.lit("s").alias("summary"), F.lit("good").alias("fit"), F.array(F.lit("flag")).alias("riskFlags"), "seq")

    got = with_verdicts(ranked(spark, 30), judge).collect()
    assert asked == [ranking.VERDICT_OFFERS]
    assert sum(r["ai"] is not None for r in got) == ranking.VERDICT_OFFERS and len(got) == 30
    assert {r["seq"] for r in got if r["ai"]} == set(range(20))

    def broken(best):
        raise ValueError("no answer")

    assert with_verdicts(ranked(spark, 3), broken).columns == ranked(spark, 3).columns
    late = lambda best: best.select("url", F.raise_error(F.lit("late")).cast("string").alias("summary"), F.lit("x").alias("fit"), F.array().cast("array<string>").alias("riskFlags"), "seq")
    assert with_verdicts(ranked(spark, 3), late).columns == ranked(spark, 3).columns
    table = spark.createDataFrame([("https://x/1", "s", None, None, 1), ("https://x/25", "s", None, None, 2)], "url string, summary string, fit string, riskFlags array<string>, seq long")
    assert {r["seq"] for r in with_verdicts(ranked(spark, 30), table).collect() if r["ai"]} == {1}


def test_titles_outside_the_catalogue(spark):
    """Features of a catalogue never change a result, whatever titles it lacks or repeats."""
    titles = ["Tict Ice Cube IC-69P", "Shimano Stella 2500", "Tict rod", None]
    offers = spark.createDataFrame([(i, t, 10.0 + i, "https://x/" + str(i)) for i, t in enumerate(titles * 2)], "seq long, title string, price double, url string")
    for c, kind in (("condition", "string"), ("sourceSite", "string"), ("seller", "string"), ("evidence", "array<string>"), ("warnings", "array<string>"), ("confidence", "double")):
        offers = offers.withColumn(c, F.lit(None).cast(kind))
    want = sorted((r["seq"], r["relevanceScore"], r["matchGrade"]) for r in ranking.enrich_offers(offers, "tict ic-69p").where("title is not null").collect())
    for known in (offers.where("seq = 0"), offers.limit(0), offers):
        features = ranking.title_features(known)
        for f in (features, features.union(features)):
            got = ranking.enrich_offers(offers, "tict ic-69p", f).where("title is not null").collect()
            assert sorted((r["seq"], r["relevanceScore"], r["matchGrade"]) for r in got) == want


# Saved searches

SEARCHES = [("a", "rods", "q1"), ("b", "reels", "q2")]


def searches(spark):
    return spark.createDataFrame(SEARCHES, "id string, name string, query string")


def found(spark, prices):
    """Groups and offers of each search: prices maps (search, key) to {url: price}."""
    o = [(s, k, u, f"t {u}", p, i) for (s, k), urls in prices.items() for i, (u, p) in enumerate(urls.items())]
    offers = spark.createDataFrame(o, saved.OFFERS)
    groups = offers.groupBy("search_id", "key").agg(F.min("price").alias("minPrice"), F.max("price").alias("maxPrice"), F.count("*").alias("offerCount"), F.min_by("url", "price").alias("bestUrl"))
    none = F.array().cast("array<string>")
    groups = groups.select(
        "search_id", "key", F.upper("key").alias("label"), "minPrice", "maxPrice", F.lit("UAH").alias("currency"), "offerCount", none.alias("sources"), none.alias("sellers"), F.lit(0).alias("sellerCount"), F.lit(None).cast(saved._SPECS).alias("specs"), "bestUrl",
        F.hash("key").cast("long").alias("place"),
    )
    return groups, offers


FIRST = {("a", "k1"): {"u1": 100.0}, ("b", "k1"): {"u1": 5.0}}
SECOND = {("a", "k1"): {"u1": 90.0, "u2": 95.0}, ("a", "k2"): {"u3": 7.0}, ("b", "k1"): {"u1": 6.0}}


def alerts_of(spark, folder):
    return sorted((r["run"], r["search_id"], r["type"], r["groupKey"], r["url"] or "") for r in saved.read_sink(spark, folder, "alerts").collect())


WANT = [
    (1, "a", "new_group", "k1", ""), (1, "b", "new_group", "k1", ""),
    (2, "a", "new_group", "k2", ""), (2, "a", "new_offer", "k1", "u2"), (2, "a", "price_drop", "k1", ""),
]


class Stop(Exception):
    pass


@pytest.mark.parametrize("sink", ["groups", "offers", "alerts", "history", "runs", "messages-good", saved.WHOLE])
def test_a_run_may_fail_after_any_sink(spark, tmp_path, sink):
    """Alerts, history and messages come out once, and from the first answer of the shops although the second one differs."""
    folder, sent = str(tmp_path / "s"), str(tmp_path / "sent")
    log = f"{sent}.log"

    def good(search_id, message):
        with open(log, "a") as f:
            f.write(search_id + "\n")

    run = lambda n, prices, stop=None: saved.run_saved(spark, folder, n, searches(spark), lambda s: found(spark, prices), f"t{n}", {"good": good}, enabled=True, on_sink=stop)
    run(1, FIRST)

    def stop(done):
        if done == sink:
            raise Stop

    with pytest.raises(Stop):
        run(2, SECOND, stop)
    if sink != saved.WHOLE:
        # Nothing of a half run is seen.
        assert alerts_of(spark, folder) == WANT[:2]
        assert saved.read_history(spark, folder).count() == 2
    for _ in range(2):
        run(2, SECOND if sink == "groups" else {("a", "k9"): {"u9": 1.0}})
        assert alerts_of(spark, folder) == WANT
        assert sorted((r["run"], r["savedSearchId"], len(r["groups"]), len(r["alerts"])) for r in saved.read_history(spark, folder).collect()) == [(1, "a", 1, 1), (1, "b", 1, 1), (2, "a", 2, 3), (2, "b", 1, 0)]
    with open(log) as f:
        assert sorted(f.read().split()) == ["a", "a", "b"]


def test_a_search_is_compared_with_its_own_last_run(spark, tmp_path):
    """Run 2 is of one search alone: the other one's last run is the first."""
    folder = str(tmp_path / "s")
    both = searches(spark)
    saved.run_saved(spark, folder, 1, both, lambda s: found(spark, FIRST), "t1")
    saved.run_saved(spark, folder, 2, both.where("id = 'a'"), lambda s: found(spark, {("a", "k2"): {"u": 1.0}}), "t2")
    saved.run_saved(spark, folder, 3, both, lambda s: found(spark, {("a", "k2"): {"u": 1.0}, ("b", "k1"): {"u1": 4.0}}), "t3")
    assert [x for x in alerts_of(spark, folder) if x[0] == 3] == [(3, "b", "price_drop", "k1", "")]


def test_snapshot_of_a_search(spark, tmp_path):
    run = run_search(*inputs(spark), "tict ic-69p")
    folder = str(tmp_path / "s")
    saved.run_saved(spark, folder, 0, spark.createDataFrame([("x", "n", "tict ic-69p")], "id string, name string, query string"), lambda s: saved.snapshot_of("x", run), "t")
    got = saved.read_history(spark, folder).first()
    assert [g["key"] for g in got["groups"]] == ["model:tict:ic-69p"] and got["groups"][0]["offerCount"] == 4
    assert [a["message"] for a in got["alerts"]] == ["Initial match: Tict IC-69P"]
    flat = history.flatten_history(saved.read_history(spark, folder).drop("run")).first()
    assert flat["minPrice"] == 700.0 and flat["alertCount"] == 1
