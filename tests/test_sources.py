from offerlake.operators.extraction import page_offers
from offerlake.plans.options import SearchSettings, deepened, discovery_limit, fetcher_order, normalize_settings, offer_filter, per_query_limit
from offerlake.sources import providers
from offerlake.sources.notify import notify
from offerlake.sources.pages import PAGE, best_pages, plain_text, scraper_pages


def test_settings():
    s = normalize_settings({"max_results": "7", "max_pages": -1, "fetch_mode": "odd", "human_in_loop": "false", "min_price": "0", "max_price": "12.5", "condition": "used", "sources": " olx,, ibis"})
    assert (s.max_results, s.max_pages, s.fetch_mode, s.human_in_loop, s.min_price, s.max_price) == (7, 60, "auto", False, None, 12.5)
    assert offer_filter(s).sources == ("olx", "ibis")
    assert discovery_limit(s) == 100
    assert deepened(s).max_results == 220
    assert per_query_limit(12, 4) == 5
    assert fetcher_order("auto", True) == ["http", "scraper", "browser"]
    assert SearchSettings().condition == "any"


def test_best_pages(spark):
    rows = [
        ("u", "u", "Just a moment", "<p>x", None, None, 403, "http"), ("u", "u", "t", "<p>good", None, None, 200, "browser"),
        ("v", "v", "t", "", None, None, 200, "http"), ("w", "w", "t", "cf-chl", None, None, 200, "http"), ("w", "w", "t", None, "md", None, 200, "scraper"),
        ("https://search.rozetka.com.ua/x", "x", "t", "<p>x", None, None, 200, "browser"),
    ]
    got = best_pages(spark.createDataFrame(rows, PAGE), ["http", "scraper", "browser"]).collect()
    assert {(r["url"], r["fetcher"]) for r in got} == {("u", "browser"), ("w", "scraper")}
    from pyspark.sql import functions as F

    assert spark.range(1).select(plain_text(F.lit("<style>p{}</style><p>a&nbsp;<b>b</b>\n c 1&nbsp;200&#8372; &lt;</p>")).alias("x")).first()["x"] == "a b c 1 200₴ <"


def test_notify(spark):
    alerts = spark.createDataFrame([("s", "new_group", "m", "k", None, None, 1.0, 1, 0, 0)], "search_id string, type string, message string, groupKey string, url string, previousPrice double, currentPrice double, groupPlace long, kindPlace int, offerPlace long")
    groups = spark.createDataFrame([], "search_id string, label string, minPrice double, currency string, bestUrl string, place long")
    searches = spark.createDataFrame([("s", "n", "q")], "id string, name string, query string")

    def broken(search_id, message):
        raise ValueError("no way")

    senders = {"good": lambda s, m: None, "bad": broken}
    got = notify(alerts, groups, searches, senders, enabled=True).orderBy("provider").collect()
    assert [tuple(r) for r in got] == [("s", "bad", False, "no way"), ("s", "good", True, None)]
    assert notify(alerts, groups, searches, senders, enabled=False).count() == 0


def _answers(spark, partitions):
    answers = [("rozetka-search", "v1", '{"data":{"goods":[{"id":3},{"id":null},{"id":1},{"id":2},{"id":3}],"meta":{"title":"said"}}}'), ("brave", "v1", '{"web":{"results":[{"title":"b","url":"http://b"}]}}')]
    answers += [("rozetka-search", "v2", '{"data":{"goods":[{"id":4}]}}'), ("rozetka-search", "v3", "broken"), ("rozetka-search", None, None)]
    answers += [("serpapi", "v2", '{"organic_results":[{"title":"o","link":"http://o","position":1}],"shopping_results":[{"title":"s","link":"http://s","position":1}]}')]
    goods = [(1, '{"data":{"id":1,"price":12.5,"status":"active"}}'), (3, '{"data":{"id":3,"title":"three","href":""}}'), (2, '{"data":null}'), (4, '{"data":{"id":4,"sell_status":""}}'), (5, '{"data":{"id":5}}'), (None, "x"), (3, None)]
    frames = spark.createDataFrame(answers, "provider string, query string, body string"), spark.createDataFrame(goods, "goods_id long, body string"), spark.createDataFrame([("v1", 0), ("v2", 1), ("v3", 2)], "query string, variant_place int")
    return [f.repartition(partitions) for f in frames]


def test_two_step_provider(spark):
    """Failed second answers drop out, ranks stay those of the first answer, and order doesn't depend on partitions."""
    rows = [[tuple(r) for r in providers.all_candidates(*_answers(spark, p)).orderBy("seq").collect()] for p in (1, 2, 8)]
    assert rows[0] == rows[1] == rows[2]
    assert len({r[-1] for r in rows[0]}) == len(rows[0])
    steps = [(r[0], r[1], r[3], r[5]) for r in rows[0] if r[4] == "rozetka-api"]
    assert steps == [("v1", "three", "said", 1), ("v1", "Rozetka product 1", "12.5 UAH | active", 2), ("v1", "three", "said", 4), ("v2", "Rozetka product 4", "Rozetka search API result for v2", 1)]
    first = [(r[0], r[4]) for r in rows[0] if not r[4].startswith(providers.DIRECT)]
    assert first == [("v1", "brave"), *[("v1", "rozetka-api")] * 3, ("v2", "serpapi:shopping"), ("v2", "serpapi"), ("v2", "rozetka-api")]
    assert sum(r[4].startswith(providers.DIRECT) for r in rows[0]) == 3 * 19
    answers, _, _ = _answers(spark, 1)
    assert {r["sourceProvider"] for r in providers.all_candidates(answers).collect()} == {"brave", "serpapi", "serpapi:shopping"}


def test_scraper_answers(spark):
    rows = [
        ("http://a", '{"data":{"markdown":"# t","html":"<p>x","metadata":{"title":"t","url":"http://a/2","statusCode":200}}}'),
        ("http://b", '{"data":{"html":"<p>y","metadata":{"sourceURL":"http://b/1","url":"http://b/2"}}}'),
        ("http://c", '{"data":{}}'), ("http://d", '{"success":false}'), ("http://e", "broken"), ("http://f", None), (None, '{"data":{"markdown":"m"}}'),
    ]
    got = {r["url"]: tuple(r)[1:] for r in scraper_pages(spark.createDataFrame(rows, "url string, body string")).collect()}
    assert got == {
        "http://a": ("http://a/2", "t", "<p>x", "# t", "# t", 200, "scraper"),
        "http://b": ("http://b/1", None, "<p>y", None, None, None, "scraper"),
        "http://c": ("http://c", None, None, None, None, None, "scraper"),
        None: (None, None, None, "m", "m", None, "scraper"),
    }


def test_product_pages_of_a_shop(spark):
    """Pages of the shop without a title of theirs are read as any other page, and so are those of other shops."""
    page = lambda url, html, text="": (url, url, None, html, None, text, 200, "http")
    shop = "https://www.shimano.kiev.ua/"
    rows = [
        page(shop + "1", '<h1>Reel - shop</h1><meta property="og:image" content="/i.png"><p id="price_update_7"><b class="ty-price">0</b></p>'),
        page(shop + "2", '<script type="application/ld+json">{"@type":"Product","name":"Structured","offers":{"price":"5","priceCurrency":"UAH"}}</script>'),
        page("https://other.example/3", "<title>Other reel</title><h1>x</h1>", "Ціна 700 грн, в наявності"),
        page("https://other.example/6", '<title>Named elsewhere</title><script type="application/ld+json">{"@type":"Product","price":"7,5","priceCurrency":"USD"}</script>'),
        page(shop + "4", None), page(shop + "5", "<h1>Помилка 404</h1>", "Помилка 404"),
    ]
    got = {r["url"]: r for r in page_offers(spark.createDataFrame(rows, PAGE)).collect()}
    assert set(got) == {shop + "1", shop + "2", "https://other.example/3", "https://other.example/6"}
    assert [got["https://other.example/6"][c] for c in ("title", "price", "currency", "confidence")] == ["Named elsewhere", 7.5, "USD", 0.78]
    first = got[shop + "1"]
    assert (first["title"], first["price"], first["currency"], first["availability"], first["imageUrl"], first["confidence"]) == ("Reel", 0.0, None, "listed", shop + "i.png", 0.72)
    assert first["evidence"] == ["shimano.kiev.ua product price: 0"]
    assert got[shop + "2"]["title"] == "Structured"
    assert got["https://other.example/3"]["title"] == "Other reel"
