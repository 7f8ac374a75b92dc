"""Many searches in one plan against one plan for each."""

from pyspark.sql import functions as F

from offerlake.operators import match, ranking

TITLES = [
    "Tict Ice Cube IC-69P", "Tict Ice Cube IC-69F", "Tict Ice Cube IC-69P-T2", "Shimano Expride 266L", "Шимано Expride 266L spinning", "Daiwa 24 Certate LT 2500", "Shimano 22 Stella C3000XG", "Shimano Stella 2500 HG",
    "Shimano 21 Scorpion DC 150", "Шимано котушка", "Daiwa rod", "spinning rod 2.1m 5-20g ML", "Megabass Destroyer F5-68X", "just a box", "IC-69P", "", None,
]
QUERIES = ["tict ice cube ic-69p", "IC-69", "шимано 266l", "shimano stella 2500", "spinning rod 5-20g", "nothing of this"]


def offers(spark):
    rows = [(10 * i + j, t, f"https://x/{i}/{j}", [None, 100.0, 5000.0][j], [None, "used", "new"][j], [[], ["2.1m"], []][j], 0.5 + j / 10, f"shop{j}.example", "s", f"clash {i}") for i, t in enumerate(TITLES) for j in range(3)]
    return spark.createDataFrame(rows, "seq long, title string, url string, price double, condition string, evidence array<string>, confidence double, sourceSite string, seller string, k string").withColumn("warnings", F.array().cast("array<string>"))


def found(rows):
    return [(r["seq"], round(r["relevanceScore"], 9), r["matchGrade"], r["matchReason"], tuple(r["warnings"])) for r in rows]


def shares(query, title):
    """Whether they have a word, brand or model in common, by the functions that a single search uses."""
    q, t = set(query["_q"]["tokens"]) | set(query["_q"]["model_tokens"]), set(title["features"]["tokens"]) | set(title["features"]["models"])
    brand = query["_q"]["brand"] is not None and query["_q"]["brand"] == title["features"]["brand"]
    return bool(q & t) or brand


def test_many_searches_equal_single_ones(spark):
    o = offers(spark)
    searches = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)] + [(3, QUERIES[3]), (99, None)], "search_id int, query string")
    profiles = {r["search_id"]: r for r in searches.where("query is not null").withColumn("_q", ranking.query_profile(F.col("query"))).collect()}
    features = {r["title"]: r for r in ranking.title_features(o.where("title is not null")).collect()}
    every = range(len(QUERIES))
    for wanted, some in ((ranking.OfferFilter(), every), (ranking.OfferFilter(min_price=50, condition="used", sources=("shop1",), limit=2), (0, 3))):
        got = match.match_searches(searches, o, wanted).orderBy("search_id", "place").collect()
        unlimited = ranking.OfferFilter(wanted.min_price, wanted.max_price, wanted.condition, wanted.sources)
        for i in some:
            query = QUERIES[i]
            single = [r for r in ranking.rank_offers(o, query, unlimited).collect() if r["title"] is not None and shares(profiles[i], features[r["title"]])]
            assert found(r for r in got if r["search_id"] == i) == found(single[: wanted.limit]), query
        assert not [r for r in got if r["search_id"] == 99]
    assert match.match_searches(searches.limit(0), o).count() == 0
    assert match.match_searches(searches, o.limit(0)).count() == 0


def test_another_model_is_no_candidate(spark):
    """Pairs of different models never meet, however many words they share."""
    features = ranking.title_features(spark.createDataFrame([(f"Tict Ice Cube IC-{n}P",) for n in range(50, 90)], "title string"))
    asked = spark.createDataFrame([(1, "Tict Ice Cube IC-69P")], "search_id int, query string").withColumn("_q", ranking.query_profile(F.col("query")))
    assert [r["title"] for r in match.matching_titles(asked, features).collect()] == ["Tict Ice Cube IC-69P"]
