import pytest
from pyspark.sql import functions as F

from offerlake.functions import models, pages, specs, text, urls
from offerlake.operators import ranking
from offerlake.plans import query_plan


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def of(spark, function, *texts):
    return value(spark, function(*[F.lit(t) for t in texts]))


@pytest.mark.parametrize(
    "title,codes",
    [("tict ice cube ic-69p", ["ic-69p", "69p"]), ("Shimano Expride 266L", ["expride-266l", "266l"]), ("shimano 21 scorpion dc 151 hg", ["scorpion-151dc-hg", "151dc-hg", "shimano-21scor"]), ("no code here", []), ("", [])],
)
def test_model_codes(spark, title, codes):
    got = [c["normalized"] for c in of(spark, models.model_codes, title)]
    assert got[: len(codes)] == codes or got == [c for c in codes if c in got]


@pytest.mark.parametrize("wanted,offered,verdict", [("ic-69p", "Tict Ice Cube IC-69F", "conflict"), ("ic-69p", "xx-69p", "exact"), ("rod", "reel", "unknown"), ("3-12g ML", "Expride 266L", "conflict")])
def test_compatibility(spark, wanted, offered, verdict):
    c = models.compatibility(models.model_codes(F.lit(wanted)), models.model_codes(F.lit(offered)))
    assert value(spark, c) == verdict


def test_specs(spark):
    got = of(spark, specs.parse_specs, "спінінг 2.13m 3-12g ML")
    assert (got["rodLengthM"], got["lureMinG"], got["lureMaxG"], got["power"]) == (2.13, 3.0, 12.0, "ML")
    assert of(spark, specs.parse_specs, "nothing to say") is None
    # A Cyrillic unit followed by a space is no ASCII word boundary.
    assert of(spark, specs.parse_specs, "3-12г тест") is None
    assert of(spark, specs.parse_specs, "7'6\" rod")["rodLengthM"] == 2.29
    score = lambda a, b: value(spark, specs.specs_score(specs.parse_specs(F.lit(a)), specs.parse_specs(F.lit(b))))
    assert score("3-12g", "10-20g") == 10
    assert score("3-12g", "15-20g") == -14
    assert score("3-12g", "nothing") == 0


@pytest.mark.parametrize(
    "url,canonical",
    [
        ("https://www.Shop.example/collections/rods/products/x/?utm_source=a&b=2&a=1#t", "https://shop.example/products/x?a=1&b=2"),
        ("http://a.example", "http://a.example/"),
        ("not a url", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert of(spark, urls.canonical_url, url) == canonical


@pytest.mark.parametrize("text_,amount", [("12 899", 12899.0), ("1,234", 1234.0), ("1,50", 1.5), ("1,234,567", 1234567.0)])
def test_price_amount(spark, text_, amount):
    assert of(spark, pages.price_amount, text_) == amount


def test_page_price_knows_no_decimal_comma(spark):
    got = of(spark, pages.page_price, "12,50 грн")
    assert (got["amount"], got["currency"]) == (50.0, "UAH")


def test_availability(spark):
    assert of(spark, pages.schema_availability, "https://schema.org/OutOfStock") == "out_of_stock"
    assert of(spark, pages.schema_availability, "Unavailable") == "in_stock"


def test_query_variants(spark):
    v = of(spark, query_plan.query_variants, "tict ice cube ic-69p")
    assert len(v) == 15
    assert v[0] == "tict ice cube ic-69p"
    assert v[8] == '"ic-69p" купити Україна'
    assert v[10] == "tict ice cube"
    assert v[-1].endswith("JDM fishing tackle")
    assert of(spark, query_plan.fallback_queries, "shimano twin power 24") == ["shimano twin"]


@pytest.mark.parametrize("score,grade", [(0.82, "exact"), (0.58, "close"), (0.34, "broad"), (0.33, "weak")])
def test_grades(spark, score, grade):
    assert of(spark, ranking.grade, score) == grade


def test_enriched_score(spark):
    row = [(1, "Shimano Expride 266L", "https://a.example/1", 8000.0, "UAH", "used", 0.5)]
    offers = spark.createDataFrame(row, "seq long, title string, url string, price double, currency string, condition string, confidence double")
    for c in ("availability", "seller", "imageUrl", "sourceSite"):
        offers = offers.withColumn(c, F.lit(None).cast("string"))
    offers = offers.withColumn("evidence", F.array().cast("array<string>")).withColumn("warnings", F.lit(None).cast("array<string>"))
    got = ranking.enrich_offers(offers, "Shimano Expride 266L").first()
    assert (got["relevanceScore"], got["matchGrade"], got["warnings"]) == (1.0, "exact", [])
    from offerlake.operators.grouping import group_offers

    g = group_offers(ranking.enrich_offers(offers, "Shimano Expride 266L")).first()
    assert (g["key"], g["label"], g["offerCount"]) == ("model:shimano:expride-266l", "Shimano EXPRIDE-266L", 1)


@pytest.mark.parametrize("n,printed", [(12899.0, "12899"), (1.5, "1.5"), (1e7, "10000000"), (0.1, "0.1")])
def test_number_text(spark, n, printed):
    assert of(spark, text.number_text, n) == printed
