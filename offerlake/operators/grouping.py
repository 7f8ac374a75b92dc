"""Grouping ranked offers into product families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import first_family, model_codes
from ..functions.text import plain_tokens
from ..functions.urls import identity_key, seller_name, source_name

#: Words that don't tell products apart.
TITLE_STOP_WORDS = ("buy", "new", "used", "sale", "uah", "грн", "купити", "ціна", "новий", "нова", "нове", "бу", "вудилище", "спінінг", "спиннинг", "удилище")


def short_title(title: Column) -> Column:
    kept = F.filter(plain_tokens(title, 2), lambda t: ~t.isin(*TITLE_STOP_WORDS))
    return F.array_join(F.slice(kept, 1, 12), "-")


def group_key(title: Column, brand: Column) -> Column:
    return _key(title, brand, first_family(model_codes(title)))


def _key(title: Column, brand: Column, family: Column) -> Column:
    maker = F.coalesce(brand, F.lit("unknown-brand"))
    return F.coalesce(F.concat(F.lit("model:"), maker, F.lit(":"), family), F.concat(F.lit("title:"), maker, F.lit(":"), short_title(title)))


def _in_order(value: Column) -> Column:
    """Distinct non-null values of a group in the order of _place.

    Values are first reduced to their first place by the caller, so that what is gathered is as small as the distinct values.
    """
    return F.transform(F.array_sort(F.collect_list(value)), lambda x: x["v"])


def group_offers(offers: DataFrame) -> DataFrame:
    """One row per product family: key, label, brand, modelKey, modelCodes, offerCount, sources, sellers, sellerCount, specs, minPrice,
    maxPrice, currency (the most frequent, the first seen of equals), bestUrl, bestTitle, bestRelevance.

    offers are enriched. Offers of one identity count once, the better one. Families of many offers are aggregated map-side:
    what a family gathers are its distinct sources, sellers and codes, with their first places.
    """
    brand = F.col("normalized.brand")
    identity = identity_key(F.col("url"), F.col("sourceSite"), F.col("seller"), F.col("title"), F.col("price"))
    keyed = offers.withColumn("key", _key(F.col("title"), brand, F.col("normalized.family"))).withColumn("_identity", identity)
    # Better offers sort lower.
    place = F.struct(-F.round("relevanceScore", 9), F.coalesce("price", F.lit(9007199254740991.0)), -F.col("confidence"), F.col("seq"))
    needed = F.struct("title", "url", "price", "currency", "specs", F.struct("normalized.brand", "normalized.modelCodes", "normalized.family").alias("normalized"), "relevanceScore", source_name(F.col("sourceSite")).alias("source"), seller_name(F.col("seller"), F.col("sourceSite")).alias("seller"))
    # Most offers are alone with their identity, so that nothing would be gained by sorting them before the shuffle too.
    once = keyed.withColumn("_place", place).select("key", "_identity", "_place", needed.alias("o")).repartition("key", "_identity").groupBy("key", "_identity").agg(F.min_by("o", "_place").alias("o"), F.min("_place").alias("_place"))
    # One pass: each offer gives a row for the family, with what few values tell apart, and one for its seller. The offer itself goes with the first.
    fields = {"whole": F.lit(True), "seller": F.lit(None).cast("string"), "source": F.col("o.source"), "currency": F.nullif("o.currency", F.lit("")), "codes": F.col("o.normalized.modelCodes"), "o": F.col("o")}
    of_seller = {"whole": F.lit(False), "seller": F.col("o.seller")}
    row = lambda given: F.struct(*[given.get(name, F.lit(None).cast(once.select(c).schema[0].dataType)).alias(name) for name, c in fields.items()])
    rows = once.select("key", "_place", F.inline(F.array(row(fields), row(of_seller)))).where("whole or seller is not null")
    finite = F.when(~F.isnan("o.price"), F.col("o.price"))
    parts = rows.groupBy("key", "whole", "seller", "source", "currency", "codes").agg(F.min("_place").alias("p"), F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.min_by("o", "_place").alias("best"))
    joined = parts.groupBy("key").agg(
        F.sum(F.when(F.col("whole"), F.col("n"))).alias("offerCount"), F.min("lo").alias("minPrice"), F.max("hi").alias("maxPrice"), F.min_by("best", F.when(F.col("whole"), F.col("p"))).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("whole"), F.struct("p", "n", "source", "currency", "codes")))).alias("parts"), _in_order(F.when(~F.col("whole"), F.struct("p", F.col("seller").alias("v")))).alias("sellers"),
    )
    # Parts stand in the order of their first places, and so do their values.
    listed = lambda name: F.array_distinct(F.array_compact(F.transform("parts", lambda x: x[name])))
    times = lambda currency: F.aggregate(F.filter("parts", lambda x: x["currency"] == currency), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    currency = F.array_min(F.transform(listed("currency"), lambda c, i: F.struct((-times(c)).alias("n"), i.alias("i"), c.alias("v"))))["v"]
    joined = joined.withColumns({"sources": listed("source"), "modelCodes": F.array_distinct(F.array_compact(F.flatten(listed("codes")))), "currency": currency})
    family = F.col("best.normalized.family")
    joined = joined.withColumn("modelKey", family).withColumn("brand", F.col("best.normalized.brand"))
    label = F.when(F.col("brand").isNotNull() & F.col("modelKey").isNotNull(), F.concat(F.initcap("brand"), F.lit(" "), F.upper("modelKey"))).otherwise(F.coalesce(F.upper("modelKey"), F.col("best.title")))
    none = F.array().cast("array<string>")
    return joined.select(
        "key", label.alias("label"), "brand", "modelKey", F.coalesce("modelCodes", none).alias("modelCodes"), "offerCount", F.coalesce("sources", none).alias("sources"), F.coalesce("sellers", none).alias("sellers"),
        F.size(F.coalesce("sellers", none)).alias("sellerCount"), F.col("best.specs").alias("specs"), "minPrice", "maxPrice", "currency", F.col("best.url").alias("bestUrl"), F.col("best.title").alias("bestTitle"), F.col("best.relevanceScore").alias("bestRelevance"),
    )


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Families with most offers first, then the more relevant, the cheaper, the key."""
    return groups.orderBy(F.desc("offerCount"), F.desc(F.round("bestRelevance", 9)), F.asc_nulls_last("minPrice"), "key")


def group_members(offers: DataFrame) -> DataFrame:
    """(key, place, url, title, price): the offers of each family, best first, one for each identity."""
    identity = identity_key(F.col("url"), F.col("sourceSite"), F.col("seller"), F.col("title"), F.col("price"))
    order = [F.desc(F.round("relevanceScore", 9)), F.asc_nulls_last("price"), F.desc("confidence"), F.asc("seq")]
    keyed = offers.withColumn("key", group_key(F.col("title"), F.col("normalized.brand"))).withColumn("_identity", identity)
    place = F.struct(-F.round("relevanceScore", 9), F.coalesce("price", F.lit(9007199254740991.0)), -F.col("confidence"), F.col("seq"))
    once = keyed.withColumn("_p", place).groupBy("key", "_identity").agg(F.min_by(F.struct("url", "title", "price", "relevanceScore", "confidence", "seq"), "_p").alias("o")).select("key", "o.*")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).select("key", "place", "url", "title", "price")
