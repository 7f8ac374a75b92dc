"""What has changed between two snapshots of a saved search.

A snapshot is groups (search_id, key, label, minPrice, place) and offers (search_id, key, url, title, price, place).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_text

_ALERT = ("search_id", "type", "message", "groupKey", "url", "previousPrice", "currentPrice", "groupPlace", "kindPlace", "offerPlace")


def snapshot_alerts(groups: DataFrame, offers: DataFrame, old_groups: DataFrame, old_offers: DataFrame) -> DataFrame:
    """new_group, price_drop and new_offer alerts, with groupPlace, kindPlace and offerPlace for their order.

    A search without any old group is new: all of its groups come as an initial match. Groups that vanish, prices that rise or
    are missing on a side, give nothing.
    """
    was = old_groups.groupBy("search_id", "key").agg(F.max_by("minPrice", "place").alias("previousPrice")).withColumn("_known", F.lit(True))
    seen = old_groups.select("search_id").distinct().withColumn("_run", F.lit(True))
    now = groups.join(was, ["search_id", "key"], "left").join(seen, "search_id", "left")
    none, no_price = F.lit(None).cast("string"), F.lit(None).cast("double")
    new_groups = now.where("_known is null").select(
        "search_id", F.lit("new_group").alias("type"), F.concat(F.when(F.col("_run"), "New group: ").otherwise("Initial match: "), F.col("label")).alias("message"), F.col("key").alias("groupKey"),
        none.alias("url"), no_price.alias("previousPrice"), F.col("minPrice").alias("currentPrice"), F.col("place").alias("groupPlace"), F.lit(0).alias("kindPlace"), F.lit(0).cast("long").alias("offerPlace"),
    )
    drops = now.where("_known and minPrice < previousPrice").select(
        "search_id", F.lit("price_drop").alias("type"), F.concat(F.lit("Price dropped for "), F.col("label"), F.lit(": "), number_text(F.col("previousPrice")), F.lit(" -> "), number_text(F.col("minPrice"))).alias("message"),
        F.col("key").alias("groupKey"), none.alias("url"), "previousPrice", F.col("minPrice").alias("currentPrice"), F.col("place").alias("groupPlace"), F.lit(1).alias("kindPlace"), F.lit(0).cast("long").alias("offerPlace"),
    )
    known = now.where("_known").select("search_id", "key", "label", F.col("place").alias("groupPlace"))
    new_offers = offers.join(old_offers.select("search_id", "key", "url").distinct(), ["search_id", "key", "url"], "left_anti").join(known, ["search_id", "key"]).select(
        "search_id", F.lit("new_offer").alias("type"), F.concat(F.lit("New offer for "), F.col("label"), F.lit(": "), F.col("title")).alias("message"), F.col("key").alias("groupKey"), "url",
        no_price.alias("previousPrice"), F.col("price").alias("currentPrice"), "groupPlace", F.lit(2).alias("kindPlace"), F.col("place").cast("long").alias("offerPlace"),
    )
    return new_groups.unionByName(drops).unionByName(new_offers).select(*_ALERT)


def alert_message(alerts: DataFrame, groups: DataFrame, searches: DataFrame, shown: int = 8) -> DataFrame:
    """(search_id, message): one notification text for each search that has alerts.

    alerts are those of snapshot_alerts; groups have search_id, label, minPrice, currency, bestUrl, place; searches id, name, query.
    Only the first `shown` alerts of a search are gathered; the best price is that of its cheapest group.
    """
    place = F.struct("groupPlace", "kindPlace", "offerPlace")
    price = F.when(F.coalesce("currentPrice", F.lit(0.0)) != 0, F.concat(F.lit(" ("), number_text(F.col("currentPrice")), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.col("message"), price)
    counted = alerts.groupBy("search_id").agg(F.count(F.lit(1)).alias("n"))
    first = alerts.withColumn("_i", F.row_number().over(Window.partitionBy("search_id").orderBy("groupPlace", "kindPlace", "offerPlace"))).where(F.col("_i") <= shown)
    lines = first.groupBy("search_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    best = groups.where("minPrice is not null").groupBy("search_id").agg(F.min_by(F.struct("label", "minPrice", "currency", "bestUrl"), F.struct("minPrice", "place")).alias("best"))
    joined = counted.join(lines, "search_id").join(searches, F.col("search_id") == F.col("id")).join(best, "search_id", "left")
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n- ...and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    cheapest = F.when(
        F.col("best").isNotNull(),
        F.concat(F.lit("\n\n"), F.trim(F.concat(F.lit("Best price: "), F.col("best.label"), F.lit(" - "), number_text(F.col("best.minPrice")), F.lit(" "), F.coalesce("best.currency", F.lit("")))), F.lit("\n"), F.coalesce("best.bestUrl", F.lit(""))),
    ).otherwise("")
    head = F.concat(F.lit("Saved search: "), F.col("name"), F.lit("\nQuery: "), F.col("query"), F.lit("\nAlerts: "), F.col("n").cast("string"), F.lit("\n\n"))
    return joined.select("search_id", F.concat(head, F.col("lines"), more, cheapest).alias("message"))
