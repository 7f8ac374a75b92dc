"""Stored runs, price history and saved searches as JSON lines and tables."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import null_if_empty, number_text
from .settings import read_version, write_version

_SPECS = "struct<rodLengthM:double,lureMinG:double,lureMaxG:double,lineMinLb:double,lineMaxLb:double,weightG:double,bearings:string,gearRatio:string,reelSize:string,handedness:string,power:string>"
GROUP = f"struct<key:string,label:string,minPrice:double,maxPrice:double,currency:string,offerCount:bigint,sources:array<string>,sellers:array<string>,sellerCount:int,specs:{_SPECS},bestOfferUrl:string>"
ALERT = "struct<type:string,message:string,groupKey:string,url:string,previousPrice:double,currentPrice:double>"
HISTORY = f"timestamp string, savedSearchId string, savedSearchName string, query string, groups array<{GROUP}>, alerts array<{ALERT}>"
#: The columns of an exported history, in order.
CSV_COLUMNS = ("timestamp", "savedSearchId", "savedSearchName", "query", "groupKey", "groupLabel", "minPrice", "maxPrice", "currency", "offerCount", "sources", "sellerCount", "sellers", "specs", "alertCount", "alerts", "bestOfferUrl")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines in file order. One broken line empties the whole, as does a missing file."""
    empty = spark.range(0).select(F.lit("").alias("file"), F.col("id").alias("seq"), F.from_json(F.lit("{}"), schema).alias("r"))
    try:
        raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), "value")
    except AnalysisException:
        return empty
    lines = raw.where("value <> ''").withColumn("r", F.from_json("value", schema))
    if lines.where(F.try_parse_json("value").isNull()).limit(1).count():
        return empty
    return lines.select("file", "seq", "r")


#: When a record was appended, and its place among those of one append. Files of a folder have no order of their own.
_ORDER = "appendedAt bigint, appendedPlace bigint"


def read_history(spark: SparkSession, path: str, schema: str = HISTORY, limit: int | None = 30, saved_search: str | None = None) -> DataFrame:
    """The last `limit` records of a JSON-lines file or folder, newest first, with seq; limit 0 and None give all.

    Records are in the order in which they were appended; those that don't say so come before others, in the order of lines.
    """
    rows = _lines(spark, path, f"{schema}, {_ORDER}").select("seq", "r.*")
    if saved_search:
        rows = rows.where(F.col("savedSearchId") == saved_search)
    newest = rows.orderBy(F.desc_nulls_last("appendedAt"), F.desc_nulls_last("appendedPlace"), F.desc("seq")).drop("appendedAt", "appendedPlace")
    return newest.limit(limit) if limit else newest


def append_history(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, each with the time of the append and its place in it; other null fields are left out."""
    stamped = records.withColumn("appendedAt", F.lit(time.time_ns())).withColumn("appendedPlace", F.monotonically_increasing_id())
    stamped.write.mode("append").json(path)


def export_csv(records: DataFrame, path: str) -> None:
    """Write a history as a CSV text with its header, in the order of seq if records have it."""
    lines = csv_lines(records)
    order = [c for c in ("seq", "groupPlace") if c in lines.columns]
    head = records.sparkSession.range(1).select(*[F.lit(-1).cast(lines.schema[c].dataType).alias(c) for c in order], F.lit(",".join(CSV_COLUMNS)).alias("value"), F.lit(0).alias("part"))
    lines.withColumn("part", F.lit(1)).unionByName(head).orderBy("part", *[F.asc_nulls_first(c) for c in order]).select("value").write.text(path)


def export_json(records: DataFrame, path: str) -> None:
    """Write a history's records as JSON lines, all fields named."""
    records.drop("seq").write.option("ignoreNullFields", "false").json(path)


def history_record(search: DataFrame, groups: DataFrame, alerts: DataFrame, timestamp: Column) -> DataFrame:
    """One record per saved search of (id, name, query): its groups in order and its alerts in order, either may be none."""
    listed = groups.groupBy("search_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("key", "label", "minPrice", "maxPrice", "currency", F.col("offerCount").cast("bigint").alias("offerCount"), "sources", "sellers", "sellerCount", "specs", F.col("bestUrl").alias("bestOfferUrl")).cast(GROUP).alias("g")))), lambda x: x["g"]).alias("groups"))
    said = alerts.groupBy("search_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("groupPlace", "kindPlace", "offerPlace", F.struct("type", "message", "groupKey", "url", "previousPrice", "currentPrice").cast(ALERT).alias("a")))), lambda x: x["a"]).alias("alerts"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    joined = search.join(listed, F.col("id") == listed["search_id"], "left").drop("search_id").join(said, F.col("id") == said["search_id"], "left").drop("search_id")
    return joined.select(timestamp.alias("timestamp"), F.col("id").alias("savedSearchId"), F.col("name").alias("savedSearchName"), "query", F.coalesce("groups", none(GROUP)).alias("groups"), F.coalesce("alerts", none(ALERT)).alias("alerts"))


def flatten_history(records: DataFrame) -> DataFrame:
    """The rows of an exported history: one for each group of a record, and one for a record without groups."""
    flat = records.select("*", F.posexplode_outer("groups").alias("groupPlace", "g"))
    said = F.array_join(F.transform("alerts", lambda a: F.concat(a["type"], F.lit(": "), a["message"])), " | ")
    return flat.select(
        "timestamp", "savedSearchId", "savedSearchName", "query", F.col("g.key").alias("groupKey"), F.col("g.label").alias("groupLabel"), F.col("g.minPrice").alias("minPrice"), F.col("g.maxPrice").alias("maxPrice"), F.col("g.currency").alias("currency"),
        F.col("g.offerCount").alias("offerCount"), F.array_join("g.sources", "; ").alias("sources"), F.col("g.sellerCount").alias("sellerCount"), F.array_join("g.sellers", "; ").alias("sellers"), F.to_json("g.specs").alias("specs"),
        F.size("alerts").alias("alertCount"), said.alias("alerts"), F.col("g.bestOfferUrl").alias("bestOfferUrl"), "groupPlace",
    )


def csv_cell(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(records: DataFrame) -> DataFrame:
    """(seq, groupPlace, value): CSV lines without the header, to be sorted by the first two."""
    rows = flatten_history(records.drop("seq")) if "seq" not in records.columns else flatten_history(records).join(records.select("seq", "timestamp", "savedSearchId").distinct(), ["timestamp", "savedSearchId"])
    text = lambda n: number_text(F.col(n)) if n in ("minPrice", "maxPrice") else F.col(n).cast("string")
    keep = [F.col("seq")] if "seq" in rows.columns else []
    return rows.select(*keep, "groupPlace", F.concat_ws(",", *[csv_cell(text(n)) for n in CSV_COLUMNS]).alias("value"))


def cheapest_group(records: DataFrame) -> DataFrame:
    """records with cheapest: their group of least minPrice, the first of equals; null if no group has a price."""
    priced = F.filter("groups", lambda g: g["minPrice"].isNotNull())
    least = F.array_min(F.transform(priced, lambda g: g["minPrice"]))
    return records.withColumn("cheapest", F.try_element_at(F.filter(priced, lambda g: g["minPrice"] == least), F.lit(1)))


def upsert_searches(searches: DataFrame, changed: DataFrame) -> DataFrame:
    """Saved searches with those of changed in place of the same id; those of other ids are added."""
    return searches.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def update_searches(searches: DataFrame, changed: DataFrame) -> DataFrame:
    """Saved searches with those of changed in place of the same id; changes of unknown ids do nothing."""
    return upsert_searches(searches, changed.join(searches.select("id").distinct(), "id", "left_semi").select(*changed.columns))


def write_searches(searches: DataFrame, path: str) -> None:
    """Write all saved searches in place of what is there, as one version: who reads meanwhile sees the former ones."""
    write_version(searches, path)


def read_searches(spark: SparkSession, path: str, schema: str = "id string, name string, query string, options map<string,string>, createdAt string, updatedAt string, seq bigint") -> DataFrame:
    """Saved searches as they were written; none where nothing is there."""
    return read_version(spark, path, schema)


def find_search(searches: DataFrame, id_or_name: str) -> DataFrame:
    """The first saved search (by seq) of that id, or of that name whatever its case."""
    return searches.where((F.col("id") == id_or_name) | (F.lower("name") == id_or_name.lower())).orderBy("seq").limit(1)


def new_search(row: DataFrame) -> DataFrame:
    """Rows of (name, query, options) with an id of 8 characters and timestamps; an empty name is the query."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return row.select(F.substring(F.expr("uuid()"), 1, 8).alias("id"), F.coalesce(null_if_empty(F.trim("name")), F.col("query")).alias("name"), "query", "options", now.alias("createdAt"), now.alias("updatedAt"))
