"""Many saved searches against one table of offers, in one plan.

An inverted index of what searches and titles have in common is joined in place of one literal query a plan: model keys where both
name models (another model is a conflict, however many words agree), words and brands where one of them names none. Titles are
judged once for each search that they meet, whatever the number of their offers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread, written
from .ranking import OfferFilter, judge_titles, passes_alone, passes_profile, query_profile, score_offers, title_features


def _open(codes: Column) -> Column:
    """Whether words decide: no codes, or one without number or variant, which says nothing about another model."""
    return (F.size(codes) <= 0) | F.exists(codes, lambda c: c["number"].isNull() | c["variant"].isNull())


def _code_keys(codes: Column, offered: bool) -> Column:
    """Keys that a wanted and an offered code of the same model share: number and variant, and the wanted one's normalized form, which the
    offered one's begins with up to its end or a hyphen."""
    same = F.transform(codes, lambda c: F.concat(F.lit("same:"), c["number"], c["variant"]))
    up_to = lambda form, n: F.concat(F.lit("form:"), F.array_join(F.slice(F.split(form, "-"), F.lit(1), n), "-"))
    if offered:
        forms = F.flatten(F.transform(codes, lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c["normalized"], "-"))), lambda n: up_to(c["normalized"], n))))
    else:
        forms = F.transform(codes, lambda c: F.concat(F.lit("form:"), c["normalized"]))
    return F.array_distinct(F.array_compact(F.concat(same, forms)))


def _word_keys(tokens: Column, models: Column, brand: Column) -> Column:
    words = F.transform(F.array_union(tokens, models), lambda t: F.concat(F.lit("word:"), t))
    return F.array_distinct(F.array_compact(F.concat(words, F.array(F.concat(F.lit("brand:"), brand)))))


def matching_titles(searches: DataFrame, features: DataFrame) -> DataFrame:
    """(search_id, title): distinct pairs that share a model key, or a word or brand where one of them names no model.

    searches: search_id, _q (query_profile); features: title, features (title_features). Both sides are exploded to their keys; no pair comes
    from anything but a common key.
    """
    asked = searches.select("search_id", _open(F.col("_q.codes")).alias("open"), _code_keys(F.col("_q.codes"), False).alias("codes"), _word_keys(F.col("_q.tokens"), F.col("_q.model_tokens"), F.col("_q.brand")).alias("words"))
    known = features.select("title", _open(F.col("features.codes")).alias("open"), _code_keys(F.col("features.codes"), True).alias("codes"), _word_keys(F.col("features.tokens"), F.col("features.models"), F.col("features.brand")).alias("words"))
    keyed = lambda table, name, keys: table.select(name, F.explode(keys).alias("k"))
    pairs = keyed(asked, "search_id", "codes").join(keyed(known, "title", "codes"), "k")
    pairs = pairs.union(keyed(asked.where("open"), "search_id", "words").join(keyed(known, "title", "words"), "k"))
    pairs = pairs.union(keyed(asked.where("not open"), "search_id", "words").join(keyed(known.where("open"), "title", "words"), "k"))
    return pairs.select("search_id", "title").distinct()


def _best_alike(offers: DataFrame, most: int) -> DataFrame:
    """The first `most` offers among those that differ in nothing that score_offers reads: no search takes more of them."""
    alike = ["title", F.coalesce("price", F.lit(0.0)) != 0, F.coalesce(F.col("condition") == "used", F.lit(False)), F.coalesce(F.array_join("evidence", " "), F.lit(""))]
    order = Window.partitionBy(*alike).orderBy(F.desc("confidence"), "seq")
    return offers.withColumn("_alike", F.row_number().over(order)).where(F.col("_alike") <= most).drop("_alike")


def match_searches(searches: DataFrame, offers: DataFrame, wanted: OfferFilter = OfferFilter()) -> DataFrame:
    """offers for each search (search_id, query) that they pass, with search_id, place from 1 and what enrich_offers adds.

    Each search gets what rank_offers gives it, in the same order and with the same limit, but for offers that have no word, brand or model in
    common with it, which aren't matched. Rows of searches with the same id count as one search each text; null queries and titles match
    nothing. Searches of the same text are answered once, and with a limit each title keeps no more offers than a search can take.
    """
    known = searches.where("query is not null").select("search_id", F.col("query").alias("_text")).distinct()
    asked = written(spread(known.select("_text").distinct()).select(F.col("_text").alias("search_id"), query_profile(F.col("_text")).alias("_q")), "match-searches")
    features = written(title_features(offers.where("title is not null")), "match-titles")
    pairs = spread(matching_titles(asked, features))
    met = pairs.join(asked, "search_id").join(features.select("title", F.col("features").alias("_f")), "title").withColumnRenamed("search_id", "_text")
    # A title's verdict for a search passes or fails without the offer, but for the score.
    judged = written(judge_titles(met).where("normalized.modelMatch <> 'conflict'"), "match-judged")
    able = offers.where(passes_alone(wanted)).join(judged.select("title").distinct(), "title", "left_semi")
    if wanted.limit is not None:
        able = _best_alike(able, wanted.limit)
    found = score_offers(able.join(judged, "title"), F.col("_q.specs")).where(passes_profile(F.col("_q"), wanted)).drop("_q")
    order = [F.desc(F.round("relevanceScore", 9)), F.desc("confidence"), F.asc("seq")]
    first = lambda found, by: found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.lit(True) if wanted.limit is None else F.col("place") <= wanted.limit)
    if wanted.limit is not None:
        found = first(found, "_text").drop("place")
    return first(found.join(known, "_text").drop("_text"), "search_id")
