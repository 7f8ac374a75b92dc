"""Candidates of a search: scoring, de-duplication, diversification and fetch order.

A candidate has seq (arrival order), title, url, snippet, sourceProvider and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..functions.urls import normalized_url, path, site
from .ranking import source_terms

DIRECT = "ukrainian-market-search:"
#: Words that speak for a shop page.
SIGNALS = ("price", "buy", "used", "купити", "ціна", "наявності", "б/в", "olx", "rozetka", "prom", "hotline", "flagman", "shimano", "daiwa")
#: Hosts of shops that are fetched early.
PRIORITY_HOSTS = ("ibis-gear.com", "flagman.ua", "shimano.kiev.ua", "fish-fish.com.ua", "zabros.com.ua", "daiwa.in.ua", "aquatory.com.ua", "fanatik.com.ua", "jdm.com.ua")


def _text(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


#: What direct sources are worth, by the end of their name; others are worth the last figure.
SOURCE_POINTS = (
    (78, ("olx", "rozetka", "prom", "zenmarket", "digitaka", "japantackle", "jdmtackleheaven", "ebay")),
    (48, ("flagman", "ibis", "fish-fish", "shimano-kiev", "jdm-com-ua")),
    (24, ("",)),
)
#: Phrases of a direct page's title and their points, each counted once.
TITLE_POINTS = ((4, ("купити україна", "ціна україна")), (-5, ("japan used", "jdm fishing")))
#: A phrase that belongs to one source, and what it costs others.
USED_PHRASE, USED_SOURCE, USED_POINTS = "б/в olx", ":olx", -18


def query_points(query: str, text: Column) -> Column:
    """12 points for each distinct query token that the text holds."""
    tokens = F.array_distinct(plain_tokens(F.lit(query), 1))
    return _sum(F.transform(tokens, lambda t: F.when(text.contains(t), 12).otherwise(0)))


def provider_points(provider: Column) -> Column:
    points = F.when(~provider.startswith(DIRECT), 0)
    for worth, names in SOURCE_POINTS:
        points = points.when(F.coalesce(provider.rlike(f"({'|'.join(names)})$"), F.lit(False)) if any(names) else F.lit(True), worth)
    return points


def candidate_score(query: str, url: str = "url") -> Column:
    everything = F.concat_ws("\n", _text("title"), _text("snippet"), _text(url))
    signals = sum((F.when(everything.contains(s), 8).otherwise(0) for s in SIGNALS), F.lit(0))
    spaced = F.regexp_replace(F.concat_ws(" ", _text("title"), _text("snippet"), _text(url)), r"\s+", " ")
    return F.lit(100) - F.col("rank") + signals + query_points(query, spaced) + provider_points(F.col("sourceProvider"))


def direct_score(query: str) -> Column:
    title, provider = _text("title"), F.col("sourceProvider")
    score = candidate_score(query) + F.when(~provider.endswith(USED_SOURCE) & title.contains(USED_PHRASE), USED_POINTS).otherwise(0)
    for points, phrases in TITLE_POINTS:
        score = score + F.when(title.rlike("|".join(phrases)), points).otherwise(0)
    return score


def dedupe_candidates(candidates: DataFrame, query: str) -> DataFrame:
    """One candidate for each normalized url, the best scored, the earliest of equals; its url is normalized, its seq the first one's."""
    scored = candidates.withColumn("_url", normalized_url(F.col("url"))).withColumn("_score", candidate_score(query, "_url"))
    picked = scored.groupBy("_url").agg(F.max_by(F.struct(*candidates.columns), F.struct("_score", -F.col("seq"))).alias("c"), F.min("seq").alias("_seq"))
    columns = [F.col("_url").alias("url") if c == "url" else F.col("_seq").alias("seq") if c == "seq" else F.col(f"c.{c}").alias(c) for c in candidates.columns]
    return picked.select(*columns)


def diversify(candidates: DataFrame, query: str, per_source: int = 3) -> DataFrame:
    """At most per_source candidates of each direct source, the best; all of other providers."""
    best = Window.partitionBy("sourceProvider").orderBy(F.desc("_direct"), F.desc("_score"), "seq")
    scored = candidates.withColumn("_score", candidate_score(query)).withColumn("_direct", direct_score(query))
    # Other providers are no groups that need ranking, so they don't go through the window.
    direct = scored.where(F.col("sourceProvider").startswith(DIRECT)).withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= per_source).drop("_i")
    rest = scored.where(~F.coalesce(F.col("sourceProvider").startswith(DIRECT), F.lit(False)))
    return direct.unionByName(rest).drop("_score", "_direct")


def discover(candidates: DataFrame, query: str, most: int) -> DataFrame:
    """De-duplicated, diversified, best first, at most `most`."""
    kept = diversify(dedupe_candidates(candidates, query), query)
    return kept.withColumn("score", candidate_score(query)).orderBy(F.desc("score"), "seq").limit(most)


def filter_sources(candidates: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Candidates whose provider or host holds one of the sources or the host behind it; no sources: all."""
    if not sources:
        return candidates
    provider, where = F.lower("sourceProvider"), F.coalesce(site(F.col("url")), F.lit(""))
    some = F.lit(False)
    for term in source_terms(sources):
        some = some | provider.contains(term) | where.contains(term)
    return candidates.where(some)


def fetch_score(query: str) -> Column:
    provider, where, at = F.lower(F.coalesce("sourceProvider", F.lit(""))), F.coalesce(site(F.col("url")), F.lit("")), path(F.col("url"))
    search_path = at.rlike(r"(?i)^/(?:ua/)?(?:search|sr|ek-list)(?![A-Za-z0-9_])")
    priority = F.lit(False)
    for h in PRIORITY_HOSTS:
        priority = priority | (where == h) | where.endswith(f".{h}")
    productive = provider.rlike("ibis|fish-fish|jdm-com-ua") | where.rlike(r"ibis-gear\.com|fish-fish\.com\.ua|jdm\.com\.ua")
    abroad = provider.rlike("zenmarket|digitaka|japantackle|jdmtackleheaven|ebay") | where.rlike(r"(?:zenmarket\.jp|digitaka\.com|japantackle\.com|jdmtackleheaven\.com|ebay\.com)$")
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    text = clean(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), "url"))
    wanted = clean(F.lit(query))
    tokens = F.array_distinct(F.filter(F.split(wanted, " "), lambda t: F.char_length(t) > 1))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return (
        points(provider.startswith(DIRECT), 100) + points(provider.rlike("(olx|rozetka|prom)$"), 80) + points(provider.endswith("-api"), 140) + points(provider.contains("fishing_store_ua"), 20)
        + points(priority, 35) + points(productive, 85) - points(abroad & search_path, 25) + points(at.isNotNull() & ~search_path, 30)
        + points((wanted != "") & text.contains(wanted), 120)
        + _sum(F.transform(tokens, lambda t: F.when(~text.contains(t), 0).when(F.char_length(t) >= 4, 35).otherwise(18)))
    )


def fetch_order(candidates: DataFrame, query: str, budget: int) -> DataFrame:
    """The first `budget` candidates to fetch, by fetch score, rank and arrival."""
    return candidates.withColumn("fetchScore", fetch_score(query)).orderBy(F.desc("fetchScore"), "rank", "seq").limit(budget)


def usable_page(attempts: DataFrame) -> DataFrame:
    """Of fetch attempts (url, ordinal, and a page's columns, usable boolean) the first usable one for each url."""
    columns = [c for c in attempts.columns if c not in ("ordinal", "usable")]
    return attempts.where("usable").groupBy(F.col("url").alias("_u")).agg(F.min_by(F.struct(*columns), "ordinal").alias("p")).select("p.*")


