"""Scoring offers against a query, filtering and ranking them.

An offer has the columns seq, title, url, price, currency, availability, condition, seller, imageUrl, sourceSite, evidence,
confidence, warnings. seq is its arrival order, which breaks all ties.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import compatibility, first_family, model_codes, model_tokens
from ..functions.specs import parse_specs, specs_score
from ..functions.text import collapsed, let, tokenize
from ..functions.urls import identity_key
from ..sources.tables import few_of, spread, written

#: Brands and how they are written, in order of precedence.
BRANDS = {
    "shimano": ("shimano", "шимано"),
    "daiwa": ("daiwa", "дайва"),
    "megabass": ("megabass", "мегабас"),
    "evergreen": ("evergreen", "евергрін"),
    "favorite": ("favorite", "фаворит"),
    "flagman": ("flagman", "флагман"),
    "tict": ("tict", "тікт"),
}
#: Hosts behind source names.
SOURCE_HOSTS = {
    "daiwa-ua": "daiwa.in.ua",
    "ibis": "ibis-gear.com",
    "shimano-kiev": "shimano.kiev.ua",
    "ek": "ek.ua",
    "aquatory": "aquatory.com.ua",
    "fanatik": "fanatik.com.ua",
    "jdm-com-ua": "jdm.com.ua",
    "zenmarket": "zenmarket.jp",
    "digitaka": "digitaka.com",
    "japantackle": "japantackle.com",
    "jdmtackleheaven": "jdmtackleheaven.com",
    "ebay": "ebay.com",
}


@dataclass(frozen=True)
class OfferFilter:
    """What a search lets through; None lets all through."""

    min_price: float | None = None
    max_price: float | None = None
    condition: str | None = None
    sources: Sequence[str] = ()
    limit: int | None = None


def source_terms(sources: Sequence[str]) -> list[str]:
    """The names, lower-cased without www., and the hosts behind them."""
    names = [s.lower().removeprefix("www.") for s in sources]
    return [t for n in names for t in ([n, SOURCE_HOSTS[n]] if n in SOURCE_HOSTS else [n])]


def brand_of(tokens: Column) -> Column:
    found = F.lit(None).cast("string")
    for brand, names in reversed(BRANDS.items()):
        found = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in names])), brand).otherwise(found)
    return found


def query_profile(query: Column) -> Column:
    """struct<raw, tokens, codes, model_tokens, brand, specs> of a query text."""
    codes = model_codes(query)
    return F.struct(query.alias("raw"), tokenize(query).alias("tokens"), codes.alias("codes"), model_tokens(query, codes).alias("model_tokens"), brand_of(tokenize(query)).alias("brand"), parse_specs(query).alias("specs"))


def grade(score: Column) -> Column:
    return F.when(score >= 0.82, "exact").when(score >= 0.58, "close").when(score >= 0.34, "broad").otherwise("weak")


def _features(title: Column) -> Column:
    """What scoring reads from a title alone."""
    return let(model_codes(title), lambda codes: let(tokenize(title), lambda tokens: F.struct(
        tokens.alias("tokens"), codes.alias("codes"), model_tokens(title, codes).alias("models"), brand_of(tokens).alias("brand"), parse_specs(F.concat_ws(" ", title, F.lit(""))).alias("specs"),
    )))


def title_features(titles: DataFrame) -> DataFrame:
    """(title, features) for each distinct title of titles: a table for enrich_offers where many offers share their titles."""
    return spread(titles.select("title").distinct()).withColumn("features", _features(F.col("title")))


def _judged(df: DataFrame, query: str) -> DataFrame:
    """judge_titles of one query for all rows of df (title, _f)."""
    return judge_titles(df.withColumn("_q", query_profile(F.lit(query)))).drop("_q")


def judge_titles(df: DataFrame) -> DataFrame:
    """df (title, _f of title_features, _q of query_profile) with what a title alone says for the row's query, in place of _f: _points, _warned,
    _says, _title_specs, _specs_points and normalized."""
    return df.withColumn("_v", _title_verdict(F.col("title"), F.col("_f"), F.col("_q"))).select(*[c for c in df.columns if c != "_f"], "_v.*")


def _title_verdict(title: Column, features: Column, profile: Column) -> Column:
    """struct<_points, _warned, _says, _title_specs, _specs_points, normalized> of judge_titles."""
    among = lambda tokens, *known: F.filter(tokens, lambda t: functools.reduce(operator.or_, [F.array_contains(k, t) for k in known]))
    return let(features, lambda f: let(profile, lambda q: let(compatibility(q["codes"], f["codes"]), lambda match: let(among(q["tokens"], f["tokens"]), lambda hits: let(
        among(q["model_tokens"], f["tokens"], f["models"]), lambda model_hits: _verdict_from(title, f, q, match, hits, model_hits)
    )))))


def _verdict_from(title: Column, f: Column, q: Column, match: Column, hits: Column, model_hits: Column) -> Column:
    ratio = lambda a, b: F.when(F.size(b) > 0, F.size(a) / F.size(b)).otherwise(0.0)
    brand, asked = f["brand"], q["brand"]
    wrong_brand = asked.isNotNull() & brand.isNotNull() & (brand != asked)
    phrase = F.lower(collapsed(q["raw"]))
    points = (
        F.when(brand == asked, 30).when(wrong_brand, -18).otherwise(0)
        + ratio(hits, q["tokens"]) * 35
        + ratio(model_hits, q["model_tokens"]) * 25
        + F.when(match == "exact", 24).when(match == "compatible", 18).when(match == "conflict", -55).otherwise(0)
        + F.when((F.char_length(phrase) > 4) & F.lower(title).contains(phrase), 12).otherwise(0)
    )
    names = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda x: x["normalized"]), ", "), F.lit("")), F.lit("unknown"))
    warned = F.array(
        F.when(wrong_brand, F.concat(F.lit("brand mismatch: expected "), asked, F.lit(", found "), brand)),
        F.when(match == "conflict", F.concat(F.lit("model mismatch: requested "), names(q["codes"]), F.lit(", found "), names(f["codes"]))),
    )
    says = F.array(
        F.when(brand == asked, F.concat(F.lit("brand "), brand)),
        F.when(F.size(model_hits) > 0, F.concat(F.lit("model tokens: "), F.array_join(model_hits, ", "))),
        F.when(F.size(hits) > 0, F.concat(F.lit("matched: "), F.array_join(F.slice(hits, 1, 6), ", "))),
    )
    normalized = F.struct(
        brand.alias("brand"), F.transform(f["codes"], lambda c: c["normalized"]).alias("modelCodes"), match.alias("modelMatch"), f["models"].alias("modelTokens"), f["tokens"].alias("titleTokens"), f["codes"].alias("codes"), first_family(f["codes"]).alias("family")
    )
    return F.struct(points.alias("_points"), F.array_compact(warned).alias("_warned"), says.alias("_says"), f["specs"].alias("_title_specs"), specs_score(q["specs"], f["specs"]).alias("_specs_points"), normalized.alias("normalized"))


def other_models(features: DataFrame, query: str) -> DataFrame:
    """The titles (title) of features whose models are others than the query's: passes lets no offer of them through."""
    wanted = query_profile(F.lit(query))["codes"]
    return written(spread(features).where(compatibility(wanted, F.col("features.codes")) == "conflict").select("title"), "other-models")


def enrich_offers(offers: DataFrame, query: str, features: DataFrame | None = None) -> DataFrame:
    """offers with relevanceScore (0 to 1), matchGrade, matchReason, warnings, specs and normalized; one row for each.

    features: from title_features, of a catalogue that holds most of the offers' titles, say; each title is then judged once, written, and
    offers are joined with it. An offer whose title it lacks is judged by itself, so that it never changes a result. Without it all of this is
    Column expressions over the row and the query's profile, which is a literal, and nothing is shuffled.
    """
    if features is None:
        df = _judged(offers.withColumn("_f", _features(F.col("title"))), query)
    else:
        one_each = spread(features.dropDuplicates(["title"]))
        judged = written(one_each.select(F.col("title").alias("_title"), _title_verdict(F.col("title"), F.col("features"), query_profile(F.lit(query))).alias("_v")), "judged-titles")
        own = F.when(F.col("title").isNotNull(), _title_verdict(F.col("title"), _features(F.col("title")), query_profile(F.lit(query))))
        df = offers.join(judged, F.col("title") == F.col("_title"), "left").withColumn("_v", F.coalesce("_v", own)).select(*offers.columns, "_v.*")
    return score_offers(df, query_profile(F.lit(query))["specs"])


def score_offers(df: DataFrame, asked: Column) -> DataFrame:
    """df, offers with the columns of judge_titles, scored; asked: the specs of the row's query."""
    none = F.array().cast("array<string>")
    evidence = F.array_join(F.coalesce("evidence", none), " ")
    df = df.withColumn("specs", F.when(evidence == "", F.col("_title_specs")).otherwise(parse_specs(F.concat_ws(" ", "title", evidence))))
    points = (
        F.coalesce("_points", F.lit(0.0))
        + F.when(F.coalesce("price", F.lit(0.0)) != 0, 4).otherwise(0)
        + F.when(evidence == "", F.coalesce("_specs_points", F.lit(0))).otherwise(specs_score(asked, F.col("specs")))
        + F.when(F.col("condition") == "used", 2).otherwise(0)
    )
    reason = F.concat_ws("; ", F.col("_says")[0], F.col("_says")[1], F.when(asked.isNotNull() & F.col("specs").isNotNull(), "specs compatible"), F.col("_says")[2])
    df = df.withColumn("relevanceScore", F.greatest(F.lit(0.0), F.least(F.lit(1.0), points / 100)))
    return df.withColumns({
        "matchGrade": grade(F.col("relevanceScore")),
        "matchReason": F.coalesce(F.nullif(reason, F.lit("")), F.lit("low textual match")),
        "warnings": F.concat(F.coalesce("warnings", none), F.coalesce("_warned", none)),
    }).drop("_points", "_warned", "_says", "_title_specs", "_specs_points")


def passes(query: str, wanted: OfferFilter) -> Column:
    """Whether an enriched offer passes: no other model, and the prices, condition and sources that are asked for."""
    return passes_profile(query_profile(F.lit(query)), wanted)


def passes_profile(q: Column, wanted: OfferFilter) -> Column:
    """passes for a query_profile, which may differ from row to row."""
    known = F.array_union("normalized.titleTokens", "normalized.modelTokens")
    required = F.filter(q["tokens"], lambda t: ~t.rlike(r"^\d{2}$"))
    covered = (F.size(required) >= 2) & F.forall(required, lambda t: F.array_contains(known, t))
    alike = (F.col("normalized.modelMatch") != "conflict") & ~((F.size(q["codes"]) > 0) & (F.col("normalized.modelMatch") == "unknown") & ~covered & (F.col("relevanceScore") < 0.75))
    return alike & passes_alone(wanted)


def passes_alone(wanted: OfferFilter) -> Column:
    """The part of passes that an offer's own columns decide, whatever the query."""
    price, out = F.coalesce("price", F.lit(0.0)), F.lit(True)
    if wanted.min_price is not None:
        out = out & (price != 0) & (price >= wanted.min_price)
    if wanted.max_price is not None:
        out = out & (price != 0) & (price <= wanted.max_price)
    if wanted.condition:
        out = out & F.coalesce(F.col("condition") == wanted.condition, F.lit(False))
    if wanted.sources:
        site = F.lower(F.regexp_replace("sourceSite", r"^www\.", ""))
        some = F.lit(False)
        for term in source_terms(wanted.sources):
            some = some | site.contains(term)
        out = out & F.coalesce((site != "") & some, F.lit(False))
    return out


def rank_offers(offers: DataFrame, query: str, wanted: OfferFilter = OfferFilter(), features: DataFrame | None = None) -> DataFrame:
    """Enriched offers that pass, best first: by relevance (to 9 digits), confidence, arrival."""
    ranked = enrich_offers(offers, query, features).where(passes(query, wanted)).orderBy(F.desc(F.round("relevanceScore", 9)), F.desc("confidence"), "seq")
    return ranked if wanted.limit is None else ranked.limit(wanted.limit)


def dedupe_offers(offers: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """One offer for each identity: the one of highest confidence, the earliest of equals, at the place of the first.

    without: titles (title) that nobody asks for. Identities of which all offers have such a title, or none, are left out before whole rows are
    shuffled; of the others all offers count, whatever their titles.
    """
    key = identity_key(F.col("url"), F.col("sourceSite"), F.col("seller"), F.col("title"), F.col("price"))
    keyed = offers.withColumn("_key", key)
    if without is not None:
        # Hashes of the identities: one that is taken for another by chance only lets more offers through.
        asked = offers.where("title is not null").join(without, "title", "left_anti").select(F.xxhash64(key).alias("_hash")).distinct()
        asked = written(asked, "asked-identities")
        keyed = keyed.withColumn("_hash", F.xxhash64("_key")).join(few_of(asked), "_hash", "left_semi").drop("_hash")
    picked = keyed.groupBy("_key").agg(F.max_by(F.struct(*offers.columns), F.struct("confidence", -F.col("seq"))).alias("o"), F.min("seq").alias("_first"))
    return picked.select("o.*", "_first").withColumn("seq", F.col("_first")).drop("_first")


#: Fixed value: how many offers a verdict is asked for.
VERDICT_OFFERS = 20


def verdict_input(ranked: DataFrame, most: int = VERDICT_OFFERS) -> DataFrame:
    """The best offers of a ranking, for which verdicts are asked."""
    return ranked.orderBy(F.desc(F.round("relevanceScore", 9)), F.desc("confidence"), "seq").limit(most)


def join_verdicts(offers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """offers with ai struct<summary, fit, riskFlags> by url; the last verdict of a url counts, fit is unknown if not given.

    Risk flags are appended to warnings. verdicts: url, summary, fit, riskFlags, seq. Offers without a verdict stay as they are.
    """
    last = verdicts.groupBy(F.col("url").alias("_url")).agg(F.max_by(F.struct("summary", F.coalesce("fit", F.lit("unknown")).alias("fit"), F.coalesce("riskFlags", F.array().cast("array<string>")).alias("riskFlags")), "seq").alias("ai"))
    joined = offers.drop("ai").join(last, F.col("url") == F.col("_url"), "left").drop("_url")
    flags = F.coalesce(F.col("ai.riskFlags"), F.array().cast("array<string>"))
    return joined.withColumn("warnings", F.concat(F.coalesce("warnings", F.array().cast("array<string>")), flags))
