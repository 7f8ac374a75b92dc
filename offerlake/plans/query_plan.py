"""Search query plans: the variants of a query, as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import REEL_FAMILIES, REEL_VARIANTS
from ..functions.text import B, collapsed, group, let, ordered_unique

#: Words of queries that Japanese shops may answer.
JDM_TERMS = (
    "jdm", "japan", "japanese", "shimano", "daiwa", "megabass", "evergreen", "tenryu", "graphiteleader", "yamaga", "zenaq", "tict", "34", "varivas", r"area\s?rod", r"ice\s?cube",
    r"ic-\d{2,3}[a-z](?:-[a-z]+)?", r"twin\s?power", "stella", "vanquish", "stradic", "scorpion", "metanium", "aldebaran", "calcutta", "curado", "bantam", "certate", "exist",
)
#: Product words of this market.
MARKET_TERMS = ("Україна", "купити", "ціна", "в наявності", "б/в", "вудилище", "спінінг", "котушка", "OLX", "Rozetka", "Prom", "Hotline")
_JDM = rf"(?i){B}(?:{'|'.join(JDM_TERMS)}){B}"
_FAMILY = "^(?:" + "|".join((*REEL_FAMILIES, "stella", "vanquish", "stradic", "twin", "power", "certate", "exist")) + ")$"
_REEL_FAMILY = f"(?i){'|'.join(REEL_FAMILIES)}"
_REEL = rf"(?i){B}(?:shimano\s+)?(?:\d{{2}}\s+)?(?:{'|'.join(REEL_FAMILIES)})\s+(?:(?:{'|'.join(REEL_VARIANTS)})\s+)?\d{{2,4}}(?:\s+(?:{'|'.join(REEL_VARIANTS)}))?(?:\s+[a-z]{{1,4}})?{B}"


def is_jdm(query: Column) -> Column:
    return query.rlike(_JDM)


def quoted_model(query: Column) -> Column:
    """The reel's name, else all tokens with a digit, in quotes; null if there are none."""
    tokens = F.filter(F.split(query, " "), lambda t: t.rlike("[0-9]"))
    # A reel's name holds a family; the whole pattern is tried on such queries alone.
    reel = F.when(query.rlike(_REEL_FAMILY), F.trim(group(query, _REEL, 0)))
    inner = F.coalesce(reel, F.nullif(F.array_join(tokens, " "), F.lit("")))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def fallback_queries(query: Column) -> Column:
    """Wider queries of the family that the query names."""
    return let(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""), _family_queries)


def _family_queries(tokens: Column) -> Column:
    has = lambda t: F.array_contains(tokens, t)
    family = F.try_element_at(F.filter(tokens, lambda t: t.rlike(_FAMILY)), F.lit(1))
    base = F.when((family == "power") & has("twin"), "shimano twin power").otherwise(F.concat(F.lit("shimano "), family))
    reel = F.array_compact(F.array(F.when(has("dc"), F.concat(base, F.lit(" dc"))), base))
    none = F.array().cast("array<string>")
    return F.when(has("shimano") & family.isNotNull(), reel).when(has("tict") & has("ice") & has("cube"), F.array(F.lit("tict ice cube"))).otherwise(none)


def query_variants(query: Column) -> Column:
    """Ordered variants of a query, no two alike but for case."""
    none = F.array().cast("array<string>")
    # What several variants share is found once for each query.
    with_more = lambda q, jdm: let(quoted_model(q), lambda model: let(F.when(jdm, fallback_queries(q)).otherwise(none), lambda more: _variants(q, jdm, model, more)))
    return let(collapsed(query), lambda q: let(is_jdm(q), lambda jdm: with_more(q, jdm)))


def _variants(q: Column, jdm: Column, model: Column, more: Column) -> Column:
    with_end = lambda end: F.concat(q, F.lit(f" {end}"))
    fixed = [q] + [with_end(e) for e in ("купити Україна", "ціна Україна", "в наявності", "б/в OLX", "site:olx.ua OR site:prom.ua OR site:rozetka.com.ua", "site:hotline.ua OR site:ek.ua", "site:flagman.ua OR site:ibis-gear.com OR site:fish-fish.com.ua")]
    quoted = [F.concat(model, F.lit(" купити Україна")), F.concat(model, F.lit(" ціна"))]
    last = [F.when(jdm, with_end("Japan used")), F.when(jdm, with_end("JDM fishing tackle"))]
    every = F.concat(F.array(*fixed, *quoted), more, F.transform(more, lambda m: F.concat(m, F.lit(" OLX"))), F.transform(more, lambda m: F.concat(m, F.lit(" JDM fishing tackle"))), F.array(*last))
    return ordered_unique(every, F.lower)


def plan_queries(queries: DataFrame) -> DataFrame:
    """queries (query) with original, variants, languageHints and productHints."""
    q = collapsed(F.col("query"))
    strings = lambda *x: F.array(*[F.lit(v) for v in x])
    return queries.select(
        q.alias("original"),
        query_variants(F.col("query")).alias("variants"),
        F.when(is_jdm(q), strings("uk", "en", "ja")).otherwise(strings("uk", "en")).alias("languageHints"),
        F.when(is_jdm(q), strings(*MARKET_TERMS, "Japan", "JDM", "used")).otherwise(strings(*MARKET_TERMS)).alias("productHints"),
    )


def plan_query(spark: SparkSession, query: str) -> DataFrame:
    return plan_queries(spark.createDataFrame([(query,)], "query string"))


#: Providers up to this many are broadcast; more are joined without a hint.
BROADCAST_PROVIDERS = 1000


def fan_out(plans: DataFrame, providers: DataFrame) -> DataFrame:
    """(original, query, variant_place, provider): each variant with each provider; providers is the short table of those configured."""
    few = providers.limit(BROADCAST_PROVIDERS + 1).count() <= BROADCAST_PROVIDERS
    return plans.select("original", F.posexplode("variants").alias("variant_place", "query")).join(F.broadcast(providers) if few else providers, F.lit(True))


def wants_deep_search(query: Column) -> Column:
    """Whether a search gets the larger budgets."""
    terms = [t for t in JDM_TERMS if t not in ("34", "varivas") and not t.startswith(("area", "ic-"))]
    return query.rlike(rf"(?i){B}(?:{'|'.join(terms)}){B}")
