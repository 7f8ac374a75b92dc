"""Queries over the relational test tables, one for each operator, with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import models, pages, specs, text, urls
from .operators import diff, discovery, extraction, grouping, jobs, match, model_catalog, ranking
from .plans import query_plan
from .plans.options import SearchSettings, fetcher_order
from .plans.run import page_routes, route_pages, run_search
from .plans.search import search_offers
from .sources import history, providers
from .sources.pages import best_pages, scraper_pages
from .sources.tables import shared_folder, spread, written
from .streaming import saved, state
from .streaming.watch import watch

SEARCH = "Tict small ring IC-61E"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with a product title: brand, name, type, and a model code such as IC-61E."""
    part = table(spark, sf_dir, "part")
    brand = F.element_at(F.array(*[F.lit(x) for x in ("Shimano ", "Daiwa ", "Tict ", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.withColumn("title", F.concat(brand, F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" IC-"), (50 + F.col("p_size") % 50).cast("string"), F.substring("p_type", 1, 1)))


TITLE = "(CASE p_partkey % 4 WHEN 0 THEN 'Shimano ' WHEN 1 THEN 'Daiwa ' WHEN 2 THEN 'Tict ' ELSE '' END || p_name || ' ' || lower(p_type) || ' IC-' || (50 + p_size % 50)::VARCHAR || substr(p_type, 1, 1))"
CODE = "((50 + p_size % 50)::VARCHAR || lower(substr(p_type, 1, 1)))"
BRAND = "(CASE p_partkey % 4 WHEN 0 THEN 'shimano' WHEN 1 THEN 'daiwa' WHEN 2 THEN 'tict' END)"


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers. part and supplier are looked up by key; Spark broadcasts them where they are small."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    part = titled_parts(spark, sf_dir).select("p_partkey", "title")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    nation = F.col("s_nationkey").cast("string")
    return joined.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("seq"), "title",
        F.concat(F.lit("https://www.Shop"), nation, F.lit(".example/products/"), F.col("l_partkey").cast("string"), F.lit("/?utm_source=a&s="), F.col("l_suppkey").cast("string"), F.lit("#top")).alias("url"),
        F.col("l_extendedprice").alias("price"), F.element_at(F.array(F.lit("UAH"), F.lit("JPY"), F.lit("USD")), F.col("s_nationkey") % 3 + 1).alias("currency"), F.lit("listed").alias("availability"),
        F.when(F.col("l_returnflag") == "R", "used").when(F.col("l_returnflag") == "N", "new").alias("condition"), F.col("s_name").alias("seller"), F.lit(None).cast("string").alias("imageUrl"),
        F.concat(F.lit("www.shop"), nation, F.lit(".example")).alias("sourceSite"), F.array().cast("array<string>").alias("evidence"), F.round(0.5 + F.col("l_discount"), 2).alias("confidence"), F.array().cast("array<string>").alias("warnings"),
    )


OFFERS = f"""
SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, {TITLE} AS title, l_partkey, p_partkey, p_size, p_type, p_name,
  'https://shop' || s_nationkey || '.example/products/' || l_partkey || '?s=' || l_suppkey AS canonical, l_extendedprice AS price,
  CASE s_nationkey % 3 WHEN 0 THEN 'UAH' WHEN 1 THEN 'JPY' ELSE 'USD' END AS currency, CASE l_returnflag WHEN 'R' THEN 'used' WHEN 'N' THEN 'new' END AS condition,
  s_name AS seller, 'shop' || s_nationkey || '.example' AS source, round(0.5 + l_discount, 2) AS confidence, {BRAND} AS brand, {CODE} AS code
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""
#: The best row of each identity: the highest confidence, then the earliest.
BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY confidence DESC, seq) AS i, min(seq) OVER (PARTITION BY canonical) AS first_seq FROM ({OFFERS})) WHERE i = 1"
#: Relevance for SEARCH: tokens tict, small, ring, ic-61e; model tokens ic-61e and 61e, which stand in a title together.
RELEVANT = f"""
SELECT *, greatest(0, least(1, (CASE WHEN brand = 'tict' THEN 30 WHEN brand IS NOT NULL THEN -18 ELSE 0 END
    + ((brand = 'tict' AND brand IS NOT NULL)::INT + (split_part(p_name, ' ', 1) = 'small' OR p_type = 'SMALL')::INT + (split_part(p_name, ' ', 2) = 'ring')::INT + (code = '61e')::INT) / 4.0 * 35
    + CASE WHEN code = '61e' THEN 25 + 24 ELSE -55 END
    + CASE WHEN contains(lower(title), 'tict small ring ic-61e') THEN 12 ELSE 0 END + 4 + CASE WHEN condition = 'used' THEN 2 ELSE 0 END) / 100)) AS relevance
FROM ({BEST})
"""


def tokenize_titles(spark, sf_dir):
    p = titled_parts(spark, sf_dir)
    return p.select("p_partkey", F.array_join(text.tokenize(F.col("title")), " ").alias("tokens"), F.size(text.tokenize(F.col("title"))).alias("n_tokens"))


def tokenize_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.plain_tokens(F.col("text"), 1)).alias("n_tokens"), F.size(F.array_distinct(text.plain_tokens(F.col("text"), 2))).alias("n_distinct"))


def brand_detect(spark, sf_dir):
    p = titled_parts(spark, sf_dir)
    return p.groupBy(F.coalesce(ranking.brand_of(text.tokenize(F.col("title"))), F.lit("none")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


def model_code_extract(spark, sf_dir):
    codes = models.model_codes(F.col("title"))
    return titled_parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(codes, lambda c: c["normalized"]), ",").alias("codes"), models.first_family(codes).alias("family"), F.array_join(models.code_tokens(codes), ",").alias("code_tokens"))


def model_compatibility(spark, sf_dir):
    verdict = models.compatibility(models.model_codes(F.lit("ic-61e")), models.model_codes(F.col("title")))
    return titled_parts(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def spec_overlap_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("rod 2.1m "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit("g "), F.when(F.col("p_partkey") % 2 == 0, "ML left").otherwise("MH right"))
    got = specs.parse_specs(line)
    return p.select("p_partkey", got["rodLengthM"].alias("length"), got["lureMinG"].alias("lure_min"), got["lureMaxG"].alias("lure_max"), got["power"].alias("power"), got["handedness"].alias("hand"), specs.format_specs(got).alias("formatted"), specs.specs_score(specs.parse_specs(F.lit("2.13m 10-20g ML left")), got).alias("points"))


def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.normalized_url(F.col("url")).alias("normalized"), urls.site(F.col("url")).alias("site"), urls.path(F.col("url")).alias("path"))


def offer_identity_keys(spark, sf_dir):
    """Signatures, of offers whose url is invalid."""
    o = offers(spark, sf_dir)
    key = urls.identity_key(F.lit("no url"), F.col("sourceSite"), F.col("seller"), F.col("title"), F.col("price"))
    return o.groupBy(key.alias("identity")).agg(F.count(F.lit(1)).alias("n"))


def _candidates(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    provider = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ukrainian-market-search:"), urls.host(F.col("url")))).otherwise("brave")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select((F.col("page_id") * 2).alias("seq"), title.alias("title"), "url", F.lit(None).cast("string").alias("snippet"), provider.alias("sourceProvider"), (F.col("page_id") % 20).cast("int").alias("rank")).unionByName(
        p.select((F.col("page_id") * 2 + 1).alias("seq"), F.lit("buy the price").alias("title"), F.concat(F.regexp_replace("url", "#.*", ""), F.lit("#other")).alias("url"), F.lit("used").alias("snippet"), F.lit("brave").alias("sourceProvider"), (F.col("page_id") % 7).cast("int").alias("rank"))
    )


CANDIDATE_QUERY = "the reed price"
_NORMAL = "regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=feed$', '')"
CANDIDATES = f"""
WITH b AS (
  SELECT page_id * 2 AS seq, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, NULL AS snippet,
    CASE WHEN page_id % 3 = 0 THEN 'ukrainian-market-search:' || lower(regexp_extract(url, '://([^/?#]+)', 1)) ELSE 'brave' END AS provider, (page_id % 20)::INT AS rank FROM pages
  UNION ALL SELECT page_id * 2 + 1, 'buy the price', regexp_replace(url, '#.*', '') || '#other', 'used', 'brave', (page_id % 7)::INT FROM pages
), u AS (SELECT *, {_NORMAL} AS nurl, lower(title || chr(10) || coalesce(snippet, '') || chr(10) || {_NORMAL}) AS everything FROM b),
s AS (SELECT *, 100 - rank + 8 * list_sum(list_transform(['price','buy','used','купити','ціна','наявності','б/в','olx','rozetka','prom','hotline','flagman','shimano','daiwa'], lambda w: contains(everything, w)::INT))
    + 12 * list_sum(list_transform(['the','reed','price'], lambda w: contains(everything, w)::INT)) + CASE WHEN provider LIKE 'ukrainian-market-search:%' THEN 24 ELSE 0 END AS score FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY nurl ORDER BY score DESC, seq) AS i, min(seq) OVER (PARTITION BY nurl) AS first_seq FROM s)
"""


def candidate_url_dedupe(spark, sf_dir):
    kept = discovery.dedupe_candidates(_candidates(spark, sf_dir), CANDIDATE_QUERY)
    return kept.select("seq", "url", "title", "rank", discovery.candidate_score(CANDIDATE_QUERY).cast("long").alias("score"))


def diversify_top3_per_source(spark, sf_dir):
    kept = discovery.diversify(discovery.dedupe_candidates(_candidates(spark, sf_dir), CANDIDATE_QUERY), CANDIDATE_QUERY, 3)
    return kept.groupBy("sourceProvider").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


def candidate_score_topk(spark, sf_dir):
    return discovery.discover(_candidates(spark, sf_dir), CANDIDATE_QUERY, 25).select("seq", "url", F.col("score").cast("long").alias("score"))


def source_alias_filter(spark, sf_dir):
    named = _candidates(spark, sf_dir).withColumn("url", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("https://www.ibis-gear.com/p/"), F.col("seq").cast("string"))).otherwise(F.col("url")))
    return discovery.filter_sources(named, ["www.ibis", "spam-farm"]).select("seq", "url")


def fetch_order_topk(spark, sf_dir):
    return discovery.fetch_order(_candidates(spark, sf_dir), CANDIDATE_QUERY, 30).select("seq", F.col("fetchScore").cast("long").alias("fetch_score"), "rank")


def _features(spark, sf_dir):
    """Offers share the titles of parts, so titles are read once each."""
    return written(ranking.title_features(titled_parts(spark, sf_dir)), "titles")


def relevance_grade(spark, sf_dir):
    e = ranking.enrich_offers(ranking.dedupe_offers(offers(spark, sf_dir)), SEARCH, _features(spark, sf_dir))
    return e.groupBy(F.col("matchGrade").alias("grade"), F.col("normalized.modelMatch").alias("model_match")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("relevanceScore"), 4).alias("relevance"))


def offer_dedupe_best(spark, sf_dir):
    return ranking.dedupe_offers(offers(spark, sf_dir)).select("seq", urls.canonical_url(F.col("url")).alias("canonical"), "price", "confidence")


def price_condition_filter(spark, sf_dir):
    wanted = ranking.OfferFilter(min_price=20000, max_price=60000, condition="used", sources=("www.shop1",))
    return ranking.rank_offers(offers(spark, sf_dir), "IC-61E ring", wanted, _features(spark, sf_dir)).select("seq", "price", "condition", F.round("relevanceScore", 6).alias("relevance"))


def ranked_offers_topk(spark, sf_dir):
    features = _features(spark, sf_dir)
    once = ranking.dedupe_offers(offers(spark, sf_dir), ranking.other_models(features, SEARCH))
    return ranking.rank_offers(once, SEARCH, ranking.OfferFilter(limit=20), features).select("seq", "title", "price", F.round("relevanceScore", 6).alias("relevance"), F.col("matchGrade").alias("grade"), F.col("matchReason").alias("reason"))


def group_offers_summary(spark, sf_dir):
    g = grouping.group_offers(ranking.enrich_offers(offers(spark, sf_dir), SEARCH, _features(spark, sf_dir)))
    return g.select("key", "label", F.col("offerCount").alias("offer_count"), F.col("minPrice").alias("min_price"), F.col("maxPrice").alias("max_price"), F.size("sources").alias("n_sources"), F.col("sellerCount").cast("long").alias("n_sellers"), "currency", F.array_join(F.array_sort("modelCodes"), ",").alias("codes"))


def flagship(spark, sf_dir):
    """The whole search: ranked offers of the model that is asked for, grouped."""
    run = search_offers(offers(spark, sf_dir), SEARCH, features=_features(spark, sf_dir))
    return grouping.ordered_groups(run.groups).select("key", "label", F.col("offerCount").alias("offer_count"), F.col("minPrice").alias("min_price"), F.col("maxPrice").alias("max_price"), F.col("sellerCount").cast("long").alias("n_sellers"), F.col("bestTitle").alias("best_title"))


def ai_left_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    verdicts = labels.select(F.concat(F.lit("u"), (F.col("doc_id") % 200).cast("string")).alias("url"), F.lit("s").alias("summary"), F.when(F.col("quality") == 1, "good").alias("fit"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).alias("riskFlags"), F.col("doc_id").alias("seq"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.array(F.lit("w")).alias("warnings"))
    return ranking.join_verdicts(docs, verdicts).select("doc_id", F.coalesce("ai.fit", F.lit("none")).alias("fit"), F.array_join("warnings", ",").alias("warnings"))


def _months(spark, sf_dir):
    """Two snapshots: offers of orders in two months, by model family within a brand of search."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).where("month in ('1997-03', '1997-04')")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(titled_parts(spark, sf_dir).select("p_partkey", "title", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("month", F.lit("s1").alias("search_id"), models.first_family(models.model_codes(F.col("title"))).alias("key"), F.concat(F.lit("u"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("url"), "title", F.col("l_extendedprice").alias("price"))
    once = rows.groupBy("month", "search_id", "key", "url").agg(F.min("title").alias("title"), F.min("price").alias("price"))
    made = lambda m: (once.where(F.col("month") == m).groupBy("search_id", "key").agg(F.min("price").alias("minPrice")).select("search_id", "key", F.upper("key").alias("label"), "minPrice", F.xxhash64("key").alias("place")), once.where(F.col("month") == m).select("search_id", "key", "url", "title", "price", F.xxhash64("url").alias("place")))
    return made("1997-03"), made("1997-04")


_DIFF = f"""
WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, 'ic-' || {CODE} AS key, 'u' || l_partkey || '-' || l_suppkey AS url, {TITLE} AS title, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE strftime(o_orderdate, '%Y-%m') IN ('1997-03', '1997-04')),
o AS (SELECT month, key, url, min(title) AS title, min(price) AS price FROM r GROUP BY ALL), g AS (SELECT month, key, min(price) AS p FROM o GROUP BY ALL),
was AS (SELECT key, p FROM g WHERE month = '1997-03'), now AS (SELECT key, p FROM g WHERE month = '1997-04')
"""


def snapshot_alerts(spark, sf_dir):
    (old_g, old_o), (new_g, new_o) = _months(spark, sf_dir)
    a = diff.snapshot_alerts(new_g, new_o, old_g, old_o)
    return a.select(F.col("type").alias("kind"), F.col("groupKey").alias("key"), F.coalesce("url", F.lit("-")).alias("url"), F.col("previousPrice").alias("previous"), F.col("currentPrice").alias("current"), "message")


def snapshot_first_run(spark, sf_dir):
    (g, o), _ = _months(spark, sf_dir)
    a = diff.snapshot_alerts(g, o, g.limit(0), o.limit(0))
    return a.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("message").startswith("Initial match: ").cast("int")).alias("initial"))


def _records(spark, sf_dir):
    """Price-history records by order month: a group for each priority, some months without groups."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).withColumn("p", F.substring("o_orderpriority", 1, 1))
    groups = o.groupBy("month", "p").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n"))
    g = F.struct(F.concat(F.lit("k"), F.col("p")).alias("key"), F.concat(F.lit('label "'), F.col("p"), F.lit('", x')).alias("label"), F.col("lo").alias("minPrice"), F.col("hi").alias("maxPrice"), F.lit("UAH").alias("currency"), F.col("n").alias("offerCount"), F.array(F.lit("a"), F.lit("b")).alias("sources"), F.array(F.lit("s")).alias("sellers"), F.lit(1).alias("sellerCount"), F.lit(None).cast(history._SPECS).alias("specs"), F.concat(F.lit("u"), F.col("p")).alias("bestOfferUrl")).cast(history.GROUP)
    r = groups.groupBy("month").agg(F.array_sort(F.collect_list(g)).alias("groups"))
    odd = F.substring("month", 7, 1).isin("1", "5")
    none = F.array().cast(f"array<{history.GROUP}>")
    alert = F.array(F.struct(F.lit("new_group").alias("type"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("groupKey"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("double").alias("previousPrice"), F.lit(None).cast("double").alias("currentPrice")).cast(history.ALERT))
    return r.select(F.col("month").alias("timestamp"), F.lit("id1").alias("savedSearchId"), F.lit("name").alias("savedSearchName"), F.lit("q").alias("query"), F.when(odd, none).otherwise(F.col("groups")).alias("groups"), alert.alias("alerts"), F.col("month").alias("seq"))


_RECORDS = """
WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, substr(o_orderpriority, 1, 1) AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY ALL),
f AS (SELECT m.month, p, lo, hi, n FROM (SELECT DISTINCT month FROM g) m LEFT JOIN g ON g.month = m.month AND substr(m.month, 7, 1) NOT IN ('1', '5'))
"""


def history_flatten_csv(spark, sf_dir):
    rows = history.flatten_history(_records(spark, sf_dir).drop("seq"))
    return rows.select("timestamp", F.coalesce("groupKey", F.lit("-")).alias("group_key"), F.col("minPrice").alias("min_price"), F.coalesce("offerCount", F.lit(0)).cast("long").alias("offer_count"), F.coalesce("sources", F.lit("-")).alias("sources"), "alerts", F.col("alertCount").alias("alert_count"), history.csv_cell(F.col("groupLabel")).alias("label_cell"))


def cheapest_group_per_record(spark, sf_dir):
    return history.cheapest_group(_records(spark, sf_dir)).select("timestamp", F.col("cheapest.key").alias("key"), F.col("cheapest.minPrice").alias("min_price"))


def history_last_n(spark, sf_dir):
    return _records(spark, sf_dir).orderBy(F.desc("seq")).limit(7).select("timestamp", F.size("groups").alias("n_groups"))


def page_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1)).withColumn("status", F.when(F.col("page_id") % 11 == 0, 403).when(F.col("page_id") % 13 == 0, 404).otherwise(200))
    body = F.when(F.col("page_id") % 2 == 0, "Access denied").otherwise("fine")
    return p.select("page_id", pages.is_search_page(F.col("url"), F.col("title")).alias("search"), pages.is_missing_page(F.col("status"), F.col("title"), F.lit(None)).alias("missing"), pages.is_blocked_page(F.col("status"), F.col("title"), body, F.lit(None)).alias("blocked"))


def price_extract_first_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    whole = F.floor("o_totalprice").cast("long")
    line = F.concat(F.lit("was "), whole.cast("string"), F.lit(" грн, now $"), (whole + 7).cast("string"), F.lit(" or 1,234 UAH"))
    first, last, page = pages.list_price(line), pages.last_list_price(line), pages.page_price(line)
    return o.select("o_orderkey", first["amount"].alias("first_amount"), first["currency"].alias("first_currency"), last["amount"].alias("last_amount"), last["currency"].alias("last_currency"), page["amount"].alias("page_amount"), page["currency"].alias("page_currency"))


def model_rank_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    m = p.select(
        key.alias("seq"), F.concat(F.element_at(F.array(F.lit("qwen/a"), F.lit("acme/coder"), F.lit("acme/guard"), F.lit("acme/x")), (key % 4 + 1).cast("int")), key.cast("string"), F.when(key % 3 == 0, ":free").otherwise("")).alias("id"), F.lit(None).cast("string").alias("name"),
        (F.col("p_size") * 30000).cast("long").alias("context_length"), F.struct(F.when(key % 5 == 0, "0").otherwise("1").alias("prompt"), F.lit("0").alias("completion"), F.lit(None).cast("string").alias("request")).alias("pricing"),
        F.struct(F.when(key % 7 == 0, "text->image").otherwise("text->text").alias("modality"), F.array().cast("array<string>").alias("output_modalities")).alias("architecture"), F.struct(F.lit(None).cast("long").alias("context_length"), (F.col("p_size") * 1000).cast("long").alias("max_completion_tokens")).alias("top_provider"),
    )
    return model_catalog.rank_models(m).select("id", F.col("localScore").cast("long").alias("score"), F.col("selectionReason").alias("reason"))


def query_variants(spark, sf_dir):
    q = spread(titled_parts(spark, sf_dir).select("p_partkey", F.col("title").alias("query")))
    v = query_plan.query_variants(F.col("query"))
    return q.select("p_partkey", F.posexplode(v).alias("place", "variant"))


def direct_catalog(spark, sf_dir):
    q = titled_parts(spark, sf_dir).select(F.col("title").alias("query"))
    return providers.direct_candidates(q).select("query", "url", "sourceProvider", F.col("rank").cast("long").alias("rank"))


def _shop_pages(spark, sf_dir):
    """Result pages in one shop's markup, 15 parts a page."""
    p = titled_parts(spark, sf_dir)
    card = F.concat(F.lit('<div class="list-item"><a class="item-title" href="/ua/p'), F.col("p_partkey").cast("string"), F.lit('/?a=1">'), F.col("title"), F.lit("</a><span>"), F.floor("p_retailprice").cast("string"), F.lit(" грн</span><img data-src='/i.png'></div>"))
    listed = p.groupBy((F.col("p_partkey") / 15).cast("long").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), "").alias("cards"))
    url = F.concat(F.lit("https://hotline.ua/ua/sr/?q="), F.col("n").cast("string"))
    return listed.select(url.alias("url"), url.alias("finalUrl"), F.lit("t").alias("title"), F.concat(F.lit("<html><body><br>"), F.col("cards"), F.lit("</body></html>")).alias("html"), F.lit("").alias("text"), F.lit(200).alias("status"))


def html_list_extract(spark, sf_dir):
    return extraction.list_offers(_shop_pages(spark, sf_dir)).select("title", "url", "price", "currency", F.col("imageUrl").alias("image"), "confidence")


def jsonld_extract(spark, sf_dir):
    p = titled_parts(spark, sf_dir)
    node = F.concat(F.lit('{"@type":["Product"],"name":"'), F.col("title"), F.lit('","url":"/p/'), F.col("p_partkey").cast("string"), F.lit('","offers":{"price":"'), F.floor("p_retailprice").cast("string"), F.lit(',50","priceCurrency":"UAH","availability":"https://schema.org/InStock",}}'))
    url = F.concat(F.lit("https://shop.example/l/"), F.col("p_partkey").cast("string"))
    made = p.select(url.alias("url"), url.alias("finalUrl"), F.lit("t").alias("title"), F.concat(F.lit("<html><script type=\"application/ld+json\">{\"@graph\":["), node, F.lit("]}</script></html>")).alias("html"), F.lit("").alias("text"), F.lit(200).alias("status"))
    return extraction.list_offers(made).select("title", "url", "price", "currency", "availability", "confidence")


RUN_QUERY = "the reed price"


def _run_inputs(spark, sf_dir):
    """A candidate for each page, and what two fetchers got for it: shop cards, JSON-LD, plain products, direct searches without hits, blocked pages."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), '["\\\\]', "").alias("title"))
    number, kind = F.col("page_id").cast("string"), (F.col("page_id") % 6).cast("int")
    url = F.concat(
        F.element_at(F.array(*[F.lit(x) for x in ("https://hotline.ua/ua/sr/?q=", "https://shop.example/l/", "https://plain.example/p/", "https://plain.example/d/", "https://hotline.ua/ua/p", "https://late.example/l/")]), kind + 1),
        number,
    )
    provider = F.when(kind.isin(0, 3), F.concat(F.lit("ukrainian-market-search:src"), (F.col("page_id") % 17).cast("string"))).otherwise("brave")
    candidates = p.select(F.col("page_id").alias("seq"), "title", url.alias("url"), F.lit(None).cast("string").alias("snippet"), provider.alias("sourceProvider"), (F.col("page_id") % 20).cast("int").alias("rank"))
    card = lambda n: F.concat(F.lit('<div class="list-item"><a class="item-title" href="/ua/p'), number, F.lit(f'-{n}/">'), F.col("title"), F.lit(f" number {n}</a><span>{n}00 грн</span></div>"))
    node = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"'), F.col("title"), F.lit('","url":"/item/'), number, F.lit('","offers":{"price":"50","priceCurrency":"UAH"}}</script>'))
    good = F.when(kind == 0, F.concat(card(1), card(2))).when(kind.isin(1, 5), node).otherwise(F.concat(F.lit("<p>"), F.col("title"), F.lit("</p>")))
    text = F.when(kind.isin(2, 3, 4), F.concat(F.col("title"), F.lit("\nЦіна 700 грн"))).otherwise("")
    blocked = (kind == 5) | (F.col("page_id") % 12 == 5)
    attempt = lambda fetcher, bad: p.select(
        url.alias("url"), url.alias("finalUrl"), F.when(bad, "Just a moment").otherwise(F.col("title")).alias("title"), F.when(bad, "captcha").otherwise(good).alias("html"), F.lit(None).cast("string").alias("markdown"),
        F.when(bad, "").otherwise(text).alias("text"), F.when(bad, 403).otherwise(200).alias("status"), F.lit(fetcher).alias("fetcher"),
    )
    return candidates, attempt("http", blocked).unionByName(attempt("browser", F.col("page_id") % 12 == 5))


def search_run_routes(spark, sf_dir):
    """Which reader each fetched page of a whole search took, and how many offers it gave."""
    candidates, attempts = _run_inputs(spark, sf_dir)
    return run_search(candidates, attempts, RUN_QUERY, SearchSettings(max_results=220, max_pages=60)).routes


def page_readers(spark, sf_dir):
    """The reader of every page, without budgets."""
    candidates, attempts = _run_inputs(spark, sf_dir)
    pages_got = best_pages(attempts, fetcher_order("auto", True)).join(candidates.select("url", "sourceProvider", F.col("seq").alias("place")), "url")
    got = route_pages(pages_got, F.col("sourceProvider").startswith("ukrainian-market-search:"))
    return page_routes(candidates.withColumn("place", F.col("seq")), pages_got, got)


def search_run_groups(spark, sf_dir):
    """The product families of the same search."""
    candidates, attempts = _run_inputs(spark, sf_dir)
    groups = run_search(candidates, attempts, RUN_QUERY, SearchSettings(max_results=220, max_pages=60)).groups
    return groups.select("label", F.col("offerCount").cast("long").alias("offer_count"), F.col("minPrice").alias("min_price"), "currency")


def watch_foreachbatch(spark, sf_dir):
    """Events as a stream of offers, watched in one micro-batch: the alerts of the first run."""
    folder = f"{shared_folder(spark)}/watch-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def search(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        o = batch.select(F.lit("s1").alias("search_id"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("url"), F.col("event_type").alias("title"), F.col("value").alias("price"), F.col("event_id").alias("place"))
        g = o.groupBy("search_id", "key").agg(F.min("price").alias("minPrice"), F.min("place").alias("place"), F.min("key").alias("label"))
        return g, o

    watch(stream, folder, search).awaitTermination()
    return spark.read.parquet(f"{folder}/run=0/alerts").select(F.col("type").alias("kind"), F.col("groupKey").alias("key"), F.col("currentPrice").alias("price"))


def _event_offers(events: DataFrame) -> DataFrame:
    """Events as offers of four searches: a group for each type and seventh of users, an offer for each user."""
    user = F.col("user_id")
    return events.select(
        F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)))").alias("ts"), "event_id", F.concat(F.lit("s"), (user % 4).cast("string")).alias("search_id"), F.concat("event_type", (user % 7).cast("string")).alias("key"), F.concat(F.lit("u"), user.cast("string")).alias("url"), F.col("value").alias("price")
    )


def saved_search_runs(spark, sf_dir):
    """Alerts of three runs of four saved searches, each run committed as one body."""
    folder = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    every = _event_offers(table(spark, sf_dir, "events"))
    searches = spark.createDataFrame([(f"s{i}", f"n{i}", f"q{i}") for i in range(4)], "id string, name string, query string")

    def search(run: int):
        o = every.where(F.col("event_id") % 3 == run).groupBy("search_id", "key", "url").agg(F.min("price").alias("price"))
        o = o.withColumn("title", F.col("url")).withColumn("place", F.xxhash64("url"))
        none = F.array().cast("array<string>")
        g = o.groupBy("search_id", "key").agg(F.min("price").alias("minPrice"), F.max("price").alias("maxPrice"), F.count(F.lit(1)).alias("offerCount"), F.min_by("url", F.struct("price", "url")).alias("bestUrl"))
        g = g.withColumns({"label": F.col("key"), "currency": F.lit("UAH"), "sources": none, "sellers": none, "sellerCount": F.lit(0), "specs": F.lit(None).cast(history._SPECS), "place": F.xxhash64("key")})
        return g, o

    for run in range(3):
        saved.run_saved(spark, folder, run, searches, lambda _, r=run: search(r), str(run))
    return saved.read_sink(spark, folder, "alerts").select("run", "search_id", F.col("type").alias("kind"), "groupKey", "url", "previousPrice", "currentPrice")


def watch_keyed_state(spark, sf_dir):
    """Alerts of the events as a stream in three parts, one after the other, each a run of a day; the stream is stopped and goes on after each."""
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    events = _event_offers(table(spark, sf_dir, "events"))
    at, least = F.unix_micros("ts"), None
    before = [*events.agg(F.percentile_approx(at, [0.33, 0.66])).first()[0], None]
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
    for i, most in enumerate(before):
        part = events.where(at > least) if least is not None else events
        (part.where(at <= most) if most is not None else part).write.parquet(f"{folder}/in/part{i}")
        state.watch_state(stream, "1 day", f"{folder}/alerts", f"{folder}/progress").awaitTermination()
        least = most
    return spark.read.schema(state.ALERT).parquet(f"{folder}/alerts").select("run", "search_id", F.col("type").alias("kind"), "groupKey", "url", "previousPrice", "currentPrice")


def many_saved_searches(spark, sf_dir):
    """A saved search for every supplier, all of them against all line items in one plan: the best 20 offers of each."""
    key = F.col("s_suppkey")
    brand = F.element_at(F.array(*[F.lit(x) for x in ("Shimano", "Daiwa", "Tict")]), (key % 3 + 1).cast("int"))
    letter = F.substring(F.lit("SMLEP"), (key % 5 + 1).cast("int"), F.lit(1))
    searches = table(spark, sf_dir, "supplier").select(key.alias("search_id"), F.concat(brand, F.lit(" IC-"), (50 + key * 7 % 50).cast("string"), letter).alias("query"))
    best = match.match_searches(searches, offers(spark, sf_dir), ranking.OfferFilter(limit=20))
    return best.select("search_id", F.col("place").cast("long").alias("place"), "seq", F.round("relevanceScore", 6).alias("relevance"), "matchGrade", "matchReason")


def _two_step_answers(spark, sf_dir):
    """(answers, goods, variants): each order asks a marketplace for its parts, whose own answers come from a second table; some fail."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    item = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_quantity") <= 45, F.col("l_partkey")).alias("id"))
    # An order has a few lines.
    asked = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"))).alias("goods"))
    asked = asked.withColumn("query", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    meta = F.when(F.col("l_orderkey") % 2 == 0, F.struct(F.concat(F.lit("found for "), F.col("query")).alias("title")))
    body = F.to_json(F.struct(F.struct("goods", meta.alias("meta")).alias("data")))
    answers = asked.select(F.lit("rozetka-search").alias("provider"), "query", body.alias("body"))
    data = F.struct(
        key.alias("id"), F.when(key % 5 != 0, F.col("p_name")).alias("title"), F.when(key % 3 != 0, F.floor("p_retailprice")).otherwise(0).alias("price"),
        F.when(key % 13 != 0, F.concat(F.lit("https://rozetka.com.ua/p"), key.cast("string"))).alias("href"), F.when(key % 2 == 0, "available").alias("sell_status"), F.when(key % 4 == 3, "active").alias("status"),
    )
    goods = part.where(key % 7 != 0).select(key.alias("goods_id"), F.to_json(F.struct(F.when(key % 11 != 0, data).alias("data"))).alias("body"))
    return answers, goods, asked.select("query", F.col("l_orderkey").alias("variant_place"))


def two_step_candidates(spark, sf_dir):
    found = providers.all_candidates(*_two_step_answers(spark, sf_dir), limit=4)
    return found.where(F.col("sourceProvider") == "rozetka-api").select("query", "title", "url", "snippet", F.col("rank").cast("long").alias("rank"), "seq")


def scraped_product_pages(spark, sf_dir):
    """A scraping service's answers for one shop's product pages, one a part, read as single products; some answers are empty or not found."""
    key = F.col("p_partkey")
    number, site = key.cast("string"), "https://shimano.kiev.ua/"
    heading = F.when(key % 5 != 0, F.concat(F.lit("<h1> "), F.col("p_name"), F.lit("\n "), number, F.lit(" | shop</h1>"))).otherwise(F.concat(F.lit('<meta property="og:title" content="'), F.col("p_name"), F.lit(" og "), number, F.lit('">')))
    price = F.when(key % 4 != 0, F.concat(F.lit('<span id="price_update_'), number, F.lit('"><b class="ty-price">1 '), F.floor("p_retailprice").cast("string"), F.lit(",50 ₴</b></span>"))).otherwise("")
    stock = F.when(key % 2 == 0, "Є в наявності").otherwise("немає")
    image = F.when(key % 3 == 0, F.concat(F.lit('<div class="ut2-pb__img-wrapper"><img data-src="/i/'), number, F.lit('.png"></div>'))).otherwise("")
    html = F.concat(F.lit("<html><body>"), heading, price, F.lit('<div class="stock-wrap">'), stock, F.lit("</div>"), image, F.lit('<i class="ut2-pb__sku">SKU '), number, F.lit("</i></body></html>"))
    status = F.when(key % 11 == 0, 404).otherwise(200).alias("statusCode")
    place = lambda letter, n: F.when(key % 3 == n, F.concat(F.lit(f"{site}{letter}"), number))
    told = F.struct(F.col("p_name").alias("title"), place("p", 0).alias("sourceURL"), place("u", 1).alias("url"), status).alias("metadata")
    data = F.when(key % 7 != 0, F.struct(F.concat(F.lit("# "), F.col("p_name")).alias("markdown"), html.alias("html"), told))
    answers = table(spark, sf_dir, "part").select(F.concat(F.lit(f"{site}a"), number).alias("url"), F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data"))).alias("body"))
    read = extraction.page_offers(best_pages(scraper_pages(answers), fetcher_order("auto", True)))
    return read.select("title", "url", "price", "currency", "availability", F.col("imageUrl").alias("image"), F.array_join("evidence", "; ").alias("evidence"), "confidence")


def _job_log(spark, sf_dir, daily=False):
    """Events as the log of a queue for each user, or for each user and day: a job is what a user does in a quarter of a day."""
    e, seconds = table(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    state = F.element_at(F.create_map(*[F.lit(x) for x in ("view", jobs.QUEUED, "click", jobs.RUNNING, "purchase", jobs.COMPLETED, "error", jobs.FAILED, "signup", "noted")]), F.col("event_type"))
    quarter = F.floor(seconds / 21_600_000_000).cast("string")
    user, day = F.col("user_id").cast("string"), F.floor(seconds / 86_400_000_000).cast("string")
    queue = F.concat(user, F.lit("-"), day) if daily else user
    return e.select(F.concat(user, F.lit("-"), quarter).alias("job"), queue.alias("queue"), state.alias("state"), seconds.alias("at"), F.col("event_id").alias("seq"))


def job_retention(spark, sf_dir):
    """The jobs that each queue keeps, with their states; -1 for times that aren't known."""
    return jobs.kept_jobs(jobs.job_states(_job_log(spark, sf_dir))).drop("created_seq").fillna(-1)


def job_queue_next(spark, sf_dir):
    """The next job of every idle queue."""
    return jobs.next_jobs(jobs.job_states(_job_log(spark, sf_dir, daily=True)))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, tokenize_titles, tokenize_documents, brand_detect, model_code_extract, model_compatibility, spec_overlap_score, canonical_url, offer_identity_keys, candidate_url_dedupe, diversify_top3_per_source, candidate_score_topk, source_alias_filter, fetch_order_topk,
        relevance_grade, offer_dedupe_best, price_condition_filter, ranked_offers_topk, group_offers_summary, ai_left_join, snapshot_alerts, snapshot_first_run, history_flatten_csv, cheapest_group_per_record, history_last_n, page_predicates, price_extract_first_last,
        model_rank_score, query_variants, direct_catalog, html_list_extract, jsonld_extract, watch_foreachbatch, search_run_routes, page_readers, search_run_groups, saved_search_runs, watch_keyed_state, many_saved_searches, two_step_candidates, scraped_product_pages,
        job_retention, job_queue_next,
    )
}

_GROUPS = f"""
WITH e AS (SELECT *, 'https://x' AS x FROM ({RELEVANT.replace(BEST, OFFERS)})),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY round(relevance, 9) DESC, price, confidence DESC, seq) AS j FROM e) WHERE j = 1),
k AS (SELECT *, 'model:' || coalesce(brand, 'unknown-brand') || ':ic-' || code AS key, row_number() OVER (PARTITION BY brand, code ORDER BY round(relevance, 9) DESC, price, confidence DESC, seq) AS place FROM d),
c AS (SELECT key, currency, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(place)) AS i FROM k GROUP BY key, currency)
"""
_RUN = r"""
WITH b AS (SELECT page_id, page_id % 6 AS kind, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '["\\]', '', 'g') AS title FROM pages),
c AS (SELECT *, ['https://hotline.ua/ua/sr/?q=', 'https://shop.example/l/', 'https://plain.example/p/', 'https://plain.example/d/', 'https://hotline.ua/ua/p', 'https://late.example/l/'][kind + 1] || page_id AS url,
  CASE WHEN kind IN (0, 3) THEN 'ukrainian-market-search:src' || (page_id % 17) ELSE 'brave' END AS provider, (page_id % 20)::INT AS rank FROM b),
t AS (SELECT *, lower(title || chr(10) || chr(10) || url) AS everything, trim(regexp_replace(lower(title || '  ' || url), '[^\p{L}\p{N}]+', ' ', 'g')) AS txt FROM c),
s AS (SELECT *, 100 - rank + 8 * list_sum(list_transform(['price','buy','used','купити','ціна','наявності','б/в','olx','rozetka','prom','hotline','flagman','shimano','daiwa'], lambda w: contains(everything, w)::INT))
    + 12 * list_sum(list_transform(['the','reed','price'], lambda w: contains(everything, w)::INT)) + CASE WHEN kind IN (0, 3) THEN 24 ELSE 0 END AS score FROM t),
j AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY score DESC, page_id) AS n FROM s),
d AS (SELECT * FROM j WHERE provider = 'brave' OR n <= 3 ORDER BY score DESC, page_id LIMIT 220),
f AS (SELECT *, CASE WHEN kind IN (0, 3) THEN 100 ELSE 0 END + CASE WHEN kind = 0 THEN 0 ELSE 30 END + CASE WHEN contains(txt, 'the reed price') THEN 120 ELSE 0 END + CASE WHEN contains(txt, 'the') THEN 18 ELSE 0 END
    + CASE WHEN contains(txt, 'reed') THEN 35 ELSE 0 END + CASE WHEN contains(txt, 'price') THEN 35 ELSE 0 END AS fetch_score FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY fetch_score DESC, rank, page_id) AS place FROM f QUALIFY place <= 60)
"""
_READER = "CASE WHEN page_id % 12 = 5 THEN 'unread' ELSE ['cards', 'json-ld', 'page', 'skipped', 'page', 'json-ld'][kind + 1] END AS reader, CASE WHEN page_id % 12 = 5 THEN 0 ELSE [2, 1, 1, 0, 1, 1][kind + 1] END::BIGINT AS n_offers"
#: Alerts between neighbouring runs of o (run, before: the number of the search's run before, search_id, key, url, price).
_RUN_ALERTS = """, g AS (SELECT run, before, search_id, key, min(price) AS p FROM o GROUP BY ALL)
SELECT n.run, n.search_id, CASE WHEN w.p IS NULL THEN 'new_group' ELSE 'price_drop' END AS kind, n.key AS "groupKey", NULL::VARCHAR AS url, w.p AS "previousPrice", n.p AS "currentPrice"
FROM g n LEFT JOIN g w ON w.search_id = n.search_id AND w.key = n.key AND w.run = n.before WHERE w.p IS NULL OR n.p < w.p
UNION ALL SELECT n.run, n.search_id, 'new_offer', n.key, n.url, NULL, n.price FROM o n
WHERE EXISTS (SELECT 1 FROM g w WHERE w.search_id = n.search_id AND w.key = n.key AND w.run = n.before)
AND NOT EXISTS (SELECT 1 FROM o x WHERE x.search_id = n.search_id AND x.key = n.key AND x.url = n.url AND x.run = n.before)"""
_EVENT_OFFER = "'s' || (user_id % 4) AS search_id, event_type || (user_id % 7) AS key, 'u' || user_id AS url, min(value) AS price"
_JOBS = """
WITH l AS (SELECT user_id::VARCHAR AS queue, user_id || '-' || (epoch_us(ts) // 21600000000) AS job, event_type AS kind, epoch_us(ts) AS t, event_id AS seq FROM events WHERE event_type <> 'signup'),
j AS (SELECT queue, job, arg_min(kind, row(t, seq)) FILTER (kind IN ('purchase', 'error')) AS ended, min(t) FILTER (kind = 'click') AS started_at, min(t) FILTER (kind IN ('purchase', 'error')) AS finished_at,
  min(t) FILTER (kind = 'view') AS queued_at, min(row(t, seq)) FILTER (kind = 'view') AS queued, min(row(t, seq)) AS first FROM l GROUP BY 1, 2),
s AS (SELECT queue, job, CASE ended WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE CASE WHEN started_at IS NULL THEN 'queued' ELSE 'running' END END AS state,
  coalesce(queued, first)[1] AS created_at, coalesce(queued, first)[2] AS created_seq, started_at, finished_at, coalesce(finished_at, started_at, queued_at) AS updated_at FROM j)
"""

ORACLES = {
    "job_retention": _JOBS + """, n AS (SELECT *, state IN ('completed', 'failed') AS done FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY queue, done ORDER BY created_at DESC, created_seq DESC, job DESC) AS place, count(*) FILTER (NOT done) OVER (PARTITION BY queue) AS open FROM n)
SELECT queue, job, state, created_at, coalesce(started_at, -1) AS started_at, coalesce(finished_at, -1) AS finished_at, coalesce(updated_at, -1) AS updated_at FROM r WHERE NOT done OR place <= 50 - open""",
    "job_queue_next": _JOBS.replace("user_id::VARCHAR AS queue", "user_id || '-' || (epoch_us(ts) // 86400000000) AS queue") + """, i AS (SELECT *, count(*) FILTER (state = 'running') OVER (PARTITION BY queue) AS busy, row_number() OVER (PARTITION BY queue, state ORDER BY created_at, created_seq, job) AS place FROM s)
SELECT queue, job FROM i WHERE busy = 0 AND state = 'queued' AND place = 1""",
    "tokenize_titles": f"SELECT p_partkey, lower({TITLE}) AS tokens, len(string_split({TITLE}, ' '))::INT AS n_tokens FROM part",
    "tokenize_documents": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: length(x) > 1))::INT AS n_tokens, len(list_distinct(list_filter(w, lambda x: length(x) > 2)))::INT AS n_distinct FROM t""",
    "brand_detect": f"SELECT coalesce({BRAND}, 'none') AS brand, count(*) AS n FROM part GROUP BY 1",
    "model_code_extract": f"SELECT p_partkey, 'ic-' || {CODE} || ',' || {CODE} AS codes, 'ic-' || {CODE} AS family, 'ic-' || {CODE} || ',' || {CODE} AS code_tokens FROM part",
    "model_compatibility": f"SELECT CASE WHEN {CODE} = '61e' THEN 'exact' ELSE 'conflict' END AS verdict, count(*) AS n FROM part GROUP BY 1",
    "spec_overlap_score": """SELECT p_partkey, 2.1::DOUBLE AS length, p_size::DOUBLE AS lure_min, (p_size + 5)::DOUBLE AS lure_max, CASE WHEN p_partkey % 2 = 0 THEN 'ML' ELSE 'MH' END AS power, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS hand,
'2.1m | ' || p_size || '-' || (p_size + 5) || 'g | ' || CASE WHEN p_partkey % 2 = 0 THEN 'ML | left' ELSE 'MH | right' END AS formatted,
(8 + CASE WHEN 10 <= p_size + 5 AND p_size <= 20 THEN 10 ELSE -14 END + CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE -16 END)::INT AS points FROM part""",
    "canonical_url": r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages),
l AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '') AS ps FROM u),
f AS (SELECT *, array_to_string(list_sort(list_filter(ps, lambda x: NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('ref', 'fbclid', 'gclid'))), '&') AS cq, array_to_string(list_filter(ps, lambda x: NOT regexp_matches(x, '^(utm_|fbclid|gclid|yclid)')), '&') AS nq FROM l)
SELECT page_id, scheme || '://' || regexp_replace(host, '^www\.', '') || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN cq = '' THEN '' ELSE '?' || cq END AS canonical,
scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN nq = '' THEN '' ELSE '?' || nq END AS normalized, regexp_replace(host, '^www\.', '') AS site, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM f""",
    "offer_identity_keys": f"""SELECT 'signature:' || source || ':' || seller || ':' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || ':' || CASE WHEN price = floor(price) THEN price::BIGINT::VARCHAR ELSE price::VARCHAR END AS identity, count(*) AS n FROM ({OFFERS}) GROUP BY 1""",
    "candidate_url_dedupe": f"{CANDIDATES} SELECT first_seq AS seq, nurl AS url, title, rank, score::BIGINT AS score FROM k WHERE i = 1",
    "diversify_top3_per_source": f"{CANDIDATES}, d AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY score DESC, first_seq) AS j FROM k WHERE i = 1) SELECT provider AS \"sourceProvider\", count(*) AS n, sum(first_seq)::BIGINT AS seqs FROM d WHERE provider = 'brave' OR j <= 3 GROUP BY 1",
    "candidate_score_topk": f"{CANDIDATES}, d AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY score DESC, first_seq) AS j FROM k WHERE i = 1) SELECT first_seq AS seq, nurl AS url, score::BIGINT AS score FROM d WHERE provider = 'brave' OR j <= 3 ORDER BY score DESC, first_seq LIMIT 25",
    "source_alias_filter": f"{CANDIDATES}, n AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN 'https://www.ibis-gear.com/p/' || seq ELSE url END AS url, provider FROM b) SELECT seq, url FROM n WHERE contains(lower(provider), 'spam-farm') OR contains(lower(regexp_extract(url, '://([^/?#]+)', 1)), 'ibis-gear.com') OR contains(lower(regexp_extract(url, '://([^/?#]+)', 1)), 'spam-farm')",
    "fetch_order_topk": rf"""{CANDIDATES}, t AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(snippet, '') || ' ' || url), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS txt FROM b),
z AS (SELECT seq, rank, (CASE WHEN provider LIKE 'ukrainian-market-search:%' THEN 100 ELSE 0 END + 30 + CASE WHEN contains(txt, 'the reed price') THEN 120 ELSE 0 END + CASE WHEN contains(txt, 'the') THEN 18 ELSE 0 END + CASE WHEN contains(txt, 'reed') THEN 35 ELSE 0 END + CASE WHEN contains(txt, 'price') THEN 35 ELSE 0 END)::BIGINT AS fetch_score FROM t)
SELECT seq, fetch_score, rank FROM z ORDER BY fetch_score DESC, rank, seq LIMIT 30""",
    "relevance_grade": f"SELECT CASE WHEN relevance >= 0.82 THEN 'exact' WHEN relevance >= 0.58 THEN 'close' WHEN relevance >= 0.34 THEN 'broad' ELSE 'weak' END AS grade, CASE WHEN code = '61e' THEN 'exact' ELSE 'conflict' END AS model_match, count(*) AS n, round(sum(relevance), 4)::DOUBLE AS relevance FROM ({RELEVANT}) GROUP BY 1, 2",
    "offer_dedupe_best": f"SELECT first_seq AS seq, canonical, price, confidence FROM ({BEST})",
    "price_condition_filter": f"""SELECT seq, price, condition, round(greatest(0, least(1, ((split_part(p_name, ' ', 2) = 'ring')::INT / 2.0 * 35 + 17.5 + 12.5 + 18 + 4 + 2) / 100)), 6)::DOUBLE AS relevance
FROM ({OFFERS}) WHERE code = '61e' AND price BETWEEN 20000 AND 60000 AND condition = 'used' AND contains(source, 'shop1')""",
    "ranked_offers_topk": f"""SELECT first_seq AS seq, title, price, round(relevance, 6)::DOUBLE AS relevance, CASE WHEN relevance >= 0.82 THEN 'exact' WHEN relevance >= 0.58 THEN 'close' WHEN relevance >= 0.34 THEN 'broad' ELSE 'weak' END AS grade,
CASE WHEN brand = 'tict' THEN 'brand tict; ' ELSE '' END || 'model tokens: ic-61e, 61e; matched: ' || array_to_string(list_filter([CASE WHEN brand = 'tict' THEN 'tict' END, CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN 'small' END, CASE WHEN split_part(p_name, ' ', 2) = 'ring' THEN 'ring' END, 'ic-61e'], lambda x: x IS NOT NULL), ', ') AS reason
FROM ({RELEVANT}) WHERE code = '61e' ORDER BY round(relevance, 9) DESC, confidence DESC, first_seq LIMIT 20""",
    "group_offers_summary": f"""{_GROUPS} SELECT k.key, coalesce(upper(substr(min(brand), 1, 1)) || substr(min(brand), 2) || ' ', '') || upper('ic-' || min(code)) AS label, count(*) AS offer_count, min(price) AS min_price, max(price) AS max_price,
count(DISTINCT source)::INT AS n_sources, count(DISTINCT seller) AS n_sellers, (SELECT currency FROM c WHERE c.key = k.key AND c.i = 1) AS currency, min(code) || ',ic-' || min(code) AS codes FROM k GROUP BY k.key""",
    "flagship": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY round(relevance, 9) DESC, price, confidence DESC, first_seq) AS place FROM ({RELEVANT}) WHERE code = '61e')
SELECT 'model:' || coalesce(brand, 'unknown-brand') || ':ic-61e' AS key, coalesce(upper(substr(brand, 1, 1)) || substr(brand, 2) || ' ', '') || 'IC-61E' AS label, count(*) AS offer_count, min(price) AS min_price, max(price) AS max_price, count(DISTINCT seller) AS n_sellers, min_by(title, place) AS best_title FROM r GROUP BY brand""",
    "ai_left_join": """WITH v AS (SELECT 'u' || (doc_id % 200) AS url, max_by(CASE WHEN quality = 1 THEN 'good' ELSE 'unknown' END, doc_id) AS fit, max_by(toxic, doc_id) AS toxic FROM labels GROUP BY 1)
SELECT doc_id, coalesce(fit, 'none') AS fit, CASE WHEN toxic = 1 THEN 'w,toxic' ELSE 'w' END AS warnings FROM documents LEFT JOIN v ON v.url = 'u' || doc_id""",
    "snapshot_alerts": f"""{_DIFF}, n AS (SELECT CASE WHEN p = floor(p) THEN p::BIGINT::VARCHAR ELSE p::VARCHAR END AS t, key FROM now), w AS (SELECT CASE WHEN p = floor(p) THEN p::BIGINT::VARCHAR ELSE p::VARCHAR END AS t, key FROM was)
SELECT 'new_group' AS kind, key, '-' AS url, NULL::DOUBLE AS previous, p AS current, 'New group: ' || upper(key) AS message FROM now WHERE key NOT IN (SELECT key FROM was)
UNION ALL SELECT 'price_drop', now.key, '-', was.p, now.p, 'Price dropped for ' || upper(now.key) || ': ' || w.t || ' -> ' || n.t FROM now JOIN was USING (key) JOIN n USING (key) JOIN w USING (key) WHERE now.p < was.p
UNION ALL SELECT 'new_offer', o.key, o.url, NULL, o.price, 'New offer for ' || upper(o.key) || ': ' || o.title FROM o WHERE month = '1997-04' AND key IN (SELECT key FROM was) AND NOT EXISTS (SELECT 1 FROM o x WHERE x.month = '1997-03' AND x.key = o.key AND x.url = o.url)""",
    "snapshot_first_run": f"{_DIFF} SELECT 'new_group' AS kind, count(*) AS n, count(*) AS initial FROM was",
    "history_flatten_csv": f"""{_RECORDS} SELECT month AS timestamp, coalesce('k' || p, '-') AS group_key, lo AS min_price, coalesce(n, 0)::BIGINT AS offer_count, CASE WHEN p IS NULL THEN '-' ELSE 'a; b' END AS sources, 'new_group: m' AS alerts, 1::INT AS alert_count, CASE WHEN p IS NULL THEN '' ELSE '"label ""' || p || '"", x"' END AS label_cell FROM f""",
    "cheapest_group_per_record": f"{_RECORDS} SELECT month AS timestamp, min_by('k' || p, lo) AS key, min(lo) AS min_price FROM f GROUP BY month",
    "history_last_n": f"{_RECORDS} SELECT month AS timestamp, count(p)::INT AS n_groups FROM f GROUP BY month ORDER BY month DESC LIMIT 7",
    "page_predicates": """SELECT page_id, contains(lower(regexp_extract(url, '[?]([^#]*)', 1)), 'q=') OR contains(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'search') AS search, page_id % 13 = 0 AND page_id % 11 <> 0 AS missing, page_id % 11 = 0 AND page_id % 2 = 0 AS blocked FROM pages""",
    "price_extract_first_last": "SELECT o_orderkey, floor(o_totalprice) AS first_amount, 'UAH' AS first_currency, floor(o_totalprice) + 7 AS last_amount, 'USD' AS last_currency, floor(o_totalprice) AS page_amount, 'UAH' AS page_currency FROM orders",
    "model_rank_score": """WITH m AS (SELECT p_partkey AS k, ['qwen/a', 'acme/coder', 'acme/guard', 'acme/x'][p_partkey % 4 + 1] || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ':free' ELSE '' END AS id, p_size * 30000 AS c, p_size * 1000 AS o FROM part WHERE (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AND p_partkey % 7 <> 0),
r AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM m)
SELECT id, (1001 - i + CASE WHEN c >= 1000000 THEN 80 WHEN c >= 250000 THEN 40 ELSE 0 END + CASE WHEN o >= 32000 THEN 20 ELSE 0 END + CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 8 WHEN 2 THEN -250 ELSE 0 END)::BIGINT AS score,
'free text model; OpenRouter sorted rank #' || i || CASE WHEN c >= 1000000 THEN '; very large context' WHEN c >= 250000 THEN '; large context' ELSE '' END || CASE WHEN o >= 32000 THEN '; large completion budget' ELSE '' END || CASE k % 4 WHEN 0 THEN '; general reasoning family' WHEN 1 THEN '; coding-capable family' WHEN 2 THEN '; penalized safety/moderation model' ELSE '' END AS reason FROM r""",
    "two_step_candidates": """
WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_quantity <= 45),
a AS (SELECT *, 'order ' || l_orderkey AS query FROM l JOIN part ON p_partkey = l_partkey WHERE n <= 4 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)
SELECT query, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE 'Rozetka product ' || p_partkey END AS title,
  'https://product-api.rozetka.com.ua/v4/goods/get-main?goodsId=' || p_partkey || '&front-type=xl&country=UA&lang=ua' AS url,
  coalesce(nullif(concat_ws(' | ', CASE WHEN p_partkey % 3 <> 0 THEN floor(p_retailprice)::BIGINT || ' UAH' END, CASE WHEN p_partkey % 2 = 0 THEN 'available' WHEN p_partkey % 4 = 3 THEN 'active' END,
      CASE WHEN p_partkey % 13 <> 0 THEN 'https://rozetka.com.ua/p' || p_partkey END), ''),
    CASE WHEN l_orderkey % 2 = 0 THEN 'found for ' || query ELSE 'Rozetka search API result for ' || query END) AS snippet,
  n AS rank, (l_orderkey * 64 + 7) * 1048576 + n AS seq
FROM a""",
    "scraped_product_pages": """
SELECT p_name || CASE WHEN p_partkey % 5 <> 0 THEN ' ' ELSE ' og ' END || p_partkey AS title,
  'https://shimano.kiev.ua/' || CASE p_partkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'u' ELSE 'a' END || p_partkey AS url,
  CASE WHEN p_partkey % 4 <> 0 THEN ('1' || floor(p_retailprice)::BIGINT || '.5')::DOUBLE END AS price, CASE WHEN p_partkey % 4 <> 0 THEN 'UAH' END AS currency,
  CASE WHEN p_partkey % 2 = 0 THEN 'in_stock' ELSE 'listed' END AS availability, CASE WHEN p_partkey % 3 = 0 THEN 'https://shimano.kiev.ua/i/' || p_partkey || '.png' END AS image,
  CASE WHEN p_partkey % 4 <> 0 THEN 'shimano.kiev.ua product price: 1 ' || floor(p_retailprice)::BIGINT || ',50 ₴' ELSE 'shimano.kiev.ua product page' END || '; SKU ' || p_partkey
    || CASE WHEN p_partkey % 2 = 0 THEN '; Є в наявності' ELSE '; немає' END AS evidence,
  (CASE WHEN p_partkey % 4 <> 0 THEN 0.86 ELSE 0.72 END)::DOUBLE AS confidence
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""",
    "query_variants": f"""WITH q AS (SELECT p_partkey, {TITLE} AS t FROM part), v AS (SELECT p_partkey, unnest(generate_series(0, 11))::INT AS place, [t, t || ' купити Україна', t || ' ціна Україна', t || ' в наявності', t || ' б/в OLX', t || ' site:olx.ua OR site:prom.ua OR site:rozetka.com.ua', t || ' site:hotline.ua OR site:ek.ua',
t || ' site:flagman.ua OR site:ibis-gear.com OR site:fish-fish.com.ua', '"' || regexp_extract(t, 'IC-.*') || '" купити Україна', '"' || regexp_extract(t, 'IC-.*') || '" ціна', t || ' Japan used', t || ' JDM fishing tackle'] AS vs FROM q) SELECT p_partkey, place, vs[place + 1] AS variant FROM v""",
    "html_list_extract": f"""WITH p AS (SELECT *, {TITLE} AS title, row_number() OVER (PARTITION BY p_partkey // 15 ORDER BY p_partkey) AS i FROM part)
SELECT title, 'https://hotline.ua/ua/p' || p_partkey || '/?a=1' AS url, floor(p_retailprice) AS price, 'UAH' AS currency, 'https://hotline.ua/i.png' AS image, 0.78::DOUBLE AS confidence FROM p WHERE i <= 12""",
    "jsonld_extract": f"SELECT {TITLE} AS title, 'https://shop.example/p/' || p_partkey AS url, floor(p_retailprice) + 0.5 AS price, 'UAH' AS currency, 'in_stock' AS availability, 0.82::DOUBLE AS confidence FROM part",
    "search_run_routes": f'{_RUN} SELECT place, url, provider AS "sourceProvider", {_READER} FROM o',
    "page_readers": f'{_RUN} SELECT page_id AS place, url, provider AS "sourceProvider", {_READER} FROM c',
    "saved_search_runs": f"WITH o AS (SELECT event_id % 3 AS run, event_id % 3 - 1 AS before, {_EVENT_OFFER} FROM events GROUP BY ALL) {_RUN_ALERTS}",
    "watch_keyed_state": f"""WITH e AS (SELECT *, epoch(date_trunc('day', ts))::BIGINT AS run FROM events WHERE value IS NOT NULL), a AS (SELECT run, {_EVENT_OFFER} FROM e WHERE run + 86400 <= (SELECT epoch(max(ts)) FROM events) GROUP BY ALL),
r AS (SELECT search_id, run, lag(run) OVER (PARTITION BY search_id ORDER BY run) AS before FROM (SELECT DISTINCT search_id, run FROM a)), o AS (SELECT a.*, before FROM a JOIN r USING (search_id, run)) {_RUN_ALERTS}""",
    "many_saved_searches": f"""WITH s AS (SELECT s_suppkey AS search_id, ['shimano', 'daiwa', 'tict'][s_suppkey % 3 + 1] AS asked, (50 + s_suppkey * 7 % 50)::VARCHAR || lower(substr('SMLEP', (s_suppkey % 5 + 1)::INT, 1)) AS wanted FROM supplier),
m AS (SELECT search_id, seq, confidence, wanted, asked, brand = asked AS same, greatest(0, least(1, (CASE WHEN brand = asked THEN 30 + 35 WHEN brand IS NULL THEN 17.5 ELSE 17.5 - 18 END + 25 + 24 + 4 + CASE WHEN condition = 'used' THEN 2 ELSE 0 END) / 100.0)) AS r FROM s JOIN ({OFFERS}) ON code = wanted),
p AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY round(r, 9) DESC, confidence DESC, seq) AS place FROM m)
SELECT search_id, place, seq, round(r, 6)::DOUBLE AS relevance, CASE WHEN r >= 0.82 THEN 'exact' WHEN r >= 0.58 THEN 'close' WHEN r >= 0.34 THEN 'broad' ELSE 'weak' END AS "matchGrade",
CASE WHEN same THEN 'brand ' || asked || '; ' ELSE '' END || 'model tokens: ic-' || wanted || ', ' || wanted || '; matched: ' || CASE WHEN same THEN asked || ', ' ELSE '' END || 'ic-' || wanted AS "matchReason" FROM p WHERE place <= 20""",
    "watch_foreachbatch": "SELECT 'new_group' AS kind, event_type AS key, min(value) AS price FROM events GROUP BY event_type",
}
