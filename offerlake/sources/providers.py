"""Search providers' answers as candidates, and the catalogue of direct search pages.

Answers arrive as a table (provider, query, body): fetching is the caller's, who holds keys and budgets. Each parser turns the bodies of its
provider into candidates (provider's query, title, url, snippet, sourceProvider, rank).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.htmltree import parse
from ..functions.text import collapsed, null_if_empty, number_text
from ..functions.urls import host, path, query_string
from ..plans.query_plan import is_jdm

#: Fixed values: (id, label, group, priority, search page up to the query, what follows the query).
CATALOG = (
    ("olx", "OLX Ukraine", "core_marketplace", 1, "https://www.olx.ua/uk/list/q-", "/"),
    ("rozetka", "Rozetka", "core_marketplace", 2, "https://rozetka.com.ua/ua/search/?text=", ""),
    ("prom", "Prom.ua", "core_marketplace", 3, "https://prom.ua/ua/search?search_term=", ""),
    ("epicentr", "Epicentr", "core_marketplace", 4, "https://epicentrk.ua/ua/search/?q=", ""),
    ("bigl", "Bigl.ua", "core_marketplace", 5, "https://bigl.ua/ua/search?search_term=", ""),
    ("allo", "Allo", "core_marketplace", 6, "https://allo.ua/ua/catalogsearch/result/?q=", ""),
    ("hotline", "Hotline", "price_aggregator", 7, "https://hotline.ua/ua/sr/?q=", ""),
    ("ek", "E-Katalog", "price_aggregator", 8, "https://ek.ua/ua/ek-list.php?search_=", "&search_but_="),
    ("price", "Price.ua", "price_aggregator", 9, "https://price.ua/search/?q=", ""),
    ("flagman", "Flagman", "fishing_store_ua", 10, "https://flagman.ua/search/", ""),
    ("ibis", "IBIS Gear", "fishing_store_ua", 11, "https://ibis-gear.com/search/?searchstring=", ""),
    ("fish-fish", "Fish-Fish", "fishing_store_ua", 12, "https://fish-fish.com.ua/ua-search?search=", ""),
    ("shimano-kiev", "Shimano Kiev", "fishing_store_ua", 13, "https://shimano.kiev.ua/search?q=", ""),
    ("daiwa-ua", "Daiwa Ukraine", "fishing_store_ua", 14, "https://daiwa.in.ua/ua/index.php?route=product/search&search=", ""),
    ("zabros", "Zabros", "fishing_store_ua", 15, "https://zabros.com.ua/ua/search/?q=", ""),
    ("fanatik", "Fanatik", "fishing_store_ua", 16, "https://fanatik.com.ua/index.php?route=product/search&search=", ""),
    ("aquatory", "Aquatory", "fishing_store_ua", 17, "https://aquatory.com.ua/ua/all-products?keyword=", ""),
    ("onlyfishing", "Only Fishing", "fishing_store_ua", 18, "https://onlyfishing.com.ua/search/?search=", ""),
    ("jdm-com-ua", "JDM Ukraine", "fishing_store_ua", 19, "https://jdm.com.ua/index.php?route=product/search&search=", ""),
    ("zenmarket", "ZenMarket", "jdm_international", 101, "https://zenmarket.jp/en/search.aspx?q=", ""),
    ("digitaka", "Digitaka", "jdm_international", 102, "https://www.digitaka.com/list.php?keywords=", ""),
    ("japantackle", "JapanTackle", "jdm_international", 103, "https://japantackle.com/catalogsearch/result/?q=", ""),
    ("jdmtackleheaven", "JDM Tackle Heaven", "jdm_international", 104, "https://jdmtackleheaven.com/search?q=", ""),
    ("ebay", "eBay", "jdm_international", 105, "https://www.ebay.com/sch/i.html?_nkw=", ""),
)
#: Detail pages that are added for one reel.
SCORPION_PAGES = (
    ("JapanTackle product: Shimano 21 Scorpion DC150/151", "https://japantackle.com/casting-reels/shimano/low-profile-casting-reels/shimano-21scorpiondc.html", "Site-specific JDM product page for Shimano Scorpion DC 150/151 variants.", "japantackle-detail"),
    ("JDM Tackle Heaven collection: Shimano Scorpion DC", "https://jdmtackleheaven.com/collections/shimano-scorpion-dc", "Site-specific Shopify collection for Shimano Scorpion DC variants.", "jdmtackleheaven-collection"),
)
DIRECT = "ukrainian-market-search"
#: What a shop's own search isn't asked: operators, words of commerce, shops' names, the market's words, words of Japanese.
NOT_ASKED = (
    r"(?i)\bOR\b", r"(?i)\bsite:\S+", r"(?i)\b(japan|japanese|jdm|used|for sale|price|buy)\b", r"(?i)\b(olx|rozetka|prom|hotline)\b",
    r"(?iu)(^|\s)(купити|ціна|україна|наявності)(?=\s|$)", r"(?iu)(^|\s)б/в(?=\s|$)", "中古|釣竿|ロッド|ヤフオク|メルカリ|楽天",
)


def direct_query(c: Column) -> Column:
    """A query without operators, shop names and commerce words."""
    out = c
    for pattern in NOT_ASKED:
        out = F.regexp_replace(out, pattern, " ")
    return collapsed(F.regexp_replace(out, "[\"']", ""))


def encoded(c: Column) -> Column:
    """Percent-encoded as a URI component: spaces as %20, and !'()*~ as they are."""
    out = F.url_encode(c)
    for found, put in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def olx_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(direct_query(c)), "(?iu)[^a-zа-яіїєґё0-9]+", "-"), "^-+|-+$", "")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "id string, label string, kind string, priority int, head string, tail string")


def direct_candidates(queries: DataFrame, limit: int = 20) -> DataFrame:
    """Candidates of the direct search pages for each row of queries (query): those abroad only for queries of Japanese goods."""
    spark = queries.sparkSession
    clean = queries.select("query", direct_query(F.col("query")).alias("q"))
    # The catalogue has 24 rows.
    crossed = clean.join(F.broadcast(catalog(spark)), F.lit(True)).where((F.col("kind") != "jdm_international") | is_jdm(F.col("q")))
    ranked = crossed.withColumn("rank", F.when(F.col("priority") > 100, F.col("priority") - 81).otherwise(F.col("priority")))
    ranked = ranked.where(is_jdm(F.col("q")) | (F.col("rank") <= max(limit, 20)))
    tail = F.when(F.col("id") == "olx", olx_slug(F.col("q"))).otherwise(encoded(F.col("q")))
    base = ranked.select("query", F.concat(F.col("label"), F.lit(" search: "), F.col("q")).alias("title"), F.concat("head", tail, "tail").alias("url"), F.concat(F.lit("Direct "), F.col("kind"), F.lit(" search page generated from the user query.")).alias("snippet"), F.concat(F.lit(f"{DIRECT}:"), F.col("id")).alias("sourceProvider"), "rank")
    extra = spark.createDataFrame([(i + 1, *row[:3], f"{DIRECT}:{row[3]}") for i, row in enumerate(SCORPION_PAGES)], "n int, title string, url string, snippet string, sourceProvider string")
    last = F.when(is_jdm(F.col("q")), 24).otherwise(19)
    named = clean.where(F.col("q").rlike(r"(?i)\bscorpion\b") & F.col("q").rlike(r"(?i)\bdc\b")).select("query", last.alias("last"))
    return base.unionByName(named.join(F.broadcast(extra), F.lit(True)).select("query", "title", "url", "snippet", "sourceProvider", (F.col("last") + F.col("n")).alias("rank")))


def _items(answers: DataFrame, provider: str, schema: str, items: str, of: Column | None = None) -> DataFrame:
    """(query, _i, x): each item of the provider's answers; of: what x is, if not the item itself."""
    mine = answers.where(F.col("provider") == provider).withColumn("_r", F.from_json("body", schema))
    rows = mine.select("query", "_r", F.posexplode(f"_r.{items}").alias("_i", "x"))
    return rows.select("query", "_i", (F.col("x") if of is None else of).alias("x"))


def _candidates(rows: DataFrame, title: Column, url: Column, snippet: Column, provider: Column, rank: Column, place: Column | None = None) -> DataFrame:
    """place: the order within one answer, where it isn't the rank."""
    place = (rank if place is None else place).cast("int").alias("place")
    return rows.select("query", title.alias("title"), url.alias("url"), null_if_empty(snippet).alias("snippet"), provider.alias("sourceProvider"), rank.cast("int").alias("rank"), place)


def _first(rows: DataFrame, keep: Column, limit: int) -> DataFrame:
    """Of each query's items those to keep, at most limit, with _n numbered from 1 in order."""
    good = rows.where(keep).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("_i", "x"))), 1, limit).alias("k"))
    return good.select("query", F.posexplode("k").alias("_n", "y")).select("query", (F.col("_n") + 1).alias("_n"), "y.x")


def exa(answers: DataFrame) -> DataFrame:
    rows = _first(_items(answers, "exa", "results array<struct<title:string,url:string,summary:string,highlights:array<string>>>", "results"), F.col("x.url") != "", 1 << 30)
    return _candidates(rows, F.coalesce("x.title", "x.url"), F.col("x.url"), F.coalesce("x.summary", F.array_join("x.highlights", " ")), F.lit("exa"), F.col("_n"))


def brave(answers: DataFrame) -> DataFrame:
    rows = _first(_items(answers, "brave", "web struct<results:array<struct<title:string,url:string,description:string>>>", "web.results"), (F.col("x.url") != "") & (F.col("x.title") != ""), 1 << 30)
    return _candidates(rows, F.col("x.title"), F.col("x.url"), F.col("x.description"), F.lit("brave"), F.col("_n"))


def tavily(answers: DataFrame) -> DataFrame:
    rows = _first(_items(answers, "tavily", "results array<struct<title:string,url:string,content:string>>", "results"), F.col("x.url") != "", 1 << 30)
    return _candidates(rows, F.coalesce("x.title", "x.url"), F.col("x.url"), F.col("x.content"), F.lit("tavily"), F.col("_n"))


def serpapi(answers: DataFrame, limit: int = 20) -> DataFrame:
    """Shopping results before organic ones, at most limit of both for a query."""
    item = "array<struct<title:string,link:string,snippet:string,source:string,price:string,position:int>>"
    mine = answers.where(F.col("provider") == "serpapi").withColumn("_r", F.from_json("body", f"organic_results {item}, shopping_results {item}"))
    tagged = lambda field, shop: F.transform(F.coalesce(f"_r.{field}", F.array().cast(item)), lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.lit(shop).alias("shop")))
    both = F.slice(F.filter(F.concat(tagged("shopping_results", True), tagged("organic_results", False)), lambda y: F.coalesce(y["x"]["link"], F.lit("")) != ""), 1, limit)
    rows = mine.select("query", F.posexplode(both).alias("_n", "y")).select("query", "_n", "y.*")
    shop = F.concat_ws(" - ", null_if_empty(F.col("x.source")), null_if_empty(F.col("x.price")))
    return _candidates(rows, F.coalesce("x.title", "x.link"), F.col("x.link"), F.when(F.col("shop"), shop).otherwise(F.col("x.snippet")), F.when(F.col("shop"), "serpapi:shopping").otherwise("serpapi"), F.coalesce("x.position", F.col("i") + 1), F.col("_n") + 1)


def _at_host(url: Column, new_host: str, keep_query: bool = True) -> Column:
    query = F.when(query_string(url) == "", "").otherwise(F.concat(F.lit("?"), query_string(url))) if keep_query else F.lit("")
    return F.coalesce(F.concat(F.lit(f"https://{new_host}"), path(url), query), url)


_SHOP_ITEM = "array<struct<name:string,url:string,brand:string,brand_name:string,sku:string,price:double,currency:string,is_presence:boolean,available:boolean>>"


def flagman(answers: DataFrame, limit: int = 20) -> DataFrame:
    rows = _first(_items(answers, "flagman-api", f"results struct<items:{_SHOP_ITEM}>", "results.items"), (F.col("x.url") != "") & (F.col("x.name") != ""), min(limit, 20))
    price = F.when(F.col("x.price") != 0, F.concat(number_text(F.col("x.price")), F.lit(" "), F.coalesce("x.currency", F.lit("UAH"))))
    return _candidates(rows, F.col("x.name"), _at_host(F.col("x.url"), "flagman.ua"), F.concat_ws(" | ", null_if_empty(F.col("x.brand")), price, F.when(F.col("x.is_presence"), "in stock")), F.lit("flagman-api"), F.col("_n"))


def ibis(answers: DataFrame, limit: int = 20) -> DataFrame:
    """Prices come in hundredths."""
    rows = _first(_items(answers, "ibis-api", f"results struct<items:{_SHOP_ITEM}>", "results.items"), (F.col("x.url") != "") & (F.col("x.name") != ""), min(limit, 20))
    code = F.when(F.coalesce("x.currency", F.lit("")).rlike("(?iu)^(грн)?$"), "UAH").otherwise(F.col("x.currency"))
    price = F.when(F.col("x.price") != 0, F.concat(F.floor(F.col("x.price") / 100 + 0.5).cast("string"), F.lit(" "), code))
    return _candidates(rows, F.col("x.name"), _at_host(F.col("x.url"), "ibis-gear.com"), F.concat_ws(" | ", null_if_empty(F.col("x.brand")), price, F.when(F.col("x.is_presence"), "in stock")), F.lit("ibis-api"), F.col("_n"))


def shimano_kiev(answers: DataFrame, limit: int = 20) -> DataFrame:
    rows = _first(_items(answers, "shimano-kiev-api", f"data struct<items:{_SHOP_ITEM}>", "data.items"), (F.col("x.url") != "") & (F.col("x.name") != ""), min(limit, 20))
    parts = (null_if_empty(F.col("x.brand_name")), F.concat(F.lit("SKU "), null_if_empty(F.col("x.sku"))), F.when(F.col("x.price") != 0, F.concat(number_text(F.col("x.price")), F.lit(" UAH"))), F.when(F.col("x.available"), "in stock"))
    return _candidates(rows, F.col("x.name"), _at_host(F.col("x.url"), "shimano.kiev.ua", False), F.concat_ws(" | ", *parts), F.lit("shimano-kiev-api"), F.col("_n"))


def rozetka_ids(answers: DataFrame, limit: int = 12) -> DataFrame:
    """(query, goods_id, rank, said): the goods to ask the product API about, and what the answer calls itself."""
    meta = "data struct<goods:array<struct<id:bigint>>,meta:struct<title:string>>"
    rows = _first(_items(answers, "rozetka-search", meta, "data.goods", F.struct(F.col("x.id").alias("id"), F.col("_r.data.meta.title").alias("said"))), F.col("x.id").isNotNull(), min(limit, 12))
    return rows.select("query", F.col("x.id").alias("goods_id"), F.col("_n").alias("rank"), F.col("x.said").alias("said"))


def rozetka(ids: DataFrame, goods: DataFrame) -> DataFrame:
    """Candidates from the product API's answers, goods (goods_id, body); ids without a good answer are left out, ranks stay.

    An id that many queries ask for is answered once; of several answers for one id the first in order of their text counts.
    """
    data = F.from_json("body", "data struct<id:bigint,title:string,price:double,href:string,sell_status:string,status:string>")["data"]
    once = goods.where("goods_id is not null").groupBy("goods_id").agg(F.min("body").alias("body"))
    rows = ids.join(once.select("goods_id", data.alias("x")), "goods_id").where("x.id is not null")
    text = F.col("x.id").cast("string")
    url = F.concat(F.lit("https://product-api.rozetka.com.ua/v4/goods/get-main?goodsId="), text, F.lit("&front-type=xl&country=UA&lang=ua"))
    price = F.when(F.col("x.price") != 0, F.concat(number_text(F.col("x.price")), F.lit(" UAH")))
    parts = F.concat_ws(" | ", price, null_if_empty(F.coalesce("x.sell_status", "x.status")), null_if_empty(F.col("x.href")))
    snippet = F.coalesce(null_if_empty(parts), F.col("said"), F.concat(F.lit("Rozetka search API result for "), F.col("query")))
    return _candidates(rows, F.coalesce("x.title", F.concat(F.lit("Rozetka product "), text)), url, snippet, F.lit("rozetka-api"), F.col("rank"))


def unwrap_bing(url: Column) -> Column:
    """The target inside a Bing redirect, else the url."""
    packed = F.regexp_replace(F.regexp_extract(url, r"[?&]u=([^&#]*)", 1), "^a1", "")
    plain = F.translate(packed, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), "=")
    target = F.when(plain.rlike("^[A-Za-z0-9+/]+=*$"), F.decode(F.unbase64(padded), "UTF-8"))
    return F.when(target.startswith("http"), target).otherwise(url)


def unwrap_duckduckgo(url: Column) -> Column:
    packed = F.regexp_extract(url, r"[?&]uddg=([^&#]*)", 1)
    return F.when(packed != "", F.try_url_decode(packed)).otherwise(url)


#: Provider -> (result, link, title inside the link, snippet, base of links).
_RESULT_PAGES = {
    "bing-html": ("li.b_algo", "h2 a", "", ".b_caption p", "https://www.bing.com/"),
    "duckduckgo-html": (".result", ".result__title a", "", ".result__snippet", "https://html.duckduckgo.com/html/"),
    "ek-quick-search": ("a.qs-link[href]", "", ".qs-str", ".qs-model-price", "https://ek.ua/"),
}


def _read_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for answer in batch.to_pylist():
            result, link, title, snippet, base = _RESULT_PAGES[answer["provider"]]
            for i, node in enumerate(parse(answer["body"]).find(result)):
                anchor = ([node] if not link else node.find(link))[:1]
                text = (anchor[0].find(title) if title else anchor) if anchor else []
                said = node.find(snippet)
                rows.append((answer["provider"], answer["query"], i, text[0].text() if text else "", urljoin(base, anchor[0].attributes.get("href", "")) if anchor else "", said[0].text() if said else ""))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(6)], names=["provider", "query", "_i", "title", "url", "snippet"])


def result_pages(answers: DataFrame, limit: int = 20) -> DataFrame:
    """Candidates of HTML result pages (Bing, DuckDuckGo, E-Katalog's quick search)."""
    raw = answers.where(F.col("provider").isin(*_RESULT_PAGES)).select("provider", "query", "body").mapInArrow(_read_results, "provider string, query string, _i int, title string, url string, snippet string")
    url = F.when(F.col("provider") == "bing-html", unwrap_bing(F.col("url"))).when(F.col("provider") == "duckduckgo-html", unwrap_duckduckgo(F.col("url"))).otherwise(F.col("url"))
    quick = F.col("provider") == "ek-quick-search"
    good = raw.withColumn("url", url).where((F.col("title") != "") & F.col("url").rlike("^https?://") & (~quick | ((host(F.col("url")) == "ek.ua") & path(F.col("url")).rlike(r"(?i)/ua/[A-Z0-9-]+\.htm$"))))
    most = F.when(quick, min(limit, 10)).otherwise(limit)
    kept = good.groupBy("provider", "query").agg(F.array_sort(F.collect_list(F.struct("_i", "title", "url", "snippet"))).alias("k")).select("provider", "query", F.inline(F.slice("k", F.lit(1), most)))
    said = F.when(F.col("provider") == "ek-quick-search", F.concat_ws(" | ", F.lit("E-Katalog quick search"), null_if_empty(F.col("snippet")))).otherwise(F.col("snippet"))
    return kept.select("query", "title", "url", said.alias("snippet"), F.col("provider").alias("sourceProvider"), (F.col("_i") + 1).alias("rank"), (F.col("_i") + 1).alias("place"))


#: Parsers by provider; each takes the table of answers.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"exa": exa, "brave": brave, "tavily": tavily, "serpapi": serpapi, "flagman-api": flagman, "ibis-api": ibis, "shimano-kiev-api": shimano_kiev, "html": result_pages}


#: Providers in the order in which a search asks them; two HTML engines stand in where none of the first four has a key.
KEYED, UNKEYED = ("exa", "brave", "tavily", "serpapi"), ("duckduckgo-html", "bing-html")
ALWAYS = ("rozetka-api", "ek-quick-search", "flagman-api", "ibis-api", "shimano-kiev-api", DIRECT)
#: seq of a candidate: its variant, then its provider (below PROVIDER_SPAN), then its place in the answer (below PLACE_SPAN).
PROVIDER_SPAN, PLACE_SPAN = 1 << 6, 1 << 20


def configured_providers(keys: dict[str, str | None]) -> list[str]:
    """The providers of a search: those whose key is given, or two HTML engines if none is; the direct ones always."""
    return [*([p for p in KEYED if keys.get(p)] or UNKEYED), *ALWAYS]


def candidate_seq(variant_place: Column, provider: Column, place: Column) -> Column:
    """The order of candidates in which a search asks: by variant, provider, place in the answer. It doesn't depend on partitions."""
    names = F.array(*[F.lit(p) for p in (*KEYED, *UNKEYED, *ALWAYS)])
    # What follows a colon tells where within the provider a candidate is from.
    number = F.array_position(names, F.substring_index(provider, ":", 1))
    return (variant_place.cast("long") * PROVIDER_SPAN + number) * PLACE_SPAN + place


def all_candidates(answers: DataFrame, goods: DataFrame | None = None, variants: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Candidates of all providers, with seq: query, title, url, snippet, sourceProvider, rank, seq.

    answers: provider, query, body. goods: goods_id, body, what the second step of the two-step provider answered; without it that provider
    has no candidates. variants: query, variant_place, each query once; with them the direct search pages of each variant are candidates as
    well, and seq is unique within a search. Without them each query is a search of its own, and candidates are those of answers.
    """
    tables = [parser(answers) for parser in PARSERS.values()]
    if goods is not None:
        tables.append(rozetka(rozetka_ids(answers, limit), goods))
    if variants is not None:
        tables.append(direct_candidates(variants, limit).withColumn("place", F.col("rank")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    variant = F.lit(0)
    if variants is not None:
        out, variant = out.join(variants.select("query", "variant_place"), "query"), F.col("variant_place")
    return out.select("query", "title", "url", "snippet", "sourceProvider", "rank", candidate_seq(variant, F.col("sourceProvider"), F.col("place")).alias("seq"))
