"""Offers from fetched pages.

Python only reads HTML: it gives raw cards (title, link, texts, image) by each shop's selectors, or the nodes of embedded JSON-LD.
Prices, availability, condition, currency and confidence are Column expressions over those.

A page has url, finalUrl, title, html, text and status.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.htmltree import Node, parse
from ..functions.pages import clean_title, first_line, is_missing_page, is_search_page, last_list_price, list_price, page_price, schema_availability, sell_state, sell_status, text_availability, text_condition
from ..functions.text import null_if_empty
from ..functions.urls import canonical_url, host

PER_PAGE = 12
OFFER = "title string, url string, price double, currency string, availability string, condition string, seller string, imageUrl string, sourceSite string, evidence array<string>, confidence double"


@dataclass(frozen=True)
class Shop:
    """How a shop's result page is read. The first shop whose host a page's host holds is used."""

    host: str
    card: str
    link: str
    label: str
    confidence: tuple[float, float]  # with and without a price
    price: str | None = None  # selector of the price text; else the card's text
    mode: str = "first"  # which price of the text; number: the digits alone
    min_title: int = 1
    href: str | None = None  # pattern of links that count
    skip: str | None = None  # pattern of links that don't
    last_link: bool = False
    stock: str | None = None  # pattern of the card's text for in stock
    gone: str | None = None  # pattern for out of stock
    condition: str | None = None
    currency: str | None = None  # where the price has none
    json_first: bool = False
    canonical: bool = False


#: The shops and their markup.
SHOPS = (
    Shop("olx.ua", '[data-cy="l-card"], [data-testid="l-card"]', 'a[href*="/d/"]', "olx rendered card", (0.78, 0.68), '[data-testid="ad-price"]', min_title=9, currency="UAH"),
    Shop("hotline.ua", ".list-item", "a.item-title[href], a[href*='/ua/']", "hotline list item", (0.78, 0.68), min_title=9, skip=r"tab=reviews|/sr/"),
    Shop("rozetka.com.ua", "rz-catalog-tile, .goods-tile, li.catalog-grid__cell, [data-goods-id]", "a.goods-tile__heading[href], a.tile-title[href], a[href*='/p']", "rozetka product card", (0.78, 0.66),
         ".goods-tile__price-value, .price_color_red, [class*='price']", min_title=7, stock="готовий до відправки|є в наявності|купити|до кошика", condition="new", currency="UAH", json_first=True),
    Shop("zabros.com.ua", ".catalog-item", "a.catalog-item-link[href], a[href*='/ua/']", "zabros catalog item", (0.76, 0.66), min_title=9, skip="#comments", stock="є в наявності"),
    Shop("fish-fish.com.ua", ".product-brief[data-product-brief]", "a.product-brief__name[href]", "fish-fish product brief", (0.77, 0.67), "[data-product-brief-price], .product-brief__price", stock="купити|в кошик|вибрати"),
    Shop("aquatory.com.ua", ".preview.fn_product", "a.product_name[href]", "aquatory product card", (0.79, 0.68), ".price .fn_price", "number", stock="купити|в наявності", condition="new", currency="UAH"),
    Shop("fanatik.com.ua", ".product-thumb.uni-item", "a.product-thumb__name[href]", "fanatik product card", (0.78, 0.67), ".product-thumb__price", "special", stock="у кошик|в корзину|купити", condition="new", currency="UAH"),
    Shop("jdm.com.ua", ".product-layout .product-thumb", ".caption h4 a[href]", "jdm.com.ua product card", (0.78, 0.67), ".price .price_no_format, .price-new .price_no_format, .price", stock="купить|в корзину|до кошика", condition="new", currency="UAH"),
    Shop("zenmarket.jp", "a[href*='auction.aspx'], a[href*='itemCode='], a[href*='itemId='], a[href*='itemid=']", "", "zenmarket result card", (0.78, 0.68), "[class*='price'], [data-testid*='price'], .money", "last",
         min_title=6, skip="login|signup|help|blog|quickguide|shipping", gone="sold|ended|out of stock|законч|продано", json_first=True, canonical=True),
    Shop("jdmtackleheaven.com", "a[href*='/products/']", "", "shopify product card", (0.8, 0.7), ".price, .money, [class*='price']", "last", min_title=8, gone="sold out|out of stock", condition="new", canonical=True),
    Shop("japantackle.com", ".category-products .item, .products-grid .item, .products-list .item", ".product-name a[href], h2 a[href], a.product-image[href]", "japantackle product grid", (0.78, 0.68),
         ".special-price .price, .regular-price .price, .price-box .price", "last", min_title=9, gone="out of stock", condition="new"),
    Shop("daiwa.in.ua", ".product-layout", "a[href]", "daiwa product grid", (0.76, 0.66), None, "last", min_title=7, href=r"^https?://", last_link=True, stock="в корзину|купити"),
)
_AROUND = "li, article, tr, .card-wrapper, .product-card-wrapper, .card, .grid__item, [class*='item'], [class*='product'], [class*='card'], [data-testid]"
_CARD = "page_url string, finalUrl string, shop int, i int, title string, href string, url string, card string, price_text string, special string, image string, variant string, stock_text string"


def shop_of(final_url: Column) -> Column:
    """The number of the shop that reads a page, by host; null for pages of other hosts."""
    out = F.lit(None).cast("int")
    for i, shop in reversed(list(enumerate(SHOPS))):
        out = F.when(host(final_url).contains(shop.host), i).otherwise(out)
    return F.when(host(final_url).contains("product-api.rozetka.com.ua"), None).otherwise(out)


def _image(card: Node) -> str | None:
    for x in card.find("img[src], img[data-src], img[srcset]"):
        return x.attributes.get("src") or x.attributes.get("data-src") or (x.attributes.get("srcset", "").split(",")[0].split() or [None])[0]
    return None


def _cards(shop: Shop, tree: Node, base: str) -> Iterator[dict]:
    seen = 0
    for card in tree.find(shop.card):
        if seen >= PER_PAGE:
            return
        links = [card] if not shop.link else card.find(shop.link)
        if not shop.link:
            card = (card.parent.closest(_AROUND) if card.parent else None) or card.parent or card
        good = []
        for link in links:
            href, title = link.attributes.get("href", ""), link.text() or link.attributes.get("title", "")
            if href and len(title) >= shop.min_title and not (shop.skip and re.search(shop.skip, href, re.I)) and not (shop.href and not re.match(shop.href, href)):
                good.append((title, href))
        if not good:
            continue
        title, href = good[-1 if shop.last_link else 0]
        priced = card.find(shop.price) if shop.price else []
        first = priced[-1 if shop.host == "japantackle.com" else 0] if priced else None
        special = first.attributes.get("data-special", "") if first else ""
        special = (special if special not in ("", "0") else first.attributes.get("data-price", "")) if first else ""
        image = _image(card)
        seen += 1
        yield {"i": seen, "title": title, "href": href, "url": urljoin(base, href), "card": card.text(), "price_text": first.text() if first else "", "special": special, "image": urljoin(base, image.strip()) if image else None}
    if shop.host == "japantackle.com":
        for n, row in enumerate(tree.find("#super-product-table tr")[1 : PER_PAGE + 1]):
            cells = [x.text() for x in row.find("td")]
            if cells and cells[0]:
                cells += [""] * 10
                yield {"i": n - PER_PAGE, "title": cells[0], "href": base, "url": base, "card": cells[9], "price_text": cells[8], "special": "", "image": None, "variant": re.sub(r"[^a-z0-9]+", "-", cells[0].lower()).strip("-"), "stock_text": cells[9]}


def _read_cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CARD.split(", ")]
    for batch in batches:
        rows = []
        for page in batch.to_pylist():
            for card in _cards(SHOPS[page["shop"]], parse(page["html"]), page["finalUrl"]):
                rows.append({"page_url": page["url"], "finalUrl": page["finalUrl"], "shop": page["shop"], **card})
        kinds = {"shop": pa.int32(), "i": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def reel_title(c: Column) -> Column:
    """Reel titles with their model's parts apart."""
    spaced = F.regexp_replace(c, r"(?i)\b(DC|XT|MGL|BFS|K|A)\s*(\d)", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"(?i)\b(\d{2,4})(HG|XG|PG|MG|MGL|BFS|DC)\b", "$1 $2"), r"\s+", " "))


def _digits(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(c, r"[^\d.,]", ""), "^([^,]*),", "$1."), r"^\d+\.?\d*", 0).try_cast("double")


def _pick(of, default=None) -> Column:
    """A per-shop value by the shop number."""
    out = F.lit(default)
    for i, shop in enumerate(SHOPS):
        if (v := of(shop)) is not None:
            out = F.when(F.col("shop") == i, v).otherwise(out)
    return out


def card_offers(pages: DataFrame) -> DataFrame:
    """Offers of the result pages of known shops: the first PER_PAGE cards of each page, the first of each url."""
    mine = pages.withColumn("shop", shop_of(F.col("finalUrl"))).where("shop is not null").select("url", "finalUrl", "html", "shop")
    cards = mine.mapInArrow(_read_cards, _CARD)
    # Each shop says which text its price stands in and how it is read; then one expression reads it.
    mode, own_text = _pick(lambda s: F.lit(s.mode), "first"), _pick(lambda s: F.lit(True) if s.host == "jdm.com.ua" else None, False)
    cards = cards.withColumn("_mode", mode).withColumn("_priced", F.when((F.col("_mode") == "special") | own_text, F.col("price_text")).otherwise(F.coalesce(null_if_empty(F.col("price_text")), F.col("card"))))
    price = F.when(F.col("_mode") == "last", last_list_price(F.col("_priced"))).when(F.col("_mode").isin("first", "special"), list_price(F.col("_priced")))
    cards = cards.withColumn("_read", price)
    found = F.when(F.col("_mode").isin("first", "last"), F.col("_read"))
    number = F.when(F.col("_mode") == "number", _digits(F.col("price_text"))).when(F.col("_mode") == "special", F.coalesce(_digits(F.col("special")), F.col("_read.amount")))
    amount = F.coalesce(number.cast("double"), found["amount"])
    amount = F.when(amount > 0, amount)
    card = F.lower(F.col("card"))
    fits = lambda pattern: card.rlike(pattern)
    availability = _pick(lambda s: F.when(fits(s.stock), "in_stock").otherwise("listed") if s.stock else F.when(fits(s.gone), "out_of_stock").otherwise("listed") if s.gone else None, "listed")
    used = F.when(card.rlike(r"(^|\s)б/в(?=\s|$)|вживан"), "used").when(card.rlike(r"(^|\s)нове(?=\s|$)"), "new")
    condition = _pick(lambda s: F.lit(s.condition) if s.condition else used if s.host == "olx.ua" else F.when(card.rlike("中古|used|pre-owned|б/в"), "used") if s.host == "zenmarket.jp" else None)
    is_row = F.col("variant").isNotNull()
    title = F.when(is_row, F.concat(F.lit("Shimano 21 "), reel_title(F.regexp_replace("title", r",\s*", " ")))).otherwise(_pick(lambda s: reel_title(F.col("title")) if s.canonical else None, None))
    url = F.when(is_row, F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("variant="), F.col("variant"))).otherwise(_pick(lambda s: F.coalesce(canonical_url(F.col("url")), F.col("url")) if s.canonical else None, None))
    label = F.when(is_row, "japantackle grouped product row").otherwise(_pick(lambda s: F.lit(s.label), ""))
    confidence = F.when(is_row, F.when(amount.isNotNull(), 0.82).otherwise(0.72)).otherwise(F.when(amount.isNotNull(), _pick(lambda s: F.lit(s.confidence[0]), 0.0)).otherwise(_pick(lambda s: F.lit(s.confidence[1]), 0.0)))
    made = cards.select(
        "page_url", "i", F.coalesce(title, "title").alias("title"), F.coalesce(url, "url").alias("url"), amount.alias("price"),
        F.when(amount.isNotNull(), F.coalesce(found["currency"], _pick(lambda s: F.lit(s.currency) if s.currency else None))).alias("currency"), availability.alias("availability"), condition.alias("condition"), F.lit(None).cast("string").alias("seller"),
        F.col("image").alias("imageUrl"), _pick(lambda s: F.lit(s.host), "").alias("sourceSite"),
        F.array(F.when(found["raw"].isNotNull(), F.concat(label, F.lit("; price pattern: "), found["raw"])).otherwise(label)).alias("evidence"), confidence.alias("confidence"),
    )
    first = made.groupBy("page_url", "url").agg(F.min_by(F.struct(*[c for c in made.columns if c not in ("page_url", "url")]), "i").alias("o"))
    return first.select("page_url", "o.i", "o.title", "url", *[f"o.{c}" for c in made.columns[4:]])


_JSON_LD = re.compile(r"<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", re.S | re.I)


def json_ld_nodes(html: str | None) -> list:
    """All nodes of a page's JSON-LD, those of a graph before the node that holds it; trailing commas are forgiven."""
    out: list = []

    def add(value: object) -> None:
        if isinstance(value, list):
            for x in value:
                add(x)
            return
        if isinstance(value, dict) and isinstance(value.get("@graph"), list):
            add(value["@graph"])
        out.append(value)

    for raw in _JSON_LD.findall(html or ""):
        for text in (raw, re.sub(r",\s*([}\]])", r"\1", raw)):
            try:
                add(json.loads(text))
                break
            except ValueError:
                continue
    return out


def _read_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page in batch.to_pylist():
            for i, node in enumerate(json_ld_nodes(page["html"])):
                kind = node.get("@type") if isinstance(node, dict) else None
                if kind == "Product" or (isinstance(kind, list) and "Product" in kind):
                    link = node.get("url") or (node.get("offers") or {}).get("url") if isinstance(node.get("offers") or {}, dict) else node.get("url")
                    rows.append((page["url"], page["finalUrl"], i, json.dumps(node, ensure_ascii=False), urljoin(page["finalUrl"] or "", link) if isinstance(link, str) else None))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(5)], names=["page_url", "finalUrl", "i", "node", "link"])


def json_ld_offers(pages: DataFrame, per_page: int = PER_PAGE, complete: bool = True) -> DataFrame:
    """Offers of the Product nodes in pages' JSON-LD, the first per_page of each page; those without title and url only where complete is False."""
    nodes = pages.select("url", "finalUrl", "html").mapInArrow(_read_nodes, "page_url string, finalUrl string, i int, node string, link string")
    get = lambda *paths: F.coalesce(*[null_if_empty(F.trim(F.get_json_object("node", p))) for p in paths])
    offer = lambda key: get(f"$.offers.offers[0].{key}", f"$.offers[0].{key}", f"$.offers.{key}")
    # A single product may have its price beside its offers.
    own = lambda key: offer(key) if complete else F.coalesce(offer(key), get(f"$.{key}"))
    price = F.regexp_extract(F.regexp_replace(F.regexp_replace(own("price"), r"[^\d.,]", ""), "^([^,]*),", "$1."), r"^\d+\.?\d*", 0).try_cast("double")
    made = nodes.select(
        "page_url", "finalUrl", "i", get("$.name").alias("title"), F.col("link").alias("url"), F.when(price > 0, price).alias("price"), F.when(price > 0, own("priceCurrency")).alias("currency"),
        schema_availability(offer("availability")).alias("availability"), schema_availability(offer("itemCondition")).alias("condition"), F.coalesce(offer("seller.name"), get("$.brand.name")).alias("seller"),
        get("$.image[0]", "$.image").alias("imageUrl"), host(F.col("finalUrl")).alias("sourceSite"), F.array(F.lit("json-ld Product list")).alias("evidence"), F.lit(0.82).alias("confidence"),
    )
    if complete:
        made = made.where("title is not null and url is not null")
    # What comes together for a page are its own nodes.
    listed = made.groupBy("page_url").agg(F.slice(F.array_sort(F.collect_list(F.struct("i", *[c for c in made.columns if c not in ("page_url", "i", "finalUrl")]))), 1, per_page).alias("o"))
    return listed.select("page_url", F.inline("o"))


def _state_ads() -> Column:
    """The ads of a page's embedded state; null if the page has none that parses."""
    quoted = F.regexp_extract("html", r'window\.__PRERENDERED_STATE__=\s*("(?:\\.|[^"\\])*")', 1)
    state = F.from_json(F.concat(F.lit('{"s":'), quoted, F.lit("}")), "s string")["s"]
    ad = "struct<title:string,url:string,price:struct<regularPrice:struct<value:double,currencyCode:string>>,params:array<struct<key:string,value:string,normalizedValue:string>>,location:struct<pathName:string>,photos:array<string>>"
    return F.from_json(state, f"listing struct<listing:struct<ads:array<{ad}>>>")["listing"]["listing"]["ads"]


def state_offers(pages: DataFrame) -> DataFrame:
    """Offers of classified-ad pages that embed their state as a JSON text within JSON."""
    ads = _state_ads()
    good = F.slice(F.filter(ads, lambda a: (F.trim(a["title"]) != "") & (F.trim(a["url"]) != "")), 1, PER_PAGE)
    rows = pages.where(host(F.col("finalUrl")).contains("olx.ua") & ads.isNotNull()).select(F.col("url").alias("page_url"), F.posexplode(good).alias("i", "a"))
    state_param = F.try_element_at(F.filter("a.params", lambda p: p["key"] == "state"), F.lit(1))
    return rows.select(
        "page_url", "i", F.trim("a.title").alias("title"), F.trim("a.url").alias("url"), F.col("a.price.regularPrice.value").alias("price"), F.coalesce("a.price.regularPrice.currencyCode", F.lit("UAH")).alias("currency"), F.lit("listed").alias("availability"),
        F.coalesce(state_param["normalizedValue"], state_param["value"]).alias("condition"), F.col("a.location.pathName").alias("seller"), F.try_element_at("a.photos", F.lit(1)).alias("imageUrl"), F.lit("olx.ua").alias("sourceSite"),
        F.array(F.lit("olx prerendered listing state")).alias("evidence"), F.lit(0.9).alias("confidence"),
    )


def api_offers(pages: DataFrame) -> DataFrame:
    """Offers of marketplace product-API answers, whose body is JSON."""
    data = F.from_json("html", "data struct<title:string,href:string,price:double,sell_status:string,status:string,seller_title:string,brand:string,state:string,product:struct<state:string>,images:array<struct<original:struct<url:string>,large:struct<url:string>,medium:struct<url:string>,preview:struct<url:string>>>>")["data"]
    rows = pages.where(host(F.col("finalUrl")).contains("product-api.rozetka.com.ua")).select(F.col("url").alias("page_url"), data.alias("d")).where("trim(d.title) <> '' and trim(d.href) <> ''")
    paid = F.col("d.price") != 0
    image = F.try_element_at(F.filter(F.transform("d.images", lambda m: F.coalesce(m["original"]["url"], m["large"]["url"], m["medium"]["url"], m["preview"]["url"])), lambda u: u.isNotNull()), F.lit(1))
    return rows.select(
        "page_url", F.lit(0).alias("i"), F.trim("d.title").alias("title"), F.trim("d.href").alias("url"), F.col("d.price").alias("price"), F.when(paid, "UAH").alias("currency"), sell_status(F.coalesce("d.sell_status", "d.status")).alias("availability"),
        sell_state(F.coalesce("d.state", "d.product.state")).alias("condition"), F.coalesce("d.seller_title", "d.brand", F.lit("Rozetka")).alias("seller"), image.alias("imageUrl"), F.lit("rozetka.com.ua").alias("sourceSite"),
        F.array(F.lit("rozetka product-api get-main")).alias("evidence"), F.when(paid, 0.88).otherwise(0.74).alias("confidence"),
    )


def listed_offers(pages: DataFrame) -> DataFrame:
    """Offers of result pages with page_url, i and reader, each page read in one way: API answer, embedded state, JSON-LD (where a shop
    puts it first or is unknown), else its shop's cards."""
    keyed = pages.withColumn("_shop", shop_of(F.col("finalUrl")))
    first = F.coalesce(_pick_shop(lambda s: s.json_first), F.lit(True)) & ~host(F.col("finalUrl")).contains("product-api.rozetka.com.ua")
    structured = json_ld_offers(keyed.where(first))
    state, api = state_offers(pages), api_offers(pages)
    # A state that parses is the whole page, also where it lists nothing.
    stated = pages.where(host(F.col("finalUrl")).contains("olx.ua") & _state_ads().isNotNull()).select(F.col("url").alias("page_url"))
    done = structured.select("page_url").union(stated).distinct()
    cards = card_offers(pages.join(done, F.col("url") == F.col("page_url"), "left_anti"))
    by = lambda table, reader: table.withColumn("reader", F.lit(reader))
    return by(structured, "json-ld").unionByName(by(state, "state")).unionByName(by(api, "api")).unionByName(by(cards, "cards"))


def list_offers(pages: DataFrame) -> DataFrame:
    """The offers of listed_offers, without their reader."""
    return listed_offers(pages).drop("reader")


def _pick_shop(of) -> Column:
    out = F.lit(None).cast("boolean")
    for i, shop in enumerate(SHOPS):
        out = F.when(F.col("_shop") == i, F.lit(bool(of(shop)))).otherwise(out)
    return out


#: The shop whose product pages have a reader of their own, and its fields: selector, attributes in order (none: the text).
PRODUCT_SHOP = "shimano.kiev.ua"
_PRODUCT_FIELDS = {
    "heading": ("h1", ()),
    "named": ('meta[property="og:title"]', ("content",)),
    "price_text": ("[id^=price_update_] .ty-price", ()),
    "stock_text": (".stock-wrap", ()),
    "sku": (".ut2-pb__sku", ()),
    "pictured": ('meta[property="og:image"]', ("content",)),
    "shown": (".ut2-pb__img-wrapper img[src], .ut2-pb__img-wrapper img[data-src]", ("src", "data-src")),
}


def _read_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text or attribute of the first element of each field, null where there is none."""

    def value(tree: Node, selector: str, attributes: tuple[str, ...]) -> str | None:
        first = next(iter(tree.find(selector)), None)
        if first is None:
            return None
        return next((first.attributes[a] for a in attributes if first.attributes.get(a)), None) if attributes else first.text()

    for batch in batches:
        urls, finals = batch.column("url"), batch.column("finalUrl").to_pylist()
        rows = [{f: value(tree, *how) for f, how in _PRODUCT_FIELDS.items()} for tree in map(parse, batch.column("html").to_pylist())]
        images = [urljoin(at, x.strip()) if (x := r["pictured"] or r["shown"]) else None for at, r in zip(finals, rows, strict=True)]
        names = list(_PRODUCT_FIELDS)
        yield pa.RecordBatch.from_arrays([urls, pa.array(finals, pa.string()), *[pa.array([r[n] for r in rows], pa.string()) for n in names], pa.array(images, pa.string())], names=["page_url", "finalUrl", *names, "image"])


def _of_product_shop() -> Column:
    return F.coalesce(host(F.col("finalUrl")).contains(PRODUCT_SHOP), F.lit(False))


def shop_product_offers(pages: DataFrame) -> DataFrame:
    """One offer for each product page of PRODUCT_SHOP that has a title; missing pages and other shops give none."""
    kept = pages.where(_of_product_shop() & ~is_missing_page(F.col("status"), F.col("title"), F.col("text"))).select("url", "finalUrl", "html")
    schema = "page_url string, finalUrl string, " + ", ".join(f"{n} string" for n in _PRODUCT_FIELDS) + ", image string"
    # Digits with the first comma as the decimal sign.
    digits = F.regexp_replace(F.regexp_replace("price_text", r"[^\d.,]", ""), "^([^,]*),", "$1.")
    read = kept.mapInArrow(_read_products, schema).withColumn("price", null_if_empty(F.regexp_extract(digits, r"^(?:\d+\.?\d*|\.\d+)", 0)).cast("double"))
    read = read.withColumn("title", clean_title(F.coalesce(null_if_empty(F.col("heading")), F.col("named")))).where("title is not null")
    paid = F.coalesce(F.col("price") != 0, F.lit(False))
    said = F.concat_ws(" product price: ", F.lit(PRODUCT_SHOP), "price_text")
    return read.select(
        "page_url", "title", F.col("finalUrl").alias("url"), "price", F.when(paid, "UAH").alias("currency"),
        F.when(F.lower("stock_text").rlike("є в наявності|в наличии|in stock"), "in_stock").otherwise("listed").alias("availability"),
        F.lit("new").alias("condition"), F.lit(PRODUCT_SHOP).alias("seller"), F.col("image").alias("imageUrl"), F.lit(PRODUCT_SHOP).alias("sourceSite"),
        F.array_compact(F.array(F.when(F.col("price_text") != "", said).otherwise(f"{PRODUCT_SHOP} product page"), null_if_empty(F.col("sku")), null_if_empty(F.col("stock_text")))).alias("evidence"),
        F.when(paid, 0.86).otherwise(0.72).alias("confidence"),
    )


def page_offers(pages: DataFrame) -> DataFrame:
    """One offer for each page that is read as a single product: by its shop's own reader, else from JSON-LD, then from what the text gives.

    Missing pages give none, and so do pages whose confidence is below 0.25. Fields that JSON-LD lacks are taken from the text.
    """
    own = shop_product_offers(pages)
    # Only pages of that shop are joined.
    unread = pages.where(_of_product_shop()).join(own.select(F.col("page_url").alias("url")), "url", "left_anti").select(*pages.columns)
    return own.unionByName(_general_page_offers(pages.where(~_of_product_shop()).unionByName(unread)))


def _general_page_offers(pages: DataFrame) -> DataFrame:
    body = F.substring(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 1, 80_000)
    heading = F.coalesce(null_if_empty(F.regexp_extract("html", r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)), null_if_empty(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))), F.col("title"), first_line(F.col("text")))
    # Columns of their own: each is used several times below, and its expression would be repeated as often.
    kept = pages.where(~is_missing_page(F.col("status"), F.col("title"), F.col("text"))).select("url", "finalUrl", "title", heading.alias("_heading"), body.alias("_body"))
    kept = kept.withColumn("_search", is_search_page(F.col("finalUrl"), F.col("_heading")) | is_search_page(F.col("url"), F.col("_heading")))
    kept = kept.withColumn("_text", F.when(~F.col("_search"), F.col("_body"))).drop("_body")
    kept = kept.withColumns({"_price": page_price(F.col("_text")), "_stock": text_availability(F.col("_text")), "_state": text_condition(F.col("_text"))})
    price, stock, state, search = (F.col(c) for c in ("_price", "_stock", "_state", "_search"))
    hits = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in (null_if_empty(F.col("_heading")), F.nullif(price["amount"], F.lit(0.0)), stock, state)), F.lit(0))
    evidence = F.array_compact(F.array(F.when(search, "search results page"), F.concat(F.lit("price pattern: "), price["raw"]), F.concat(F.lit("availability pattern: "), stock), F.concat(F.lit("condition pattern: "), state)))
    read = kept.select(
        F.col("url").alias("page_url"), "finalUrl", "title", clean_title(F.col("_heading")).alias("h_title"), price["amount"].alias("h_price"), price["currency"].alias("h_currency"), stock.alias("h_availability"), state.alias("h_condition"), evidence.alias("h_evidence"), F.when(search, 0.35).otherwise(hits / 6).alias("h_confidence"),
    )
    best = json_ld_offers(pages, 1, complete=False).drop("url", "i", "sourceSite").withColumn("s_known", F.lit(True))
    names = ["price", "currency", "availability", "condition"]
    joined = read.join(best.select("page_url", *[F.col(c).alias(f"s_{c}") for c in ("title", *names, "seller", "imageUrl")], "s_known"), "page_url", "left")
    known = F.coalesce("s_known", F.lit(False))
    return joined.select(
        "page_url", F.coalesce("s_title", "h_title", "title", host(F.col("finalUrl")), "finalUrl").alias("title"), F.col("finalUrl").alias("url"), *[F.coalesce(f"s_{c}", f"h_{c}").alias(c) for c in names], F.col("s_seller").alias("seller"),
        F.col("s_imageUrl").alias("imageUrl"), host(F.col("finalUrl")).alias("sourceSite"), F.slice(F.array_distinct(F.concat(F.when(known, F.array(F.lit("json-ld Product"))).otherwise(F.array().cast("array<string>")), "h_evidence")), 1, 8).alias("evidence"),
        F.greatest(F.when(known, 0.78).otherwise(0.0), "h_confidence", F.lit(0.15)).alias("confidence"),
    ).where("confidence >= 0.25")


def needs_model() -> Column:
    """Whether an offer is so incomplete that a language model should read its page, where one is at hand."""
    return (F.col("confidence") < 0.65) | (F.coalesce("price", F.lit(0.0)) == 0) | F.coalesce(F.col("currency") == "", F.lit(True))


