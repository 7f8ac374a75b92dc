"""Facts read from page text: prices, availability, condition, and what kind of page it is, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, collapsed, group, let, null_if_empty
from .urls import path, query_string

#: How amounts and currencies are written in lists of goods.
_THOUSANDS = r"\d{1,3}(?:[  ,]\d{3})+|\d+(?:[.,]\d+)?"
_MONEY = r"грн|₴|UAH|JPY|¥|￥|USD|\$"
LIST_AFTER, LIST_BEFORE = rf"(?iu)({_THOUSANDS})[{WS}]?({_MONEY})", rf"(?iu)({_MONEY})[{WS}]?({_THOUSANDS})"
_PAGE_AMOUNT = rf"\d{{1,3}}(?:[,{WS}]\d{{3}})+|\d+(?:\.\d+)?"
#: Fixed values: (pattern, group of the amount, group of the currency), the first that matches counting.
PAGE_PRICES = (
    (rf"(?iu)(¥|￥|JPY)[{WS}]?({_PAGE_AMOUNT})", 2, 1),
    (rf"(?iu)({_PAGE_AMOUNT})[{WS}]?(円|JPY|USD|EUR|UAH|грн|₴|\$|€)", 1, 2),
    (rf"(?iu)(\$|€|₴)[{WS}]?({_PAGE_AMOUNT})", 2, 1),
)
#: Currency signs.
CURRENCY_SIGNS = {"¥": "JPY", "￥": "JPY", "円": "JPY", "$": "USD", "€": "EUR", "₴": "UAH", "ГРН": "UAH"}


def currency_code(c: Column) -> Column:
    up = F.upper(c)
    out = null_if_empty(up)
    for sign, code in CURRENCY_SIGNS.items():
        out = F.when(up == sign, code).otherwise(out)
    return out


def price_amount(c: Column) -> Column:
    """A comma before three digits separates thousands, else it is a decimal comma; the first only."""
    compact = F.regexp_replace(c, r"[  ]", "")
    grouped = compact.rlike(r",\d{3}(?:\D|$)")
    plain = F.when(grouped, F.regexp_replace(compact, ",", "")).otherwise(F.regexp_replace(compact, "^([^,]*),", "$1."))
    return null_if_empty(F.regexp_extract(plain, r"^\d+\.?\d*", 0)).cast("double")


def _priced(amount: Column, currency: Column, raw: Column) -> Column:
    found = F.struct(amount.alias("amount"), let(currency, currency_code).alias("currency"), raw.alias("raw"))
    return let(found, lambda f: F.when(f["amount"].isNotNull(), f))


def list_price(text: Column) -> Column:
    """struct<amount, currency, raw> of the first price; an amount before its currency is preferred. Null if there is none."""
    after = _priced(price_amount(group(text, LIST_AFTER, 1)), group(text, LIST_AFTER, 2), group(text, LIST_AFTER, 0))
    before = _priced(price_amount(group(text, LIST_BEFORE, 2)), group(text, LIST_BEFORE, 1), group(text, LIST_BEFORE, 0))
    return F.coalesce(after, before)


def last_list_price(text: Column) -> Column:
    """As list_price, of the last price: the last with the currency in front, if there is such, else the last of all."""
    pick = lambda pattern, i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    last = lambda i, j: F.try_element_at(F.concat(pick(LIST_AFTER, i), pick(LIST_BEFORE, j)), F.lit(-1))
    return _priced(price_amount(last(1, 2)), last(2, 1), last(0, 0))


def page_price(text: Column) -> Column:
    """struct<amount, currency, raw> of a product page's text; decimal commas aren't known there."""
    tries = [_priced(F.regexp_replace(group(text, p, a), rf"[,{WS}]", "").cast("double"), group(text, p, c), group(text, p, 0)) for p, a, c in PAGE_PRICES]
    return F.coalesce(*tries)


def text_availability(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("sold out|out of stock|売り切れ|在庫なし|продано|немає в наявності"), "out_of_stock").when(t.rlike("in stock|available|在庫あり|販売中|в наявності"), "in_stock")


def text_condition(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("中古|used|pre-owned|second hand|б/в|вживан"), "used").when(t.rlike("新品|new with tags|brand new|новий|нова"), "new")


def schema_availability(value: Column) -> Column:
    """schema.org availability and condition values; an unknown one as it is."""
    return (
        F.when(value.rlike("(?i)OutOfStock|SoldOut"), "out_of_stock").when(value.rlike("(?i)InStock|Available"), "in_stock")
        .when(value.rlike("(?i)UsedCondition"), "used").when(value.rlike("(?i)NewCondition"), "new").otherwise(null_if_empty(value))
    )


def sell_status(value: Column) -> Column:
    """A marketplace's sell status; unavailable and inactive read as in stock, as the marketplace pages are taken to mean."""
    return F.when(value.rlike("(?i)available|active|sell"), "in_stock").when(value.rlike("(?i)out|hidden"), "out_of_stock").otherwise(null_if_empty(value))


def sell_state(value: Column) -> Column:
    return F.when(value.rlike("(?i)new"), "new").when(value.rlike("(?i)used|second"), "used").otherwise(null_if_empty(value))


def clean_title(c: Column) -> Column:
    return null_if_empty(F.trim(F.regexp_replace(F.regexp_replace(c, rf"[{WS}]+", " "), r" +[|｜-] +.*$", "")))


def first_line(text: Column) -> Column:
    """The first line of more than 8 characters."""
    return F.try_element_at(F.filter(F.transform(F.split(text, "\n+"), lambda x: collapsed(x)), lambda x: F.char_length(x) > 8), F.lit(1))


#: Marks of search pages in paths, query strings and titles, of missing pages, of refusals and of checks of who asks.
SEARCH_PATHS, SEARCH_KEYS = ("/search", "/s/"), ("keyword=", "search=", "search_=", "search_term=", "?p=", "&p=", "q=")
SEARCH_TITLES = ("search", "検索", "一覧")
MISSING = ("помилка 404", "сторінка не знайдена", "not found")
REFUSED, REFUSING = ("just a moment", "access denied", "captcha", "forbidden"), (403, 429)
CHECKING = (r"challenges\.cloudflare\.com", "cf-chl", "checking your browser", "verify you are human")


def is_search_page(url: Column, title: Column) -> Column:
    p, q, t = F.lower(path(url)), F.lower(F.concat(F.lit("?"), query_string(url))), F.lower(F.coalesce(title, F.lit("")))
    marks = [where.contains(x) for where, found in ((p, SEARCH_PATHS), (q, SEARCH_KEYS), (t, SEARCH_TITLES)) for x in found]
    return F.coalesce(reduce(or_, marks), F.lit(False))


def is_missing_page(status: Column, title: Column, text: Column) -> Column:
    t = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.coalesce(status == 404, F.lit(False)) | t.rlike("|".join(MISSING))


def is_blocked_page(status: Column, title: Column, html: Column, text: Column) -> Column:
    body = F.lower(F.concat(F.coalesce(html, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    words = F.concat(F.lower(F.coalesce(title, F.lit(""))), body).rlike("|".join(REFUSED))
    return (F.coalesce(status.isin(*REFUSING), F.lit(False)) & words) | body.rlike("|".join(CHECKING))
