"""URL and identity functions as Column expressions. A URL without scheme and host is invalid and gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, let, null_if_empty, number_text, slug

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query parameters that only track visits.
TRACKING = ("fbclid", "gclid", "gbraid", "wbraid", "yclid", "msclkid", "_pos", "_sid", "_ss", "ref", "referrer", "utm")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, i)


def host(url: Column) -> Column:
    return null_if_empty(F.lower(_part(url, 2)))


def site(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.when(host(url).isNull(), F.lit(None).cast("string")).when(_part(url, 3) == "", "/").otherwise(_part(url, 3))


def query_string(url: Column) -> Column:
    return _part(url, 4)


def _split(url: Column) -> Column:
    """[scheme, host, path, parameters] of a valid URL; one element of others."""
    return F.split(F.regexp_replace(F.trim(url), _PARTS, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")


def _parsed(url: Column, body) -> Column:
    """body(scheme, host, path, parameters) of a valid URL, which is read once; null for others.

    scheme and host are lower-cased, an empty path is /, parameters are array<struct<name, i, pair>> in order.
    """

    def made(p: Column) -> Column:
        pairs = F.filter(F.split(p[3], "&"), lambda x: x != "")
        parameters = F.transform(pairs, lambda x, i: F.struct(F.split(x, "=", 2)[0].alias("name"), i.alias("i"), x.alias("pair")))
        return F.when(F.size(p) == 4, body(F.lower(p[0]), F.lower(p[1]), F.when(p[2] == "", "/").otherwise(p[2]), parameters))

    return let(_split(url), made)


#: A tracking parameter after its separator. The Kelvin sign is a small k to lower().
_TRACKED = "(?i)&(?:utm_[^=&]*|" + "|".join(TRACKING).replace("k", "[k\u212a]") + r")(?:=[^&]*)?(?=&|\z)"


def _sorted_parameters(query: Column) -> Column:
    """Parameters by name; one without a value gets a sign of equality."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x, i: F.struct(F.split(x, "=", 2)[0].alias("name"), i.alias("i"), x.alias("pair")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.when(p["pair"].contains("="), p["pair"]).otherwise(F.concat(p["pair"], F.lit("=")))), "&")


def canonical_url(url: Column) -> Column:
    """Lower-cased host without www, no fragment, no trailing slashes, shop collection paths cut, no tracking, parameters by name."""

    def made(p: Column) -> Column:
        host, path = F.lower(p[1]), F.regexp_replace(p[2], "/+$", "")
        short = F.when(path.startswith("/collections/"), F.regexp_replace(path, r"^/collections/[^/]+(/products/[^/]+)$", "$1")).otherwise(path)
        # Most have one parameter left, which needn't be sorted.
        kept = F.when(p[3] == "", "").otherwise(F.trim(F.regexp_replace(F.concat(F.lit("&"), p[3]), _TRACKED, ""), F.lit("&")))
        one = lambda k: F.when(k == "", "").when(~k.contains("&"), F.concat(F.lit("?"), k, F.when(k.contains("="), "").otherwise("="))).otherwise(F.concat(F.lit("?"), _sorted_parameters(k)))
        return F.concat(F.lower(p[0]), F.lit("://"), F.when(host.startswith("www."), F.substring(host, 5, 1 << 30)).otherwise(host), let(short, lambda s: F.when(s == "", "/").otherwise(s)), let(kept, one))

    return let(_split(url), lambda p: F.when(F.size(p) == 4, made(p)))


def normalized_url(url: Column) -> Column:
    """No fragment and no campaign parameters; an invalid URL as it is."""

    def made(scheme: Column, host: Column, path: Column, parameters: Column) -> Column:
        kept = F.filter(parameters, lambda p: ~F.lower(p["name"]).rlike("^(utm_|fbclid|gclid|yclid)"))
        query = F.array_join(F.transform(kept, lambda p: p["pair"]), "&")
        return F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))

    return F.coalesce(_parsed(url, made), url)


def source_name(source: Column) -> Column:
    return null_if_empty(F.lower(F.trim(F.regexp_replace(source, r"^www\.", ""))))


def seller_name(seller: Column, source: Column) -> Column:
    return F.coalesce(null_if_empty(collapsed(seller)), source_name(source))


def identity_key(url: Column, source: Column, seller: Column, title: Column, price: Column) -> Column:
    """The canonical URL; for an invalid one a signature of source, seller, title and price."""
    signature = F.concat_ws(
        ":",
        F.lit("signature"),
        F.coalesce(source_name(source), site(url), F.lit("unknown-source")),
        F.coalesce(seller_name(seller, source), F.lit("unknown-seller")),
        slug(title),
        F.coalesce(number_text(price), F.lit("unknown-price")),
    )
    return F.coalesce(F.concat(F.lit("url:"), canonical_url(url)), signature)
