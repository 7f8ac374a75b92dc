"""A whole search in one plan: candidates in, their pages read, offers ranked and grouped.

Every page goes to exactly one reader. Which one depends on what another reader made of it: pages that no list reader gets
anything from are read as a single product, unless they are direct search pages. List readers' rows are therefore written once;
the single-product reader's pages are those without one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.discovery import DIRECT, discover, fetch_order, filter_sources
from ..operators.extraction import listed_offers, page_offers
from ..sources.pages import best_pages
from ..sources.tables import written
from .options import SearchSettings, discovery_limit, fetcher_order, offer_filter
from .query_plan import plan_query
from .search import SearchRun, search_offers

#: Offers of one page are numbered below this.
PAGE_SPAN = 1 << 16
#: Columns that a page brings along; readers use the others.
_OWN = ("place", "sourceProvider")


def route_pages(pages: DataFrame, direct: Column) -> DataFrame:
    """(page_url, reader, i, offer columns) of every offer of pages, each page read by one reader, whatever their number.

    direct: whether a page was found by a direct search, so that without list hits it is no product. reader is api, state, json-ld or cards
    for list readers, page for the single product. A page that no reader gets an offer from has no row. pages has each url once.
    """
    lists = written(listed_offers(pages), "search-lists")
    rest = pages.where(~F.coalesce(direct, F.lit(False))).join(lists.select(F.col("page_url").alias("url")).distinct(), "url", "left_anti")
    return lists.unionByName(page_offers(rest).select("page_url", F.lit("page").alias("reader"), F.lit(0).alias("i"), *[c for c in lists.columns if c not in ("page_url", "reader", "i")]))


def page_routes(fetched: DataFrame, pages: DataFrame, offers: DataFrame) -> DataFrame:
    """(place, url, sourceProvider, reader, n_offers) for every candidate that was to be fetched.

    reader is that of route_pages; skipped: a direct page without list hits; nothing: read, but no offer; unread: no fetcher got it.
    """
    found = offers.groupBy(F.col("page_url").alias("url")).agg(F.min("reader").alias("reader"), F.count(F.lit(1)).alias("n_offers"))
    got = pages.select("url", F.lit(True).alias("_read"))
    joined = fetched.select("place", "url", "sourceProvider").join(got, "url", "left").join(found, "url", "left")
    no_offer = F.when(F.col("_read").isNull(), "unread").when(F.col("sourceProvider").startswith(DIRECT), "skipped").otherwise("nothing")
    return joined.select("place", "url", "sourceProvider", F.coalesce("reader", no_offer).alias("reader"), F.coalesce("n_offers", F.lit(0)).alias("n_offers"))


def numbered_fetches(candidates: DataFrame, query: str, settings: SearchSettings) -> DataFrame:
    """The candidates that the budget of pages allows, with place from 1 in the order in which they are fetched."""
    order = Window.orderBy(F.desc("fetchScore"), "rank", "seq")
    # At most max_pages rows.
    return fetch_order(filter_sources(candidates, offer_filter(settings).sources), query, settings.max_pages).withColumn("place", F.row_number().over(order).cast("long"))


def run_search(candidates: DataFrame, attempts: DataFrame, query: str, settings: SearchSettings = SearchSettings(), verdicts: DataFrame | Callable[[DataFrame], DataFrame] | None = None, has_scraper: bool = True) -> SearchRun:
    """Discover, fetch, read, rank and group: plan, candidates, routes, offers and groups of a search.

    candidates: of all providers, with seq. attempts: what fetchers got (PAGE of sources.pages). verdicts: a table of verdicts, or a function
    that gets the best offers and returns one; they are asked for only where settings.verdicts says so, and a function that fails leaves
    the offers as they are. Offers count in the order of their pages' places, then of their place on the page.
    """
    spark = candidates.sparkSession
    found = written(discover(candidates, query, discovery_limit(settings)), "search-candidates")
    fetched = written(numbered_fetches(found, query, settings), "search-fetches")
    few = F.broadcast(fetched.select("url", *_OWN))  # at most max_pages rows
    chosen = best_pages(attempts.join(few.select("url"), "url", "left_semi"), fetcher_order(settings.fetch_mode, has_scraper), settings.human_in_loop)
    pages = written(chosen.join(few, "url"), "search-pages")
    read = written(route_pages(pages, F.col("sourceProvider").startswith(DIRECT)), "search-offers")
    places = F.broadcast(fetched.select(F.col("url").alias("page_url"), "place"))
    offers = read.join(places, "page_url").withColumn("seq", F.col("place") * PAGE_SPAN + F.col("i")).withColumn("warnings", F.array().cast("array<string>")).drop("page_url", "place", "reader", "i")
    run = search_offers(offers, query, offer_filter(settings), verdicts if settings.verdicts else None)
    return SearchRun(plan_query(spark, query), run.offers, run.groups, found, page_routes(fetched, pages, read))
