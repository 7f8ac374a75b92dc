"""The whole search: offers in, ranked offers and product families out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import group_offers
from ..operators.ranking import OfferFilter, dedupe_offers, join_verdicts, other_models, rank_offers, verdict_input
from ..sources.tables import written


@dataclass(frozen=True)
class SearchRun:
    """plan and candidates are None for a search that starts at offers; so are routes, the reader of each page."""

    plan: DataFrame | None
    offers: DataFrame
    groups: DataFrame
    candidates: DataFrame | None = None
    routes: DataFrame | None = None


def with_verdicts(ranked: DataFrame, verdicts: DataFrame | Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """ranked with verdicts on its best offers only; other offers of the same url get that url's verdict too.

    A function is given the best offers; if it fails, and with a table of none, offers stay as they are.
    """
    if verdicts is None:
        return ranked
    best = verdict_input(ranked)
    if callable(verdicts):
        best = written(best, "verdict-input")
        try:
            verdicts = written(verdicts(best), "verdicts")
        except (PySparkException, OSError, ValueError):
            return ranked
    # At most VERDICT_OFFERS urls.
    return join_verdicts(ranked, verdicts.join(F.broadcast(best.select("url").distinct()), "url", "left_semi"))


def search_offers(offers: DataFrame, query: str, wanted: OfferFilter = OfferFilter(), verdicts: DataFrame | Callable[[DataFrame], DataFrame] | None = None, plan: DataFrame | None = None, features: DataFrame | None = None) -> SearchRun:
    """De-duplicate, rank and filter offers, join verdicts on the best if there are any, and group what is left. features: see enrich_offers."""
    once = dedupe_offers(offers, other_models(features, query) if features is not None else None)
    ranked = with_verdicts(rank_offers(once, query, wanted, features), verdicts)
    return SearchRun(plan, ranked, group_offers(ranked))
