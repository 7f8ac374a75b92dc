"""What a search run is given: settings, their normalisation, budgets, and which pages are fetched how. All of it is driver-side."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

from ..operators.ranking import OfferFilter

FETCH_MODES = ("http", "browser", "auto")
#: Budgets of deep searches, and the least candidates of a search in named sources.
DEEP_RESULTS, DEEP_PAGES, SOURCE_RESULTS = 220, 60, 100


@dataclass(frozen=True)
class SearchSettings:
    max_results: int = 220
    max_pages: int = 60
    limit: int = 120
    fetch_mode: str = "auto"
    human_in_loop: bool = False
    verdicts: bool = False
    save: bool = False
    sources: str = ""
    condition: str = "any"
    min_price: float | None = None
    max_price: float | None = None


def _number(value: object) -> float | None:
    try:
        n = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return n if math.isfinite(n) and n > 0 else None


def normalize_settings(given: Mapping[str, object], base: SearchSettings = SearchSettings()) -> SearchSettings:
    """Settings from untyped values; what doesn't fit falls back to base. The words false, 0, no and an empty text are false."""
    whole = lambda key, default: int(n) if (n := _number(given.get(key))) is not None and n >= 1 else default

    def flag(key: str, default: bool) -> bool:
        value = given.get(key, default)
        return value.strip().lower() not in ("", "false", "0", "no", "off") if isinstance(value, str) else bool(value)

    mode, condition = given.get("fetch_mode"), given.get("condition")
    return replace(
        base,
        max_results=whole("max_results", base.max_results),
        max_pages=whole("max_pages", base.max_pages),
        limit=whole("limit", base.limit),
        fetch_mode=mode if mode in FETCH_MODES else base.fetch_mode,
        human_in_loop=flag("human_in_loop", base.human_in_loop),
        verdicts=flag("verdicts", base.verdicts),
        save=flag("save", base.save),
        sources=str(given.get("sources") or "").strip(),
        condition=condition if condition in ("new", "used") else "any",
        min_price=_number(given.get("min_price")),
        max_price=_number(given.get("max_price")),
    )


def offer_filter(settings: SearchSettings) -> OfferFilter:
    named = tuple(s.strip() for s in settings.sources.split(",") if s.strip())
    return OfferFilter(settings.min_price, settings.max_price, None if settings.condition == "any" else settings.condition, named, settings.limit)


def deepened(settings: SearchSettings) -> SearchSettings:
    """The budgets of a deep search, which also never goes without a browser."""
    return replace(settings, max_results=max(settings.max_results, DEEP_RESULTS), max_pages=max(settings.max_pages, DEEP_PAGES), fetch_mode="auto" if settings.fetch_mode == "http" else settings.fetch_mode)


def discovery_limit(settings: SearchSettings) -> int:
    """Candidates that are discovered: more if a source filter will thin them out."""
    return max(settings.max_results, SOURCE_RESULTS) if settings.sources else settings.max_results


def per_query_limit(max_results: int, n_providers: int) -> int:
    return max(5, math.ceil(max_results / max(1, n_providers)))


def fetcher_order(mode: str, has_scraper: bool) -> list[str]:
    """The fetchers to try for a page, in order."""
    scraper = ["scraper"] if has_scraper else []
    return {"http": ["http"], "browser": ["browser", "http"]}.get(mode, ["http", *scraper, "browser"])
