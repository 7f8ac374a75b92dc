"""Fetched pages as tables: attempts of several fetchers, and the page of each url that is used.

An attempt has url, finalUrl, title, html, markdown, text, status, fetcher. Fetching is the caller's: its rows arrive as a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pages import is_blocked_page
from ..functions.text import collapsed
from ..functions.urls import host
from ..operators.discovery import usable_page

PAGE = "url string, finalUrl string, title string, html string, markdown string, text string, status int, fetcher string"
TEXT_LIMIT = 80_000


def skips_browser(url: Column, human: bool = False, profile: bool = False) -> Column:
    """Pages that a browser isn't tried for: JSON APIs, and one shop that asks for a human."""
    at = F.coalesce(host(url), F.lit(""))
    return at.rlike(r"(?:product-api|search)\.rozetka\.com\.ua") | (at.endswith("zenmarket.jp") & F.lit(not (human or profile)))


@F.pandas_udf(T.StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Texts with their character references decoded."""
    return texts.map(unescape, na_action="ignore")


def plain_text(html: Column) -> Column:
    """Body text without markup, character references decoded, white space runs as one space, as far as pages are read."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.substring(collapsed(decoded(body)), 1, TEXT_LIMIT)


def scraper_pages(answers: DataFrame) -> DataFrame:
    """Attempts (PAGE) from a scraping service's JSON answers (url, body): its markdown is the page's text. Answers without data give no row."""
    told = "metadata struct<title:string, sourceURL:string, url:string, statusCode:int>"
    rows = answers.select("url", F.from_json("body", f"data struct<markdown:string, html:string, {told}>")["data"].alias("d")).where("d is not null")
    at = F.coalesce("d.metadata.sourceURL", "d.metadata.url", "url")
    return rows.select("url", at.alias("finalUrl"), "d.metadata.title", "d.html", "d.markdown", F.col("d.markdown").alias("text"), F.col("d.metadata.statusCode").alias("status"), F.lit("scraper").alias("fetcher"))


def best_pages(attempts: DataFrame, order: Sequence[str], human: bool = False, profile: bool = False) -> DataFrame:
    """For each url the page of the first fetcher, in order, that has content and isn't blocked; urls without one are left out."""
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("fetcher"))
    filled = F.coalesce(F.nullif("html", F.lit("")), F.nullif("markdown", F.lit("")), F.nullif("text", F.lit(""))).isNotNull()
    tried = (place > 0) & ~((F.col("fetcher") == "browser") & skips_browser(F.col("url"), human, profile))
    good = tried & filled & ~is_blocked_page(F.col("status"), F.col("title"), F.col("html"), F.col("text"))
    return usable_page(attempts.withColumn("ordinal", place).withColumn("usable", F.coalesce(good, F.lit(False))))
