"""App and place reviews: store addresses, review records, place records with nested reviews."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import parse_qs, quote, urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.schema import payload
from prosegrid.sources import cursor


def app_address(url: str) -> tuple[str, str, str]:
    """(country, name, id) of an address ``/country/app/name/id123``; other shapes are an error."""
    parts = urlparse(url).path.split("/")
    if len(parts) != 5 or parts[4].count("id") != 1:
        raise ValueError(f"not an app address: {url!r}")
    return parts[1], parts[3], parts[4].split("id")[1]


def app_address_columns(url: Column) -> dict[str, Column]:
    """The same for a column; null where the shape differs."""
    parts = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    fits = (F.size(parts) == 5) & (F.size(F.split(F.get(parts, F.lit(4)), "id")) == 2)
    return {"country": F.when(fits, F.get(parts, F.lit(1))), "app_name": F.when(fits, F.get(parts, F.lit(3))), "app_id": F.when(fits, F.get(F.split(F.get(parts, F.lit(4)), "id"), F.lit(1)))}


def package_address(url: str) -> tuple[str | None, list[str], str | None]:
    """(package, countries, language) from the query parameters id, gl and hl."""
    own = parse_qs(urlparse(url).query)
    first = lambda k: own.get(k, [None])[0]
    return first("id"), own.get("gl", []), first("hl")


def package_address_columns(url: Column) -> dict[str, Column]:
    part = lambda k: F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)))
    return {"package_name": part("id"), "country": part("gl"), "language": part("hl")}


def find_in_search(name: str, search: Callable[[str], str], pattern: str, site: str) -> str:
    """The first match of a pattern's group in the result page of a web search for an app."""
    found = re.search(pattern, search(quote(f"{site} {name}")))
    if not found:
        raise RuntimeError(f"no match for {name!r}")
    return found[1]


def search_app_id(name: str, search: Callable[[str], str]) -> str:
    return find_in_search(name, search, r"/id([0-9]+)", "app store")


def search_package(name: str, search: Callable[[str], str]) -> str:
    return find_in_search(name, search, r"[?&]id=([\w.]+)", "play store")


@dataclass
class AppReviewsConfig:
    app_url: str | None = None
    countries: list[str] = field(default_factory=lambda: ["us"])
    app_id: str | None = None
    app_name: str | None = None
    lookup_period: str | None = None
    max_count: int | None = None

    def __post_init__(self) -> None:
        if self.app_url:
            country, self.app_name, self.app_id = app_address(self.app_url)
            self.countries = [country]
        if not (self.app_id or self.app_name):
            raise ValueError("an app needs an id, a name or an address")


@dataclass
class PackageReviewsConfig:
    app_url: str | None = None
    countries: list[str] = field(default_factory=lambda: ["us"])
    package_name: str | None = None
    app_name: str | None = None
    language: str = "en"
    filter_score_with: int | None = None
    lookup_period: str | None = None
    max_count: int = 200

    def __post_init__(self) -> None:
        if self.app_url:
            package, countries, language = package_address(self.app_url)
            self.package_name, self.countries, self.language = package, countries or self.countries, language or self.language
        if not (self.package_name or self.app_name):
            raise ValueError("an app needs a package, a name or an address")


def _chosen(reviews: DataFrame, config: AppReviewsConfig | PackageReviewsConfig, cursors: DataFrame | None, now: datetime | None) -> DataFrame:
    own = reviews.where(F.col("country").isin(config.countries))
    new = cursor.newer(own, cursors, cursor.start_time(config.lookup_period, now), key="country", record_id="id")
    return cursor.newest(new, config.max_count, key="country") if config.max_count else new


def app_reviews(reviews: DataFrame, config: AppReviewsConfig, *, cursors: DataFrame | None = None, now: datetime | None = None) -> DataFrame:
    """Payloads of reviews (country, id, ts, title, content), the newest of each country."""
    return payload(_chosen(reviews, config, cursors, now), F.concat_ws(". ", "title", "content"), F.col("id"), meta=F.struct("*"), source_name="AppStoreScrapper")


def package_reviews(reviews: DataFrame, config: PackageReviewsConfig, *, cursors: DataFrame | None = None, now: datetime | None = None) -> DataFrame:
    """Payloads of reviews (country, id, ts, score, content), with one score only if configured."""
    if config.filter_score_with is not None:
        reviews = reviews.where(F.col("score") == config.filter_score_with)
    return payload(_chosen(reviews, config, cursors, now), F.col("content"), F.col("id"), meta=F.struct("*"), source_name="PlayStoreScrapper")


def publisher_reviews(responses: DataFrame, *, since_id: str | None = None) -> DataFrame:
    """Payloads of a publisher API's reviews: ``comments`` is an array whose first entry holds the user's comment."""
    own = responses.where(F.col("reviewId") > since_id) if since_id else responses
    return payload(own, F.get("comments", F.lit(0))["userComment"]["text"], F.col("reviewId"), meta=F.struct("*"), source_name="PlayStoreReviews")


@dataclass
class PlaceReviewsConfig:
    queries: list[str]
    sort: str = "newest"
    number_of_reviews: int = 10
    number_of_places_per_query: int = 1
    since_timestamp: int | None = None
    until_timestamp: int | None = None
    language: str | None = None
    country: str | None = None

    def request(self, since: int | None = None) -> dict:
        """The parameters of a call; a cursor goes before the configured start."""
        own = {
            "query": self.queries, "sort": self.sort, "reviewsLimit": self.number_of_reviews, "limit": self.number_of_places_per_query,
            "cutoff": since if since is not None else self.since_timestamp, "start": self.until_timestamp, "language": self.language, "region": self.country, "async": False,
        }
        return {k: v for k, v in own.items() if v is not None}


def place_reviews(places: DataFrame, *, reviews: str = "reviews_data", since: datetime | None = None, text: str = "review_text", ts: str = "review_timestamp", review_id: str = "review_id") -> DataFrame:
    """Payloads of the reviews nested in place records; where both have a field, the place's stands in meta."""
    rest = [c for c in places.columns if c != reviews]
    rows = places.select(*rest, F.explode(reviews).alias("__review"))
    own = [f for f in rows.schema["__review"].dataType.fieldNames() if f not in rest]
    flat = rows.select(F.col(f"__review.{review_id}").alias("__id"), F.col(f"__review.{text}").alias("__text"), F.col(f"__review.{ts}").alias("__ts"), F.struct(*[F.col(f"__review.{f}") for f in own], *rest).alias("__meta"))
    if since is not None:
        flat = flat.where(F.col("__ts") > int(since.timestamp()))
    return payload(flat, F.col("__text"), F.col("__id"), meta=F.col("__meta"), source_name="Maps Reviews Scrapper")
