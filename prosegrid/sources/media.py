"""News by one-day windows, and video comments from nested JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.functions.times import parse_time
from prosegrid.schema import payload
from prosegrid.sources import cursor


@dataclass
class NewsConfig:
    query: str
    country: str = "US"
    language: str = "en"
    max_results: int = 100
    lookup_period: str | None = None
    after_date: str | None = None
    before_date: str | None = None
    fetch_article: bool = False

    def __post_init__(self) -> None:
        if self.lookup_period and self.after_date:
            raise ValueError("give a lookup period or an after date, not both")
        if self.before_date and not (self.lookup_period or self.after_date):
            raise ValueError("a before date needs a lookup period or an after date")


def day_windows(config: NewsConfig, now: datetime) -> list[tuple[date, date]]:
    """The one-day windows to ask for, the latest first."""
    end = parse_time(config.before_date, now) if config.before_date else now
    start = parse_time(config.after_date or config.lookup_period or "1h", end if config.lookup_period else now)
    days = (end.date() - start.date()).days
    return [(end.date() - timedelta(days=k), end.date() - timedelta(days=k - 1)) for k in range(days + 1)]


def news_requests(config: NewsConfig, now: datetime) -> list[dict]:
    """A request (a partition of a polled read) for each window."""
    return [{"key": str(a), "query": f"{config.query}+after:{a}+before:{b}", "country": config.country, "language": config.language} for a, b in day_windows(config, now)]


def news(articles: DataFrame, config: NewsConfig, now: datetime) -> DataFrame:
    """Payloads of articles (id, ts, title, text of the crawled article or null), the newest ``max_results``."""
    since = parse_time(config.after_date or config.lookup_period or "1h", now)
    found = cursor.newer(articles, None, since).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(config.max_results)
    text = F.concat_ws("\n\n ", F.concat(F.col("title"), F.lit(".")), F.col("text")) if config.fetch_article else F.col("title")
    return payload(found, text, F.col("id"), meta=F.struct("*"), source_name="GoogleNews")


def find_key(tree: Any, key: str) -> Iterator[Any]:
    """Values of a key anywhere in nested JSON, in document order; values are not searched themselves."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            if k == key:
                yield v
            else:
                yield from find_key(v, key)
    elif isinstance(tree, list):
        for v in tree:
            yield from find_key(v, key)


def embedded_json(html: str, name: str) -> Any:
    """The JSON value assigned to a variable in a page's script."""
    found = re.search(re.escape(name) + r"""["'\]]*\s*[=:]\s*""", html)
    return json.JSONDecoder().raw_decode(html, found.end())[0] if found else None


def relative_time(text: str, now: datetime) -> datetime:
    """``3 weeks ago`` as a time."""
    found = re.search(r"(\d+)\s+(second|minute|hour|day|week|month|year)", text)
    if not found:
        raise ValueError(f"{text!r} is not a relative time")
    days = {"day": 1, "week": 7, "month": 30, "year": 365}
    n, unit = int(found[1]), found[2]
    return now - (timedelta(days=n * days[unit]) if unit in days else timedelta(**{unit + "s": n}))


def parse_comments(response: Any, now: datetime, *, replies: bool = False) -> list[dict]:
    """Comments of one response: id, ts, text and author; ids with a dot are replies."""
    out = []
    for c in find_key(response, "commentRenderer"):
        if "." in c["commentId"] and not replies:
            continue
        when = relative_time(c["publishedTimeText"]["runs"][0]["text"], now)
        out.append({"id": c["commentId"], "ts": when.timestamp(), "text": "".join(r["text"] for r in c["contentText"]["runs"]), "author": c.get("authorText", {}).get("simpleText", "")})
    return out


def comment_transport(load: Callable[[str], str], call: Callable[[Any], Any], *, replies: bool = False, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> Callable[[dict, str | None], tuple[list[dict], str | None]]:
    """A transport for polled reads of a video's comments: the page names the first continuation, each answer the next.

    ``load`` fetches the page of the request's ``url``, ``call`` posts a continuation and returns its JSON.
    """

    def read(request: dict, token: str | None) -> tuple[list[dict], str | None]:
        if token is None:
            section = next(find_key(embedded_json(load(request["url"]), "ytInitialData"), "itemSectionRenderer"), None)
            start = next(find_key(section, "continuationEndpoint"), None)
            if start is None:  # comments are disabled
                return [], None
            token = json.dumps(start)
        answer = call(json.loads(token))
        if error := next(find_key(answer, "externalErrorMessage"), None):
            raise OSError(error)
        following = next(find_key(answer, "continuationEndpoint"), None)
        return parse_comments(answer, clock(), replies=replies), json.dumps(following) if following else None

    return read


def video_comments(comments: DataFrame, since: datetime, *, max_comments: int = 20, cursors: DataFrame | None = None) -> DataFrame:
    """Payloads of video comments (key = video, id, ts, text), the newest of each video."""
    new = cursor.newest(cursor.newer(comments, cursors, since, record_id="id"), max_comments)
    return payload(new, F.col("text"), F.col("id"), meta=F.struct("*"), source_name="YoutubeScrapper")
