"""HTTP with retries, crawled pages and feeds."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions.html import article_of
from prosegrid.schema import payload

RETRY_ON = (404, 429)  # a service may know a new object a little later


def fetch(url: str, *, headers: dict | None = None, data: bytes | None = None, method: str | None = None, total: int = 3, backoff: float = 3.0, retry_on: Sequence[int] = RETRY_ON, timeout: float = 30, opener: Callable | None = None) -> bytes:
    """The body of a response; statuses in ``retry_on`` and failed connections are tried ``total`` more times."""
    send = opener or (lambda request: urllib.request.urlopen(request, timeout=timeout).read())
    for attempt in range(total + 1):
        try:
            return send(urllib.request.Request(url, data=data, headers=headers or {}, method=method))
        except urllib.error.HTTPError as error:
            if error.code not in retry_on or attempt == total:
                raise
        except urllib.error.URLError:
            if attempt == total:
                raise
        time.sleep(backoff * 2**attempt if attempt else 0)
    raise AssertionError


@dataclass
class CrawlerConfig:
    urls: Sequence[str] = field(default_factory=list)
    is_feed: bool = False
    is_sitemap: bool = False
    include_comments: bool = True
    find_urls: Callable[[str], list[str]] | None = None
    extract: Callable[[Column], Column] = article_of


def links_of(document: str, *, feed: bool = False) -> list[str]:
    """URLs of a sitemap (``loc``) or of a feed's entries (``link`` text or its ``href``), in their order."""
    found = []
    for element in ET.fromstring(document).iter():
        tag = element.tag.rsplit("}", 1)[-1]
        if tag == ("link" if feed else "loc") and (url := (element.text or "").strip() or element.get("href", "")):
            found.append(url)
    return list(dict.fromkeys(found))


def expand_urls(config: CrawlerConfig, load: Callable[[str], str]) -> list[str]:
    """The URLs to crawl: a sitemap goes before a feed; otherwise the URLs themselves."""
    if not (config.is_sitemap or config.is_feed):
        return list(config.urls)
    find = config.find_urls or (lambda document: links_of(document, feed=not config.is_sitemap))
    return [u for url in config.urls for u in find(load(url))]


def crawled(pages: DataFrame, *, config: CrawlerConfig | None = None, key: str = "page_id", url: str = "url", html: str = "html", source_name: str = "Crawler") -> DataFrame:
    """Payloads of pages that have an article: text, then comments; pages without one are left out."""
    config = config or CrawlerConfig()
    extract = config.extract
    found = pages.select(F.col(key).alias("__key"), F.col(url).alias("url"), extract(F.col(html)).alias("a")).where("a.text is not null")
    text = F.concat_ws(". ", "a.text", "a.comments") if config.include_comments else F.col("a.text")
    return payload(found, text, F.col("__key"), meta=F.struct("url", "a.title", "a.author", "a.description", "a.language"), source_name=source_name)


def feed_entries(document: str) -> list[dict]:
    """Entries of an RSS or Atom document: id, title, link, published and content."""
    out = []
    for element in ET.fromstring(document).iter():
        if element.tag.rsplit("}", 1)[-1] not in ("item", "entry"):
            continue
        own = {c.tag.rsplit("}", 1)[-1]: (c.text or c.get("href") or "").strip() for c in element}
        out.append({
            "id": own.get("guid") or own.get("id") or own.get("link"), "title": own.get("title", ""), "link": own.get("link"),
            "published": own.get("pubDate") or own.get("updated") or own.get("published"), "content": own.get("encoded") or own.get("content") or own.get("description") or own.get("summary") or "",
        })
    return out


def json_of(url: str, **options) -> dict:
    return json.loads(fetch(url, **options))
