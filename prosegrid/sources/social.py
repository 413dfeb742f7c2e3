"""Short posts and their comments: search queries, author enrichment, posts with comments, feeds."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrid.functions.hashing import hex_id
from prosegrid.functions.html import visible_text_of
from prosegrid.functions.times import STAMP
from prosegrid.schema import payload
from prosegrid.sources import cursor
from prosegrid.sources.web import fetch

MAX_RESULTS = 100  # of one search call
DEFAULT_OPERATORS = ("-is:reply", "-is:retweet")


@dataclass
class SearchConfig:
    query: str | None = None
    keywords: Sequence[str] = ()
    hashtags: Sequence[str] = ()
    usernames: Sequence[str] = ()
    operators: Sequence[str] = DEFAULT_OPERATORS
    lookup_period: str | None = None
    since_id: int | None = None
    until_id: int | None = None
    max_results: int = 10
    fields: dict[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not (self.query or self.keywords or self.hashtags or self.usernames):
            raise ValueError("a search needs a query, keywords, hashtags or usernames")
        self.max_results = min(self.max_results, MAX_RESULTS)


def query_string(config: SearchConfig) -> str:
    """The search expression: groups of alternatives joined by OR, then the operators."""
    if config.query:
        return config.query
    groups = [f"({' OR '.join(own)})" for own in (config.keywords, config.hashtags, config.usernames) if own]
    required = f" ({' '.join(config.operators)})" if config.operators else ""
    return " OR ".join(groups) + required


def search_request(config: SearchConfig) -> dict:
    """The parameters of a search call; lists of fields are comma-joined, ids take the place of a period."""
    by_id = config.since_id is not None or config.until_id is not None
    own = {"query": query_string(config), "max_results": config.max_results, "since_id": config.since_id, "until_id": config.until_id}
    if config.lookup_period and not by_id:
        own["start_time"] = cursor.start_time(config.lookup_period).strftime(STAMP)
    return {k: v for k, v in (own | {name: ",".join(values) for name, values in config.fields.items()}).items() if v is not None}


def bearer_token(key: str, secret: str, url: str, post: Callable[..., bytes] = fetch) -> str:
    """An application's token for its key and secret (OAuth 2 client credentials)."""
    basic = base64.b64encode(f"{quote(key)}:{quote(secret)}".encode()).decode()
    headers = {"Authorization": f"Basic {basic}", "Content-Type": "application/x-www-form-urlencoded;charset=UTF-8"}
    return json.loads(post(url, headers=headers, data=b"grant_type=client_credentials"))["access_token"]


def matches(text: Column, config: SearchConfig, *, is_reply: Column, is_retweet: Column) -> Column:
    """The same search over a table of posts."""
    words = [*config.keywords, *[h if h.startswith("#") else f"#{h}" for h in config.hashtags], *config.usernames]
    out = F.lit(False)
    for word in words:
        out |= F.contains(F.lower(text), F.lit(word.lower()))
    flags = {"-is:reply": ~is_reply, "-is:retweet": ~is_retweet, "is:reply": is_reply, "is:retweet": is_retweet}
    for operator in config.operators:
        if operator not in flags:
            raise ValueError(f"operator {operator!r} has no meaning for a table")
        out &= flags[operator]
    return out


def with_authors(posts: DataFrame, users: DataFrame, *, author: str = "author_id", user_id: str = "id", username: str = "username", prefix: str = "https://twitter.com/") -> DataFrame:
    """Posts with ``author_info`` (null for unknown authors) and the post's address; users are one page of a search."""
    info = users.dropDuplicates([user_id]).select(
        F.col(user_id).alias("__user"), F.struct(*[F.col(c) for c in users.columns], F.concat(F.lit(prefix), F.col(username)).alias("user_url")).alias("author_info")
    )
    joined = posts.join(info, posts[author] == F.col("__user"), "left").drop("__user")
    return joined.withColumn("tweet_url", F.concat(F.lit(f"{prefix}twitter/statuses/"), F.col("id").cast("string")))


def posts_to_payloads(posts: DataFrame, config: SearchConfig, *, now: datetime | None = None, source_name: str = "Twitter") -> DataFrame:
    """Payloads of posts inside the configured ids and period."""
    if config.since_id is not None:
        posts = posts.where(F.col("id") > config.since_id)
    if config.until_id is not None:
        posts = posts.where(F.col("id") < config.until_id)
    if config.lookup_period and config.since_id is None and config.until_id is None:
        posts = cursor.newer(posts, None, cursor.start_time(config.lookup_period, now), ts="created_at")
    return payload(posts, F.col("text"), F.col("id"), meta=F.struct("*"), source_name=source_name)


def comments_of_posts(posts: DataFrame, comments: DataFrame, since: datetime, *, post_ids: Sequence[str] | None = None, cursors: DataFrame | None = None, source_name: str = "Facebook") -> DataFrame:
    """Payloads of comments (post_id, id, ts, text) of posts (id, ts) updated since then; each post has its own cursor."""
    chosen = posts.where(F.col("id").isin(list(post_ids))) if post_ids else cursor.newer(posts, None, since, key="id")
    new = cursor.newer(comments, cursors, since, key="post_id", record_id="id")
    found = new.join(chosen.select(F.col("id").alias("post_id")).distinct(), "post_id", "left_semi")
    return payload(found, F.col("text"), F.col("id"), meta=F.struct("*"), source_name=source_name)


def forum_comments(posts: DataFrame, comments: DataFrame, since: datetime, *, communities: Sequence[str], post_ids: Sequence[str] | None = None, include_post_meta: bool = True, post_meta_field: str = "post_meta", cursors: DataFrame | None = None) -> DataFrame:
    """Payloads of top-level forum comments (body_html) of the named communities, with their post in meta if wanted."""
    chosen = posts.where(F.col("community").isin(list(communities)))
    if post_ids:
        chosen = chosen.where(F.col("id").isin(list(post_ids)))
    new = cursor.newer(comments.where("parent_id is null"), cursors, since, key="post_id", record_id="id")
    joined = new.join(chosen.select(F.col("id").alias("post_id"), F.struct(*chosen.columns).alias("__post")), "post_id")
    columns = [F.col(c) for c in comments.columns] + ([F.col("__post").alias(post_meta_field)] if include_post_meta else [])
    return payload(joined, visible_text_of(F.col("body_html")), F.col("id"), meta=F.struct(*columns), source_name="Reddit")


def feed_payloads(entries: DataFrame, url: str, since: datetime, *, url_id: str | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """Payloads of feed entries (id, ts, title, content): the title and the visible text of the content."""
    keyed = entries.withColumn("key", F.lit(url_id or hex_id(url)))
    new = cursor.newer(keyed, cursors, since, record_id="id")
    return payload(new, F.concat_ws(". ", "title", visible_text_of(F.col("content"))), F.col("id"), meta=F.struct("*"), source_name="RedditScrapper")
