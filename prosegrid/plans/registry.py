"""The registered queries of the text engine: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.functions import cleaning, html, render, sentiment, times
from prosegrid.functions.hashing import hex_id_of
from prosegrid.functions.tokens import sentences, white_space_tokens, word_tokens
from prosegrid.operators import aggregate, analyze, clean, split
from prosegrid.schema import payload, with_segment
from prosegrid.scratch import scratch_path
from prosegrid.sinks import convert, deliver
from prosegrid.sources import cursor, frames, media, polling, reviews, social, web
from prosegrid.sources.tables import read_table as _table
from prosegrid.state import upsert
from prosegrid.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CUTOFF = datetime(2024, 1, 20, tzinfo=timezone.utc)
STOP = ["the", "of", "and", "in", "to", "de", "la", "der", "die", "und", "que", "el"]
KEYWORDS = [("the", "THE"), ("tion", "TION"), ("la ", "LA ")]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return payload(docs, F.col("text"), F.col("doc_id"), meta=F.struct("doc_id", "lang", "source"), source_name="documents")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return payload(rows, F.col("text"), F.concat_ws("-", "conv_id", "turn"), meta=F.struct("conv_id", "turn", "role"), source_name="conversations")


def _text(df: DataFrame) -> DataFrame:
    return df.select("payload_id", "processed_text")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads, cleaned, scored and flattened: source to sink in one lazy plan."""
    config = clean.CleanerConfig([cleaning.lower_case(), cleaning.white_space(), cleaning.punctuation(), cleaning.special_characters()], white_space_tokens)
    scored = analyze.lexicon_sentiment(clean.clean(_documents(spark, sf_dir), config), rules=False)
    return scored.select(
        "payload_id", "source_name", F.col("meta.lang").alias("meta_lang"), F.length("processed_text").alias("n_clean"),
        F.round(F.col("segmented_data.classifier_data")["positive"], 6).alias("positive"), F.round(F.col("segmented_data.classifier_data")["negative"], 6).alias("negative"),
    )


@query
def flagship_clean_score_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


# Sources


@query
def source_dataframe_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.from_frame(_table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], payload_id=F.col("p_partkey"))
    return rows.select("payload_id", "processed_text", "source_name")


@query
def source_include_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.from_frame(_table(spark, sf_dir, "documents"), ["lang", "source"], separator="/", include_columns=["lang", "n_chars"], payload_id=F.col("doc_id"))
    return rows.select("payload_id", "processed_text", F.col("meta.lang").alias("meta_lang"), F.col("meta.n_chars").alias("meta_n_chars"))


@query
def source_lookback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = times.parse_time("10d", datetime(2024, 1, 30, tzinfo=timezone.utc))
    return cursor.newer(_table(spark, sf_dir, "events"), None, since).select("event_id", "user_id", "event_type")


@query
def source_newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.newest(_table(spark, sf_dir, "events"), 20, key="event_type", record_id="event_id").select("event_id", "event_type")


@query
def source_cursor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = cursor.advance(_table(spark, sf_dir, "events"), key="user_id", record_id="event_id")
    return moved.select("key", F.unix_micros(F.col("since_time").cast("timestamp")).alias("since_micros"), "since_id")


@query
def source_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    cursors = cursor.advance(events.where(F.col("ts") <= F.lit(CUTOFF)), key="user_id", record_id="event_id")
    return cursor.newer(events, cursors, CUTOFF, key="user_id", record_id="event_id").select("event_id", "user_id")


@query
def source_user_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"))
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return social.with_authors(posts, users).select("id", F.col("author_info.username").alias("username"), F.col("author_info.user_url").alias("user_url"), "tweet_url")


@query
def source_search_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = social.SearchConfig(keywords=["please", "explain"], hashtags=["help"], usernames=["the"])
    rows = _table(spark, sf_dir, "conversations")
    keep = social.matches(F.col("text"), config, is_reply=F.col("turn") > 2, is_retweet=F.col("role") == "system")
    return rows.where(keep).select("conv_id", "turn")


@query
def source_search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.concat_ws(" ", "event_type", "props").alias("text"))
    config = social.SearchConfig(query="any", lookup_period="10d")
    return _text(social.posts_to_payloads(posts, config, now=datetime(2024, 1, 30, tzinfo=timezone.utc)))


@query
def source_comments_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    lines = _table(spark, sf_dir, "lineitem")
    comments = lines.select(F.col("l_orderkey").alias("post_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"), F.concat_ws("", "l_returnflag", "l_linestatus").alias("text"))
    return _text(social.comments_of_posts(posts, comments, datetime(1996, 6, 1, tzinfo=timezone.utc)))


@query
def source_forum_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("community"), F.col("o_orderstatus").alias("title"))
    lines = _table(spark, sf_dir, "lineitem")
    comments = lines.select(
        F.col("l_orderkey").alias("post_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("parent_id"), F.concat(F.lit("<p>"), "l_returnflag", F.lit("</p>")).alias("body_html"),
    )
    found = social.forum_comments(posts, comments, datetime(1996, 6, 1, tzinfo=timezone.utc), communities=["1-URGENT", "2-HIGH"])
    return found.select("payload_id", "processed_text", F.col("meta.post_meta.title").alias("post_title"))


@query
def source_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("title"), F.concat(F.lit("<p>"), F.col("user_id").cast("string"), F.lit("</p>")).alias("content"))
    return _text(social.feed_payloads(entries, "https://example.org/r/x/.rss", CUTOFF))


@query
def source_app_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("p_partkey") % 7 == 0, F.lit("https://apps.example.com/us/app")).otherwise(
        F.concat(F.lit("https://apps.example.com/us/app/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/id"), F.col("p_partkey").cast("string"))
    )
    return _table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in reviews.app_address_columns(url).items()])


@query
def source_package_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://play.example.com/store/apps/details?id=com%2E"), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit("&gl=us&hl=en"))
    return _table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in reviews.package_address_columns(url).items()])


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("country"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("title"), F.col("props").alias("content"), (F.col("user_id") % 5 + 1).alias("score")
    )


@query
def source_app_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = reviews.AppReviewsConfig(app_id="1", countries=["click", "view", "purchase"], lookup_period="10d", max_count=50)
    return _text(reviews.app_reviews(_reviews(spark, sf_dir), config, now=datetime(2024, 1, 30, tzinfo=timezone.utc)))


@query
def source_package_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = reviews.PackageReviewsConfig(package_name="a.b", countries=["click", "view", "purchase"], filter_score_with=3, lookup_period="10d")
    return _text(reviews.package_reviews(_reviews(spark, sf_dir), config, now=datetime(2024, 1, 30, tzinfo=timezone.utc)))


@query
def source_publisher_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.struct(F.struct(F.col("props").alias("text")).alias("userComment"))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("reviewId"), F.array(comment).alias("comments"))
    return _text(reviews.publisher_reviews(rows))


@query
def source_place_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    review = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"), F.col("l_returnflag").alias("review_text"), F.unix_timestamp("l_shipdate").alias("review_timestamp"), F.lit("review").alias("kind"))
    places = lines.groupBy(F.col("l_suppkey").alias("place_id")).agg(F.collect_list(review).alias("reviews_data")).withColumn("kind", F.lit("place"))
    found = reviews.place_reviews(places, since=datetime(1996, 6, 1, tzinfo=timezone.utc))
    return found.select("payload_id", "processed_text", F.col("meta.place_id").alias("place_id"), F.col("meta.kind").alias("kind"))


@query
def source_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = datetime(2024, 1, 30, tzinfo=timezone.utc)
    config = media.NewsConfig("x", after_date="2024-01-20", fetch_article=True)
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("text"))
    return _text(media.news(rows, config, now))


@query
def source_video_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("text"))
    return _text(media.video_comments(rows, CUTOFF, max_comments=30))


@query
def source_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html.visible_text_of(F.col("html")).alias("visible"))


@query
def source_crawler(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.crawled(_table(spark, sf_dir, "pages"))
    return found.select("payload_id", "processed_text", F.col("meta.title").alias("title"), F.col("meta.language").alias("language"))


@query
def source_url_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", hex_id_of(F.col("url")).alias("url_id"))


def _numbered(request: dict, token: str | None) -> tuple[list[dict], str | None]:
    """A service with 100 records a request, 30 a page, one a minute."""
    upto = int(token) if token else 100
    records = [{"id": n, "ts": 1_700_000_000 + 60 * n, "text": f"{request['key']} {n}"} for n in range(upto, max(0, upto - 30), -1)]
    return records, str(upto - 30) if upto > 30 else None


@query
def source_polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(polling.data_source({"numbered": _numbered}))
    requests = render.to_json([{"key": k} for k in ("us", "fr", "de")])
    rows = spark.read.format("polled").options(requests=requests, transport="numbered", since=str(1_700_000_000 + 60 * 20), maxCount="50").load()
    return rows.select("key", "id", F.unix_timestamp("ts").alias("ts"), F.get_json_object("body", "$.text").alias("text"))


# Cleaning


def _cleaned(spark: SparkSession, sf_dir: str, *steps: cleaning.Cleaner, tokenizer=white_space_tokens) -> DataFrame:
    return _text(clean.clean(_documents(spark, sf_dir), clean.CleanerConfig(list(steps), tokenizer)))


@query
def clean_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.lower_case())


@query
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.white_space(), tokenizer=None)


@query
def clean_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.punctuation())


@query
def clean_special_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.special_characters())


@query
def clean_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.stop_words(STOP))


@query
def clean_domain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.domain_keywords(KEYWORDS))


@query
def clean_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.substitute("([a-z])([0-9])", r"\1 \2"))


@query
def clean_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.decode_unicode())


@query
def clean_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.stemming())


@query
def clean_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, cleaning.lemmatization(lambda t: {"was": "be", "is": "be", "are": "be"}.get(t, t)))


@query
def clean_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir)
    return _text(clean.clean(rows, clean.CleanerConfig([cleaning.date_time()], white_space_tokens)))


@query
def clean_default_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(clean.clean(_conversations(spark, sf_dir)))


@query
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("payload_id", F.size(word_tokens(F.col("processed_text"))).alias("n_tokens"))


@query
def tokenize_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("payload_id", F.posexplode(sentences(F.col("processed_text"))).alias("n", "sentence"))


# Splitting


def _chunks(df: DataFrame) -> DataFrame:
    return df.select(F.col("splitter.document_id").alias("document_id"), F.col("splitter.chunk_id").alias("chunk_id"), F.col("splitter.chunk_length").alias("chunk_length"), F.col("splitter.total_chunks").alias("total_chunks"), F.col("splitter.phrase").alias("phrase"))


@query
def split_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(split.split(_documents(spark, sf_dir), split.SplitterConfig(512, document_id_key="doc_id")))


@query
def split_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(split.split(_documents(spark, sf_dir), split.SplitterConfig(512, 128)))


@query
def split_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(split.split(_documents(spark, sf_dir), split.SplitterConfig(128, honor_paragraph_boundary=True, paragraph_marker="\n")))


@query
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(split.split(_documents(spark, sf_dir), split.SplitterConfig(512, enable_sentence_split=True)))


# Analyzers


def _classes(df: DataFrame) -> DataFrame:
    return df.select("payload_id", F.explode("segmented_data.classifier_data").alias("label", "score")).withColumn("score", F.round("score", 6))


@query
def analyze_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.dummy(_documents(spark, sf_dir), "seen").select("payload_id", F.col("segmented_data.dummy_data").alias("dummy_data"))


@query
def analyze_merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = analyze.dummy(analyze.dummy(_documents(spark, sf_dir), "first"), "second")
    return twice.select("payload_id", F.col("segmented_data.dummy_data").alias("dummy_data"))


@query
def analyze_sentiment_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(analyze.lexicon_sentiment(_conversations(spark, sf_dir), rules=False))


@query
def analyze_sentiment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(analyze.lexicon_sentiment(_conversations(spark, sf_dir)))


@query
def analyze_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = analyze.ClassifierConfig(label_map={"LABEL_1": "long", "LABEL_0": "short"})

    def load():
        return lambda texts: [{"LABEL_1" if len(t) >= 500 else "LABEL_0": 0.75} for t in texts]

    return _classes(analyze.classify(_documents(spark, sf_dir), load, config, max_length=None))


@query
def analyze_zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = analyze.ClassifierConfig(labels=["facility", "food", "comfortable"])
    return _classes(analyze.zero_shot(_conversations(spark, sf_dir), config, max_length=None))


@query
def analyze_zero_shot_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(analyze.zero_shot_sentiment(_conversations(spark, sf_dir), max_length=None))


@query
def analyze_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.entities(_conversations(spark, sf_dir), max_length=None)
    return found.select("payload_id", F.explode("segmented_data.ner_data").alias("e")).select("payload_id", "e.entity_group", "e.word", "e.start", "e.end")


@query
def analyze_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = analyze.translate(_conversations(spark, sf_dir), analyze.dictionary_translator({"the": "le", "and": "et"}), max_length=None)
    return done.select("payload_id", "processed_text", F.col("segmented_data.translation_data.original_text").alias("original_text"))


@query
def analyze_pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.personal_data(_documents(spark, sf_dir), analyze.PIIConfig(entities=["EMAIL_ADDRESS"], analyze_only=True))
    return found.select("payload_id", F.size("segmented_data.pii_data.analyzer_result").cast("long").alias("n_found"))


@query
def analyze_pii_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.personal_data(_documents(spark, sf_dir), analyze.PIIConfig(entities=["IP_ADDRESS"], analyze_only=True))
    return found.select("payload_id", F.size("segmented_data.pii_data.analyzer_result").cast("long").alias("n_found"))


@query
def anonymize_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(analyze.personal_data(_documents(spark, sf_dir), analyze.PIIConfig(entities=["EMAIL_ADDRESS"])))


# Aggregation


def _scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = split.split(_documents(spark, sf_dir), split.SplitterConfig(512))
    share = lambda c: (F.length("processed_text") - F.length(F.replace("processed_text", F.lit(c), F.lit("")))) / F.length("processed_text")
    both = F.create_map(F.lit("e"), share("e"), F.lit("t"), share("t"))
    return with_segment(chunks, "classifier_data", F.map_filter(both, lambda k, v: v > 0.02))


@query
def aggregate_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = aggregate.aggregate(_scored_chunks(spark, sf_dir))
    rows = done.select("payload_id", F.length("processed_text").alias("n_chars"), F.explode_outer("segmented_data.aggregator_data.avg_score").alias("label", "score"))
    return rows.withColumn("score", F.round("score", 6))


@query
def aggregate_max_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = aggregate.aggregate(_scored_chunks(spark, sf_dir), aggregate.MaxCategories(0.11))
    data = F.col("segmented_data.aggregator_data")
    rows = done.select("payload_id", data["max_scores"].alias("m"), F.explode(data["category_count"]).alias("label", "n"))
    return rows.select("payload_id", "label", "n", F.round(F.col("m")[F.col("label")], 6).alias("top"))


@query
def aggregate_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(aggregate.aggregate(_conversations(spark, sf_dir)))


@query
def analyze_split_and_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = analyze.ClassifierConfig(True, split.SplitterConfig(512), labels=["food", "facility"])
    done = analyze.zero_shot(_conversations(spark, sf_dir), config, max_length=None)
    return done.select("payload_id", F.explode("segmented_data.aggregator_data.avg_score").alias("label", "score")).withColumn("score", F.round("score", 6))


# Sinks and utilities


@query
def sink_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    nested = events.select("event_id", F.struct("event_type", F.struct("user_id", "value").alias("who")).alias("meta"))
    return convert.flat_rows(nested)


@query
def sink_frame_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyze.dummy(_documents(spark, sf_dir), "x")
    old = spark.createDataFrame([("old", "kept")], "payload_id string, note string")
    return convert.appended(old, rows.select("payload_id", "source_name", "segmented_data"), ["payload_id", "source_name", "segmented_data_dummy_data"])


@query
def sink_sentiment_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.pmod(F.col("event_id"), F.lit(101)) / 100
    return _table(spark, sf_dir, "events").select("event_id", convert.sentiment_label_column(1 - share, share - 0.2).alias("label"))


@query
def sink_json_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver.bulk_actions(_conversations(spark, sf_dir)).select("payload_id", "action", F.get_json_object("source", "$.processed_text").alias("text"), F.get_json_object("source", "$.meta.role").alias("role"))


@query
def sink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("payload_id", render.shortened(F.col("processed_text"), 50).alias("summary"))


@query
def util_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    kind = F.col("event_id") % 5
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm", "yyyyMMddHHmm", "yyyy-MM-dd"]
    text = F.coalesce(*[F.when(kind == k, F.date_format("ts", s)) for k, s in enumerate(shapes)], F.lit("no time"))
    return events.select("event_id", times.epoch_column(text).alias("epoch"))


@query
def util_sentiment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("payload_id", F.round(sentiment.lexicon_compound(F.col("processed_text")), 6).alias("compound"))


# State and streams


@query
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "event_type")
    old, new = events.where("version % 2 = 0"), events.where("version % 2 = 1")
    return upsert(old, new)


@query
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = scratch_path(spark, "stream"), _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file or a folder
    run = incremental.run_available(stream, f"{path}/checkpoint", lambda rows: rows.write.mode("append").parquet(f"{path}/out"), steps=[lambda df: df.where("value > 10")])
    run.awaitTermination()
    done = spark.read.schema(events.schema).parquet(f"{path}/out")
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = incremental.windowed_counts(_table(spark, sf_dir, "events"))
    return counted.select(F.unix_timestamp("window_start").alias("window_epoch"), "event_type", "n", F.round("total", 2).alias("total"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
