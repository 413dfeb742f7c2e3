"""Delivery: every executor sends the records of its partitions; nothing passes through the driver.

A transport is a function from (request dict) to a response; the default one honours the request's
method and headers and sends its ``json`` or ``ndjson`` body. Each sink
is a convertor plus a request builder, so that payloads can be tested without a network.
"""

from __future__ import annotations

import base64
import json
import logging
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from prosegrid.functions.render import to_json, to_json_bytes
from prosegrid.sinks import convert
from prosegrid.sources.web import fetch

Transport = Callable[[dict], object]


def post(request: dict) -> object:
    """Sends a request; newline-delimited bodies are sent as they are, others as JSON."""
    lines = "ndjson" in request
    body = request["ndjson"].encode() if lines else to_json_bytes(request["json"])
    kind = "application/x-ndjson" if lines else "application/json"
    return fetch(request["url"], headers={"Content-Type": kind, **request.get("headers", {})}, data=body, method=request.get("method", "POST"))


@dataclass
class Sink:
    """Converts each payload and hands it to the transport."""

    convertor: convert.Convertor = field(default_factory=convert.overlay)
    request: Callable[[dict], dict] = lambda record: {"json": record}
    transport: Transport = post
    prepare: Callable[[DataFrame], DataFrame] = lambda payloads: payloads  # columns that the convertor needs, made in the JVM

    def requests(self, rows: Iterator[Row]) -> Iterator[dict]:
        for row in rows:
            yield self.request(self.convertor(row.asDict()))

    def send(self, payloads: DataFrame) -> None:
        """An action: sends all rows, at least once."""

        def run(rows: Iterator[Row]) -> None:
            for request in self.requests(rows):
                self.transport(request)

        self.prepare(payloads).foreachPartition(run)


def http_sink(url: str, *, headers: Mapping | None = None, base_payload: Mapping | None = None, payload_mapping: Mapping | None = None, field_conversion: Mapping | None = None, transport: Transport = post) -> Sink:
    own = convert.mapped(payload_mapping, field_conversion, convert.overlay(base_payload))
    return Sink(own, lambda r: {"url": url, "headers": dict(headers or {}), "json": r}, transport)


def enquiry_sink(url: str, *, partner_id: str, consumer_phone_number: str, source_information: str, headers: Mapping | None = None, base_payload: Mapping | None = None, use_enquiry_api: bool = False, transport: Transport = post) -> Sink:
    base = {**(base_payload or {}), **({} if use_enquiry_api else {"partnerId": partner_id, "consumerPhoneNumber": consumer_phone_number})}
    prepare = lambda payloads: convert.enquiries(payloads, partner_id=partner_id, source_information=source_information, base=base, use_enquiry_api=use_enquiry_api)
    return Sink(convert.ready, lambda r: {"url": url, "headers": dict(headers or {}), "json": r}, transport, prepare)


def issue_sink(url: str, *, project: Mapping, issue_type: Mapping, username: str, password: str, summary_max_length: int = 50, transport: Transport = post) -> Sink:
    if not (username and password):
        raise ValueError("an issue tracker needs a username and a password")
    own = convert.issue(base={"project": dict(project), "issuetype": dict(issue_type)}, summary_max_length=summary_max_length)
    return Sink(own, lambda r: {"url": f"{url}/rest/api/2/issue", "headers": basic_auth(username, password), "json": {"fields": r}}, transport)


def basic_auth(user: str, secret: str) -> dict:
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{secret}".encode()).decode()}


def ticket_auth(*, email: str | None = None, password: str | None = None, token: str | None = None, oauth_token: str | None = None) -> dict:
    """Headers by precedence: OAuth, e-mail and API token, e-mail and password; password and token exclude each other."""
    if password and token:
        raise ValueError("give a password or a token, not both")
    if oauth_token:
        return {"Authorization": f"Bearer {oauth_token}"}
    if email and token:
        return basic_auth(f"{email}/token", token)
    if email and password:
        return basic_auth(email, password)
    raise ValueError("no credentials")


def ticket_sink(*, domain: str = "zendesk.com", subdomain: str | None = None, auth: Mapping | None = None, base_payload: Mapping | None = None, summary_max_length: int = 50, labels_count: int = 1, transport: Transport = post) -> Sink:
    own = convert.ticket(base=base_payload, summary_max_length=summary_max_length, labels_count=labels_count)
    host = f"{subdomain}.{domain}" if subdomain else domain
    return Sink(own, lambda r: {"url": f"https://{host}/api/v2/tickets.json", "headers": dict(auth or {}), "json": {"ticket": {**r["ticket"], "subject": r["subject"], "tags": r["tags"], "comment": {**r["ticket"]["comment"], "html_body": r["html_body"]}}}}, transport)


def message_sink(channel: str, token: str, *, template: str | None = None, icon_url: str | None = None, is_markdown: bool = True, url: str = "https://slack.com/api/chat.postMessage", transport: Transport = post) -> Sink:
    return Sink(convert.message(template), lambda r: {"url": url, "headers": {"Authorization": f"Bearer {token}"}, "json": {**r, "channel": channel, "icon_url": icon_url, "mrkdwn": is_markdown}}, transport)


def log_sink(name: str = "prosegrid", level: int = logging.INFO) -> Sink:
    return Sink(transport=lambda request: logging.getLogger(name).log(level, to_json(request["json"])))


def bulk_actions(payloads: DataFrame, index: str = "es_index", base: Mapping | None = None) -> Column | DataFrame:
    """One row a payload: the action line and the source line of a bulk request, as JSON."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("create")))
    return payloads.select("payload_id", action.alias("action"), convert.overlay_column(base).alias("source"))


#: Fixed value: the default index template, strings as keywords.
STRING_KEYWORDS = {"mappings": {"dynamic_templates": [{"strings": {"path_match": "*", "match_mapping_type": "string", "mapping": {"type": "keyword"}}}]}}


@dataclass
class SearchIndexSink:
    """Bulk requests of ``batch`` payloads to a search index."""

    url: str
    index: str = "es_index"
    refresh: str = "wait_for"
    base_payload: Mapping | None = None
    custom_mapping: Mapping | None = None
    batch: int = 500
    transport: Transport = post

    def create_index(self, exists: Callable[[str], bool]) -> None:
        """Creates the index; that another worker was faster is no error."""
        try:
            self.transport({"url": f"{self.url}/{self.index}", "method": "PUT", "json": dict(self.custom_mapping or STRING_KEYWORDS)})
        except Exception:
            if not exists(self.index):
                raise

    def send(self, payloads: DataFrame) -> None:
        def run(rows: Iterator[Row]) -> None:
            held: list[str] = []
            for row in rows:
                held += [row["action"], row["source"]]
                if len(held) >= 2 * self.batch:
                    self.transport({"url": f"{self.url}/_bulk?refresh={self.refresh}", "ndjson": "\n".join(held) + "\n"})
                    held = []
            if held:
                self.transport({"url": f"{self.url}/_bulk?refresh={self.refresh}", "ndjson": "\n".join(held) + "\n"})

        bulk_actions(payloads, self.index, self.base_payload).foreachPartition(run)


def loads(line: str) -> dict:
    return json.loads(line)
