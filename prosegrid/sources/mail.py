"""E-mail messages from raw RFC 822 bytes (files read by ``binaryFile`` or a mailbox transport)."""

from __future__ import annotations

import base64
import email
import imaplib
from collections.abc import Callable
from datetime import datetime, timezone
from email.header import decode_header, make_header
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.functions.arrow import arrow_function
from prosegrid.functions.html import visible_text
from prosegrid.schema import payload
from prosegrid.sources import cursor

PART = "struct<content_type:string,content_disposition:string,email_body:string>"
MESSAGE = f"struct<subject:string,from_address:string,to_address:string,date_received:timestamp,message_id:string,parts:array<{PART}>,content:string>"


def _header(message, name: str) -> str:
    value = message.get(name)
    return "" if value is None else str(make_header(decode_header(str(value))))


def parse_message(raw: bytes) -> dict:
    """Headers, parts and the text of a message: all text parts but attachments, HTML as visible text."""
    message = email.message_from_bytes(raw)
    parts = []
    for part in message.walk():
        kind, disposition = part.get_content_type(), str(part.get("Content-Disposition") or "")
        body = None
        if kind.startswith("text/") and "attachment" not in disposition:
            body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
            body = visible_text(body) if kind == "text/html" else body
        parts.append({"content_type": kind, "content_disposition": disposition or None, "email_body": body})
    try:
        received = parsedate_to_datetime(_header(message, "Date"))
        received = received.replace(tzinfo=timezone.utc) if received.tzinfo is None else received.astimezone(timezone.utc)
    except (TypeError, ValueError):
        received = None
    bodies = "".join("\n" + p["email_body"] for p in parts if p["email_body"] is not None)
    return {
        "subject": _header(message, "Subject"), "from_address": _header(message, "From"), "to_address": _header(message, "To"),
        "date_received": received, "message_id": _header(message, "Message-ID"), "parts": parts, "content": bodies,
    }


def mailbox_transport(connect: Callable[[dict], imaplib.IMAP4], page: int = 50) -> Callable[[dict, str | None], tuple[list[dict], str | None]]:
    """A transport for polled reads of IMAP mailboxes, newest first; a request names its mailbox under ``key``."""

    def read(request: dict, token: str | None) -> tuple[list[dict], str | None]:
        client = connect(request)
        try:
            status, counted = client.select(request["key"], readonly=True)
            if status != "OK":
                raise OSError(f"cannot open mailbox {request['key']!r}: {status}")
            newest = int(token) if token else int(counted[0])
            records = []
            for number in range(newest, max(0, newest - page), -1):
                parts = client.fetch(str(number), "(RFC822)")[1]
                raw = next(part[1] for part in parts if isinstance(part, tuple))
                found = parse_message(raw)
                if found["date_received"] is not None:
                    records.append({"id": found["message_id"], "ts": found["date_received"].timestamp(), "raw": base64.b64encode(raw).decode()})
            return records, str(newest - page) if newest > page else None
        finally:
            client.logout()

    return read


@arrow_function(MESSAGE)
def message_of(raw: pd.Series) -> pd.DataFrame:
    rows = [parse_message(bytes(r)) for r in raw]
    out = pd.DataFrame(rows, columns=["subject", "from_address", "to_address", "date_received", "message_id", "parts", "content"])
    out["date_received"] = pd.to_datetime(out["date_received"], utc=True).dt.tz_localize(None)
    return out


def messages(raw: DataFrame, since: datetime, *, cursors: DataFrame | None = None, mailbox: str = "mailbox", content: str = "content") -> DataFrame:
    """Payloads of messages newer than their mailbox's cursor: the subject, a line end and the text."""
    parsed = raw.select(F.col(mailbox).alias("mailbox"), message_of(F.col(content)).alias("m"))
    flat = parsed.select("mailbox", "m.*").withColumnRenamed("content", "body")
    new = cursor.newer(flat, cursors, since, key="mailbox", ts="date_received", record_id="message_id")
    meta = F.struct("mailbox", "subject", "from_address", "to_address", "date_received", "message_id", "parts")
    return payload(new, F.concat_ws("\n", "subject", "body"), F.col("message_id"), meta=meta, source_name="Email")
