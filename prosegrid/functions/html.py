"""Visible text of HTML and articles of pages, with the standard parser in Arrow functions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from prosegrid.functions.arrow import arrow_function

# Elements whose own text is not visible, and elements without content.
HIDDEN = {"style", "script", "head", "title", "meta"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BOILERPLATE = {"nav", "footer", "header", "aside", "form", "noscript", "button"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd"}


class _Nodes(HTMLParser):
    """Collects (parents, number of block elements so far, text) of every text node."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[tuple[tuple[str, ...], int, str]] = []
        self.blocks = 0
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag == "meta" and (key := named.get("name") or named.get("property")):
            self.meta.setdefault(key.lower(), named.get("content") or "")
        if tag == "html" and named.get("lang"):
            self.meta.setdefault("language", named["lang"] or "")
        self.blocks += tag in BLOCKS
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.nodes.append((tuple(self.open), self.blocks, data))


def _parse(html: str) -> _Nodes:
    parser = _Nodes()
    parser.feed(html)
    parser.close()
    return parser


def visible_text(html: str | None) -> str | None:
    """Text nodes whose parent is visible, stripped and joined by a blank (empty nodes leave their blank)."""
    if html is None:
        return None
    return " ".join(text.strip() for parents, _, text in _parse(html).nodes if parents and parents[-1] not in HIDDEN)


def article(html: str | None) -> dict[str, str | None] | None:
    """Title, main text, comments and metadata of a page; None if there is no text."""
    if not html:
        return None
    parsed = _parse(html)
    title = " ".join(t.strip() for p, _, t in parsed.nodes if p and p[-1] == "title") or None
    blocks: list[str] = []
    comments: list[str] = []
    last = 0
    for parents, block, text in parsed.nodes:
        if not text.strip() or HIDDEN & set(parents) or BOILERPLATE & set(parents) or not BLOCKS & set(parents):
            continue
        into = comments if "comment" in parents else blocks
        if last == block and into:
            into[-1] += " " + " ".join(text.split())
        else:
            into.append(" ".join(text.split()))
        last = block
    if not blocks:
        return None
    keep = {k: parsed.meta.get(k) for k in ("author", "description", "language")}
    return {"title": title, "text": "\n".join(blocks), "comments": "\n".join(comments) or None, **keep}


@arrow_function("string")
def visible_text_of(html: pd.Series) -> pd.Series:
    return html.map(visible_text)


ARTICLE = "struct<title:string,text:string,comments:string,author:string,description:string,language:string>"


@arrow_function(ARTICLE)
def article_of(html: pd.Series) -> pd.DataFrame:
    names = ["title", "text", "comments", "author", "description", "language"]
    return pd.DataFrame([article(h) or dict.fromkeys(names) for h in html], columns=names, dtype=object)
