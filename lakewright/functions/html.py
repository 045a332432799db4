"""HTML to text with the standard library parser, run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without readable content, elements outside the main content, and void elements.
NO_TEXT = frozenset({"script", "style", "noscript", "template", "svg", "iframe"})
BOILERPLATE = frozenset({"nav", "header", "footer", "aside", "form"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCKS = frozenset({"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"})
INVISIBLE = re.compile("[​‌‍⁠﻿­]")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ACTIVE_RUN = re.compile(r"[ \t\r\n]+")


class _PageText(HTMLParser):
    """Collects the title and visible text; ``block`` limits it to one element kind or class."""

    def __init__(self, block: str | None):
        super().__init__(convert_charrefs=True)
        self.block = block
        self.open: list[tuple[str, bool, bool]] = []  # (tag, hides, inside block)
        self.title: list[str] = []
        self.out: list[str] = []
        self.in_title = False

    def _hides(self, tag, attrs) -> bool:
        style = attrs.get("style") or ""
        return (
            tag in NO_TEXT or tag in BOILERPLATE or "hidden" in attrs
            or attrs.get("aria-hidden") == "true" or bool(HIDDEN_STYLE.search(style))
        )

    def _is_block(self, tag, attrs) -> bool:
        if self.block is None:
            return True
        if self.block.startswith("."):
            return self.block[1:] in (attrs.get("class") or "").split()
        if self.block.startswith("#"):
            return attrs.get("id") == self.block[1:]
        return tag == self.block

    def _state(self) -> tuple[bool, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, self.block is None)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "title":
            self.in_title = True
        if tag == "br":
            self._add("\n")
        if tag in VOID:
            return
        hidden, inside = self._state()
        starts = not inside and self._is_block(tag, attrs)
        # the block is cut out before hidden elements are removed: a hidden ancestor does not hide it
        hides = self._hides(tag, attrs) if starts else hidden or self._hides(tag, attrs)
        self.open.append((tag, hides, inside or starts))
        if tag in BLOCKS:
            self._add("\n\n" + ("#" * int(tag[1]) + " " if len(tag) == 2 and tag[1].isdigit() else ""))
        elif tag == "li":
            self._add("\n- ")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if not any(t == tag for t, _, _ in self.open):
            return
        if tag in BLOCKS:
            self._add("\n\n")
        while self.open and self.open.pop()[0] != tag:
            pass

    def _add(self, text: str):
        hidden, inside = self._state()
        if inside and not hidden:
            self.out.append(text)

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif data:
            self._add(ACTIVE_RUN.sub(" ", data))


def page_text(html: str, block: str | None = None) -> tuple[str, str]:
    """(title, text) of one page; empty text when the wanted block is not there."""
    parser = _PageText(block)
    parser.feed(html or "")
    parser.close()
    text = INVISIBLE.sub("", "".join(parser.out))
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", text)
    return "".join(parser.title).strip(), re.sub(r"\n{3,}", "\n\n", text).strip()


def pages_to_text(pages: DataFrame, html: str = "html", block: str | None = None) -> DataFrame:
    """Adds ``title`` and ``text``. Pages are parsed where they lie, without a shuffle."""
    @F.pandas_udf("title string, text string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([page_text(h, block) for h in batch], columns=["title", "text"])

    return pages.withColumn("p__", parse(F.col(html))).select(*pages.columns, "p__.title", "p__.text")


def hrefs(html: Column) -> Column:
    """Targets of all links, in order, as written."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))

    def plain(target: Column) -> Column:
        out = F.when(target.rlike("^[\"']"), F.substr(target, F.lit(2), F.length(target) - 2)).otherwise(target)
        for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(char))
        return out

    return F.transform(raw, plain)


# Lines made by share buttons.
SHARE_LINES = (r"facebook\.com/sharer|twitter\.com/share|linkedin\.com/shareArticle|api\.whatsapp\.com/send"
               r"|link para Copiar|^Compartilhe:")


def clean_text(c: Column) -> Column:
    """Without share lines, broken sentences joined, runs of blanks and blank lines collapsed."""
    out = F.regexp_replace(c, rf"(?imu)^[^\n]*(?:{SHARE_LINES})[^\n]*$", "")
    out = F.regexp_replace(out, r"(?<=[^\n|])\n(?=[^\n|#*>\-])", " ")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


#: Names that pages give to the one-byte charsets read here; others are taken for UTF-8.
ONE_BYTE = ("windows-1252", "cp1252", "iso-8859-1", "latin-1", "latin1", "us-ascii")


def decoded(content: Column, content_type: Column) -> Column:
    """Text of a page's bytes: by the charset of the header, else of the meta tag anywhere in the page, else UTF-8.

    Bytes that are no UTF-8 are read as windows-1252.
    """
    western = F.decode(content, "windows-1252")
    named = F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=\s*[\"']?([\w-]+)", 1), F.lit(""))
    meta = F.nullif(F.regexp_extract(western, r"(?i)<meta[^>]+charset=\s*[\"']?([\w-]+)", 1), F.lit(""))
    one_byte = F.lower(F.coalesce(named, meta, F.lit("utf-8"))).isin(*ONE_BYTE)
    text = content.cast("string")
    return F.when(one_byte | ~F.is_valid_utf8(text), western).otherwise(text)


def decode_pages(df: DataFrame, content: str = "content", content_type: str = "content_type", out: str = "html") -> DataFrame:
    return df.withColumn(out, decoded(F.col(content), F.col(content_type)))
