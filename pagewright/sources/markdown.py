"""HTML to Markdown, by a parser that bears any markup, in Arrow batches; documents as text with a header."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Writer(HTMLParser):
    _HIDDEN = {"script", "style", "template", "noscript"}
    _MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links, self.lists = [], 0, [], []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in self._HIDDEN:
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "section", "table", "tr", "title"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag in self._MARKS:
            self.out.append(self._MARKS[tag])
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "a":
            self.links.append(found.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{found.get('alt') or ''}]({found.get('src') or ''})")

    def handle_endtag(self, tag):
        if tag in self._HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self._MARKS:
            self.out.append(self._MARKS[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(" ".join(data.split()).join((" " * data[:1].isspace(), " " * data[-1:].isspace())) if data.strip() else " ")


def to_markdown_text(html: str | None) -> str:
    writer = _Writer()
    writer.feed(html or "")
    writer.close()
    lines = [line.strip(" ") for line in "".join(writer.out).replace("  \n", "\x00").split("\n")]
    text = "\n".join(" ".join(line.split(" ")) for line in lines).replace("\x00", "  \n")
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip()


@F.pandas_udf(T.StringType())
def to_markdown(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in html:
        yield some.map(to_markdown_text)


def document(title: Column, url: Column, body: Column) -> Column:
    """The stored form of a page: a heading, its URL, the body."""
    return F.concat(F.lit("# "), title, F.lit("\n\n**URL:** "), url, F.lit("\n\n"), body)


def page_data(title: Column, url: Column, h1: Column, h2: Column, h3: Column, paragraphs: Column, links: Column) -> Column:
    """Markdown of a page given as fields and arrays."""
    some = lambda arr: F.filter(F.coalesce(arr, F.array()), lambda x: x.isNotNull() & (x != ""))
    lines = lambda arr, shape: F.array_join(F.transform(some(arr), shape), "")
    marked = lambda mark: lambda x: F.concat(F.lit(mark), x, F.lit("\n"))
    linked = lambda x: F.concat(F.lit("["), x, F.lit("]("), x, F.lit(")"))
    tail = F.when(F.size(F.coalesce(links, F.array())) > 0, F.concat(F.lit("\n**Links:**\n"), lines(links, lambda x: F.concat(F.lit("- "), linked(x), F.lit("\n"))))).otherwise("")
    return F.concat(
        F.lit("# "), title, F.lit("\n**URL:** "), linked(url), F.lit("\n"), lines(h1, marked("# ")), lines(h2, marked("## ")), lines(h3, marked("### ")),
        lines(paragraphs, marked("")), tail, F.lit("\n---\n"),
    )
