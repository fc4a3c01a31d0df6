"""Reports in HTML: title, date, endnotes, the sentence of each marker, takeaways. Parsing is per page; relations are DataFrames."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hedging, hedging_cue
from ..session import ship

_MONTHS = {calendar.month_name[i].lower(): i for i in range(1, 13)}
_DATE = re.compile(rf"({'|'.join(_MONTHS)})\s+(\d{{1,2}}),?\s+(\d{{4}})", re.I)
_MARKER = re.compile(r"\[(\d{1,4})\]")
_URL = re.compile(r"https?://[^\s;<>\"')\]]+(?:\s+dot\s+[^\s;<>\"')\]]+)*", re.I)
#: Elements that end a line of text, and those whose text isn't the page's.
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "tr", "table", "section", "article", "title"}
_HIDDEN = {"script", "style", "nav", "header", "footer"}
#: Characters before a marker that are looked at.
CONTEXT = 350
#: Pages whose parts are held at once.
PAGES = 200
#: Fixed value: the class of blocks of endnotes.
NOTES = "endnote-accordion-content"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: dict[str, list[list[str]]] = {"title": [], "h1": [], "p": [], "li": []}
        self.links = 0
        #: For each open element whether it is in a block of endnotes; what these say; whether there is one.
        self.noted: list[bool] = []
        self.notes: list[str] = []
        self.has_notes = False

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        self.links += tag == "a"
        own = NOTES in (dict(attrs).get("class") or "").split()
        self.has_notes |= own
        self.open.append(tag)
        self.noted.append(own or self.noted[-1:] == [True])
        if tag in self.found:
            self.found[tag].append([])

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                self.noted.pop()
            self.noted.pop()

    def handle_data(self, data):
        if self.noted[-1:] == [True]:
            self.notes.append(data)
            return
        if _HIDDEN & set(self.open):
            return
        for tag in self.open:
            if tag in self.found and self.found[tag]:
                self.found[tag][-1].append(data)

    def texts(self, tag: str) -> list[str]:
        return [t for t in (" ".join("".join(x).split()) for x in self.found[tag]) if t]


def page_parts(html: str | None) -> dict:
    """title, items of lists, paragraphs and the number of links; notes: what blocks of endnotes say, whatever is nested in them, or None without a block. They are no part of the others."""
    p = _Page()
    p.feed(html or "")
    p.close()
    heads = p.texts("h1") or p.texts("title")
    return {"title": heads[0] if heads else None, "items": p.texts("li"), "paragraphs": p.texts("p"), "links": p.links, "notes": " ".join(" ".join(p.notes).split()) if p.has_notes else None}


def date_in_title(title: str | None) -> str | None:
    m = _DATE.search(title or "")
    return f"{m[3]}-{_MONTHS[m[1].lower()]:02d}-{int(m[2]):02d}" if m else None


def endnotes(text: str) -> dict[int, list[str]]:
    """URLs of each endnote of a block `[1] url ; url [2] url`."""
    out: dict[int, list[str]] = {}
    marks = list(_MARKER.finditer(text))
    for m, following in zip(marks, [*marks[1:], None]):
        urls = [u.rstrip("),.;]") for u in _URL.findall(text[m.end() : following.start() if following else len(text)])]
        if urls:
            out.setdefault(int(m[1]), []).extend(urls)
    return out


def marker_contexts(body: str) -> dict[int, str]:
    """The sentence before each marker, where it first stands."""
    out: dict[int, str] = {}
    for m in _MARKER.finditer(body):
        if int(m[1]) not in out:
            before = max((body.rfind(e, 0, m.start()) + len(e) for e in (". ", "! ", "? ", "\n", "] ") if e in body[: m.start()]), default=0)
            out[int(m[1])] = body[max(m.start() - CONTEXT, before) : m.start()].strip()
    return out


def parsed(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, report_date (text), items, paragraphs, links of each page."""
    ship(pages.sparkSession)
    out_type = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, PAGES) for whole in batches for at in range(0, whole.num_rows, PAGES)):
            rows = [page_parts(h) for h in b.column(1).to_pylist()]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r["title"] for r in rows], pa.string()), pa.array([date_in_title(r["title"]) for r in rows], pa.string()), pa.array([r["items"] for r in rows], texts), pa.array([r["paragraphs"] for r in rows], texts), pa.array([r["links"] for r in rows], pa.int64())],
                [key, "title", "report_date", "items", "paragraphs", "links"],
            )

    return pages.select(key, html).mapInArrow(run, f"{key} {out_type}, title string, report_date string, items array<string>, paragraphs array<string>, links bigint")


_HEADING = re.compile(r"(?is)<(h[1-4]|strong|b)\b[^>]*>(?:(?!</\1>).)*key takeaways(?:(?!</\1>).)*</\1>")
_LABEL = re.compile(r'(?i)aria-label="[^"]*key takeaways[^"]*"')
_LIST, _ITEM, _TAG = re.compile(r"(?is)<(ul|ol)\b[^>]*>(.*?)</\1>"), re.compile(r"(?is)<li\b[^>]*>(.*?)</li>"), re.compile(r"(?s)<[^>]+>")
_NOTE = re.compile(r"^\s*\[\d{1,4}\]\s*https?://")


def _said(html: str) -> str:
    return " ".join(unescape(_TAG.sub(" ", html)).split())


def takeaways(html: str | None) -> list[str]:
    """The items of the first list after the heading that names the takeaways, or in a block that is labelled so; none without either."""
    found = _HEADING.search(html or "") or _LABEL.search(html or "")
    items = _LIST.search(html, found.end()) if found else None
    return [t for t in map(_said, _ITEM.findall(items[2])) if t] if items else []


def report(html: str | None) -> dict:
    """title, report_date, takeaways, and the citations of a report: (endnote, url, the sentence before its marker)."""
    parts = page_parts(html)
    notes = parts["notes"]
    paragraphs = [p for p in parts["paragraphs"] if not (notes is None and _NOTE.match(p))]
    text = notes if notes is not None else "\n".join(p for p in parts["paragraphs"] if _NOTE.match(p))
    contexts = marker_contexts(" ".join(paragraphs))
    cited = [(n, url, contexts.get(n)) for n, urls in endnotes(text).items() for url in urls]
    return {"title": parts["title"], "report_date": date_in_title(parts["title"]), "takeaways": takeaways(html), "citations": cited}


def reports(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, report_date, takeaways (array), citations (array of endnote, url, context, hedging, cue) and ok (a date and endnotes) of each page."""
    ship(pages.sparkSession)
    cited = pa.list_(pa.struct([("endnote", pa.int64()), ("url", pa.string()), ("context", pa.string())]))

    def run(texts: pa.Array) -> pa.Array:
        rows = [report(t.as_py()) for t in texts]
        links = [[{"endnote": n, "url": u, "context": c} for n, u, c in r["citations"]] for r in rows]
        return pa.StructArray.from_arrays(
            [pa.array([r["title"] for r in rows], pa.string()), pa.array([r["report_date"] for r in rows], pa.string()), pa.array([r["takeaways"] for r in rows], pa.list_(pa.string())), pa.array(links, cited)],
            ["title", "report_date", "takeaways", "citations"],
        )

    made = F.arrow_udf(run, "title string, report_date string, takeaways array<string>, citations array<struct<endnote: bigint, url: string, context: string>>")
    rows = pages.select(key, made(F.col(html)).alias("r")).select(key, "r.*")
    said = lambda c: F.coalesce(c.getField("context"), F.lit(""))
    hedged = F.transform("citations", lambda c: F.struct(c.getField("endnote").alias("endnote"), c.getField("url").alias("url"), c.getField("context").alias("context"), hedging(said(c)).alias("hedging"), hedging_cue(said(c)).alias("cue")))
    return rows.withColumn("citations", hedged).withColumn("ok", F.col("report_date").isNotNull() & (F.size("citations") > 0))
