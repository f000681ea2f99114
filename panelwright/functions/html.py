"""HTML to main text, chrome text and links, on the standard library's parser, batch by batch."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import unquote, urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags whose content is noise, and tags of the page's frame.
NOISE = ("script", "style", "noscript", "svg", "canvas", "iframe", "form")
FRAME = ("header", "footer", "nav", "aside")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def mail_addresses(href: str) -> list[str]:
    """The addresses of a mailto link, lower-cased; none of any other link."""
    scheme, _, rest = href.strip().partition(":")
    if scheme.lower() != "mailto":
        return []
    return [a for a in (unquote(part).strip().lower() for part in rest.partition("?")[0].split(",")) if a.count("@") == 1 and "." in a.partition("@")[2]]


class _Page(HTMLParser):
    """Text runs with the open tags they stand in, and links with their anchor text."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.runs: list[tuple[str, frozenset[str]]] = []
        self.links: list[list[str]] = []
        self.base, self.based, self.anchor = base, False, None
        self.mails: list[str] = []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == "base" and at.get("href") and not self.based:  # the first one counts, if it leads to a page
            self.based = True
            whole = urljoin(self.base, at["href"].strip())
            self.base = whole if whole.lower().startswith(("http://", "https://")) else self.base
        if tag == "a" and at.get("href"):
            self.anchor = [at["href"], ""]
            self.mails += mail_addresses(at["href"])
        if tag not in VOID:
            self.open.append((tag, at.get("role") == "main"))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if tag == "a" and self.anchor:
            self.links.append(self.anchor)
            self.anchor = None

    def handle_data(self, data):
        tags = frozenset(t for t, _ in self.open) | ({"role=main"} if any(m for _, m in self.open) else set())
        if self.anchor:
            self.anchor[1] += data
        for line in data.split("\n"):
            if line.strip():
                self.runs.append((line.strip(), tags))


def _kept(line: str) -> bool:
    return len(line) > 20 or not line.replace(" ", "").isalpha()


def parse(html: str, url: str = "") -> tuple[str, str, list[tuple[str, str]]]:
    """(main text, chrome text, links): links are absolute, without fragment, each once, in order."""
    page = _Page(url)
    page.feed(html)
    page.close()
    body = [(t, tags) for t, tags in page.runs if not tags.intersection(NOISE) and "head" not in tags]
    plain = [(t, tags) for t, tags in body if not tags.intersection(FRAME)]
    for inside in ("main", "article", "role=main"):
        chosen = [t for t, tags in plain if inside in tags]
        if chosen:
            break
    else:
        chosen = [t for t, _ in plain]
    links: dict[str, str] = {}
    for href, text in page.links:
        try:
            whole = urldefrag(urljoin(page.base, href.strip())).url
        except ValueError:
            continue
        if whole.startswith(("http://", "https://")):
            links.setdefault(whole, " ".join(text.split()))
    return "\n".join(filter(_kept, chosen)), "\n".join(t for t, tags in body if tags.intersection(FRAME)), list(links.items())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, main_text, chrome_text, links) of each page; a null page gives empty texts and no links."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    link = pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [parse(h or "", u or "") for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([[{"url": u, "text": t} for u, t in f[2]] for f in found], link)], ["key", "main_text", "chrome_text", "links"])

    return rows.mapInArrow(run, f"key {kind}, main_text string, chrome_text string, links array<struct<url:string,text:string>>")


def email_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, emails): distinct mailto addresses of each page in order; a null page has none."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            found = []
            for h in batch.column(1).to_pylist():
                page = _Page("")
                page.feed(h or "")
                page.close()
                found.append(list(dict.fromkeys(page.mails)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["key", "emails"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, emails array<string>")


# Names of date metadata, by the tag they count as.
DATE_NAMES = {
    "citation_publication_date": "citation_publication_date", "article:published_time": "article:published_time",
    "dc.date.issued": "dcterms.issued", "dcterms.issued": "dcterms.issued",
}
SCHEMA_TAG, SCHEMA_HOSTS = "schema.org datePublished", ("http://schema.org/", "https://schema.org/", "http://www.schema.org/", "https://www.schema.org/")


class _Dates(HTMLParser):
    """Date metadata in document order; a microdata element's text is known only where it closes, so its place is kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []  # tag, found_as, raw
        self.open: list[tuple[str, bool | None, list | None]] = []  # tag, whether its scope is on schema.org, the entry that takes its text
        self.script: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            for name in dict.fromkeys(DATE_NAMES.get(at.get(a, "").strip().lower()) for a in ("name", "property")):
                if name:
                    self.found.append([name, "meta", at.get("content", "")])
        if tag == "script" and at.get("type", "").split(";")[0].strip().lower() == "application/ld+json":
            self.script = []
        scope = any(t.lower().startswith(SCHEMA_HOSTS) for t in at.get("itemtype", "").split()) if "itemscope" in at else None
        entry = None
        if "datePublished" in at.get("itemprop", "").split() and next((s for _, s, _ in reversed(self.open) if s is not None), False):
            entry = [SCHEMA_TAG, "microdata", at.get("content", "") if tag == "meta" else at.get("datetime") if tag == "time" else None]
            self.found.append(entry)
            entry = entry if entry[2] is None else None
            if entry is not None:
                entry[2] = ""
        if tag not in VOID:
            self.open.append((tag, scope, entry))

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        for _, _, entry in self.open:
            if entry is not None:
                entry[2] += data.strip()

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.found += [[SCHEMA_TAG, "json-ld", value] for value in _json_dates("".join(self.script))]
            self.script = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break


def _json_dates(text: str) -> list[str]:
    """datePublished of the nodes of a JSON-LD document and of those right under their @graph."""
    try:
        whole = json.loads(text)
    except ValueError:
        return []
    listed = lambda x: x if isinstance(x, list) else [x]
    nodes = [n for top in listed(whole) if isinstance(top, dict) for n in (top, *listed(top.get("@graph"))) if isinstance(n, dict)]
    values = [v.get("@value") if isinstance(v, dict) else v for n in nodes if "datePublished" in n for v in listed(n["datePublished"])]
    return ["" if v is None else str(v) for v in values]


def date_candidates(html: str) -> list[tuple[str, str, str]]:
    """(tag, found_as, raw) of a page's date metadata: meta elements, JSON-LD and schema.org microdata, in document order."""
    page = _Dates()
    page.feed(html)
    page.close()
    return [(tag, how, raw) for tag, how, raw in page.found]


def dates(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, tag, found_as, raw, value): one row per date signal, with its ISO value where it is one; a null page has none."""
    from .dates import normalise_iso

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            found = [(k, place, *c) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for place, c in enumerate(date_candidates(h or ""), 1)]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:])], ["key", "place", "tag", "found_as", "raw"])

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, place int, tag string, found_as string, raw string")
    return out.withColumn("value", normalise_iso(F.col("raw")))
