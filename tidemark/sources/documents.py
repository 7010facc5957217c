"""Attachments and HTML as columns: media types, links, tables (EXT01 to EXT09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import EXTENSION_MIMES, MIME_DOCTYPES, lookup
from tidemark.functions.urls import domain, part


def extension(path: Column) -> Column:
    """The last suffix of a path, with its dot, lower case."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def resolve_mime(declared: Column, filename: Column, url: Column) -> Column:
    """EXT01: the declared type without parameters, else by the file's, else by the address's extension."""
    stated = F.lower(F.trim(F.get(F.split(declared, ";"), 0)))
    return F.when(F.coalesce(declared, F.lit("")) != "", stated).otherwise(F.coalesce(lookup(EXTENSION_MIMES, extension(filename)), lookup(EXTENSION_MIMES, extension(part(url, 3)))))


def doctype(mime: Column) -> Column:
    """EXT02."""
    return lookup(MIME_DOCTYPES, F.lower(F.trim(F.get(F.split(mime, ";"), 0))))


def table_markdown(headers: Column, rows: Column) -> Column:
    """EXT05: an array of headers and an array of rows as a pipe table."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def html_text(html: Column) -> Column:
    """EXT06: scripts, styles, comments and tags gone, the usual references decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def links(html: Column) -> Column:
    """The addresses of <a href>, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), 1), lambda x: F.trim(x))


def absolute(link: Column, base: Column) -> Column:
    """A link against the page's address."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def links_ending(html: Column, base: Column, suffix: str = ".pdf") -> Column:
    """EXT07: absolute addresses of links that end so, each once, in order."""
    return F.array_distinct(F.transform(F.filter(links(html), lambda x: F.lower(x).endswith(suffix)), lambda x: absolute(x, base)))


def first_outside_link(html: Column) -> Column:
    """EXT08: the first absolute link that is not the news aggregator's."""
    return F.get(F.filter(links(html), lambda x: x.rlike("^https?://") & ~F.lower(x).contains("news.google.")), 0)


def extraction_status(method: Column, characters: Column) -> Column:
    """EXT09."""
    return F.when(method == "skipped", "skipped").when(F.coalesce(characters, F.lit(0)) > 0, "ok").otherwise("empty")


#: Attachments of more bytes are not read.
MOST_BYTES = 20 * 1024 * 1024
#: The ways to read each kind of document, in the order in which they are tried.
READERS = {"document_html": ["main text", "tags stripped"], "document_docx": ["office"], "document_xlsx": ["office"], "document_pdf": ["layout", "tables", "plain text"]}


def route(mime: Column, size: Column) -> Column:
    """EXT03: struct<method, readers>: unknown kinds are skipped before they are fetched, empty and too large files give none; others have their readers."""
    kind = doctype(mime)
    readers = F.element_at(F.create_map(*[x for k, v in READERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), kind)
    method = F.when(kind.isNull(), "skipped").when((F.coalesce(size, F.lit(0)) <= 0) | (size > MOST_BYTES), "none").otherwise("read")
    return F.struct(method.alias("method"), F.when(method == "read", readers).alias("readers"))


def first_success(attempts: DataFrame, *by: str) -> DataFrame:
    """EXT03: (by..., try, method, text) to the first try of each document that gave text; none of them is method ``none``."""
    good = F.trim(F.coalesce("text", F.lit(""))) != ""
    first = F.min(F.when(good, F.struct("try", "method", "text")))
    return attempts.groupBy(*by).agg(first.alias("f")).select(*by, F.coalesce("f.method", F.lit("none")).alias("method"), F.coalesce("f.text", F.lit("")).alias("text"))


def host(url: Column) -> Column:
    return domain(url)
