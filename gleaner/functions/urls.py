"""URLs, hosts and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import collapsed, java

#: Hosts that no outside page can be on.
PRIVATE_HOST = r"^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\.0\.0\.0|\[?::1\]?)$"


def _full(url: Column) -> Column:
    t = F.trim(url)
    return F.when(t == "", None).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def host(url: Column) -> Column:
    """Lower-case host without www; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(_full(url), F.lit("HOST"))), r"^www\.", "")


def normal_url(url: Column) -> Column:
    """Host and path, without scheme, www, query, fragment and closing slashes; null without a dot in the host."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(_full(url), F.lit("PATH")), F.lit("")), "/+$", "")
    return F.when(host(url).contains("."), F.concat(host(url), path))


def domain_key(url: Column) -> Column:
    return F.when(host(url).contains("."), host(url))


def normal_domain(url: Column) -> Column:
    """The same by text alone, for what no URL parser takes."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^https?://", ""), r"^www\.", "")
    h = F.element_at(F.split(s, "[/?#]"), 1)
    return F.when(h.contains("."), h)


def url_problem(url: Column, longest: int = 2000) -> Column:
    """Why an article's URL can't be used; null if it can."""
    h = F.try_parse_url(url, F.lit("HOST"))
    return (
        F.when(F.length(url) > longest, "too-long")
        .when(url.isNull() | h.isNull(), "malformed-url")
        .when(~F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), "not-http")
        .when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "credentials-in-url")
        .when(h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.startswith("["), "bare-ip")
        .when(~h.contains("."), "no-domain")
    )


def is_outside_host(url: Column) -> Column:
    return F.coalesce(~host(url).rlike(PRIVATE_HOST), F.lit(False))


def on_domain(url: Column, site: Column) -> Column:
    """Whether ``url`` is on the site's host or below it."""
    return F.coalesce((host(url) == host(site)) | F.endswith(host(url), F.concat(F.lit("."), host(site))), F.lit(False))


def readable_text(html: Column) -> Column:
    """A page's text: scripts, styles, comments and tags gone, common entities as spaces."""
    s = html
    for tag in ("script", "style", "noscript", "template"):
        s = F.regexp_replace(s, java(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    s = F.regexp_replace(s, r"(?i)&(?:nbsp|amp|quot|#39|lt|gt);", " ")
    return collapsed(s)


def block_text(html: Column) -> Column:
    """One line per block, without addresses."""
    s = F.regexp_replace(html, java(r"(?is)<(script|style)\b[^>]*>.*?</\1>"), " ")
    s = F.regexp_replace(F.regexp_replace(s, java(r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|section|tr|td)\b[^>]*>"), "\n"), r"<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(s, r"https?://\S+", ""), r"[ \t]*\n\s*", "\n")


def tag_content(html: Column, tag: str) -> Column:
    """The first element's content; null if there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), F.lit(""))


def tag_contents(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def meta_content(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:name|property)=["']{name}["'][^>]+content=["']([^"']*)["']""", 1), F.lit(""))


def published_at(html: Column) -> Column:
    """The date a page states for itself."""
    stated = F.coalesce(meta_content(html, "article:published_time"), F.nullif(F.regexp_extract(html, r"""(?is)<time[^>]+datetime=["']([^"']+)["']""", 1), F.lit("")))
    return F.to_date(F.nullif(F.regexp_extract(stated, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def character(code: Column) -> Column:
    """The character of a code point, by its four bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """CDATA unwrapped, named and numeric entities decoded, tags gone."""
    s = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        s = F.regexp_replace(s, f"&{name};", char)
    codes = F.array_distinct(F.regexp_extract_all(s, F.lit(r"&#(x?[0-9A-Fa-f]{1,6});"), F.lit(1)))
    number = lambda c: F.when(c.startswith("x"), F.conv(F.substring(c, 2, 6), 16, 10)).otherwise(c).cast("int")
    usable = F.filter(codes, lambda c: number(c).between(1, 0x10FFFF) & ~number(c).between(0xD800, 0xDFFF))
    s = F.aggregate(usable, s, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), character(number(c))))
    return collapsed(F.regexp_replace(s, "&amp;", "&"))


def filing_index_url(cik: Column, accession: Column, archive: str = "https://www.sec.gov/Archives/edgar/data/") -> Column:
    """The page of a filing by filer and accession number; null without either."""
    there = (F.coalesce(cik, F.lit("")) != "") & (F.coalesce(accession, F.lit("")) != "")
    return F.when(there, F.concat(F.lit(archive), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-index.htm")))
