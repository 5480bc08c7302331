"""Text and links of HTML pages, as column expressions over the raw markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.base import WS, let, present, squeeze, truncate, utf16_length

MIN_TEXT = 1000      # shorter texts fall back to the stripped raw page
BATCH_BUDGET = 5000  # text units per page in a batch prompt
PAGE_BUDGET = 50000  # text units in a single-page prompt

_SCRIPT = r"(?is)<script[^>]*>.*?</script>"
_STYLE = r"(?is)<style[^>]*>.*?</style>"
_ANCHOR = rf"""(?is)<a{WS}[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""

# Attributes, then the one wanted; values may be quoted or bare. What has been read as an attribute is
# never read again (possessive), so a tag may have any number of them and costs its length once.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_ATTRIBUTE = r"""[\s/]++[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
_WANTED = r"[\s/]+href\s*=\s*"
# Comments, scripts and styles are matched first, so links inside them are passed over; so are
# the attributes of a link without an address.
_HREF = (r"(?is)(?=<[!sa])(?:<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
         rf"|<a(?:(?!{_WANTED}{_VALUE}){_ATTRIBUTE})*+(?:{_WANTED}({_VALUE}))?+)")

_URL = r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
# An address that is already in its canonical form: nothing to fold, drop or encode.
_CLEAN_URL = (r"\Ahttps?://[a-z0-9.-]++/[\w~!$&'()*+,;=:@%./\[\]|^-]*+"
              r"(?:\?[\w~!$&()*+,;=:@%./?\[\]|^`{}-]*+)?(?:#[\w~!$&'()*+,;=:@%./?\[\]|^{}-]*+)?\z")
# A link that is a path without dots, and an origin that such a path can follow as it is.
_PLAIN_PATH = r"\A/(?!/)[\w~!$&'()*+,;=:@%/\[\]|^-]*+\z"
_PLAIN_ORIGIN = r"\Ahttps?://[a-z0-9-][a-z0-9.-]*+\z"


def _without_code(html: Column) -> Column:
    def code_free(h: Column) -> Column:
        # Most pieces have no tag that begins like these two: finding that out is far cheaper than two patterns.
        return F.when(h.contains("<s") | h.contains("<S"), F.regexp_replace(F.regexp_replace(h, _SCRIPT, ""), _STYLE, "")).otherwise(h)

    return let(html, code_free)


def _untag(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, r"<[^>]+>", " "))


def strip_html(html: Column) -> Column:
    """Plain text of raw HTML: scripts and styles go, tags become spaces."""
    return _untag(_without_code(html))


def text_with_links(html: Column) -> Column:
    """Plain text that keeps link targets, each link as `text (address)`."""
    return _untag(_without_code(F.regexp_replace(html, _ANCHOR, "$2 ($1)")))


def _elements(html: Column, tag: str) -> Column:
    """What stands inside the outermost elements of a tag, in order and with the elements nested
    in them, joined by spaces; empty without a closing tag. One that is left open goes to the end."""
    tags = (r"(?is)(?=<)(?:(<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>)"
            rf"|(</?{tag}(?=[\s/>])[^>]*>))")
    # Marks stand before and after each tag; comments and code, passed over, leave an empty pair.
    marked = F.replace(F.regexp_replace(html, tags, "$1\0[$2\0]"), F.lit("\0[\0]"), F.lit(""))

    def take(done: Column, piece: Column) -> Column:
        opens = ~piece.startswith("</")
        depth = F.greatest(done["depth"] + F.when(opens, 1).otherwise(-1), F.lit(0))
        text = F.when(opens & (done["depth"] == 0), F.concat(F.lit(" "), F.substring_index(piece, "\0]", -1)))
        part = F.coalesce(text, F.replace(piece, F.lit("\0]"), F.lit("")))
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(done["parts"], F.array(part)))
                        .otherwise(done["parts"]).alias("parts"))

    def join(pieces: Column) -> Column:
        none = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"))
        found = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), none, take,
                            lambda done: F.array_join(done["parts"], ""))
        return F.when(F.exists(pieces, lambda p: p.startswith("</")), F.substr(found, F.lit(2))).otherwise("")

    return F.when(html.rlike(rf"(?i)</{tag}[\s/>]"), let(F.split(marked, r"\x00\["), join))


def main_content(html: Column) -> Column:
    """Markup of the main part: all articles in order, else all of `main`, else the body
    without its navigation, header, footer and side bars. Null when nothing is left."""
    body = let(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1),
               lambda b: F.when(b != "", b).otherwise(html))
    for tag in ("nav", "header", "footer", "aside"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.coalesce(
        let(_elements(html, "article"), present),
        let(_elements(html, "main"), present),
        let(body, lambda b: F.when(b.rlike(r"[^\s]"), b)),
    )


def page_text(html: Column) -> Column:
    """Readable text of a page, or null when it has no content."""
    return let(text_with_links(main_content(html)), present)


def choose_content(text: Column, raw_html: Column) -> Column:
    """The page text, or the stripped raw page when the text is too short."""
    def choose(t: Column) -> Column:
        short = (F.length(t) < MIN_TEXT) & (utf16_length(t) < MIN_TEXT)
        return F.when(short & F.coalesce(raw_html != "", F.lit(False)), strip_html(raw_html)).otherwise(t)

    return let(F.coalesce(text, F.lit("")), choose)


def prompt_content(text: Column, raw_html: Column, budget: int = BATCH_BUDGET) -> Column:
    """The chosen content cut to a prompt's budget."""
    return let(choose_content(text, raw_html), lambda content: truncate(content, budget))


def hostname(url: Column) -> Column:
    """Lower-case host of an address without user or port; empty when it has none."""
    authority = F.regexp_extract(url, _URL, 2)
    return F.lower(F.regexp_replace(authority, r"\A.*@|:\d*\z", ""))


def _percent(text: Column, reserved: str) -> Column:
    """Percent-encode non-ASCII, control and `reserved` characters."""
    unsafe = rf"[^\x21-\x7E]|[{reserved}]"

    def encode(c: Column) -> Column:
        return F.when(c.rlike(unsafe), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)

    return let(text, lambda t: F.when(
        t.rlike(unsafe), F.array_join(F.transform(F.split(t, ""), encode), "")).otherwise(t))


def _fold_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    def fold(parts: Column) -> Column:
        segments = F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == ".", done)
            .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(s))),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        return F.regexp_replace(F.concat(F.lit("/"), F.array_join(segments, "/"), tail), r"\A//\z", "/")

    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), let(F.split(path, "/"), fold)).otherwise(path)


def _normalize(url: Column) -> Column:
    """Canonical text of an absolute http(s) address."""
    def build(part: Column) -> Column:
        scheme = F.lower(part[0])
        authority = F.concat(
            F.regexp_extract(part[1], r"\A(.*@)?", 1),
            F.lower(F.regexp_replace(part[1], r"\A.*@", "")),
        )
        port = F.when(scheme == "https", F.lit(r":443\z")).otherwise(F.lit(r":80\z"))
        authority = F.regexp_replace(F.regexp_replace(authority, port, F.lit("")), r":\z", "")
        path = F.when(part[2] == "", "/").otherwise(_percent(_fold_dots(part[2]), r'"<>`{}'))
        return F.concat(scheme, F.lit("://"), authority, path,
                        _percent(part[3], r'"<>\''), _percent(part[4], r'"<>`'))

    return let(F.array(*[F.regexp_extract(url, _URL, g) for g in range(1, 6)]), build)


def url_parts(url: Column) -> Column:
    """The parts of a page address that resolving a link needs."""
    part = [F.regexp_extract(url, _URL, g) for g in range(5)]
    folder = F.when(part[3] == "", "/").otherwise(F.regexp_replace(part[3], r"[^/]*\z", ""))
    origin = F.concat(part[1], F.lit("://"), part[2])
    return F.struct(
        part[1].alias("scheme"), origin.alias("origin"), origin.rlike(_PLAIN_ORIGIN).alias("plain"),
        folder.alias("folder"), part[3].alias("path"), part[4].alias("query"),
        hostname(url).alias("host"),
    )


def _resolve(href: Column, base: Column) -> Column:
    def build(h: Column) -> Column:
        absolute = (
            F.when(h.rlike(r"(?i)\Ahttps?://"), h)
            .when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(base["origin"], h))
            .when(h == "", F.concat(base["origin"], base["path"], base["query"]))
            .when(h.startswith("?"), F.concat(base["origin"], base["path"], h))
            .when(h.startswith("#"), F.concat(base["origin"], base["path"], base["query"], h))
            .otherwise(F.concat(base["origin"], base["folder"], h))
        )
        # No host, or one with forbidden characters, is not an address.
        return let(absolute, lambda u: (
            F.when(~u.contains("/.") & u.rlike(_CLEAN_URL), u)
            .when(u.rlike(r"""(?i)\Ahttps?://[^/?#\s<>"|\\^]+([/?#]|\z)"""), _normalize(u))))

    clean = F.when(href.rlike(r"\A[\x00-\x20]|[\t\n\r]|[\x00-\x20]\z"), F.regexp_replace(
        F.regexp_replace(href, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")).otherwise(href)
    before = F.regexp_extract(clean, r"\A[^?#]*", 0)
    slashed = F.concat(F.translate(before, "\\", "/"), F.substr(clean, F.length(before) + 1))
    return F.when(base["plain"] & href.rlike(_PLAIN_PATH), F.concat(base["origin"], href)).otherwise(
        let(F.when(clean.contains("\\"), slashed).otherwise(clean), build))


def resolve_url(href: Column, base: Column) -> Column:
    """Resolve a link against the page address; null unless the result is http(s)."""
    return let(url_parts(base), lambda b: _resolve(href, b))


def _href_value(raw: Column) -> Column:
    value = F.when(raw.startswith('"') | raw.startswith("'"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    plain = value
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(raw.contains("&"), plain).otherwise(value)


def page_links(html: Column, url: Column) -> Column:
    """Same-host links of a page, absolute, each once, in order of appearance.

    Works inside the page's own row: no explode and no shuffle.
    """
    hrefs = F.array_distinct(F.regexp_extract_all(html, F.lit(_HREF), F.lit(1)))
    values = F.filter(F.transform(hrefs, _href_value), lambda v: v != "")

    def same_host(base: Column) -> Column:
        links = F.transform(values, lambda v: _resolve(v, base))
        here = F.concat(base["origin"], F.lit("/"))
        return F.array_distinct(F.filter(
            links, lambda u: F.when(u.startswith(here), True).otherwise(hostname(u) == base["host"])))

    return let(url_parts(url), same_host)
