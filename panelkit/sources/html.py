"""Links found in stored web pages.

A page is cut into tokens in one pass, in the order in which a parser meets them: comments, elements whose content is not
markup (scripts, styles, titles, text areas) with all of it, and tags with their quoted and bare attributes. So an anchor
inside a comment or a script is no token of its own. Every repeat is possessive: the engine never goes back, and long pages
cost time in proportion.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: An attribute: its name, and a value that is quoted or bare. A tag's attributes are parted by white space or slashes.
_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+)?+"""
#: A tag that never ends takes the rest of the page with it, as it does in a parser; it is no tag then.
_REST = rf"""(?:[\s/]++|{_ATTRIBUTE}|=)*+(?:>|\z)"""
#: Elements whose content is text, up to their own end tag or the end of the page.
_RAW = ["script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"]
#: Comments in all their endings; declarations; raw elements; tags. What is none of them is text.
TOKEN = ("(?is)(?:<!--(?:>|->|.*?(?:--!?>|\\z))|<[!?][^>]*+(?:>|\\z)|" + "|".join(rf"<{e}(?=[\s/>]){_REST}.*?(?:</{e}(?=[\s/>])|\z)" for e in _RAW)
         + rf"|</?[a-z][^\s/>]*+{_REST})")
ANCHOR = r"(?is)^<a[\s/].*+(?<=>)$"
HREF = r"""(?is)^href\s*+=\s*+(.*+)$"""
#: The usual character entities, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&amp;": "&"}


def _plain(value: Column) -> Column:
    """An attribute's value without its quotes, entities decoded; white space around a link does not belong to it."""
    quoted = value.rlike("""(?s)^(?:".*"|'.*')$""") & (F.length(value) > 1)
    bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    for entity, char in ENTITIES.items():
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.btrim(bare, F.lit(" \t\n\f\r"))


def _href(tag: Column) -> Column:
    """The value of a tag's first attribute called href, NULL without one."""
    inside = F.regexp_extract_all(F.regexp_replace(tag, r"(?is)^<[a-z][^\s/>]*+|>$", ""), F.lit(f"(?is)({_ATTRIBUTE})"), F.lit(1))
    found = F.filter(inside, lambda x: x.rlike(r"(?is)^href(?:\s*+=|$)"))
    return F.regexp_extract(F.get(found, F.lit(0)), HREF, 1)


def tags(html: Column | str) -> Column:
    """The tokens of a page, in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def extract_links(pages: DataFrame, pattern: str = r"\.csv$", key: str = "page_id", html: str = "html", base: str | None = None) -> DataFrame:
    """One row per anchor whose target matches ``pattern``: ``(key, pos, href)``, pos from 0 among the page's anchors with a
    target. With ``base``, a column of page addresses, also ``address``: the target made whole, by the page's own base
    address if it names one.

    A page that is NULL or has no anchor has no row.
    """
    tokens = pages.select(key, *([F.col(base).alias("_base")] if base else []), tags(html).alias("_tokens"))
    anchors = F.filter(F.transform(F.filter("_tokens", lambda x: x.rlike(ANCHOR)), _href), lambda h: h.isNotNull())
    own = F.get(F.filter(F.transform(F.filter("_tokens", lambda x: x.rlike(r"(?is)^<base[\s/].*+(?<=>)$")), _href), lambda h: h.isNotNull()), F.lit(0))
    kept = [F.when(own.isNull(), F.col("_base")).otherwise(absolute(_plain(own), F.col("_base"))).alias("_base")] if base else []
    links = tokens.select(key, *kept, F.posexplode(anchors).alias("pos", "href")).withColumn("href", _plain(F.col("href")))
    out = links.where(F.col("href").rlike(pattern))
    return out.select(key, "pos", "href", absolute(F.col("href"), F.col("_base")).alias("address")) if base else out


def absolute(href: Column, base: Column) -> Column:
    """A link made whole: with a scheme it stands for itself; else scheme, host or folder come from ``base``."""
    scheme = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.-]*:)", 1)
    host = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://[^/]*", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    own, query = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    # "." stays where it is, ".." takes the part before away
    parts = F.split(F.regexp_replace(joined, "^/", ""), "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda seen, x: F.when(x == ".", seen).when(
        x == "..", F.when(F.size(seen) > 0, F.slice(seen, 1, F.size(seen) - 1)).otherwise(seen)).otherwise(F.concat(seen, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    whole = F.concat(host, F.lit("/"), F.array_join(walked, "/"), ends, query)
    return (F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
            .when(href == "", F.regexp_replace(base, "#.*$", "")).when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
            .when(href.startswith("?"), F.concat(host, path, href)).otherwise(whole))


def first_links(links: DataFrame, words: list[str], key: str = "page_id") -> DataFrame:
    """For each page, the first link that contains each word, one column per word."""
    picks = [
        F.min_by("href", F.when(F.col("href").contains(w), F.col("pos"))).alias(w) for w in words
    ]
    return links.groupBy(key).agg(*picks)
