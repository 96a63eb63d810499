"""Additive score of links on a job board: how likely a link leads to one posting.

Words and patterns come from the caller (``LinkWords``); the points are the same for all. Everything is
a column expression: a link is split once, and no row goes through Python.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes and parts of links that results must agree on.
NO_LINKS = ("javascript", "tel", "mailto", "skype", "whatsapp")
SERVICE_STARTS = ("api", "catalog", "service", "services", "redirect")
LIST_KEYS = ("page", "p", "sort", "filter")
ASSET_FOLDERS = ("static", "assets", "_next", "cdn-cgi")
ASSET_ENDS = (".css", ".eot", ".gif", ".ico", ".jpeg", ".jpg", ".js", ".map", ".mp4", ".png", ".svg", ".ttf", ".webm", ".webp", ".woff", ".woff2")
DOCUMENT_ENDS = (".pdf", ".doc", ".docx")
# End of fixed values.


class LinkWords(NamedTuple):
    """keywords: words of jobs; barred: path words of other pages; barred_parts: text of links to other pages;
    detail_path: expression for the path of one posting; detail_keys: query keys that name one."""

    keywords: tuple[str, ...]
    barred: tuple[str, ...]
    barred_parts: tuple[str, ...] = ()
    detail_path: str = r"$^"
    detail_keys: tuple[str, ...] = ()


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[/\-_.]+"), lambda x: x != "")


def _ends(text: Column, ends) -> Column:
    return reduce(lambda a, b: a | b, [text.endswith(e) for e in ends])


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def parts(url: Column) -> dict[str, Column]:
    """Scheme, host, path, query, fragment, segments and query keys (with a value) of the lower-cased link."""
    low = F.lower(F.trim(url))
    bare = F.regexp_extract(low, r"^[^#?]*", 0)
    path = F.regexp_replace(bare, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/]*)?", "")
    query = F.regexp_extract(low, r"^[^#?]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: F.regexp_extract(x, "=(.+)", 1) != "")
    return {
        "low": low,
        "scheme": F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*):", 1),
        "host": F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1),
        "path": path,
        "query": query,
        "fragment": F.regexp_extract(low, r"#(.*)$", 1),
        "segments": F.filter(F.split(path, "/"), lambda x: x != ""),
        "keys": F.transform(pairs, lambda x: F.substring_index(x, "=", 1)),
    }


def site_family(host: Column) -> Column:
    """Last two labels of a host, three below a country's short second level (co.uk)."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    short = (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    return F.when(F.size(labels) <= 2, host).when(short, last(3)).otherwise(last(2))


def same_family(host: Column, board_host: Column) -> Column:
    """Unknown hosts count as the same site."""
    known = (F.coalesce(host, F.lit("")) != "") & (F.coalesce(board_host, F.lit("")) != "")
    below = lambda a, b: a.endswith(F.concat(F.lit("."), b))
    return ~known | (site_family(host) == site_family(board_host)) | below(host, board_host) | below(board_host, host)


def link_score(url: Column, board: Column, words: LinkWords) -> Column:
    """Points of a link found on ``board`` (null: unknown); null for a null link. Above zero it is probably a posting."""
    p, b = parts(url), parts(board)
    path, seg, keys = p["path"], p["segments"], p["keys"]
    n = F.size(seg)
    last, first = (F.coalesce(F.try_element_at(seg, F.lit(k)), F.lit("")) for k in (-1, 1))
    jobs, barred = F.array(*[F.lit(w) for w in words.keywords]), F.array(*[F.lit(w) for w in words.barred])
    any_of = lambda text, ws: reduce(lambda a, c: a | c, [F.contains(text, F.lit(w)) for w in ws], F.lit(False))
    key_of = lambda ks: F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ks])) if ks else F.lit(False)
    bare = lambda x: F.regexp_replace(x, "/+$", "")
    detail, detail_key = path.rlike(f"(?i){words.detail_path}"), key_of(words.detail_keys)
    hits = F.array_intersect(words_of(path), barred)
    last_words = words_of(last)
    digit = last.rlike(r"\d")
    listing_tail = last.rlike(r"-(?:jobs|job|vacancies|vacancy)$")
    terms = [
        (F.coalesce(bare(p["low"]) == bare(b["low"]), F.lit(False)), -12),
        (~F.coalesce(same_family(p["host"], b["host"]), F.lit(True)), -12),
        (any_of(p["low"], words.barred_parts), -8),
        # A numbered posting may have "search" in its title.
        ((F.size(hits) > 0) & ~(detail & _within(hits, F.array(F.lit("search")))), -15),
        (F.array_contains(jobs, last), -6),
        ((F.size(last_words) > 0) & _within(last_words, jobs), -6),
        (F.contains(path, F.lit("viewjob")) & detail_key, 9),
        (path.rlike(r"/jobdesc/?$") & p["query"].rlike(r"(?:^|&)id=\d+(?:&|$)"), 16),
        (detail, 8),
        (path.rlike(r"[-/]\d{4,}(?:\.html)?$"), 7),
        (detail_key, 5),
        (path.rlike(r"\d{3,}"), 3),
        (last.rlike(r"[a-zа-я].*\d|\d.*[a-zа-я]"), 3),
        (F.contains(last, F.lit("-")) & (F.length(last) >= 12), 1),
        (F.contains(last, F.lit("jobs")) & ~digit & F.contains(path, F.lit("/jobs/")), -6),
        ((n > 0) & (n <= 2) & ~path.rlike(r"\d") & ~F.contains(last, F.lit("-")), -5),
        ((n == 1) & ~digit & any_of(last, words.keywords), -5),
        ((n == 1) & listing_tail, -5),
        ((n == 2) & F.array_contains(jobs, first) & ~digit & last.rlike(r"-(?:jobs|job|vacancies|vacancy)\b"), -12),
        (F.array_contains(F.array(*[F.lit(s) for s in SERVICE_STARTS]), first), -12),
        (any_of(path, words.keywords), 2),
        ((n <= 1) & ~detail_key, -2),
        (key_of(LIST_KEYS), -3),
        (p["fragment"].rlike(r"^(?:job|vacancy|opening)[\w-]*$"), -3),
        (_ends(path, DOCUMENT_ENDS), -8),
        (_ends(path, ASSET_ENDS), -50),
        (F.arrays_overlap(seg, F.array(*[F.lit(s) for s in ASSET_FOLDERS])), -20),
    ]
    total = reduce(lambda a, t: a + F.when(t[0], t[1]).otherwise(0), terms, F.lit(0))
    return F.when(url.isNull(), F.lit(None).cast("int")).when(p["scheme"].isin(*NO_LINKS), -100).otherwise(total)


def is_listing(url: Column, board: Column, words: LinkWords) -> Column:
    """No posting and not the board itself, but its path speaks of jobs: a page that lists more of them."""
    p, b = parts(url), parts(board)
    bare = lambda x: F.regexp_replace(x, "/+$", "")
    spoken = p["path"].rlike("|".join(re.escape(w) for w in words.keywords))
    return F.coalesce((F.size(p["segments"]) > 0) & (link_score(url, board, words) <= 0) & ~F.coalesce(bare(p["low"]) == bare(b["low"]), F.lit(False)) & spoken, F.lit(False))


def without_tracking(url: Column) -> Column:
    """The link without utm_* pairs of its query; a query left empty goes with its mark."""
    cut = F.regexp_replace(url, r"(?i)([?&])utm_[^=&#]*(?:=[^&#]*)?(?=&|#|$)", "$1")
    cut = F.regexp_replace(F.regexp_replace(cut, "&&+", "&"), r"\?&+", "?")
    return F.regexp_replace(cut, r"[?&]+(?=#|$)", "")
