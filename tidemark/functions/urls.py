"""Addresses as column expressions: parts, resolution of links, how a target would be read, how lasting its shape looks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import clamp

#: Fixed: markers of a session in an address, endings of structured files, marks of interface descriptions,
#: how a structured file is read, weights of the shape.
SESSION_MARKS = ("sessionid", "sid=", "token=", "jsessionid", "phpsessid", "authtoken")
LASTING_ENDINGS = (".csv", ".xml", ".json", ".rss", ".pdf", ".atom", ".xlsx")
API_MARKS = ("swagger.json", "openapi.json", "openapi.yaml", "api-docs", "docs/api")
READ_AS = {".csv": "CSV_DOWNLOAD", ".xlsx": "CSV_DOWNLOAD", ".xls": "CSV_DOWNLOAD", ".json": "JSON_API", ".xml": "XBRL"}
NEUTRAL, SESSION_COST, FILE_GAIN, OPAQUE_COST, OPAQUE_DIGITS = 0.5, 0.4, 0.3, 0.2, 24


def _part(url: Column, n: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query with its mark, 5 fragment with its mark."""
    return F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", n)


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def without_dots(p: Column) -> Column:
    """An absolute path with `.` and `..` segments applied; more `..` than folders stop at the root."""
    last = F.element_at(F.split(p, "/"), -1)
    kept = F.aggregate(
        F.slice(F.split(p, "/"), 2, 1_000_000), F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def resolved(page: Column, link: Column) -> Column:
    """A link of a page as an absolute address. An empty link is the page itself."""
    link = F.trim(link)
    root = F.concat(_part(page, 1), F.lit("://"), _part(page, 2))
    tail = F.concat(_part(link, 4), _part(link, 5))
    base = F.when(path(page) == "", "/").otherwise(path(page))
    folder = F.regexp_extract(base, r"^(.*/)", 1)
    return (
        F.when(link == "", page)
        .when(_part(link, 1) != "", link)
        .when(link.startswith("//"), F.concat(_part(page, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, without_dots(path(link)), tail))
        .when(link.startswith("?"), F.concat(root, path(page), tail))
        .when(link.startswith("#"), F.concat(root, path(page), _part(page, 4), tail))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path(link))), tail))
    )


def read_as(url: Column) -> Column:
    """How the target would be read, by the ending of its path."""
    low, out = F.lower(path(url)), F.lit("HTML_SCRAPE")
    for ending, method in READ_AS.items():
        out = F.when(low.endswith(ending), method).otherwise(out)
    return out


def shape_score(url: Column) -> Column:
    """From 0 to 1: a structured file is likely to stay, a session or a long opaque number is not."""
    low = F.lower(url)
    holds = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: low.contains(m))
    worth = lambda test, w: F.when(test, F.lit(w)).otherwise(F.lit(0.0))
    score = F.lit(NEUTRAL) - worth(holds(SESSION_MARKS), SESSION_COST) + worth(holds(LASTING_ENDINGS), FILE_GAIN) - worth(low.rlike(f"[0-9a-f]{{{OPAQUE_DIGITS},}}"), OPAQUE_COST)
    return F.round(clamp(score, 0.0, 1.0), 6)
