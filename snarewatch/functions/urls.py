"""Columns of a web address. All are Catalyst expressions; none needs a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snarewatch.functions import constants as C

_NETLOC = r"^[^:/?#]*://([^/?#]*)"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(raw: Column) -> Column:
    return F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("http://"), raw))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))


def userinfo(url: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(url, _NETLOC, 1), r"^(.*)@", 1)


def host(url: Column) -> Column:
    after = F.regexp_replace(F.regexp_extract(url, _NETLOC, 1), r"^.*@", "")
    return F.lower(F.regexp_replace(after, r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def registered_domain(host: Column) -> Column:
    """The owning domain: two labels, or three where the last two are a suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*C.TWO_LEVEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def deleet(text: Column) -> Column:
    return F.translate(text, C.LEET_FROM, C.LEET_TO)


def entropy(label: Column) -> Column:
    """Shannon entropy in bits a character, to six digits; 0 for an empty label."""
    n = F.length(label).cast("double")

    def part(c: Column) -> Column:
        share = (n - F.length(F.replace(label, c, F.lit("")))) / n
        return -share * F.log2(share)

    total = F.aggregate(F.transform(F.array_distinct(F.split(label, "")), part), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, F.round(total, 6)).otherwise(0.0)


def suspicious_words(host: Column, path: Column, query: Column) -> Column:
    """Distinct scam-typical words of host and path, sorted; whole words only."""
    pattern = F.lit(r"\b(?:" + "|".join(C.URL_WORDS) + r")\b")
    rest = F.lower(F.concat(path, F.lit("?"), query))
    return F.array_sort(F.array_union(F.regexp_extract_all(host, pattern, F.lit(0)), F.regexp_extract_all(rest, pattern, F.lit(0))))


def brand_hit(host: Column, reg: Column) -> Column:
    """First brand that a domain poses as: struct(points, brand, rule), null if none.

    Brands go in list order; within one, a disguised copy (50) goes before a typo
    and a buried name (45). A listed domain never poses as another. The list is a
    literal of fixed length, so no join and no shuffle are needed.
    """
    leet_reg, leet_host = deleet(reg), deleet(host)
    brands = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(d.split(".")[0]).alias("root")) for d in C.BRANDS])

    def typo(domain: Column, text: Column) -> Column:
        return (F.abs(F.length(text) - F.length(domain)) <= 2) & F.levenshtein(text, domain, 2).between(1, 2)

    def rule(b: Column) -> Column:
        domain, root = b["domain"], b["root"]
        near = (F.length(domain) >= 7) & (typo(domain, reg) | typo(domain, leet_reg))
        buried = (F.length(root) >= 4) & (F.contains(host, root) | F.contains(leet_host, root))
        return F.when(leet_reg == domain, "leet").when(near, "typo").when(buried, "buried")

    hits = F.transform(brands, lambda b: F.struct(b["domain"].alias("brand"), rule(b).alias("rule")))
    first = F.get(F.filter(hits, lambda h: h["rule"].isNotNull()), F.lit(0))
    scored = lambda h: F.when(h.isNotNull(), F.struct(F.when(h["rule"] == "leet", 50).otherwise(45).alias("points"), h["brand"].alias("brand"), h["rule"].alias("rule")))
    return F.when(~reg.isin(*C.BRANDS), let(first, scored))
