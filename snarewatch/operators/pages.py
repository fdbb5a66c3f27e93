"""Captured pages: text, forms, redirects, spoofing and credential theft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.functions import urls
from snarewatch.operators.links import lexical_score

MAX_HTML = 200_000
NETWORK_CAP = 45
#: Characters within which a portal phrase must stand from a brand's name.
NEAR = 80
#: Similarity of a host to a brand from which it resembles it.
RESEMBLES = 0.55
#: Characters that a page must have to be compared with others.
MIN_TEXT = 300


def _without_element(html: Column, name: str) -> Column:
    """The text with each element ``name`` and its content as one blank; one that never ends stays.

    Cut at the end tags: what stands before one goes from the first start tag on.
    """
    start = rf"(?i)<{name}"

    def cut(part: Column) -> Column:
        at = F.regexp_instr(part, F.lit(start))
        return F.when(at > 0, F.concat(F.left(part, at - 1), F.lit(" "))).otherwise(F.concat(part, F.lit(f"</{name}>")))

    def joined(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.array_join(F.transform(parts, lambda part, i: F.when(i < last, cut(part)).otherwise(part)), "")

    return urls.let(F.split(html, rf"(?i)</{name}>"), joined)


def _without_tags(html: Column) -> Column:
    """The text with each tag, from ``<`` to the next ``>``, as one blank."""
    cut = lambda part: F.when(F.contains(part, F.lit("<")), F.concat(F.substring_index(part, "<", 1), F.lit(" "))).otherwise(F.concat(part, F.lit(">")))

    def joined(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.array_join(F.transform(parts, lambda part, i: F.when(i < last, cut(part)).otherwise(part)), "")

    return urls.let(F.split(html, ">"), joined)


def _title(html: Column) -> Column:
    """What stands in the first title element, or nothing."""
    opened = F.regexp_instr(html, F.lit("(?i)<title"))
    inner = F.when(opened > 0, F.substring(html, opened, F.length(html)))
    rest = F.when(F.contains(inner, F.lit(">")), F.substring(inner, F.locate(">", inner) + 1, F.length(html)))
    within = lambda r: F.when(F.regexp_instr(r, F.lit("(?i)</title>")) > 0, F.get(F.split(r, "(?i)</title>", 2), F.lit(0)))
    return F.coalesce(urls.let(rest, within), F.lit(""))


def page_text(html: Column) -> Column:
    """Title, line feed, text without scripts, styles and tags; white space collapsed.

    Texts are cut at fixed strings and put together again, never matched across, so
    that the time is linear in the page, whatever it holds.
    """
    flat = lambda x: F.trim(F.regexp_replace(_without_tags(x), r"\s+", " "))
    body = _without_element(_without_element(html, "script"), "style")
    return F.concat(flat(_title(html)), F.lit("\n"), flat(body))


def tags(html: Column, name: str) -> Column:
    """Attributes of each start tag ``name`` in page order, as text; a tag ends at the next ``>``."""
    after = F.slice(F.split(html, rf"(?i)<{name}(?=[\s/])"), F.lit(2), F.greatest(F.size(F.split(html, rf"(?i)<{name}(?=[\s/])")) - 1, F.lit(0)))
    return F.transform(F.filter(after, lambda part: F.contains(part, F.lit(">"))), lambda part: F.substring_index(part, ">", 1))


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's quoted attribute; null without one."""
    found = F.regexp_extract_all(tag, F.lit(rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    return F.get(F.transform(found, lambda v: F.substring(v, F.lit(2), F.length(v) - 2)), F.lit(0))


#: A field of type password, and a form's target, wherever the name of an attribute begins: quotes need not be alike, the last target
#: of a tag counts, and it may hold ``>``. A start tag that has none is passed over up to the next ``>``, so that the time stays linear.
_ANY_PASSWORD = r"""(?i)<input(?!\w)(?:[^>]*(?<!\w)(type)\s*=\s*["']password["']|[^>]*+)"""
_ANY_ACTION = r"""(?i)<form(?!\w)(?:[^>]*(?<!\w)action\s*=\s*["']([^"']*)["']|[^>]*+)"""


def asks_password(html: Column, loose: bool = False) -> Column:
    """Whether the page has an input of type password."""
    if loose:
        return F.exists(F.regexp_extract_all(html, F.lit(_ANY_PASSWORD), F.lit(1)), lambda name: name != "")
    return F.exists(tags(html, "input"), lambda tag: F.coalesce(F.lower(attribute(tag, "type")) == "password", F.lit(False)))


def any_actions(html: Column) -> Column:
    """Targets of forms in page order whose attributes need no blank in front of them; empty for a form without one."""
    return F.regexp_extract_all(html, F.lit(_ANY_ACTION), F.lit(1))


def form_actions(pages: DataFrame) -> DataFrame:
    """Targets of every form in page order: page_id, position (from 1), action."""
    named = F.filter(F.transform(tags(F.col("html"), "form"), lambda tag: attribute(tag, "action")), lambda a: a.isNotNull())
    found = pages.select("page_id", F.posexplode(named).alias("i", "action"))
    return found.select("page_id", (F.col("i") + 1).alias("position"), "action")


def redirects(pages: DataFrame) -> DataFrame:
    """Add from_domain, to_domain, crossed and redirect_points (0 for allowed pairs)."""
    pairs = pages.sparkSession.createDataFrame([*C.FIRST_PARTY_REDIRECTS], "from_domain string, to_domain string")
    domain = lambda c: urls.registered_domain(urls.host(urls.normalized(F.col(c))))
    wide = pages.withColumn("from_domain", domain("url")).withColumn("to_domain", domain("final_url"))
    wide = wide.join(F.broadcast(pairs.withColumn("allowed", F.lit(True))), ["from_domain", "to_domain"], "left")
    wide = wide.withColumn("crossed", F.col("from_domain") != F.col("to_domain"))
    return wide.withColumn("redirect_points", F.when(F.col("crossed") & F.col("allowed").isNull(), 20).otherwise(0))


def response_points(pages: DataFrame) -> DataFrame:
    """Add shape_points of hops, plain http and status.

    Where ``pages`` has trace_error, a page that could not be followed has the
    error's points instead: 30 for a bad certificate, 15 for any other.
    """
    hops = F.when(F.col("hops") >= 4, 10).otherwise(0)
    plain = F.when(~F.lower("final_url").startswith("https://"), 5).otherwise(0)
    failed = F.when(F.col("status") >= 400, 10).otherwise(0)
    shape = hops + plain + failed
    if "trace_error" in pages.columns:
        shape = F.when(F.col("trace_error") == "bad_tls", 30).when(F.col("trace_error").isNotNull(), 15).otherwise(shape)
    return pages.withColumn("shape_points", shape)


def network_points(pages: DataFrame) -> DataFrame:
    """Add network_points (capped) and rescored (the final address's own score, at most 30)."""
    wide = lexical_score(response_points(redirects(pages)), "final_url")
    again = F.when(F.col("redirect_points") > 0, F.least("score", F.lit(30))).otherwise(0)
    return wide.withColumn("network_points", F.least(F.col("shape_points") + F.col("redirect_points"), F.lit(NETWORK_CAP))).withColumn("rescored", again)


def stolen_to(html: Column, final_url: Column, loose: bool = False) -> Column:
    """The host of another domain to which the first such form of a page with a password field posts; null if none.

    With ``loose`` attributes need no blank in front of them.
    """
    own = urls.registered_domain(urls.host(urls.normalized(final_url)))
    if loose:
        named = any_actions(html)
    else:
        named = F.filter(F.transform(tags(html, "form"), lambda tag: attribute(tag, "action")), lambda a: a.isNotNull())
    hosts = F.transform(F.filter(named, lambda a: F.contains(a, F.lit("://"))), urls.host)
    first = lambda o: F.get(F.filter(hosts, lambda h: (h != "") & (urls.registered_domain(h) != o)), F.lit(0))
    return F.when(asks_password(html, loose), urls.let(own, first))


def credential_exfil(pages: DataFrame) -> DataFrame:
    """Pages with a password field and a form that posts to another domain: page_id, target."""
    found = pages.select("page_id", stolen_to(F.col("html"), F.col("final_url")).alias("target"))
    return found.where(F.col("target").isNotNull())


def with_resemblance(pages: DataFrame, top: DataFrame) -> tuple[DataFrame, Column]:
    """Pages with their host's best similarity to a brand, and whether that is enough.

    ``top`` has page_id, kind and similarity of each host's nearest seeds.
    """
    best = top.where("kind = 'brand'").groupBy("page_id").agg(F.max("similarity").alias("best_brand"))
    return pages.join(best.hint("merge"), "page_id", "left"), F.coalesce(F.col("best_brand") >= RESEMBLES, F.lit(False))


def long_enough(text: Column) -> Column:
    """Whether a page says enough to be compared; near-empty pages are all alike."""
    return F.length(text) >= MIN_TEXT


def portrayed(low: Column, own: Column) -> Column:
    """Brands that a text in lower case names three times on a domain ``own`` that is not theirs, in list order: array of {brand, near}.

    ``near`` says that a portal phrase begins within NEAR characters of a mention. Only what
    names a brand is searched for phrases.
    """
    phrases, told = "|".join(C.PORTAL_PHRASES), []
    for domain in C.BRANDS:
        root = domain.split(".")[0]
        if len(root) >= 4:
            before = "|".join(f"{p}.{{0,{NEAR - len(p)}}}{root}" for p in C.PORTAL_PHRASES)
            near = low.rlike(f"(?s){root}.{{0,{NEAR - len(root)}}}(?:{phrases})|{before}")
            without = F.length(F.replace(low, F.lit(root), F.lit("")))
            thrice = F.contains(low, F.lit(root)) & (F.length(low) - without >= 3 * len(root))
            told.append(F.when(thrice & (own != domain), F.struct(F.lit(domain).alias("brand"), near.alias("near"))))
    return F.filter(F.array(*told), lambda b: b.isNotNull())


def posing(low: Column, own: Column, resembles: Column) -> Column:
    """The first brand that a text in lower case presents itself as, on the domain ``own``; null if none."""
    return F.get(F.filter(portrayed(low, own), lambda b: resembles | b["near"]), F.lit(0))["brand"]


def brand_spoof(pages: DataFrame, resembles: Column | None = None) -> DataFrame:
    """Pages that present themselves as a brand they are not: page_id, brand.

    The brand's name, of four letters or more, occurs three times and the domain
    resembles a brand (``resembles``) or a portal phrase begins within 80
    characters of a mention. The first brand in list order counts. Brands are
    literals of the expression, so pages stay where they are.
    """
    resembles = F.lit(False) if resembles is None else resembles
    own = urls.registered_domain(urls.host(urls.normalized(F.col("final_url"))))
    text = F.lower(page_text(F.substring("html", 1, MAX_HTML)))
    wide = pages.withColumn("own", own).withColumn("brand", urls.let(text, lambda low: posing(low, F.col("own"), resembles)))
    # the row number keeps the filter above the projection, so that each page is read once
    return wide.withColumn("row", F.monotonically_increasing_id()).where("brand is not null and row >= 0").select("page_id", "brand")
