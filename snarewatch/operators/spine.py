"""The evidence spine: what is known of pages, links and messages, each written once.

Every page's html is parsed in one pass, every link gets its verdict by joins on its id, and
every message one row that holds its links (five at most) with their verdicts. What is said of
a message - verdicts, reasons, documents, shortcuts - is a projection of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.functions import addresses, risk, urls
from snarewatch.functions import constants as C
from snarewatch.operators import links as L
from snarewatch.operators import pages as P
from snarewatch.operators import vectors as V
from snarewatch.operators import verdicts as D
from snarewatch.sources.fixtures import kept


def page_facts(pages: DataFrame, whole: bool = False, loose: bool = False) -> DataFrame:
    """One row a page, written: page_id, host, network_points, rescored, posed, posed_alike, stolen, enough, unreached, signature.

    ``posed`` is the brand that a page presents itself as, ``posed_alike`` the one if its host
    resembles a brand; ``stolen`` says that a login form posts to another domain, ``enough``
    that the text can be compared with others, ``unreached`` that nothing answered. With
    ``whole`` a page poses by all of its text, else by that of its first MAX_HTML characters; with ``loose``
    forms count whose attributes have no blank in front of them.
    """
    pages = V.spread(pages)
    text = P.page_text(F.col("html"))
    # a text of the first MAX_HTML characters alone is parsed only where there are more
    shown = F.lit(None).cast("string") if whole else F.when(F.length("html") > P.MAX_HTML, P.page_text(F.substring("html", 1, P.MAX_HTML)))
    error = F.col("trace_error") if "trace_error" in pages.columns else F.lit(None).cast("string")
    read = P.network_points(pages).select(
        "page_id", urls.host(F.col("url")).alias("host"), "final_url", "network_points", "rescored",
        text.alias("text"), shown.alias("shown"), P.stolen_to(F.col("html"), F.col("final_url"), loose).isNotNull().alias("stolen"),
        F.coalesce(error.isNotNull() & (error != "bad_tls"), F.lit(False)).alias("unreached"),
    )
    own = urls.registered_domain(urls.host(urls.normalized(F.col("final_url"))))
    named = urls.let(F.struct(F.lower(F.coalesce("shown", "text")).alias("low"), own.alias("own")), lambda x: P.portrayed(x["low"], x["own"]))
    first = lambda brands: F.get(brands, F.lit(0))["brand"]
    told = urls.let(named, lambda b: F.struct(first(F.filter(b, lambda x: x["near"])).alias("posed"), first(b).alias("posed_alike")))
    # texts are judged before they are signed, so that no task of Python hands them on
    judged = read.withColumns({"told": told, "enough": P.long_enough(F.col("text"))}).select(
        "page_id", "text", "host", "network_points", "rescored", "told.posed", "told.posed_alike", "stolen", "enough", "unreached"
    )
    facts = V.minhash(judged, "page_id", "text", *judged.columns[2:])
    facts = facts.select(*judged.columns[:1], *judged.columns[2:], "signature")
    return kept(facts)


def link_facts(links: DataFrame, intel: DataFrame, facts: DataFrame, by_domain: bool = True, least_length: bool = True, seen: DataFrame | None = None) -> DataFrame:
    """Verdict of every link: link_id, norm, score, level, trusted, confirmed, degraded, dead.

    The rules are those of ``link_verdicts`` with cached reputation and ``degraded``, where
    ``intel`` has vt_cached; ``facts`` has the capture of each link under the link's id. With
    ``by_domain`` a page also poses as a brand where the link's host resembles one, with
    ``least_length`` short texts are not compared. ``seen`` has link_id and seen_points of links
    that resemble an earlier risky one. A link is dead if its name has no address or nothing answered.
    """
    long = facts.where("enough") if least_length else facts
    near = V.near_duplicates(long.select(F.col("page_id").alias("id"), "host", "signature")).select(F.col("id").alias("link_id"), F.lit(25).alias("copied"))
    base = L.lexical_score(links).select("link_id", "norm", "host", "score", F.col("reg_domain").isin(*C.BRANDS).alias("trusted"))
    base = V.with_similarity(base, "host", ("brand", "phish"), 4)
    wide = L.enrich_links(base, intel)
    remembered = [] if seen is None else [seen.select("link_id", "seen_points")]
    for side in (facts.drop("host", "signature").withColumnRenamed("page_id", "link_id"), near, *remembered):
        wide = wide.join(side.hint("merge"), "link_id", "left")
    wide = wide if remembered else wide.withColumn("seen_points", F.lit(0))
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    alike = F.coalesce(F.col("brand_near") >= P.RESEMBLES, F.lit(False)) if by_domain else F.lit(False)
    spoof = F.when(F.when(alike, F.col("posed_alike")).otherwise(F.col("posed")).isNotNull(), 35).otherwise(0)
    theft = F.when(F.coalesce("stolen", F.lit(False)), 40).otherwise(0)
    strange = F.when(F.col("trusted"), 0).otherwise(D.phish_points(F.coalesce("phish_near", F.lit(0.0))) + spoof + theft + v("seen_points"))
    so_far = F.col("score") + strange + v("dns_points") + v("age_points") + v("cert_points") + v("network_points") + v("rescored") + v("copied")
    cached = F.coalesce("vt_cached", F.lit(False)) if "vt_cached" in intel.columns else F.lit(False)
    wide = wide.withColumn("so_far", so_far)
    wide = wide.withColumn("asked", F.when(~F.col("trusted") & ((F.col("so_far") > 0) | cached), v("vt_points")).otherwise(0))
    told = wide.select(
        "link_id", "norm", (F.col("so_far") + F.col("asked")).cast("int").alias("score"), "trusted", (F.col("asked") > 0).alias("confirmed"),
        F.coalesce("vt_unavailable", F.lit(True)).alias("blind"), (F.col("brand_near").isNull() & F.col("phish_near").isNull()).alias("unlike"),
        (F.coalesce(F.col("n_ips") == 0, F.lit(False)) | F.coalesce("unreached", F.lit(False))).alias("dead"),
    ).withColumn("level", risk.level(F.col("score")))
    silent = F.col("unlike") & (F.col("level") != "safe") & ~F.col("confirmed")
    return told.withColumn("degraded", silent | (F.col("blind") & (F.col("level") != "dangerous"))).drop("blind", "unlike")


def message_rows(messages: DataFrame, hidden: DataFrame) -> DataFrame:
    """Messages read once, written: message_id, file_id, links_only, keyword, malformed, similarity, links.

    ``links`` holds what ``web_links`` and ``merge_hidden_links`` find, in order:
    {url, display_text, hidden}; a message without any has an empty list.
    """
    words = F.exists(F.array(*[F.lit(k) for k in C.KEYWORDS]), lambda k: F.contains(F.lower("text"), k))
    read = messages.select(
        "message_id", "file_id", F.coalesce("text", F.lit("")).alias("text"), addresses.found_urls(F.col("text")).alias("found"), L.only_links_of(F.col("text")).alias("bare"),
    )
    read = read.withColumn("links_only", (F.size("found") > 0) & F.col("bare")).withColumn("malformed", F.lower("text").rlike(r"\bhttps?//")).withColumn("keyword", words)
    scored = V.with_similarity(read.select("message_id", "file_id", "text", "found", "links_only", "malformed", "keyword"), "text", ("scam_pattern",), 1)
    script = F.when(~F.col("links_only") & (F.col("scam_pattern_near") >= 0.5), F.col("scam_pattern_near"))
    web = F.slice(F.filter("found", lambda u: (~F.contains(u, F.lit("://"))) | F.lower(u).rlike("^https?://")), 1, C.MAX_LINKS)
    base = scored.select("message_id", "file_id", "links_only", "keyword", "malformed", script.alias("similarity"), web.alias("seen"))
    # of hidden links the first in order can be needed, and as many as those that are visible
    few = hidden.where(F.lower("raw_url").rlike("^https?://")).withColumn("n", F.row_number().over(Window.partitionBy("message_id").orderBy("raw_url", "display_text")))
    few = few.where(F.col("n") <= 2 * C.MAX_LINKS).groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct(F.col("raw_url").alias("url"), "display_text"))).alias("more"))
    wide = base.join(few.hint("merge"), "message_id", "left")
    shown = F.transform("seen", lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("display_text"), F.lit(False).alias("hidden")))
    low = F.transform("seen", F.lower)
    new = F.filter(F.coalesce("more", F.array()), lambda x: ~F.array_contains(F.col("low"), F.lower(x["url"])))
    both = F.slice(F.concat(shown, F.transform(new, lambda x: F.struct(x["url"].alias("url"), x["display_text"].alias("display_text"), F.lit(True).alias("hidden")))), 1, C.MAX_LINKS)
    return kept(wide.withColumn("low", low).withColumn("links", both).drop("low", "seen", "more"))


def judged_links(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Every link of a message with its verdict there: message_id, link {position, url, hidden, score, level, confirmed, degraded, dead, reg_domain}.

    ``known`` has norm, score, confirmed, degraded and dead of judged links; the highest of
    several counts. An address never captured has its lexical score. A campaign's address may
    stand in half of all messages: verdicts are dealt anew, so that the join can be split.
    """
    found = rows.select("message_id", "malformed", F.posexplode("links").alias("i", "link")).select(
        "message_id", "malformed", (F.col("i") + 1).alias("position"), F.col("link.url").alias("raw_url"), "link.display_text", "link.hidden"
    )
    links = L.anchor_mismatch(L.lexical_score(found)).select("message_id", "malformed", "position", "raw_url", "hidden", "norm", "score", "mismatch_points", "reg_domain")
    flags = [F.bool_or(c).alias(c) for c in ("confirmed", "degraded", "dead")]
    best = known.groupBy("norm").agg(F.max("score").alias("judged"), *flags).repartition(F.xxhash64("norm"))
    wide = links.join(best.hint("merge"), "norm", "left")
    context = F.when(F.col("hidden"), F.col("mismatch_points")).when(F.col("malformed"), 15).otherwise(0)
    total = (F.coalesce("judged", "score") + context).cast("int")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    told = wide.withColumn("score", total)
    link = F.struct("position", F.col("raw_url").alias("url"), "hidden", "score", risk.level(F.col("score")).alias("level"), flag("confirmed"), flag("degraded"), flag("dead"), "reg_domain")
    return told.select("message_id", link.alias("link"))


def message_evidence(rows: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """The evidence of each message, one row: what ``full_message_evidence`` has, and degraded, dead and links.

    A message's links come together as five at most; ``dead`` says that one of them is, and
    ``degraded`` that evidence on one was not to be had. ``files`` has file_id, file_pct,
    file_level, found and malicious.
    """
    by_message = judged_links(rows, known).groupBy("message_id").agg(F.sort_array(F.collect_list("link")).alias("links"))
    wide = rows.drop("links").join(by_message.hint("merge"), "message_id", "left").join(files.hint("merge"), "file_id", "left")
    wide = wide.withColumn("links", F.coalesce("links", F.array().cast(by_message.schema["links"].dataType)))
    count = lambda test: F.size(F.filter("links", test)).cast("bigint")
    risky = lambda x: x["level"] != "safe"
    bad_file = F.coalesce(F.col("found") & (F.col("malicious") > 0), F.lit(False))
    return wide.withColumns({
        "worst": F.coalesce(F.array_max(F.transform("links", lambda x: x["score"])), F.lit(0)), "n_links": F.size("links").cast("bigint"), "n_risky": count(risky),
        "n_trusted": count(lambda x: x["reg_domain"].isin(*C.BRANDS)), "confirmed": bad_file | F.exists("links", lambda x: x["confirmed"]),
        "confirmed_link": F.exists("links", lambda x: x["confirmed"] & risky(x)), "degraded": F.exists("links", lambda x: x["degraded"]), "dead": F.exists("links", lambda x: x["dead"]),
    })


def links_of(evidence: DataFrame) -> DataFrame:
    """The links of messages as rows: message_id, position, url, hidden, score, level, confirmed."""
    found = evidence.select("message_id", F.explode("links").alias("x"))
    return found.select("message_id", *[F.col(f"x.{c}").alias(c) for c in ("position", "url", "hidden", "score", "level", "confirmed")])


def findings(links: Column) -> Column:
    """What a model may see of links: host, level, score, confirmed, by position."""
    host = lambda x: urls.host(urls.normalized(x["url"])).alias("host")
    return F.transform(links, lambda x: F.struct(host(x), x["level"].alias("level"), x["score"].alias("score"), x["confirmed"].alias("confirmed")))
