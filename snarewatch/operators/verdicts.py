"""Verdicts: one link's full score, one message's evidence, and what is said of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.functions import risk, urls
from snarewatch.operators import links as L
from snarewatch.operators import pages as P
from snarewatch.operators import vectors as V

#: Without confirmed evidence no verdict shows a higher number.
UNCONFIRMED_CAP = 80
DEAD_LINK_RISK, DEAD_LINK_MOST = 30, 45


def phish_points(similarity: Column) -> Column:
    return F.when(similarity >= 0.80, 40).when(similarity >= 0.55, 20).otherwise(0)


def link_verdicts(links: DataFrame, intel: DataFrame, pages: DataFrame, near: DataFrame, by_domain: bool = False, degraded: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """Full score of each link: link_id, score, level, trusted, confirmed.

    Lexical points, similarity to phishing shapes among the four nearest seeds,
    enrichment, network, page and near-duplicate evidence are summed. Reputation is
    asked only where something else has scored. ``pages`` holds the capture of each
    link under the link's id; ``near`` has (page_id) of near-duplicates. With
    ``by_domain`` a page also poses as a brand where the link's host resembles one. If
    ``intel`` has vt_cached, a fresh cached answer counts even where nothing has scored.
    With ``degraded`` a column of that name says that evidence which could change the level was not to be had.
    ``seen`` has link_id and seen_points of links that resemble an earlier risky one.
    """
    base = L.lexical_score(links).withColumn("trusted", F.col("reg_domain").isin(*C.BRANDS))
    top = V.nearest(base, "link_id", "host", ("brand", "phish"), 4)
    phish = top.where("kind = 'phish'").groupBy("link_id").agg(F.max("similarity").alias("phish"))
    network = P.network_points(pages).select(F.col("page_id").alias("link_id"), "network_points", "rescored")
    posed = P.brand_spoof(pages)
    if by_domain:
        posed = P.brand_spoof(*P.with_resemblance(pages, top.select(F.col("link_id").alias("page_id"), "kind", "similarity")))
    spoof = posed.select(F.col("page_id").alias("link_id"), F.lit(35).alias("spoof"))
    theft = P.credential_exfil(pages).select(F.col("page_id").alias("link_id"), F.lit(40).alias("theft"))
    copied = near.select(F.col("page_id").alias("link_id"), F.lit(25).alias("copied"))
    wide = L.enrich_links(base.select("link_id", "score", "trusted"), intel)
    remembered = [] if seen is None else [seen.select("link_id", "seen_points")]
    for side in (phish, network, spoof, theft, copied, *remembered):
        wide = wide.join(side.hint("merge"), "link_id", "left")
    wide = wide if remembered else wide.withColumn("seen_points", F.lit(0))
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    strange = F.when(F.col("trusted"), 0).otherwise(phish_points(F.coalesce("phish", F.lit(0.0))) + v("spoof") + v("theft") + v("seen_points"))
    so_far = F.col("score") + strange + v("dns_points") + v("age_points") + v("cert_points") + v("network_points") + v("rescored") + v("copied")
    cached = F.coalesce("vt_cached", F.lit(False)) if "vt_cached" in intel.columns else F.lit(False)
    asked = F.when(~F.col("trusted") & ((F.col("so_far") > 0) | cached), v("vt_points")).otherwise(0)
    unlike = top.select("link_id", F.lit(True).alias("like")).distinct()
    told = (
        wide.withColumn("so_far", so_far).withColumn("asked", asked)
        .select("link_id", (F.col("so_far") + F.col("asked")).cast("int").alias("score"), "trusted", (F.col("asked") > 0).alias("confirmed"), F.coalesce("vt_unavailable", F.lit(True)).alias("blind"))
        .withColumn("level", risk.level(F.col("score")))
    )
    if not degraded:
        return told.drop("blind")
    silent = F.col("like").isNull() & (F.col("level") != "safe") & ~F.col("confirmed")
    return told.join(unlike.hint("merge"), "link_id", "left").withColumn("degraded", silent | (F.col("blind") & (F.col("level") != "dangerous"))).drop("blind", "like")


#: Characters of a page's text that the memory keeps of a link.
KEPT_TEXT = 300


def remembered_scans(scans: DataFrame, links: DataFrame, pages: DataFrame, levels: DataFrame) -> DataFrame:
    """Checks as ``seen_memory`` takes them: scan_id, link_id, at, key, text, kept, level, trusted.

    A link is compared by its address and remembered under where it led to (its host if it
    was not followed) as address and start of the page; ``levels`` has link_id, level, trusted.
    """
    text = F.substring(P.page_text(F.col("html")), 1, KEPT_TEXT)
    led = pages.select(F.col("page_id").alias("link_id"), "final_url", text.alias("page"))
    norm = urls.normalized(F.col("raw_url"))
    known = links.select("link_id", norm.alias("text"), urls.host(norm).alias("host")).join(led.hint("merge"), "link_id", "left").join(levels.hint("merge"), "link_id")
    known = known.select("link_id", "text", F.lower(F.coalesce("final_url", "host")).alias("key"), F.trim(F.concat_ws(" ", "text", F.coalesce("page", F.lit("")))).alias("kept"), "level", "trusted")
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    # a link may have a third of all checks: its row is dealt anew, so that the join can be split
    return scans.select("scan_id", "link_id", at).join(known.repartition(F.xxhash64("link_id")).hint("merge"), "link_id")


def message_evidence(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence of each message, one row a message.

    ``messages`` has message_id, text and file_id (null without a file); ``files``
    has file_id, file_pct, file_level, malicious, found. Adds worst (highest link
    score, 0 without links), n_links, n_risky, links_only, keywords, script and
    similarity, and the file's columns; a file that could not be read is a row.
    """
    found = L.explode_links(messages)
    scored = L.lexical_score(found, "url").groupBy("message_id").agg(
        F.max("score").alias("worst"), F.count("*").alias("n_links"), F.count_if(F.col("level") != "safe").alias("n_risky"),
        F.count_if(F.col("reg_domain").isin(*C.BRANDS)).alias("n_trusted"),
    )
    told = L.only_links(messages)
    words = F.exists(F.array(*[F.lit(k) for k in C.KEYWORDS]), lambda k: F.contains(F.lower("text"), k))
    scripts = V.script_matches(told.where("not links_only").select("message_id", "text")).select("message_id", "similarity")
    wide = told.withColumn("keyword", words).join(scored.hint("merge"), "message_id", "left").join(scripts.hint("merge"), "message_id", "left").join(files.hint("merge"), "file_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("worst", "n_links", "n_risky", "n_trusted")}
    told = wide.withColumns(zero).withColumn("confirmed", F.coalesce(F.col("found") & (F.col("malicious") > 0), F.lit(False)))
    return told.withColumn("confirmed_link", F.col("confirmed") & (F.col("n_risky") > 0))


def reason_rows(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Why a message is suspected, a row a reason: message_id, place, reason, points.

    Keyword, script, each link that is not safe (``links`` as rows of the evidence's links), file;
    places count from 1 in that order, links by position.
    """
    file = F.col("file_level").isin("dangerous", "suspicious", "uncertain")
    rules = (
        (1, "keyword", F.col("keyword"), F.lit(None)), (2, "script", F.col("similarity").isNotNull(), F.floor(F.col("similarity") * 100)),
        (9, "file", F.coalesce(file, F.lit(False)), F.col("file_pct")),
    )
    row = lambda rank, name, points: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("position"), F.lit(name).alias("reason"), points.cast("int").alias("points"))
    told = evidence.select("message_id", F.explode(F.array_compact(F.array(*[F.when(c, row(rank, name, points)) for rank, name, c, points in rules]))).alias("r"))
    risky = links.where("level <> 'safe'").select("message_id", F.struct(F.lit(3).alias("rank"), "position", F.lit("link").alias("reason"), F.col("score").cast("int").alias("points")).alias("r"))
    turn = Window.partitionBy("message_id").orderBy("r.rank", "r.position")
    return told.unionByName(risky).select("message_id", F.row_number().over(turn).alias("place"), "r.reason", "r.points")


def fallback_verdict(evidence: DataFrame) -> DataFrame:
    """The verdict without a language model: message_id, verdict, risk_percentage.

    A dangerous file makes a Scam, any reason makes Uncertain. The number is the
    highest of link, script and file, capped unless confirmed, and missing when an
    unverified file is the only concern; then it is pulled into the verdict's band.
    """
    bad_file = F.coalesce(F.col("file_level") == "dangerous", F.lit(False))
    odd_file = F.coalesce(F.col("file_level").isin("suspicious", "uncertain"), F.lit(False))
    script = F.col("similarity").isNotNull()
    reason = F.col("keyword") | script | (F.col("n_risky") > 0) | bad_file | odd_file
    verdict = F.when(bad_file, "Scam").when(reason, "Uncertain").otherwise("Not a Scam")
    any_part = (F.col("n_links") > 0) | script | F.col("file_level").isNotNull()
    top = F.greatest(F.least("worst", F.lit(100)), F.floor(F.coalesce("similarity", F.lit(0.0)) * 100).cast("int"), F.coalesce("file_pct", F.lit(0)))
    capped = F.when(F.col("confirmed"), top).otherwise(F.least(top, F.lit(UNCONFIRMED_CAP)))
    lone = (F.coalesce(F.col("file_level") == "uncertain", F.lit(False))) & ~F.col("keyword") & ~script & (F.col("n_risky") == 0)
    number = F.when(any_part & ~lone, capped)
    return evidence.select("message_id", verdict.alias("verdict"), risk.coherent(verdict, number).alias("risk_percentage"))


def reconcile(evidence: DataFrame, model: DataFrame) -> DataFrame:
    """Raise a model's verdict that evidence contradicts; never lower one.

    ``model`` has message_id, verdict, risk_percentage. Returns the same columns.
    """
    both = model.select("message_id", F.col("verdict").alias("said"), risk_number(F.col("risk_percentage")).alias("given")).join(evidence.hint("merge"), "message_id")
    bad_file = F.coalesce(F.col("file_level") == "dangerous", F.lit(False))
    odd_file = F.coalesce(F.col("file_level").isin("suspicious", "uncertain"), F.lit(False))
    proven = F.col("confirmed_link") | F.col("similarity").isNotNull()
    clean = F.col("said") == "Not a Scam"
    first, second, third = bad_file & (F.col("said") != "Scam"), clean & proven, clean & odd_file
    verdict = F.when(first, "Scam").when(second | third, "Uncertain").otherwise(F.col("said"))
    script = F.floor(F.coalesce("similarity", F.lit(0.0)) * 100).cast("int")
    number = (
        F.when(first, F.greatest("given", F.coalesce("file_pct", F.lit(0))))
        .when(second, F.greatest(F.col("given"), F.least("worst", F.lit(100)), script))
        .when(third, F.col("file_pct"))
        .otherwise(F.col("given"))
    )
    capped = F.when(F.col("confirmed"), number).otherwise(F.when(number.isNotNull(), F.least(number, F.lit(UNCONFIRMED_CAP))))
    return both.select("message_id", verdict.alias("verdict"), risk.coherent(verdict, capped).alias("risk_percentage"))


def risk_number(given: Column) -> Column:
    return F.when(given.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), given)))


def shortcuts(evidence: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Messages decided without a model: message_id, verdict, risk_percentage, rule.

    A column ``dead`` of the evidence says that a link does not answer; where it has none,
    ``dead`` has message_id of messages whose only link does not.
    """
    alone = F.col("links_only") & (F.col("n_links") == 1) & F.col("file_level").isNull() & ~F.col("keyword") & F.col("similarity").isNull()
    wide = evidence if dead is None else evidence.join(dead.select("message_id", F.lit(True).alias("dead")).hint("merge"), "message_id", "left")
    gone = alone & F.coalesce("dead", F.lit(False)) & (risk.level(F.col("worst")) == "suspicious") & (F.col("worst") <= DEAD_LINK_MOST) & ~F.col("confirmed")
    trusted = alone & (F.col("n_trusted") == 1) & (risk.level(F.col("worst")) == "safe")
    rule = F.when(gone, "dead_link").when(trusted, "trusted_link")
    return wide.withColumn("rule", rule).where("rule is not null").select(
        "message_id", F.when(F.col("rule") == "dead_link", "Uncertain").otherwise("Not a Scam").alias("verdict"),
        F.when(F.col("rule") == "dead_link", DEAD_LINK_RISK).otherwise(F.col("worst")).cast("int").alias("risk_percentage"), "rule",
    )


def summary_key(verdict: Column, number: Column) -> Column:
    """Which of four sentences stands under a verdict."""
    band = risk.band(number)
    return (
        F.when(verdict == "Scam", F.when(band.isin("low", "medium"), "warning_signs").otherwise("strong_unsafe"))
        .when(verdict == "Not a Scam", F.when(band.isin("medium", "high"), "warning_signs").otherwise("no_indicators"))
        .when(band == "high", "strong_unsafe").when(band == "medium", "warning_signs")
        .when(number.isNull(), "uncertain_no_signal").otherwise("no_indicators")
    )


def type_label(text: Column, link: Column, file: Column) -> Column:
    return (
        F.when(text & link & file, "all").when(text & link, "text+link").when(text & file, "text+file")
        .when(link & file, "file+link").when(text, "text").when(link, "link").when(file, "file").otherwise("text")
    )


#: Advice by verdict, in the order shown.
ADVICE = {
    "Scam": ("do_not_click", "do_not_share", "block_sender"),
    "Uncertain": ("verify_sender", "do_not_share"),
    "Not a Scam": ("stay_alert",),
}


def advice(verdicts: DataFrame) -> DataFrame:
    """Advice keys of each verdict in order: message_id, position (from 1), advice."""
    rows = [(v, i + 1, a) for v, keys in ADVICE.items() for i, a in enumerate(keys)]
    table = verdicts.sparkSession.createDataFrame(rows, "verdict string, position int, advice string")
    return verdicts.join(F.broadcast(table), "verdict").select("message_id", "position", "advice")


def localize(keys: DataFrame, texts: DataFrame, default: str = "en") -> DataFrame:
    """Text of each (lang, key): in that language, else in the default, else the key.

    ``texts`` (lang, key, text) is a translation table, small by nature and checked:
    beyond 100,000 rows it is joined by shuffle like any other table.
    """
    small = texts.limit(100_001).count() <= 100_000
    hint = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    own = texts.select("lang", "key", F.col("text").alias("own"))
    fall = texts.where(F.col("lang") == default).select("key", F.col("text").alias("fall"))
    return keys.join(hint(own), ["lang", "key"], "left").join(hint(fall), "key", "left").withColumn("text", F.coalesce("own", "fall", "key")).drop("own", "fall")


def evidence_json(evidence: DataFrame, links: Column | None = None) -> DataFrame:
    """One JSON document a message with the facts a model may see: message_id, body.

    Links are told by their number and highest score or, with ``links``, an array of
    findings, one by one; of an address the host alone is shown, as its sender wrote the rest.
    A column ``sender`` of the evidence, the name of a verified sender, is told where not null.
    """
    file = F.when(F.col("file_level").isNotNull(), F.struct(F.col("file_level").alias("kind"), F.col("file_pct").alias("score")))
    told = [F.col("worst").alias("worst_link"), F.col("n_links")]
    if links is not None:
        told = [links.alias("links")]
    sender = ["sender"] if "sender" in evidence.columns else []
    body = F.to_json(
        F.struct("keyword", *told, "confirmed", F.round("similarity", 3).alias("similarity"), file.alias("file"), *sender), {"ignoreNullFields": "true"}
    )
    return evidence.select("message_id", body.alias("body"))
