"""Links: extraction, lexical score, brand checks and enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.functions import addresses, risk, urls


def explode_links(messages: DataFrame) -> DataFrame:
    """One row per address in a message: message_id, position (from 1), url."""
    found = messages.select("message_id", F.posexplode(addresses.found_urls(F.col("text"))).alias("i", "url"))
    return found.select("message_id", (F.col("i") + 1).alias("position"), "url")


def web_links(links: DataFrame, most: int = C.MAX_LINKS) -> DataFrame:
    """Links that a browser opens, at most ``most`` a message, by position."""
    web = links.where((~F.col("url").contains("://")) | F.lower("url").rlike("^https?://"))
    turn = Window.partitionBy("message_id").orderBy("position")
    return web.withColumn("position", F.row_number().over(turn)).where(F.col("position") <= most)


def merge_hidden_links(visible: DataFrame, hidden: DataFrame, most: int = C.MAX_LINKS) -> DataFrame:
    """Visible links, then hidden ones that are http(s) and not already visible.

    ``hidden`` has message_id, display_text, raw_url. At most ``most`` in all; the
    text that a hidden link showed is kept as display_text.
    """
    seen = visible.select("message_id", F.lower("url").alias("low"))
    new = hidden.where(F.lower("raw_url").rlike("^https?://")).withColumn("low", F.lower("raw_url"))
    new = new.join(seen.hint("merge"), ["message_id", "low"], "left_anti").select(
        "message_id", F.lit(1).alias("side"), F.lit(0).alias("position"), F.col("raw_url").alias("url"), "display_text"
    )
    shown = visible.select("message_id", F.lit(0).alias("side"), "position", "url", F.lit(None).cast("string").alias("display_text"))
    turn = Window.partitionBy("message_id").orderBy("side", "position", "url")
    both = shown.unionByName(new).withColumn("position", F.row_number().over(turn)).where(F.col("position") <= most)
    return both.select("message_id", "position", "url", "display_text", (F.col("side") == 1).alias("hidden"))


def link_parts(links: DataFrame, raw: str = "raw_url") -> DataFrame:
    """Add norm, scheme, userinfo, host, path, query, reg_domain and tld."""
    return (
        links.withColumn("norm", urls.normalized(F.col(raw)))
        .withColumn("scheme", urls.scheme(F.col("norm")))
        .withColumn("userinfo", urls.userinfo(F.col("norm")))
        .withColumn("host", urls.host(F.col("norm")))
        .withColumn("path", urls.path(F.col("norm")))
        .withColumn("query", urls.query(F.col("norm")))
        .withColumn("reg_domain", urls.registered_domain(F.col("host")))
        .withColumn("tld", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise(""))
    )


#: Points of the lexical rules, by name, for a table that ``link_parts`` has widened.
def lexical_points() -> dict[str, Column]:
    host, reg = F.col("host"), F.col("reg_domain")
    core = F.substring_index(reg, ".", 1)
    digits = F.length(core) - F.length(F.regexp_replace(core, "[0-9]", ""))
    # labels in front of the owning domain
    before = F.when(host.endswith(reg), F.size(F.array_remove(F.split(F.expr("left(host, length(host) - length(reg_domain))"), r"\."), ""))).otherwise(0)
    hyphens = F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))
    random = F.col("hit").isNull() & (F.length(core) >= 8) & (digits >= 2) & (urls.entropy(core) >= 3.0)
    rule = lambda condition, points: F.when(condition, points).otherwise(0)
    return {
        "raw_ip": rule(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), 45),
        "userinfo": rule(F.col("userinfo") != "", 40),
        "punycode": rule(host.contains("xn--"), 30),
        "shortener": rule(host.isin(*C.SHORTENERS) | reg.isin(*C.SHORTENERS), 25),
        "abused_tld": rule(F.col("tld").isin(*C.ABUSED_TLDS), 25),
        "brand": F.coalesce(F.col("hit.points"), F.lit(0)),
        "words": F.least(F.size("words") * 10, F.lit(30)),
        "random_label": rule(random, 15),
        "deep": rule(before >= 3, 15),
        "hyphens": rule(hyphens >= 3, 10),
        "long": rule(F.length("norm") > 90, 5),
        "not_https": rule(F.col("scheme") != "https", 5),
    }


def lexical_score(links: DataFrame, raw: str = "raw_url") -> DataFrame:
    """Add the parts, hit, words, reasons, score (uncapped) and level of each link.

    A link without a host scores 0. One projection: no join, no shuffle.
    """
    wide = link_parts(links, raw)
    wide = wide.withColumn("hit", urls.brand_hit(F.col("host"), F.col("reg_domain"))).withColumn(
        "words", urls.suspicious_words(F.col("host"), F.col("path"), F.col("query"))
    )
    points = lexical_points()
    rows = F.array(*[F.struct(F.lit(k).alias("code"), v.cast("int").alias("points")) for k, v in points.items()])
    empty = F.col("host") == ""
    return (
        wide.withColumn("reasons", F.filter(rows, lambda r: (r["points"] > 0) & ~empty))
        .withColumn("score", F.aggregate("reasons", F.lit(0), lambda a, r: a + r["points"]))
        .withColumn("level", risk.level(F.col("score")))
    )


def anchor_mismatch(links: DataFrame) -> DataFrame:
    """Add shown (domain that the display text names) and mismatch_points (55 or 0)."""
    shown = urls.host(urls.normalized(F.get(addresses.found_urls(F.col("display_text")), F.lit(0))))
    real = urls.registered_domain(urls.host(urls.normalized(F.col("raw_url"))))
    return links.withColumn("shown", urls.registered_domain(shown)).withColumn(
        "mismatch_points", F.when(F.col("shown").isNotNull() & (F.col("shown") != "") & (F.col("shown") != real), 55).otherwise(0)
    )


def malformed_links(messages: DataFrame) -> DataFrame:
    """Every link of a message whose text has ``http//`` or ``https//``: +15 each."""
    flagged = messages.withColumn("malformed", F.lower("text").rlike(r"\bhttps?//"))
    found = flagged.select("message_id", "malformed", F.posexplode(addresses.found_urls(F.col("text"))).alias("i", "url"))
    return found.select("message_id", (F.col("i") + 1).alias("position"), "url", F.when(F.col("malformed"), 15).otherwise(0).alias("points"))


def _leftover(text: Column) -> Column:
    """The text without addresses, their bare hosts and dotted words."""
    return F.regexp_replace(addresses.replaced(text, " ", "", shown=False), r"[^\s]+\.[^\s]+", " ")


def only_links_of(text: Column) -> Column:
    """Whether no word character remains of a text without its addresses."""
    return ~_leftover(F.coalesce(text, F.lit(""))).rlike(r"[\p{L}\p{N}_]")


def only_links(messages: DataFrame) -> DataFrame:
    """Add links_only: an address is present and no word character remains without them."""
    has = F.size(addresses.found_urls(F.col("text"))) > 0
    return messages.withColumn("links_only", has & ~_leftover(F.col("text")).rlike(r"[\p{L}\p{N}_]"))


def bare_trusted_links(messages: DataFrame) -> DataFrame:
    """Messages that are one address of a listed brand and nothing else."""
    one = only_links(messages).withColumn("found", addresses.found_urls(F.col("text"))).where("links_only and size(found) = 1")
    one = one.withColumn("reg_domain", urls.registered_domain(urls.host(urls.normalized(F.get("found", F.lit(0))))))
    return one.where(F.col("reg_domain").isin(*C.BRANDS)).select("message_id", F.get("found", F.lit(0)).alias("url"), "reg_domain")


#: Address ranges that no fetch may reach, as (first, last) of each block.
BLOCKED_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
)


def as_number(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def blocked_ip(hosts: DataFrame, column: str = "host") -> DataFrame:
    """Add ip_number and blocked: inside a blocked range, or no well-formed address."""
    octets = F.split(F.col(column), r"\.")
    shaped = F.col(column).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    values = [F.get(octets, F.lit(i)).try_cast("bigint") for i in range(4)]
    number = ((values[0] * 256 + values[1]) * 256 + values[2]) * 256 + values[3]
    fine = shaped & (F.greatest(*values) <= 255)
    numbered = hosts.withColumn("ip_number", F.when(fine, number))
    inside = F.lit(False)
    for low, high in BLOCKED_RANGES:
        inside = inside | F.col("ip_number").between(as_number(low), as_number(high))
    return numbered.withColumn("blocked", F.col("ip_number").isNull() | inside)


def url_identifier(url: Column) -> Column:
    """The key of a reputation service: unpadded url-safe base64 of the address."""
    lines = F.base64(F.encode(url, "utf-8"))
    return F.rtrim(F.translate(lines, "+/\r\n", "-_"), F.lit("="))


def defang(text: Column, plain: bool = False) -> Column:
    """The text with each address as code: in an element, or with ``plain`` in backticks."""
    return addresses.replaced(text, *("`", "`") if plain else ("<code>", "</code>"))


def domain_age_points(days: Column) -> Column:
    return F.when(days.isNull(), 0).when(days < 30, 35).when(days < 90, 20).when(days < 365, 10).otherwise(0)


def cert_age_points(days: Column) -> Column:
    return F.when(days.isNull(), 0).when(days < 7, 20).when(days < 30, 10).otherwise(0)


def reputation_points(malicious: Column, suspicious: Column) -> Column:
    return F.when(malicious >= 5, 50).when(malicious >= 2, 40).when(malicious >= 1, 25).when(suspicious >= 1, 15).otherwise(0)


def enrich_links(links: DataFrame, intel: DataFrame) -> DataFrame:
    """Left-join a link's enrichment row and score it; a link without one keeps zeros.

    An unavailable reputation answer is a state of its own and scores nothing.
    """
    known = F.coalesce(F.col("vt_unavailable"), F.lit(True)) == F.lit(False)
    return (
        links.join(intel.hint("merge"), "link_id", "left")
        .withColumn("age_points", domain_age_points(F.col("domain_age_days")))
        .withColumn("cert_points", cert_age_points(F.col("cert_age_days")))
        .withColumn("dns_points", F.when(F.col("n_ips") == 0, 25).otherwise(0))
        .withColumn("vt_points", F.when(known, reputation_points(F.col("vt_malicious"), F.col("vt_suspicious"))).otherwise(0))
    )


def asof_latest(checks: DataFrame, observed: DataFrame, key: str, ttl: str) -> DataFrame:
    """For each check, the newest observation of its key not older than ``ttl``.

    ``checks`` has check_id, ts and the key; ``observed`` has ts, value and the key.
    Both go into one stream per key, in time order, and the last observation is
    carried forward: one shuffle, no range join. An observation as old as the ttl
    still counts; at equal times it goes before the check.
    """
    one = observed.select(key, "ts", F.lit(0).alias("side"), F.struct("ts", "value").alias("seen"), F.lit(None).cast("bigint").alias("check_id"))
    two = checks.select(key, "ts", F.lit(1).alias("side"), F.lit(None).cast(one.schema["seen"].dataType).alias("seen"), "check_id")
    order = Window.partitionBy(key).orderBy("ts", "side", F.col("seen.value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = one.unionByName(two).withColumn("last", F.last("seen", ignorenulls=True).over(order)).where("side = 1")
    fresh = F.col("last.ts") >= F.col("ts") - F.expr(f"interval {ttl}")
    return carried.select("check_id", key, "ts", F.when(fresh, F.col("last.value")).alias("value"))


def rdap_dates(rows: DataFrame) -> DataFrame:
    """Registration date and registrar from registry JSON (column ``body``)."""
    shape = (
        "events array<struct<eventAction:string,eventDate:string>>, "
        "entities array<struct<roles:array<string>,fn:string>>"
    )
    doc = F.from_json("body", shape)
    registered = F.get(F.filter(doc["events"], lambda e: e["eventAction"] == "registration"), F.lit(0))["eventDate"]
    registrar = F.get(F.filter(doc["entities"], lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))["fn"]
    return rows.withColumn("registered_on", F.to_date(F.try_to_timestamp(registered))).withColumn("registrar", registrar)


def cert_dates(rows: DataFrame) -> DataFrame:
    """``Jan  1 00:00:00 2024 GMT`` in column ``not_before`` to a UTC date; null if malformed."""
    text = F.regexp_replace(F.regexp_replace("not_before", " +", " "), " GMT$", "")
    return rows.withColumn("valid_from", F.to_date(F.try_to_timestamp(text, F.lit("MMM d HH:mm:ss yyyy"))))
