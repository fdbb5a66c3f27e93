"""URL filters: list rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes of a host are shrunk through beta-binomial priors: the
suffix is shrunk towards the whole, the registered domain towards its suffix, the
host towards its domain. How strongly is estimated from the data, by moments. A
host is blocked when the lower posterior bound of its rate of bad pages is over a
threshold. All of it is DataFrame expressions; pages and documents are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarewatch.llm.common import checkpoint

#: (verdict, host, path): a rule fits its host and all subdomains from that path on.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host goes when its rate of bad pages is above this with the given confidence.
BAD_RATE = 0.5
Z = 1.645
#: Copies of the tables of hosts and of prints, over which a hot one's pages spread.
SALT = 16
#: Halvings in which a posterior bound is found: it is exact to 1e-7.
HALVINGS = 24
#: Second labels that make a suffix of two labels under a country's two letters.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "govt", "mil", "ne", "net", "nom", "or", "org", "sch")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host on up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule = verdict = None
    for kind, at, below in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        rule = F.when(fits, at + below) if rule is None else rule.when(fits, at + below)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(name: Column) -> Column:
    """The last label, or the last two where a country's registry sells below the second; an address has none."""
    two = F.substring_index(name, ".", -2)
    registry = r"^(?:" + "|".join(REGISTRY_LABELS) + r")\.[a-z]{2}$"
    return F.when(name.rlike(r"^[0-9.]+$|^\["), "").when(two.rlike(registry), two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(name: Column) -> Column:
    """The suffix and the label before it, or the name if it has no more; an address stands for itself."""
    suffix = suffix_of(name)
    labels = F.when(suffix.contains("."), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(suffix == "", name).otherwise(labels)


def _strength(groups: DataFrame) -> float:
    """Weight of the prior that the spread of the groups' rates speaks for, by moments.

    One row of sums comes to the driver. Groups no more apart than chance allows
    get the largest weight, groups that are all bad or all good the smallest.
    """
    seen = groups.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum("bad"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("bad") * F.col("bad") / F.col("n")))
    j, n, bad, squares, spread = (float(x or 0) for x in seen.first())
    if j < 2 or not 0 < bad < n:
        return 10.0
    m = bad / n
    between = spread - n * m * m  # sum of n (rate - mean)^2
    room = m * (1 - m) * (n - squares / n - (j - 1))
    share = (between - m * (1 - m) * (j - 1)) / room if room > 0 else 0.0
    share = min(max(share, 0.002), 0.5)
    return 1 / share - 1


def beta_below(x: Column, alpha: Column, beta: Column) -> Column:
    """Normal deviate of the chance that a beta variable is below ``x``.

    The cube-root approximation; its chance is off by less than 0.01 from about one
    pseudo-count each on, and by less than 0.001 from ten.
    """
    u, v = F.pow(beta * x, F.lit(1 / 3)), F.pow(alpha * (1 - x), F.lit(1 / 3))
    return 3 * (u * (1 - 1 / (9 * beta)) - v * (1 - 1 / (9 * alpha))) / F.sqrt(u * u / beta + v * v / alpha)


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """The rate that the posterior is below with the chance of ``-z``, found by halving."""

    def halve(low: Column, step: Column) -> Column:
        middle = low + F.pow(F.lit(2.0), -step)
        return F.when(beta_below(middle, alpha, beta) <= -z, middle).otherwise(low)

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.lit(0.0), halve)


def host_reputation(visits: DataFrame) -> DataFrame:
    """Posterior of each host's rate of bad pages from rows (host, bad).

    ``bad`` is 0, 1 or null (not labelled). Returns host, n, n_bad, prior (the
    domain's shrunken rate), alpha, beta, rate and low (the lower bound). A host
    without labelled pages keeps its domain's prior. Counts by host are written once;
    all else is computed from them.
    """
    name = host_name(F.col("host"))
    counts = visits.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = checkpoint(counts.withColumn("domain", registered_domain(name)).withColumn("suffix", suffix_of(name)))
    domains = checkpoint(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = checkpoint(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    whole = (bad + 1.0) / (n + 2.0)
    shrunk = lambda prior, k: (F.col("bad") + prior * k) / (F.col("n") + F.lit(k))
    top = suffixes.select("suffix", shrunk(F.lit(whole), _strength(suffixes)).alias("over"))
    mid = domains.join(top.hint("merge"), "suffix").select("domain", shrunk(F.col("over"), _strength(domains)).alias("prior"))
    k = _strength(hosts)
    return (
        hosts.join(mid.hint("merge"), "domain")
        .withColumn("alpha", F.col("bad") + F.col("prior") * k)
        .withColumn("beta", F.col("n") - F.col("bad") + (1 - F.col("prior")) * k)
        .withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        .withColumn("low", lower_bound(F.col("alpha"), F.col("beta")))
        .select("host", "n", F.col("bad").alias("n_bad"), "prior", "alpha", "beta", "rate", "low")
    )


def _letters(text: Column) -> Column:
    """Print of a text's letters, null if it has none."""
    letters = F.regexp_replace(text, r"[^\p{L}]+", "")
    return F.when(letters != "", F.md5(letters))


def article_text(html: Column) -> Column:
    """What stands between the tags of the first article, headings and references left out; "" without one.

    Cut at its angle brackets, not matched, so that the time is linear in the page.
    """
    opened = F.regexp_instr(html, F.lit(r"<article[\s>]"))
    inner = F.substring_index(F.when(opened > 0, F.substring(html, opened + 1, F.length(html))), "</article>", 1)
    # the piece after each "<" is a tag, ">" and the text that follows it
    after = lambda piece: F.when(F.contains(piece, F.lit(">")), F.substring(piece, F.locate(">", piece) + 1, F.length(piece))).otherwise("")
    pieces = F.filter(F.split(inner, "<"), lambda piece: ~F.startswith(piece, F.lit("h1>")))
    return F.coalesce(F.regexp_replace(F.array_join(F.transform(pieces, after), " "), r"&[A-Za-z0-9#]{1,32};", ""), F.lit(""))


def page_outcomes(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages through the labelled document whose letters their article has.

    Returns (page_id, bad): 1 for low quality or toxic, 0 otherwise; pages without
    a labelled document, without an article or without a letter in it are not
    returned. Copies of a text take the worst label. Prints of few labelled texts go
    out in ``SALT`` copies, so that the pages that hold one text are spread.
    """
    bad = F.greatest(1 - F.coalesce("quality", F.lit(1)), F.coalesce("toxic", F.lit(0)))
    prints = documents.select("doc_id", _letters(F.col("text")).alias("print")).where("print is not null")
    known = prints.join(labels.select("doc_id", bad.alias("bad")).hint("merge"), "doc_id").groupBy("print").agg(F.max("bad").alias("bad"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    read = pages.select("page_id", _letters(article_text(F.col("html"))).alias("print")).where("print is not null")
    salted = read.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    return salted.join(known.hint("merge"), ["print", "salt"]).select("page_id", "bad")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, bad_rate: float = BAD_RATE) -> DataFrame:
    """Judge every page's url: page_id, host, path, rule, verdict, low.

    The longest fitting rule decides; otherwise the host's reputation does, and low
    is its bound. A null url or one without ``://`` has empty host and path and
    shares the reputation of the empty host. Repeated page ids are judged row by
    row; outcomes of one id are taken at their worst. No pages give no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    worst = outcomes.groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("bad"))
    visits = parts.join(worst.hint("merge"), F.col("page_id") == F.col("_id"), "left")
    known = host_reputation(visits.select("host", "bad")).select("host", "low", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    judged = salted.join(known.hint("merge"), ["host", "_salt"], "left").withColumn("rule", rule)
    method = F.when(F.col("low") > bad_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "low")
