"""Link queries and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.functions import addresses as A
from snarewatch.functions import constants as C
from snarewatch.functions import risk, urls
from snarewatch.operators import links as L
from snarewatch.sources.fixtures import Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def host_sql(url: str) -> str:
    norm = f"case when {url} like '%://%' then {url} else 'http://' || {url} end"
    return f"lower(regexp_replace(regexp_replace(regexp_extract({norm}, '^[^:/?#]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


def reg_sql(host: str) -> str:
    last = lambda n: f"array_to_string(list_slice(string_split({host}, '.'), -{n}, -1), '.')"
    return f"case when {last(2)} in ({names(C.TWO_LEVEL_SUFFIXES)}) then {last(3)} else {last(2)} end"


def deleet_sql(x: str) -> str:
    return f"translate({x}, '{C.LEET_FROM}', '{C.LEET_TO}')"


def parts_sql(table: str = "links", raw: str = "raw_url") -> str:
    """CTE body: ``table`` with the parts of its address."""
    return f"""select *, array_to_string(list_slice(string_split(reg_domain, '.'), 1, 1), '.') as core,
      case when host like '%.%' then string_split(host, '.')[-1] else '' end as tld
    from (select *, {reg_sql('host')} as reg_domain from (select *, lower(regexp_extract(norm, '^([^:/?#]*)://', 1)) as scheme,
      regexp_extract(regexp_extract(norm, '^[^:/?#]*://([^/?#]*)', 1), '^(.*)@', 1) as userinfo, {host_sql('norm')} as host,
      regexp_extract(norm, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(norm, '\\?([^#]*)', 1) as query
      from (select *, case when {raw} like '%://%' then {raw} else 'http://' || {raw} end as norm from {table})))"""


_BRANDS = ", ".join(f"({i}, '{d}', '{d.split('.')[0]}')" for i, d in enumerate(C.BRANDS))


def brand_sql(parts: str) -> str:
    """CTE body: (host, brand, rule, points) of the first brand that a host poses as."""
    lev = lambda x: f"(abs(length({x}) - length(b.domain)) <= 2 and levenshtein({x}, b.domain) between 1 and 2)"
    leet_reg, leet_host = deleet_sql("h.reg_domain"), deleet_sql("h.host")
    return f"""select host, arg_min(domain, place) as brand, arg_min(rule, place) as rule,
      cast(case arg_min(rule, place) when 'leet' then 50 else 45 end as integer) as points
    from (select h.host, b.domain, b.i as place,
        case when {leet_reg} = b.domain then 'leet'
             when length(b.domain) >= 7 and ({lev('h.reg_domain')} or {lev(leet_reg)}) then 'typo'
             when length(b.root) >= 4 and (contains(h.host, b.root) or contains({leet_host}, b.root)) then 'buried' end as rule
      from (select distinct host, reg_domain from {parts}) h, (values {_BRANDS}) b(i, domain, root)
      where h.reg_domain not in ({names(C.BRANDS)}))
    where rule is not null group by host"""


_WORDS = r"\b(?:" + "|".join(C.URL_WORDS) + r")\b"
WORDS_SQL = f"list_sort(list_distinct(list_concat(regexp_extract_all(host, '{_WORDS}'), regexp_extract_all(lower(path || '?' || query), '{_WORDS}'))))"


def entropy_sql(x: str) -> str:
    share = f"((length({x}) - length(replace({x}, c, '')))::double / length({x}))"
    return f"(case when length({x}) > 0 then round(list_sum([-{share} * log2({share}) for c in list_distinct(string_split({x}, ''))]), 6) else 0.0 end)"


def score_sql(table: str = "links", raw: str = "raw_url", keep: str = "link_id") -> str:
    """Statement: ``keep``, host, reg_domain, score, level of every link of ``table``."""
    return f"""with p as ({parts_sql(table, raw)}), b as ({brand_sql('p')}),
    s as (select p.{keep}, p.host, p.reg_domain, case when p.host = '' then 0 else
        case when regexp_matches(p.host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') then 45 else 0 end
      + case when userinfo <> '' then 40 else 0 end + case when contains(p.host, 'xn--') then 30 else 0 end
      + case when p.host in ({names(C.SHORTENERS)}) or reg_domain in ({names(C.SHORTENERS)}) then 25 else 0 end
      + case when tld in ({names(C.ABUSED_TLDS)}) then 25 else 0 end + coalesce(b.points, 0)
      + least(10 * len({WORDS_SQL.replace('host,', 'p.host,')}), 30)
      + case when b.points is null and length(core) >= 8 and length(core) - length(regexp_replace(core, '[0-9]', '', 'g')) >= 2
             and {entropy_sql('core')} >= 3.0 then 15 else 0 end
      + case when ends_with(p.host, reg_domain) and len([x for x in string_split(left(p.host, length(p.host) - length(reg_domain)), '.') if x <> '']) >= 3 then 15 else 0 end
      + case when length(p.host) - length(replace(p.host, '-', '')) >= 3 then 10 else 0 end
      + case when length(norm) > 90 then 5 else 0 end + case when scheme <> 'https' then 5 else 0 end end as score
      from p left join b on p.host = b.host)
    select {keep}, host, reg_domain, cast(score as integer) as score,
      case when score >= 60 then 'dangerous' when score >= 25 then 'suspicious' else 'safe' end as level from s"""


def _is_host(s: str) -> str:
    host = f"string_split(regexp_replace({s}, ':[0-9]+$', ''), '@')[-1]"
    labels = f"string_split({host}, '.')"
    return f"""(len({labels}) > 1 and not list_contains({labels}, '') and regexp_full_match({host}, '[a-zA-Z0-9.-]+')
      and (regexp_full_match({labels}[-1], '[a-zA-Z]+') and length({labels}[-1]) between 2 and {A.LAST_MOST} or len({labels}) = 4 and regexp_full_match({host}, '[0-9.]+')))"""


def pieces_sql(x: str) -> str:
    """List of the pieces of a text between blanks and brackets: {piece, parts (cut at slashes), host (number of the part
    that is one, 0 if none), start (number of the part where the address begins)}."""
    cut = f"[{{'piece': c, 'parts': string_split(c, '/')}} for c in string_split_regex(coalesce({x}, ''), '[\\s<>()]+')]"
    hosted = f"[{{'piece': p.piece, 'parts': p.parts, 'host': case when contains(p.piece, '.') then coalesce(list_position([{_is_host('s')} for s in p.parts], true), 0) else 0 end}} for p in {cut}]"
    scheme = "p.host > 2 and p.parts[p.host - 1] = '' and lower(p.parts[p.host - 2]) in ('http:', 'https:')"
    return f"[{{'piece': p.piece, 'parts': p.parts, 'host': p.host, 'start': p.host - case when {scheme} then 2 else 0 end}} for p in {hosted}]"


def raw_urls_sql(x: str) -> str:
    return f"[array_to_string(p.parts[p.start:], '/') for p in {pieces_sql(x)} if p.host > 0]"


def urls_sql(x: str) -> str:
    """List of the addresses in a text, without their closing marks."""
    return f"[rtrim(u, {text(A.CLOSING)}) for u in {raw_urls_sql(x)}]"


def marked_sql(x: str, before: str, after: str) -> str:
    """A text of one address at most, with that between two marks."""
    first = f"({raw_urls_sql(x)})[1]"
    return f"coalesce(replace({x}, {first}, '{before}' || {first} || '{after}'), {x})"


_URLS = urls_sql("text")
EXPLODED_SQL = f"""select message_id, text, position, url from (
    select message_id, text, generate_subscripts(l, 1) as i, unnest(l) as url, l from (select message_id, text, {_URLS} as l from message_text))
    , lateral (select list_position([lower(x) for x in l], lower(url)) as first), lateral (select len(list_distinct([lower(x) for x in l[1:i]])) as position)
    where i = first"""


@query(f"select message_id, cast(position as integer) as position, url from ({EXPLODED_SQL})")
def extract_urls(t: Tables) -> DataFrame:
    return L.explode_links(t["message_text"])


@query(f"""select message_id, cast(position as integer) as position, url from (select message_id, url, row_number() over (partition by message_id order by position) as position
  from ({EXPLODED_SQL}) where not contains(url, '://') or regexp_matches(lower(url), '^https?://')) where position <= 5""")
def web_urls(t: Tables) -> DataFrame:
    return L.web_links(L.explode_links(t["message_text"]))


@query(f"""with v as (select message_id, url, row_number() over (partition by message_id order by position) as position from ({EXPLODED_SQL})
    where not contains(url, '://') or regexp_matches(lower(url), '^https?://')),
  a as (select message_id, 0 as side, position, url, null as display_text from v where position <= 5
    union all select message_id, 1, 0, raw_url, display_text from hidden_links h where regexp_matches(lower(raw_url), '^https?://')
      and not exists (select 1 from v where v.position <= 5 and v.message_id = h.message_id and lower(v.url) = lower(h.raw_url)))
  select message_id, cast(n as integer) as position, url, display_text, side = 1 as hidden
  from (select *, row_number() over (partition by message_id order by side, position, url) as n from a) where n <= 5""")
def merge_hidden_links(t: Tables) -> DataFrame:
    return L.merge_hidden_links(L.web_links(L.explode_links(t["message_text"])), t["hidden_links"])


@query(f"""select message_id, cast(position as integer) as position, url,
  cast(case when regexp_matches(lower(text), '\\bhttps?//') then 15 else 0 end as integer) as points from ({EXPLODED_SQL})""")
def malformed_protocol(t: Tables) -> DataFrame:
    return L.malformed_links(t["message_text"])


@query(f"select link_id, norm, scheme, userinfo, host, path, query, tld from ({parts_sql()})")
def url_parts(t: Tables) -> DataFrame:
    return L.link_parts(t["links"]).select("link_id", "norm", "scheme", "userinfo", "host", "path", "query", "tld")


@query(f"select link_id, host, reg_domain from ({parts_sql()})")
def registered_domain(t: Tables) -> DataFrame:
    return L.link_parts(t["links"]).select("link_id", "host", "reg_domain")


@query(f"select link_id, {deleet_sql('host')} as plain_host from ({parts_sql()})")
def deleet(t: Tables) -> DataFrame:
    return L.link_parts(t["links"]).select("link_id", urls.deleet(F.col("host")).alias("plain_host"))


@query(f"select link_id, core, {entropy_sql('core')} as entropy from ({parts_sql()})")
def domain_entropy(t: Tables) -> DataFrame:
    parts = L.link_parts(t["links"]).withColumn("core", F.substring_index("reg_domain", ".", 1))
    return parts.select("link_id", "core", urls.entropy(F.col("core")).alias("entropy"))


@query(f"select link_id, array_to_string(w, ',') as words, cast(least(10 * len(w), 30) as integer) as points from (select link_id, {WORDS_SQL} as w from ({parts_sql()}))")
def suspicious_words(t: Tables) -> DataFrame:
    words = L.link_parts(t["links"]).withColumn("w", urls.suspicious_words(F.col("host"), F.col("path"), F.col("query")))
    return words.select("link_id", F.array_join("w", ",").alias("words"), F.least(F.size("w") * 10, F.lit(30)).alias("points"))


@query(score_sql())
def lexical_score(t: Tables) -> DataFrame:
    return L.lexical_score(t["links"]).select("link_id", "host", "reg_domain", "score", "level")


@query(f"""with x as (select link_id, coalesce(({urls_sql('display_text')})[1], '') as u, {reg_sql(host_sql('raw_url'))} as real from links),
  y as (select link_id, real, case when u <> '' then {reg_sql(host_sql('u'))} end as shown from x)
  select link_id, shown, cast(case when shown is not null and shown <> '' and shown <> real then 55 else 0 end as integer) as mismatch_points from y""")
def anchor_mismatch(t: Tables) -> DataFrame:
    return L.anchor_mismatch(t["links"]).select("link_id", "shown", "mismatch_points")


#: A web address in running text (bot/detectors/url/offline/lexical.py:103-108 of the reference), several in a piece as well, and its closing marks; blanks are those of Python.
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NAME = r"(?:[0-9a-z](?:[0-9a-z-]{0,61}[0-9a-z])?\.)+[a-z]{2,24}"
URL_PATTERN = rf"(?i)(?:https?://)?(?:[0-9a-z%+._-]+@)?(?:{_NAME}|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})(?::[0-9]{{2,5}})?(?:/[^()<>{_BLANK}]*)?"


def every_url_sql(x: str) -> str:
    """List of all addresses in a text, without their closing marks."""
    return f"[rtrim(u, {text(A.CLOSING)}) for u in regexp_extract_all(coalesce({x}, ''), {text(URL_PATTERN)})]"


_LEFT = f"regexp_replace(array_to_string([case when p.host > 0 then array_to_string(p.parts[1:p.start - 1], '/') else p.piece end for p in {pieces_sql('text')}], ' '), '[^\\s]+\\.[^\\s]+', ' ', 'g')"
_LEFT_OF_ALL = f"regexp_replace(regexp_replace(text, {text(URL_PATTERN)}, ' ', 'g'), '[^\\s]+\\.[^\\s]+', ' ', 'g')"
ONLY_SQL = f"select message_id, text, {_URLS} as l, len({_URLS}) > 0 and not regexp_matches({_LEFT}, '[\\p{{L}}\\p{{N}}_]') as links_only from message_text"


def all_addresses_sql(sql: str, *others: str) -> str:
    """A statement with all addresses of messages and of the texts ``others``."""
    for x in ("text", *others):
        sql = sql.replace(urls_sql(x), every_url_sql(x))
    return sql.replace(_LEFT, _LEFT_OF_ALL)


@query(f"select message_id, links_only from ({ONLY_SQL})")
def message_is_only_links(t: Tables) -> DataFrame:
    return L.only_links(t["message_text"]).select("message_id", "links_only")


@query(f"""select message_id, l[1] as url, {reg_sql(host_sql('l[1]'))} as reg_domain from ({ONLY_SQL})
  where links_only and len(list_distinct([lower(x) for x in l])) = 1 and {reg_sql(host_sql('l[1]'))} in ({names(C.BRANDS)})""")
def bare_trusted_link(t: Tables) -> DataFrame:
    return L.bare_trusted_links(t["message_text"])


_IPS = "select link_id, case cast(link_id % 6 as int) when 0 then concat('10.0.', cast(link_id % 256 as string), '.7') when 1 then '8.8.8.8' when 2 then '169.254.169.254' when 3 then '300.1.1.1' when 4 then concat('93.184.', cast(link_id % 256 as string), '.34') else 'not-an-ip' end as host from links"
_OCT = lambda i: f"try_cast(string_split(host, '.')[{i}] as bigint)"


@query(f"""with a as ({_IPS}), n as (select *, case when regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') and greatest({_OCT(1)}, {_OCT(2)}, {_OCT(3)}, {_OCT(4)}) <= 255
    then (({_OCT(1)} * 256 + {_OCT(2)}) * 256 + {_OCT(3)}) * 256 + {_OCT(4)} end as ip_number from a)
  select link_id, host, ip_number, ip_number is null or {' or '.join(f'ip_number between {L.as_number(a)} and {L.as_number(b)}' for a, b in L.BLOCKED_RANGES)} as blocked from n""")
def blocked_ip(t: Tables) -> DataFrame:
    return L.blocked_ip(t.sql(_IPS)).select("link_id", "host", "ip_number", "blocked")


@query("select link_id, rtrim(replace(replace(to_base64(encode(raw_url)), '+', '-'), '/', '_'), '=') as identifier from links")
def url_identifier(t: Tables) -> DataFrame:
    return t["links"].select("link_id", L.url_identifier(F.col("raw_url")).alias("identifier"))


@query(f"select message_id, {marked_sql('text', '<code>', '</code>')} as shown from message_text")
def defang_text(t: Tables) -> DataFrame:
    return t["message_text"].select("message_id", L.defang(F.col("text")).alias("shown"))


@query(f"select message_id, {marked_sql('text', '`', '`')} as shown from message_text")
def defang_backticks(t: Tables) -> DataFrame:
    return t["message_text"].select("message_id", L.defang(F.col("text"), plain=True).alias("shown"))



AGE_SQL = "case when domain_age_days is null then 0 when domain_age_days < 30 then 35 when domain_age_days < 90 then 20 when domain_age_days < 365 then 10 else 0 end"
CERT_SQL = "case when cert_age_days is null then 0 when cert_age_days < 7 then 20 when cert_age_days < 30 then 10 else 0 end"
VT_SQL = "case when vt_malicious >= 5 then 50 when vt_malicious >= 2 then 40 when vt_malicious >= 1 then 25 when vt_suspicious >= 1 then 15 else 0 end"


@query(f"select link_id, cast({AGE_SQL} as integer) as points from link_intel")
def domain_age_score(t: Tables) -> DataFrame:
    return t["link_intel"].select("link_id", L.domain_age_points(F.col("domain_age_days")).alias("points"))


@query(f"select link_id, cast({CERT_SQL} as integer) as points from link_intel")
def cert_age_score(t: Tables) -> DataFrame:
    return t["link_intel"].select("link_id", L.cert_age_points(F.col("cert_age_days")).alias("points"))


@query(f"select link_id, cast({VT_SQL} as integer) as points from link_intel")
def vt_url_score(t: Tables) -> DataFrame:
    return t["link_intel"].select("link_id", L.reputation_points(F.col("vt_malicious"), F.col("vt_suspicious")).alias("points"))


_RDAP_BODY = """concat('{"events":[{"eventAction":"last changed","eventDate":"2024-05-05T00:00:00Z"}',
  case when page_id % 4 = 0 then '' else concat(',{"eventAction":"registration","eventDate":"20', cast(10 + page_id % 14 as string), '-03-1', cast(page_id % 10 as string), 'T08:00:00Z"}') end,
  '],"entities":[{"roles":["abuse"],"fn":"x"}', case when page_id % 3 = 0 then '' else concat(',{"roles":["registrar"],"fn":"Registrar ', cast(page_id % 7 as string), '"}') end, ']}') as body"""
_RDAP_COLUMNS = ("page_id as link_id", _RDAP_BODY)
_RDAP = f"select page_id as link_id, {_RDAP_BODY} from pages"


@query(f"""with r as ({_RDAP}) select link_id,
  cast(try_cast(nullif(json_extract_string(list_filter(cast(json_extract(body, '$.events') as json[]), lambda e: json_extract_string(e, '$.eventAction') = 'registration')[1], '$.eventDate'), '') as timestamptz)::timestamp as date) as registered_on,
  json_extract_string(list_filter(cast(json_extract(body, '$.entities') as json[]), lambda e: contains(json_extract_string(e, '$.roles'), 'registrar'))[1], '$.fn') as registrar from r""")
def rdap_flatten(t: Tables) -> DataFrame:
    return L.rdap_dates(t["pages"].selectExpr(*[x for x in _RDAP_COLUMNS])).select("link_id", "registered_on", "registrar")


_CERT = """select page_id as link_id, case when page_id % 9 = 0 then 'not a date' else concat(case cast(page_id % 3 as int) when 0 then 'Jan' when 1 then 'Jun' else 'Dec' end,
  case when page_id % 28 < 9 then '  ' else ' ' end, cast(1 + page_id % 28 as string), ' 0', cast(page_id % 10 as string), ':00:00 202', cast(page_id % 5 as string), ' GMT') end as not_before from pages"""


@query(f"with r as ({_CERT}) select link_id, cast(try_strptime(regexp_replace(regexp_replace(not_before, ' +', ' ', 'g'), ' GMT$', ''), '%b %-d %H:%M:%S %Y') as date) as valid_from from r")
def cert_date_parse(t: Tables) -> DataFrame:
    return L.cert_dates(t.sql(_CERT)).select("link_id", "valid_from")


@query(f"""with p as ({parts_sql()}) select link_id, reg_domain, reg_domain in ({names(C.BRANDS)}) as trusted_brand from p""")
def brand_immunity(t: Tables) -> DataFrame:
    brands = t.spark.createDataFrame([(d, True) for d in C.BRANDS], "reg_domain string, trusted_brand boolean")
    parts = L.link_parts(t["links"]).select("link_id", "reg_domain")
    return parts.join(F.broadcast(brands), "reg_domain", "left").select("link_id", "reg_domain", F.coalesce("trusted_brand", F.lit(False)).alias("trusted_brand"))


@query(f"with p as ({parts_sql()}), b as ({brand_sql('p')}) select link_id, brand, rule, points from p join b on p.host = b.host")
def brand_check(t: Tables) -> DataFrame:
    parts = L.link_parts(t["links"]).withColumn("hit", urls.brand_hit(F.col("host"), F.col("reg_domain")))
    return parts.where("hit is not null").select("link_id", "hit.brand", "hit.rule", "hit.points")


def _rule_query(rule: str):
    sql = f"with p as ({parts_sql()}), b as ({brand_sql('p')}) select link_id, brand, points from p join b on p.host = b.host where rule = '{rule}'"

    def run(t: Tables) -> DataFrame:
        return brand_check(t).where(F.col("rule") == rule).select("link_id", "brand", "points")

    QUERIES[f"brand_{ {'leet': 'leet', 'typo': 'typosquat', 'buried': 'buried'}[rule]}"], SQL[f"brand_{ {'leet': 'leet', 'typo': 'typosquat', 'buried': 'buried'}[rule]}"] = run, sql


for _rule in ("leet", "typo", "buried"):
    _rule_query(_rule)


@query(f"""with p as ({parts_sql()}) select link_id, host in ({names(C.SHORTENERS)}) or reg_domain in ({names(C.SHORTENERS)}) as shortened, tld in ({names(C.ABUSED_TLDS)}) as abused from p""")
def list_membership(t: Tables) -> DataFrame:
    parts = L.link_parts(t["links"])
    short = F.col("host").isin(*C.SHORTENERS) | F.col("reg_domain").isin(*C.SHORTENERS)
    return parts.select("link_id", short.alias("shortened"), F.col("tld").isin(*C.ABUSED_TLDS).alias("abused"))


ENRICH_SQL = f"""select l.link_id, cast({AGE_SQL} as integer) as age_points, cast({CERT_SQL} as integer) as cert_points,
  cast(case when n_ips = 0 then 25 else 0 end as integer) as dns_points,
  cast(case when vt_unavailable is not null and not vt_unavailable then {VT_SQL} else 0 end as integer) as vt_points
  from links l left join link_intel i on l.link_id = i.link_id"""


@query(ENRICH_SQL)
def enrich_link(t: Tables) -> DataFrame:
    return L.enrich_links(t["links"], t["link_intel"]).select("link_id", "age_points", "cert_points", "dns_points", "vt_points")


_OBSERVED = "select link_id, ts, cast(check_id as bigint) as value from link_checks where check_id % 7 = 0"


@query(f"""with o as ({_OBSERVED}), j as (select c.check_id, c.link_id, (select max_by(o.value, (o.ts, o.value)) from o where o.link_id = c.link_id and o.ts <= c.ts and o.ts >= c.ts - interval 7 days) as value from link_checks c)
  select check_id, link_id, value from j""")
def asof_enrichment(t: Tables) -> DataFrame:
    return L.asof_latest(t["link_checks"], t.sql(_OBSERVED), "link_id", "7 days").select("check_id", "link_id", "value")


@query("select link_id, cast(greatest(0, least(99, s)) as integer) as shown, case when s >= 60 then 'high' when s >= 25 then 'medium' else 'low' end as band, case when s >= 60 then 'dangerous' when s >= 25 then 'suspicious' else 'safe' end as level from (select link_id, link_id % 151 as s from links)")
def risk_band(t: Tables) -> DataFrame:
    scored = t["links"].withColumn("s", F.col("link_id") % 151)
    return scored.select("link_id", risk.clamp(F.col("s")).cast("int").alias("shown"), risk.band(F.col("s")).alias("band"), risk.level(F.col("s")).alias("level"))


@query("""with h as (select event_id, link_id, ts, first_value(event_id) over w as a from (select check_id as event_id, link_id, ts from link_checks) window w as (partition by link_id order by ts desc, event_id desc))
  select link_id, max(a) as check_id, count(*) as n from h group by link_id""")
def latest_per_key(t: Tables) -> DataFrame:
    checks = t["link_checks"].groupBy("link_id").agg(F.max_by("check_id", F.struct("ts", "check_id")).alias("check_id"), F.count("*").alias("n"))
    return checks


@query("select link_id, max(check_id) as check_id, cast(sum(check_id % 5) as bigint) as weight from link_checks where (link_id, ts) in (select (link_id, max(ts)) from link_checks group by link_id) group by link_id")
def upsert_latest(t: Tables) -> DataFrame:
    """Insert or replace by key: the rows of the newest time win, the largest id among them."""
    newest = t["link_checks"].groupBy("link_id").agg(F.max(F.struct("ts", "check_id")).alias("top"))
    rows = t["link_checks"].join(newest.hint("merge"), "link_id").where("ts = top.ts")
    return rows.groupBy("link_id").agg(F.max("check_id").alias("check_id"), F.sum(F.col("check_id") % 5).alias("weight"))
