"""Verdict queries, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.functions import risk
from snarewatch.operators import files as X
from snarewatch.operators import links as L
from snarewatch.operators import memory as M
from snarewatch.operators import spine as E
from snarewatch.operators import verdicts as D
from snarewatch.plans import files, links, pages
from snarewatch.plans.links import host_sql, names, reg_sql, score_sql, urls_sql
from snarewatch.sources.fixtures import Tables, kept

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NORM = lambda x: f"case when {x} like '%://%' then {x} else 'http://' || {x} end"
_LEVEL = lambda x: f"case when {x} >= 60 then 'dangerous' when {x} >= 25 then 'suspicious' else 'safe' end"
_NEAREST = pages.nearest_sql(pages._HOSTS, "link_id", "host", ("brand", "phish"), 4)
LINK_SQL = f"""with l as ({score_sql()}), ph as (select link_id, max(similarity) as phish from ({_NEAREST}) where kind = 'phish' group by link_id),
  e as ({links.ENRICH_SQL}), n as ({pages.NETWORK_SQL}), sp as ({pages.SPOOF_SQL}), ex as ({pages.EXFIL_SQL}), nd as ({pages.NEAR_SQL}),
  s as (select l.link_id, l.reg_domain in ({names(C.BRANDS)}) as trusted, vt_points, l.score + dns_points + age_points + cert_points + coalesce(network_points, 0) + coalesce(rescored, 0)
      + case when nd.page_id is null then 0 else 25 end + case when l.reg_domain in ({names(C.BRANDS)}) then 0 else
        case when coalesce(phish, 0) >= 0.8 then 40 when coalesce(phish, 0) >= 0.55 then 20 else 0 end + case when sp.page_id is null then 0 else 35 end + case when ex.page_id is null then 0 else 40 end end as so_far
    from l left join ph on ph.link_id = l.link_id left join e on e.link_id = l.link_id left join n on n.page_id = l.link_id left join sp on sp.page_id = l.link_id
      left join ex on ex.page_id = l.link_id left join nd on nd.page_id = l.link_id)
  select link_id, score, trusted, confirmed, {_LEVEL('score')} as level from (select link_id, trusted, cast(so_far + case when not trusted and so_far > 0 then vt_points else 0 end as integer) as score,
    not trusted and so_far > 0 and vt_points > 0 as confirmed from s)"""


#: What a verdict of a link says.
_VERDICT = ["link_id", "score", "trusted", "confirmed", "level"]


@query(LINK_SQL)
def link_verdict(t: Tables) -> DataFrame:
    return E.link_facts(t["links"], t["link_intel"], E.page_facts(t["page_obs"]), by_domain=False, least_length=False).select(_VERDICT)


#: What pages pose as by their first characters, and by their whole text.
_POSED, _POSED_WHOLE = (pages.spoof_sql(pages.best_brand_sql(pages._HOSTS), *html) for html in ((), ("html",)))
LINK_FULL_SQL = LINK_SQL.replace(pages.SPOOF_SQL, _POSED).replace(pages.NEAR_SQL, pages.NEAR_FULL_SQL)


@query(LINK_FULL_SQL.replace(_POSED, _POSED_WHOLE))
def link_verdict_full(t: Tables) -> DataFrame:
    """With brand-like hosts and a least length of compared pages."""
    return E.link_facts(t["links"], t["link_intel"], E.page_facts(t["page_obs"], whole=True)).select(_VERDICT)


_CACHED = "select *, link_id % 3 = 0 as vt_cached from link_intel"
_ALIKE = f"select distinct link_id from ({_NEAREST})"
LINK_WHOLE_SQL = LINK_FULL_SQL.replace("so_far > 0", "(so_far > 0 or link_id % 3 = 0)")


@query(f"""select v.*, (v.level <> 'safe' and not v.confirmed and v.link_id not in ({_ALIKE})) or (coalesce(i.vt_unavailable, true) and v.level <> 'dangerous') as degraded
  from ({LINK_WHOLE_SQL.replace(_POSED, _POSED_WHOLE)}) v left join link_intel i on i.link_id = v.link_id""")
def link_verdict_degraded(t: Tables) -> DataFrame:
    """With cached reputation, and whether evidence that could change the level was missing."""
    return E.link_facts(t["links"], t.sql(_CACHED), E.page_facts(t["page_obs"], whole=True)).select(*_VERDICT, "degraded")


# --- the memory of checked links


def scans_sql(levels: str) -> str:
    """Checks with what they leave in the memory; ``levels`` states link_id, level and trusted."""
    return f"""select scan_id, row_number() over (order by ts, scan_id) as pos, s.link_id, {_NORM('raw_url')} as norm, lower(o.final_url) as key, v.level, v.trusted,
    trim({_NORM('raw_url')} || ' ' || substr({pages.text_sql('html')}, 1, {D.KEPT_TEXT})) as kept
  from link_scans s join links l on l.link_id = s.link_id join page_obs o on o.page_id = s.link_id join ({levels}) v on v.link_id = s.link_id"""


def seen_sql(levels: str) -> str:
    """For each check every key as it stood just before: of equal places none, by one as-of join."""
    return f"""with c as ({scans_sql(levels)}), t as (select distinct link_id, norm, kept, trusted from c), qv as ({pages.vector_sql('t', 'link_id', 'norm')}), mv as ({pages.vector_sql('t', 'link_id', 'kept')}),
    si as (select q.link_id as a, m.link_id as b, round(sum(q.w * m.w), 6) as similarity from qv q join mv m on q.bucket = m.bucket group by 1, 2 having round(sum(q.w * m.w), 6) >= {M.SEEN_LEAST}),
    k as (select distinct key from c),
    held as (select x.scan_id, x.link_id, v.key, v.link_id as other, v.level from (select scan_id, link_id, pos, k.key from c, k where not trusted) x asof join c v on x.key = v.key and x.pos > v.pos),
    sn as (select h.scan_id, 'seen' as kind, h.key, similarity, level from held h join si on si.a = h.link_id and si.b = h.other),
    ns as ({pages.nearest_sql('t', 'link_id', 'norm', ('brand', 'phish'), 4)}),
    u as (select * from sn union all select scan_id, kind, seed_key, similarity, null from c join ns on ns.link_id = c.link_id where not trusted),
    r as (select *, row_number() over (partition by scan_id order by similarity desc, kind, key) as place from u),
    n as (select scan_id, count(*) filter (place <= 4 and kind = 'seen' and level in ('suspicious', 'dangerous')) as seen from r group by 1)
  select c.scan_id, c.link_id, c.pos, coalesce(seen, 0) as seen, cast(case when seen > 0 then {M.SEEN_POINTS} else 0 end as integer) as points from c left join n on n.scan_id = c.scan_id"""


_LEXICAL = f"select link_id, level, reg_domain in ({names(C.BRANDS)}) as trusted from ({score_sql()})"


def _scans(t: Tables, levels: DataFrame) -> DataFrame:
    return D.remembered_scans(t["link_scans"], t["links"], t["page_obs"], levels)


@query(f"select scan_id, seen, points from ({seen_sql(_LEXICAL)})")
def seen_memory(t: Tables) -> DataFrame:
    """Checks that resemble an earlier risky link, whose label is its lexical level."""
    levels = L.lexical_score(t["links"]).select("link_id", "level", F.col("reg_domain").isin(*C.BRANDS).alias("trusted"))
    return M.seen_memory(_scans(t, levels))


_LAST_SEEN = f"select link_id, max_by(points, pos) as seen_points from ({seen_sql(f'select link_id, level, trusted from ({LINK_FULL_SQL})')}) group by 1"
LINK_SEEN_SQL = LINK_FULL_SQL.replace("case when ex.page_id is null then 0 else 40 end end as so_far", "case when ex.page_id is null then 0 else 40 end + coalesce(ls.seen_points, 0) end as so_far").replace(
    "left join nd on nd.page_id = l.link_id)", f"left join nd on nd.page_id = l.link_id left join ({_LAST_SEEN}) ls on ls.link_id = l.link_id)")


@query(LINK_SEEN_SQL)
def link_verdict_seen(t: Tables) -> DataFrame:
    """With the memory as the last check of each link saw it; what it holds are verdicts without it."""
    facts = E.page_facts(t["page_obs"])
    told = kept(E.link_facts(t["links"], t["link_intel"], facts).select(_VERDICT))
    scans = _scans(t, told.select("link_id", "level", "trusted"))
    last = scans.groupBy("link_id").agg(F.max_by("scan_id", F.struct("at", "scan_id")).alias("scan_id"))
    seen = M.seen_memory(scans).join(last.hint("merge"), "scan_id").select("link_id", F.col("points").alias("seen_points"))
    return E.link_facts(t["links"], t["link_intel"], facts, seen=seen).select(_VERDICT)


_MESSAGES = "select message_id, text, case when message_id % 4 = 0 then message_id % 1000 end as file_id from message_text"


def evidence_sql() -> str:
    """Evidence of messages; links are numbered so that each keeps its own score."""
    numbered = f"(select message_id * 100 + position as mp, message_id, url from ({links.EXPLODED_SQL}))"
    scored = score_sql(numbered, "url", "mp")
    return f"""select m.message_id, m.text, links_only, len([k for k in [{names(C.KEYWORDS)}] if contains(lower(m.text), k)]) > 0 as keyword,
    coalesce(worst, 0) as worst, coalesce(n_links, 0) as n_links, coalesce(n_risky, 0) as n_risky, coalesce(n_trusted, 0) as n_trusted, similarity, f.file_level, f.pct as file_pct,
    coalesce(f.found and f.malicious > 0, false) as confirmed
  from ({_MESSAGES}) m join ({links.ONLY_SQL}) o on o.message_id = m.message_id
  left join (select mp // 100 as message_id, max(score) as worst, count(*) as n_links, count(*) filter (level <> 'safe') as n_risky, count(*) filter (reg_domain in ({names(C.BRANDS)})) as n_trusted
    from ({scored}) group by 1) a on a.message_id = m.message_id
  left join ({pages.MATCH_SQL}) s on s.message_id = m.message_id
  left join ({files.FILE_SQL}) f on f.file_id = m.file_id"""


EVIDENCE_SQL = evidence_sql()


def _evidence(t: Tables) -> DataFrame:
    scored = X.files_with_risk(t["files"], t["archive_entries"]).select("file_id", "file_pct", "file_level", "found", "malicious")
    return D.message_evidence(t.sql(_MESSAGES), scored)


@query(f"select message_id, cast(worst as integer) as worst, n_links, n_risky, links_only, keyword, similarity, file_level, file_pct, confirmed from ({EVIDENCE_SQL})")
def message_evidence(t: Tables) -> DataFrame:
    return _evidence(t).select("message_id", "worst", "n_links", "n_risky", "links_only", "keyword", "similarity", "file_level", "file_pct", "confirmed")


@query(f"select message_id, cast(worst as integer) as worst from ({EVIDENCE_SQL})")
def worst_link(t: Tables) -> DataFrame:
    return _evidence(t).select("message_id", "worst")


def coherent_sql(verdict: str, number: str) -> str:
    value = f"greatest(0, least(99, {number}))"
    return f"""cast(case when {number} is null then case {verdict} when 'Scam' then 60 when 'Not a Scam' then 0 end
      when {verdict} = 'Scam' then greatest({value}, 60) when {verdict} = 'Uncertain' then least(greatest({value}, 25), 59) when {verdict} = 'Not a Scam' then least({value}, 24) else {value} end as integer)"""


_TOP = "greatest(least(worst, 100), cast(floor(coalesce(similarity, 0) * 100) as integer), coalesce(file_pct, 0))"


@query(f"""with e as ({EVIDENCE_SQL}), v as (select *, case when file_level = 'dangerous' then 'Scam' when keyword or similarity is not null or n_risky > 0 or coalesce(file_level in ('suspicious', 'uncertain'), false) then 'Uncertain' else 'Not a Scam' end as verdict,
    case when (n_links > 0 or similarity is not null or file_level is not null) and not (coalesce(file_level = 'uncertain', false) and not keyword and similarity is null and n_risky = 0)
      then case when confirmed then {_TOP} else least({_TOP}, 80) end end as number from e)
  select message_id, verdict, {coherent_sql('verdict', 'number')} as risk_percentage from v""")
def unified_fallback(t: Tables) -> DataFrame:
    return D.fallback_verdict(_evidence(t))


@query(f"""with e as ({EVIDENCE_SQL}), b as (select e.*, m.verdict as said, greatest(0, least(100, m.risk_percentage)) as given from model_verdicts m join e on e.message_id = m.message_id),
  r as (select *, coalesce(file_level = 'dangerous', false) and said <> 'Scam' as r1, said = 'Not a Scam' and ((confirmed and n_risky > 0) or similarity is not null) as r2,
    said = 'Not a Scam' and coalesce(file_level in ('suspicious', 'uncertain'), false) as r3 from b),
  v as (select *, case when r1 then 'Scam' when r2 or r3 then 'Uncertain' else said end as verdict,
    case when r1 then greatest(given, coalesce(file_pct, 0)) when r2 then greatest(given, least(worst, 100), cast(floor(coalesce(similarity, 0) * 100) as integer)) when r3 then file_pct else given end as number from r)
  select message_id, verdict, {coherent_sql('verdict', 'case when confirmed or number is null then number else least(number, 80) end')} as risk_percentage from v""")
def reconcile_verdict(t: Tables) -> DataFrame:
    return D.reconcile(_evidence(t), t["model_verdicts"])


_DEAD = "select message_id from message_text where message_id % 3 = 0"
_ALONE = "links_only and n_links = 1 and file_level is null and not keyword and similarity is null"
_SHORT = f"""with e as ({EVIDENCE_SQL}), d as ({_DEAD}), r as (select *, case when {_ALONE} and message_id in (select message_id from d) and worst between 25 and 45 and not confirmed then 'dead_link'
    when {_ALONE} and n_trusted = 1 and worst < 25 then 'trusted_link' end as rule from e)
  select message_id, case rule when 'dead_link' then 'Uncertain' else 'Not a Scam' end as verdict, cast(case rule when 'dead_link' then 30 else worst end as integer) as risk_percentage, rule from r where rule is not null"""


@query(f"select * from ({_SHORT}) where rule = 'dead_link'")
def dead_link_shortcut(t: Tables) -> DataFrame:
    return D.shortcuts(_evidence(t), t.sql(_DEAD)).where("rule = 'dead_link'")


@query(f"select * from ({_SHORT}) where rule = 'trusted_link'")
def trusted_link_shortcut(t: Tables) -> DataFrame:
    return D.shortcuts(_evidence(t), t.sql(_DEAD)).where("rule = 'trusted_link'")


_NUMBER = "case when message_id % 13 = 0 then null else risk_percentage end"


@query(f"select message_id, verdict, {coherent_sql('verdict', f'({_NUMBER})')} as risk_percentage from model_verdicts")
def coherent_risk(t: Tables) -> DataFrame:
    number = F.when(F.col("message_id") % 13 != 0, F.col("risk_percentage"))
    return t["model_verdicts"].select("message_id", "verdict", risk.coherent(F.col("verdict"), number).alias("risk_percentage"))


@query(f"""select message_id, case verdict when 'Scam' then case when n < 60 then 'warning_signs' else 'strong_unsafe' end
  when 'Not a Scam' then case when n >= 25 then 'warning_signs' else 'no_indicators' end
  else case when n >= 60 then 'strong_unsafe' when n >= 25 then 'warning_signs' when n is null then 'uncertain_no_signal' else 'no_indicators' end end as key
  from (select message_id, verdict, {_NUMBER} as n from model_verdicts)""")
def summary_key(t: Tables) -> DataFrame:
    number = F.when(F.col("message_id") % 13 != 0, F.col("risk_percentage"))
    return t["model_verdicts"].select("message_id", D.summary_key(F.col("verdict"), number).alias("key"))


@query("""select message_id, case when a and b and c then 'all' when a and b then 'text+link' when a and c then 'text+file' when b and c then 'file+link' when a then 'text' when b then 'link' when c then 'file' else 'text' end as label
  from (select message_id, body <> '' as a, link_text <> '' as b, message_id % 4 = 0 as c from messages)""")
def scan_type_label(t: Tables) -> DataFrame:
    return t["messages"].select("message_id", D.type_label(F.col("body") != "", F.col("link_text") != "", F.col("message_id") % 4 == 0).alias("label"))


_ADVICE = ", ".join(f"('{v}', {i + 1}, '{a}')" for v, keys in D.ADVICE.items() for i, a in enumerate(keys))


@query(f"select message_id, cast(position as integer) as position, advice from model_verdicts m join (values {_ADVICE}) a(verdict, position, advice) on a.verdict = m.verdict")
def recommendation_keys(t: Tables) -> DataFrame:
    return D.advice(t["model_verdicts"])


_TEXTS = (("en", "Scam", "Scam"), ("en", "Uncertain", "Not sure"), ("km", "Scam", "បោកប្រាស់"))


@query(f"""with t(lang, key, text) as (values {', '.join(str(x) for x in _TEXTS)}), k as (select message_id, case when message_id % 3 = 0 then null when message_id % 3 = 1 then 'km' else 'en' end as lang, verdict as key from model_verdicts)
  select message_id, k.lang, k.key, coalesce(a.text, b.text, k.key) as text from k left join t a on a.lang = k.lang and a.key = k.key left join t b on b.lang = 'en' and b.key = k.key""")
def localize(t: Tables) -> DataFrame:
    texts = t.spark.createDataFrame(_TEXTS, "lang string, key string, text string")
    lang = F.when(F.col("message_id") % 3 == 1, "km").when(F.col("message_id") % 3 == 2, "en")
    return D.localize(t["model_verdicts"].select("message_id", lang.alias("lang"), F.col("verdict").alias("key")), texts).select("message_id", "lang", "key", "text")


@query()
def evidence_json(t: Tables) -> DataFrame:
    return D.evidence_json(_evidence(t))


# --- the same verdicts over the full verdict of visible and hidden links

_MERGED = f"(select message_id * 100 + position as mp, url, display_text, hidden from ({links.SQL['merge_hidden_links']}))"
_SHOWN = host_sql(f"coalesce(({urls_sql('m.display_text')})[1], '')")
#: Links with cached reputation and pages that could not be followed, and whether each is dead.
SPINE_LINKS_SQL = f"""select v.*, (v.level <> 'safe' and not v.confirmed and v.link_id not in ({_ALIKE})) or (coalesce(i.vt_unavailable, true) and v.level <> 'dangerous') as degraded,
    coalesce(i.n_ips = 0, false) or coalesce(o.trace_error = 'timeout', false) as dead
  from ({LINK_WHOLE_SQL.replace(pages.NETWORK_SQL, pages.TRACED_NETWORK_SQL)}) v left join link_intel i on i.link_id = v.link_id left join ({pages.TRACED}) o on o.page_id = v.link_id"""
FULL_LINKS_SQL = f"""select m.mp, m.hidden, sc.reg_domain, coalesce(k.confirmed, false) as confirmed, coalesce(k.degraded, false) as degraded, coalesce(k.dead, false) as dead, coalesce(k.score, sc.score)
    + case when m.hidden then case when {_SHOWN} <> '' and {reg_sql(_SHOWN)} <> sc.reg_domain then 55 else 0 end
      when regexp_matches(lower(t.text), '\\bhttps?//') then 15 else 0 end as score
  from {_MERGED} m join ({score_sql(_MERGED, 'url', 'mp')}) sc on sc.mp = m.mp join message_text t on t.message_id = m.mp // 100
  left join (select {_NORM('raw_url')} as norm, max(v.score) as score, bool_or(v.confirmed) as confirmed, bool_or(v.degraded) as degraded, bool_or(v.dead) as dead from links l join ({SPINE_LINKS_SQL}) v on v.link_id = l.link_id group by 1) k on k.norm = {_NORM('m.url')}"""
FULL_SQL = f"""select m.message_id, m.text, links_only, len([k for k in [{names(C.KEYWORDS)}] if contains(lower(m.text), k)]) > 0 as keyword,
    coalesce(worst, 0) as worst, coalesce(n_links, 0) as n_links, coalesce(n_risky, 0) as n_risky, coalesce(n_trusted, 0) as n_trusted, similarity, f.file_level, f.pct as file_pct,
    coalesce(f.found and f.malicious > 0, false) or coalesce(any_confirmed, false) as confirmed, coalesce(a.confirmed_link, false) as confirmed_link,
    coalesce(a.degraded, false) as degraded, coalesce(a.dead, false) as dead
  from ({_MESSAGES}) m join ({links.ONLY_SQL}) o on o.message_id = m.message_id
  left join (select mp // 100 as message_id, max(score) as worst, count(*) as n_links, count(*) filter (score >= 25) as n_risky, count(*) filter (reg_domain in ({names(C.BRANDS)})) as n_trusted,
      bool_or(confirmed) as any_confirmed, bool_or(confirmed and score >= 25) as confirmed_link, bool_or(degraded) as degraded, bool_or(dead) as dead from ({FULL_LINKS_SQL}) group by 1) a on a.message_id = m.message_id
  left join ({pages.MATCH_SQL}) s on s.message_id = m.message_id
  left join ({files.FILE_SQL}) f on f.file_id = m.file_id"""


def _links(t: Tables, loose: bool = False) -> DataFrame:
    return E.link_facts(t["links"], t.sql(_CACHED), E.page_facts(t.sql(pages.TRACED), loose=loose))


def _full(t: Tables, loose: bool = False) -> DataFrame:
    scored = X.files_with_risk(t["files"], t["archive_entries"]).select("file_id", "file_pct", "file_level", "found", "malicious")
    return kept(E.message_evidence(E.message_rows(t.sql(_MESSAGES), t["hidden_links"]), _links(t, loose), scored))


def _over_full(name: str) -> str:
    """The statement of query ``name`` over full evidence."""
    return SQL[name].replace(EVIDENCE_SQL, FULL_SQL).replace("(confirmed and n_risky > 0)", "confirmed_link").replace("message_id in (select message_id from d)", "dead")


@query(_over_full("message_evidence").replace("file_pct, confirmed from", "file_pct, confirmed, confirmed_link, degraded from"))
def message_evidence_full(t: Tables) -> DataFrame:
    return _full(t).select("message_id", "worst", "n_links", "n_risky", "links_only", "keyword", "similarity", "file_level", "file_pct", "confirmed", "confirmed_link", "degraded")


@query(pages.any_form_sql(links.all_addresses_sql(_over_full("worst_link"), "m.display_text")))
def worst_link_full(t: Tables) -> DataFrame:
    """With every address of a text, and forms of pages however their attributes are written."""
    return _full(t, loose=True).select("message_id", "worst")


@query(_over_full("unified_fallback"))
def unified_fallback_full(t: Tables) -> DataFrame:
    return D.fallback_verdict(_full(t))


@query(_over_full("reconcile_verdict"))
def reconcile_verdict_full(t: Tables) -> DataFrame:
    return D.reconcile(_full(t), t["model_verdicts"])


@query(_over_full("dead_link_shortcut"))
def dead_link_shortcut_full(t: Tables) -> DataFrame:
    return D.shortcuts(_full(t)).where("rule = 'dead_link'")


@query(_over_full("trusted_link_shortcut"))
def trusted_link_shortcut_full(t: Tables) -> DataFrame:
    return D.shortcuts(_full(t)).where("rule = 'trusted_link'")


@query(SPINE_LINKS_SQL)
def link_evidence(t: Tables) -> DataFrame:
    """Every link's verdict as messages take it: with cached reputation, trace errors, missing evidence and whether it is dead."""
    return _links(t).select("link_id", "score", "trusted", "confirmed", "level", "degraded", "dead")


_REASONS = f"""with e as ({FULL_SQL}), r as (select message_id, 1 as rank, 0 as position, 'keyword' as reason, cast(null as integer) as points from e where keyword
    union all select message_id, 2, 0, 'script', cast(floor(similarity * 100) as integer) from e where similarity is not null
    union all select message_id, 9, 0, 'file', file_pct from e where file_level in ('dangerous', 'suspicious', 'uncertain')
    union all select mp // 100, 3, mp % 100, 'link', cast(score as integer) from ({FULL_LINKS_SQL}) where score >= 25)
  select message_id, cast(row_number() over (partition by message_id order by rank, position) as integer) as place, reason, points from r"""


@query(_REASONS)
def verdict_reasons(t: Tables) -> DataFrame:
    evidence = _full(t)
    return D.reason_rows(evidence, E.links_of(evidence))


@query()
def evidence_json_full(t: Tables) -> DataFrame:
    return D.evidence_json(_full(t))


_FINDINGS = f"""select f.mp // 100 as message_id, string_agg('{{"host":' || to_json({host_sql('m.url')}) || ',"level":"' || {_LEVEL('f.score')} || '","score":' || cast(f.score as integer)
    || ',"confirmed":' || f.confirmed || '}}', ',' order by f.mp % 100) as found from ({FULL_LINKS_SQL}) f join {_MERGED} m on m.mp = f.mp group by 1"""


def _json_sql(evidence: str, links: str, also: str = "") -> str:
    return f"""select e.message_id, '{{"keyword":' || keyword || ',{links} || ',"confirmed":' || confirmed
    || case when similarity is null then '' else ',"similarity":' || cast(round(cast(similarity as decimal(9, 6)), 3) as double) end
    || case when file_level is null then '' else ',"file":{{"kind":"' || file_level || '"' || case when file_pct is null then '' else ',"score":' || file_pct end || '}}' end || '}}' as body
  from ({evidence}) e {also}"""


SQL["evidence_json"] = _json_sql(EVIDENCE_SQL, """"worst_link":' || cast(worst as integer) || ',"n_links":' || n_links""")
SQL["evidence_json_full"] = _json_sql(FULL_SQL, """"worst_link":' || cast(worst as integer) || ',"n_links":' || n_links""")


@query(_json_sql(FULL_SQL, """"links":[' || coalesce(found, '') || ']'""", f"left join ({_FINDINGS}) k on k.message_id = e.message_id"))
def evidence_json_links(t: Tables) -> DataFrame:
    """The document a model may see, with a finding a link."""
    return D.evidence_json(_full(t), E.findings(F.col("links")))


@query("""select message_id, coalesce(nullif(body, ''), link_text) as text from messages where coalesce(nullif(body, ''), link_text) <> ''""")
def message_source(t: Tables) -> DataFrame:
    """Body, or else the caption; messages with neither are left out."""
    text = F.coalesce(F.nullif(F.col("body"), F.lit("")), "link_text")
    return t["messages"].select("message_id", text.alias("text")).where("text <> ''")
