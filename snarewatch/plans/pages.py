"""Page and similarity queries, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.functions import urls
from snarewatch.operators import pages as P
from snarewatch.operators import vectors as V
from snarewatch.operators.links import only_links
from snarewatch.plans.links import ONLY_SQL, deleet_sql, host_sql, names, reg_sql, score_sql, text
from snarewatch.sources.fixtures import Tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _flat(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def text_sql(html: str) -> str:
    body = f"regexp_replace(regexp_replace({html}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')"
    return f"{_flat(f'''regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)''')} || chr(10) || {_flat(body)}"


@query(f"select page_id, substr(html, 1, {P.MAX_HTML}) as html, final_url, hops, status from page_obs")
def page_source(t: Tables) -> DataFrame:
    return t["page_obs"].select("page_id", F.substring("html", 1, P.MAX_HTML).alias("html"), "final_url", "hops", "status")


@query(f"select page_id, {text_sql('html')} as text from page_obs")
def page_text(t: Tables) -> DataFrame:
    return t["page_obs"].select("page_id", P.page_text(F.col("html")).alias("text"))


_QUOTED = lambda value: f"""("{value}"|'{value}')"""
_PASSWORD = rf"(?i)<input[\s/]([^>]*\s)?type\s*=\s*{_QUOTED('password')}"


@query(f"select page_id, regexp_matches(html, {text(_PASSWORD)}) as asks from page_obs")
def password_field(t: Tables) -> DataFrame:
    return t["page_obs"].select("page_id", P.asks_password(F.col("html")).alias("asks"))


_ACTION = r"""(?i)<form[\s/](?:[^>]*\s)?action\s*=\s*["']([^"'>]*)["']"""
#: The same wherever the name of an attribute begins, with quotes of any kind (bot/detectors/url/online/network.py:154-155 of the reference).
ANY_PASSWORD = r"""(?i)<input\b[^>]*\btype\s*=\s*["']password["']"""
ANY_ACTION = r"""(?i)<form\b[^>]*\baction\s*=\s*["']([^"']*)["']"""
_FORMS = f"select page_id, generate_subscripts(l, 1) as position, unnest(l) as action, final_url from (select page_id, final_url, regexp_extract_all(html, {text(_ACTION)}, 1) as l from page_obs)"


@query(f"select page_id, cast(position as integer) as position, action from ({_FORMS})")
def form_actions(t: Tables) -> DataFrame:
    return P.form_actions(t["page_obs"])


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in C.FIRST_PARTY_REDIRECTS)
_MOVES = f"""select *, case when from_domain <> to_domain and (from_domain, to_domain) not in ({_PAIRS}) then 20 else 0 end as redirect_points,
  case when hops >= 4 then 10 else 0 end + case when not starts_with(lower(final_url), 'https://') then 5 else 0 end + case when status >= 400 then 10 else 0 end as shape_points
  from (select *, {reg_sql(host_sql('url'))} as from_domain, {reg_sql(host_sql('final_url'))} as to_domain from page_obs)"""


@query(f"select page_id, cast(shape_points as integer) as points from ({_MOVES})")
def response_shape_score(t: Tables) -> DataFrame:
    return P.response_points(t["page_obs"]).select("page_id", F.col("shape_points").alias("points"))


TRACED = "select *, case when page_id % 29 = 0 then 'bad_tls' when page_id % 31 = 0 then 'timeout' end as trace_error from page_obs"


@query(f"select page_id, cast(case when trace_error = 'bad_tls' then 30 when trace_error is not null then 15 else shape_points end as integer) as points from ({_MOVES.replace('from page_obs', f'from ({TRACED})')})")
def response_shape_full(t: Tables) -> DataFrame:
    """With pages that could not be followed."""
    return P.response_points(t.sql(TRACED)).select("page_id", F.col("shape_points").alias("points"))


_SHORT = """select page_id, url, case when page_id % 4 = 0 then 'https://amzn.to/x' when page_id % 4 = 1 then 'https://g.co/y' else url end as from_url,
  case when page_id % 3 = 0 then 'https://www.amazon.com/z' when page_id % 3 = 1 then 'https://ai.google/' else final_url end as final_url from page_obs"""


@query(f"""select page_id, from_domain <> to_domain as crossed, cast(case when from_domain <> to_domain and (from_domain, to_domain) not in ({_PAIRS}) then 20 else 0 end as integer) as points
  from (select page_id, {reg_sql(host_sql('from_url'))} as from_domain, {reg_sql(host_sql('final_url'))} as to_domain from ({_SHORT}))""")
def first_party_redirect(t: Tables) -> DataFrame:
    rows = t.sql(_SHORT).drop("url").withColumnRenamed("from_url", "url")
    return P.redirects(rows).select("page_id", "crossed", F.col("redirect_points").alias("points"))


NETWORK_SQL = f"""with m as ({_MOVES}), s as ({score_sql('page_obs', 'final_url', 'page_id')})
  select m.page_id, cast(least(shape_points + redirect_points, {P.NETWORK_CAP}) as integer) as network_points,
    cast(case when redirect_points > 0 then least(s.score, 30) else 0 end as integer) as rescored from m join s on m.page_id = s.page_id"""


#: The same where a page that could not be followed has the points of its error.
TRACED_NETWORK_SQL = NETWORK_SQL.replace(
    _MOVES, _MOVES.replace("from page_obs", f"from ({TRACED})").replace("  case when hops >= 4", "  case when trace_error = 'bad_tls' then 30 when trace_error is not null then 15 else case when hops >= 4").replace("end as shape_points", "end end as shape_points")
)


@query(NETWORK_SQL)
def redirect_score(t: Tables) -> DataFrame:
    return P.network_points(t["page_obs"]).select("page_id", "network_points", "rescored")


@query(f"select page_id, network_points from ({NETWORK_SQL})")
def network_cap(t: Tables) -> DataFrame:
    return redirect_score(t).select("page_id", "network_points")




def any_form_sql(sql: str) -> str:
    """A statement with forms and password fields wherever the name of an attribute begins."""
    return sql.replace(text(_PASSWORD), text(ANY_PASSWORD)).replace(text(_ACTION), text(ANY_ACTION))


EXFIL_SQL = f"""select page_id, arg_min(target, position) as target from (select f.page_id, position, {host_sql('action')} as target, {reg_sql(host_sql('final_url'))} as own from ({_FORMS}) f
  where contains(action, '://') and page_id in (select page_id from page_obs where regexp_matches(html, {text(_PASSWORD)})))
  where target <> '' and {reg_sql('target')} <> own group by page_id"""


@query(EXFIL_SQL)
def credential_exfil(t: Tables) -> DataFrame:
    return P.credential_exfil(t["page_obs"])


def spoof_sql(best: str | None = None, html: str = f"substr(html, 1, {P.MAX_HTML})") -> str:
    """With ``best`` (page_id, resembles) a host that resembles a brand is enough; ``html`` states what is read of a page."""
    rules, or_alike, pages = [], " or resembles" if best else "", "page_obs"
    if best:
        pages = f"(select o.*, coalesce(resembles, false) as resembles from page_obs o left join ({best}) b on b.page_id = o.page_id)"
    for domain in C.BRANDS:
        root = domain.split(".")[0]
        if len(root) >= 4:
            near = " or ".join(f"regexp_matches(low, '(?s){root}.{{0,{P.NEAR - len(root)}}}{p}|{p}.{{0,{P.NEAR - len(p)}}}{root}')" for p in C.PORTAL_PHRASES)
            rules.append(f"when contains(low, '{root}') and own <> '{domain}' and length(low) - length(replace(low, '{root}', '')) >= {3 * len(root)} and ({near}{or_alike}) then '{domain}'")
    return f"""select page_id, brand from (select page_id, case when regexp_matches(low, '{"|".join(C.PORTAL_PHRASES)}'){or_alike} then case {' '.join(rules)} end end as brand
      from (select page_id{', resembles' if best else ''}, lower({text_sql(html)}) as low, {reg_sql(host_sql('final_url'))} as own from {pages})) where brand is not null"""


SPOOF_SQL = spoof_sql()


@query(SPOOF_SQL)
def brand_page_spoof(t: Tables) -> DataFrame:
    return P.brand_spoof(t["page_obs"])


# --- text vectors


@query(f"select message_id, array_to_string([k for k in [{names(C.KEYWORDS)}] if contains(lower(text), k)], ',') as matches from message_text")
def keyword_prescan(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(k) for k in C.KEYWORDS])
    return t["message_text"].select("message_id", F.array_join(F.filter(words, lambda k: F.contains(F.lower("text"), k)), ",").alias("matches"))


_TOKENS = lambda x: f"regexp_extract_all({deleet_sql(f'''lower(coalesce({x}, ''))''')}, '{V.TOKEN}')"


@query(f"select message_id, array_to_string({_TOKENS('text')}, ' ') as tokens from message_text")
def tokenize(t: Tables) -> DataFrame:
    return t["message_text"].select("message_id", F.array_join(V.tokens(F.col("text")), " ").alias("tokens"))


_HEX = lambda i: f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1)"


def vector_sql(rows: str, key: str, column: str) -> str:
    return f"""select {key}, bucket, s / sqrt(sum(s * s) over (partition by {key})) as w from (
      select {key}, {_HEX(1)} * 16 + {_HEX(2)} as bucket, sum(w * case when {_HEX(10)} % 2 = 0 then 1.0 else -1.0 end)::double as s from (
        select {key}, f.w as w, md5(f.f) as h from (select {key}, unnest(list_concat([{{'f': 'w:' || tok, 'w': 1.0::double}}],
            [{{'f': 'c:' || substr('^' || tok || '$', i, 4), 'w': 0.5::double}} for i in range(1, length(tok))])) as f, tok
          from (select {key}, unnest({_TOKENS(column)}) as tok from {rows if ' ' not in rows else f'({rows})'}) where length(tok) >= 2))
      group by 1, 2) where s <> 0"""


_q = lambda x: "'" + x.replace("'", "''") + "'"


def _seed_values(kinds) -> str:
    rows = [("brand", d, label, d) for d, label in C.BRANDS.items()]
    roots: dict[str, str] = {}
    for d, label in C.BRANDS.items():
        roots.setdefault(d.split(".")[0], label)
    rows += [("phish", p.format(brand=r), f"{label} impersonation pattern", p.format(brand=r)) for r, label in roots.items() for p in C.PHISH_TEMPLATES]
    rows += [("scam_pattern", f"{c}:{i}", c, x) for c, texts in C.SCRIPTS.items() for i, x in enumerate(texts)]
    return "select kind, key, label, text, kind || '|' || key as seed from (values " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows if r[0] in kinds) + ") v(kind, key, label, text)"


def nearest_sql(rows: str, key: str, column: str, kinds, k: int) -> str:
    return f"""with qv as ({vector_sql(rows, key, column)}), sd as ({_seed_values(kinds)}), sv as ({vector_sql('sd', 'seed', 'text')}),
    si as (select q.{key}, d.kind, d.key as seed_key, d.label, round(sum(q.w * v.w), {V.DIGITS}) as similarity from qv q join sv v on q.bucket = v.bucket join sd d on d.seed = v.seed group by all)
    select {key}, kind, seed_key, label, similarity, place from (select *, cast(row_number() over (partition by {key} order by similarity desc, kind, seed_key) as integer) as place from si) where place <= {k}"""


@query(f"select message_id, cast(bucket as integer) as bucket, round(w, 6) as weight from ({vector_sql('message_text', 'message_id', 'text')})")
def hashed_embedding(t: Tables) -> DataFrame:
    return V.hashed_vectors(t["message_text"], "message_id", "text").select("message_id", "bucket", F.round("w", 6).alias("weight"))


_HOSTS = f"select link_id, {host_sql('raw_url')} as host from links"


@query(nearest_sql(_HOSTS, "link_id", "host", ("brand", "phish"), 4))
def nearest_vectors(t: Tables) -> DataFrame:
    hosts = t["links"].select("link_id", urls.host(urls.normalized(F.col("raw_url"))).alias("host"))
    return V.nearest(hosts, "link_id", "host", ("brand", "phish"), 4)


_USED = f"""with top as ({nearest_sql(_HOSTS, 'link_id', 'host', ('brand', 'phish'), 4)}), n as (select kind, seed_key, count(*) as n from top group by 1, 2)
  select s.kind, s.key, s.label, coalesce(n, 0) as n from ({_seed_values(('brand', 'phish'))}) s left join n on n.kind = s.kind and n.seed_key = s.key"""


@query(f"select kind, key, label, n as n_links from ({_USED})")
def seed_vectors(t: Tables) -> DataFrame:
    """Reference rows of links, each with the number of links among whose four nearest it is."""
    return V.seed_usage(nearest_vectors(t), ("brand", "phish")).withColumnRenamed("n", "n_links")


@query(f"select sha256(string_agg(kind || '|' || key || '|' || label || '|' || n, chr(10) order by kind, key)) as fingerprint, count(*) as n from ({_USED})")
def seed_fingerprint(t: Tables) -> DataFrame:
    """One digest over the sorted reference rows and their use: a changed one calls for a reload."""
    rows = seed_vectors(t).agg(F.sort_array(F.collect_list(F.struct("kind", "key", F.concat_ws("|", "kind", "key", "label", "n_links").alias("line")))).alias("rows"))
    return rows.select(F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 256).alias("fingerprint"), F.size("rows").cast("bigint").alias("n"))


BEST_SQL = nearest_sql("message_text", "message_id", "text", ("scam_pattern",), 1)
MATCH_SQL = f"select b.message_id, seed_key as script, label, similarity from ({BEST_SQL}) b join ({ONLY_SQL}) o on o.message_id = b.message_id and not links_only where similarity >= 0.5"


@query(MATCH_SQL)
def scam_pattern_match(t: Tables) -> DataFrame:
    texts = only_links(t["message_text"]).where("not links_only").select("message_id", "text")
    return V.script_matches(texts)


@query(f"""select starts_with(text, 'Your account will be suspended') as scripted, min(similarity) as lowest, max(similarity) as highest,
  count(*) filter (similarity >= 0.5 and not starts_with(text, 'Your account will be suspended')) as false_hits,
  count(*) filter (similarity < 0.5 and starts_with(text, 'Your account will be suspended')) as misses
  from ({BEST_SQL}) b join message_text m on m.message_id = b.message_id group by 1""")
def threshold_calibration(t: Tables) -> DataFrame:
    best = V.script_matches(t["message_text"], threshold=-2.0).hint("merge").join(t["message_text"], "message_id")
    scripted, hit = F.col("text").startswith("Your account will be suspended"), F.col("similarity") >= 0.5
    return best.groupBy(scripted.alias("scripted")).agg(
        F.min("similarity").alias("lowest"), F.max("similarity").alias("highest"), F.count_if(hit & ~scripted).alias("false_hits"), F.count_if(~hit & scripted).alias("misses")
    )


_SWEPT = f"select similarity, starts_with(text, 'Your account will be suspended') as scripted from ({BEST_SQL}) b join message_text m on m.message_id = b.message_id"


@query(f"""with s as ({_SWEPT}) select i / 100 as threshold, (select count(*) from s where not scripted and similarity >= i / 100) as false_hits, (select count(*) from s where scripted and similarity < i / 100) as misses,
  coalesce(i / 100 > (select max(similarity) from s where not scripted), true) and coalesce(i / 100 <= (select min(similarity) from s where scripted), true) as safe
  from range(0, 101) r(i)""")
def threshold_sweep(t: Tables) -> DataFrame:
    """False hits and misses of the script match at every threshold, and where both are none."""
    best = V.nearest(t["message_text"], "message_id", "text", ("scam_pattern",), 1).select("message_id", "similarity")
    told = t["message_text"].select("message_id", F.col("text").startswith("Your account will be suspended").alias("scripted"))
    return V.threshold_sweep(best.hint("merge").join(told, "message_id"))


@query(f"""with c as (select label as centroid, arg_min(embedding, vec_id) as c from embeddings group by label),
  s as (select vec_id, centroid, round(list_cosine_similarity(cast(embedding as double[]), cast(c as double[])), 6) as similarity from embeddings, c)
  select vec_id, centroid, similarity, similarity >= 0.74 as near from (select *, row_number() over (partition by vec_id order by similarity desc, centroid) as n from s) where n = 1""")
def dense_nearest(t: Tables) -> DataFrame:
    centroids = t["embeddings"].groupBy(F.col("label").alias("centroid")).agg(F.min_by("embedding", "vec_id").alias("c"))
    return V.dense_nearest(t["embeddings"], centroids)


class LetterShares:
    """A model for ``encode_dense``: how often each letter a-z occurs, by the text's length."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[x.count(c) / max(len(x), 1) for c in "abcdefghijklmnopqrstuvwxyz"] for x in texts]


_SHARES = ", ".join(f"cast((length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1) as float)" for c in "abcdefghijklmnopqrstuvwxyz")


@query(f"select message_id, len(e) as size, round(list_sum([cast(x as double) for x in e]), 5) as total, round(cast(e[5] as double), 5) as fifth from (select message_id, [{_SHARES}] as e from message_text)")
def dense_encoder(t: Tables) -> DataFrame:
    """Messages through an encoder that the caller brings."""
    made = V.encode_dense(t["message_text"], "message_id", "text", LetterShares())
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return made.select("message_id", F.size("embedding").cast("bigint").alias("size"), F.round(total, 5).alias("total"), F.round(F.get("embedding", F.lit(4)).cast("double"), 5).alias("fifth"))


_MINIMA = ", ".join(f"min((x * {a} + {b}) % {V.PRIME})" for a, b in map(V.affine, range(V.HASHES)))


def _hex8() -> str:
    out = "0::bigint"
    for i in range(1, 9):
        out = f"({out} * 16 + {_HEX(i)})"
    return out


_SIGNED = f"""select page_id as id, host, [{_MINIMA}] as signature from (select page_id, host, {_hex8()} % {V.PRIME} as x from (select distinct page_id, host, h from (
  select page_id, host, md5(unnest([substr(flat, i, 8) for i in range(1, greatest(length(flat) - 7, 1) + 1)])) as h
  from (select page_id, {host_sql('url')} as host, trim(regexp_replace(lower({text_sql('html')}), '\\s+', ' ', 'g')) as flat from page_obs)))) group by page_id, host"""


@query(f"select id as page_id, array_to_string(signature, ',') as signature from ({_SIGNED})")
def minhash_signature(t: Tables) -> DataFrame:
    texts = V.spread(t["page_obs"]).select("page_id", P.page_text(F.col("html")).alias("text"))
    return V.minhash(texts, "page_id", "text").select("page_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


def _signed(t: Tables, long: bool = False) -> DataFrame:
    texts = V.spread(t["page_obs"]).select("page_id", "url", P.page_text(F.col("html")).alias("text"))
    if long:
        texts = texts.where(P.long_enough(F.col("text")))
    return V.minhash(texts, "page_id", "text", "url").select(F.col("page_id").alias("id"), urls.host(F.col("url")).alias("host"), "signature")


_MATCHING = "len([i for i in range(1, 65) if a.signature[i] = b.signature[i]])"


@query(f"with s as ({_SIGNED}) select a.id as page_id, b.id as other, round({_MATCHING} / 64, 6) as similarity from s a join s b on b.id = a.id + 1")
def minhash_similarity(t: Tables) -> DataFrame:
    one = _signed(t)
    two = one.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("signature").alias("s2"))
    met = one.join(two.hint("merge"), "id")
    return met.select(F.col("id").alias("page_id"), "other", F.round(V.matching(F.col("signature"), F.col("s2")) / 64, 6).alias("similarity"))


NEAR_SQL = f"""with s as ({_SIGNED}), p as (select a.id, b.id as other, {_MATCHING} as m from s a join s b on a.host <> b.host)
  select id as page_id, other, cast(m as integer) as matches from (select *, row_number() over (partition by id order by m desc, other) as n from p where m >= {V.MATCHES}) where n = 1"""


@query(NEAR_SQL)
def page_near_dup(t: Tables) -> DataFrame:
    return V.near_duplicates(_signed(t)).select(F.col("id").alias("page_id"), "other", "matches")


NEAR_FULL_SQL = NEAR_SQL.replace("from page_obs)))", f"from page_obs where length({text_sql('html')}) >= {P.MIN_TEXT})))")


@query(NEAR_FULL_SQL)
def page_near_dup_full(t: Tables) -> DataFrame:
    return V.near_duplicates(_signed(t, long=True)).select(F.col("id").alias("page_id"), "other", "matches")


def best_brand_sql(rows: str) -> str:
    """Statement: page_id and whether the host of ``rows`` (link_id, host) resembles a brand."""
    return f"select link_id as page_id, max(similarity) >= {P.RESEMBLES} as resembles from ({nearest_sql(rows, 'link_id', 'host', ('brand', 'phish'), 4)}) where kind = 'brand' group by 1"


@query(spoof_sql(best_brand_sql(f"select page_id as link_id, {host_sql('url')} as host from page_obs")))
def brand_page_spoof_full(t: Tables) -> DataFrame:
    hosts = t["page_obs"].select("page_id", urls.host(urls.normalized(F.col("url"))).alias("host"))
    top = V.nearest(hosts, "page_id", "host", ("brand", "phish"), 4)
    return P.brand_spoof(*P.with_resemblance(t["page_obs"], top))
