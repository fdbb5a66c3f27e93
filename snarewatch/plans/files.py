"""File queries and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.operators import files as X
from snarewatch.operators.links import asof_latest
from snarewatch.plans.links import names
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


def _named(name: str = "file_name", outer: str = "outer_ext", inner: str = "inner_ext") -> str:
    parts = f"string_split(lower({name}), '.')"
    return f"case when len({parts}) > 1 then {parts}[-1] end as {outer}, case when len({parts}) > 2 then {parts}[-2] end as {inner}"


_SCORED = f"""select *, cast(case when doc and prog then 60 when doc and arch then 30 when prog then 35 else 0 end as integer) as name_score,
  case when doc and prog then 'disguised_executable' when doc and arch then 'disguised_archive' when prog then 'lone_executable' end as name_warning
  from (select *, coalesce(inner_ext in ({names(C.DOCUMENT_EXT)}), false) as doc, coalesce(outer_ext in ({names(C.EXECUTABLE_EXT)}), false) as prog,
    coalesce(outer_ext in ({names(C.ARCHIVE_EXT)}), false) as arch from (select *, {_named()} from files))"""
_BLIND = f"""select *, case when size_bytes > 20971520 then 'too_large' end as scan_error,
  size_bytes > 20971520 and coalesce(name_warning = 'disguised_executable' or (name_warning = 'disguised_archive' and inner_ext in ({names(X.LURE_INNER)}) and outer_ext in ({names(X.LURE_OUTER)})), false) as blind_disguise
  from ({_SCORED})"""
_FINDINGS = f"""select file_id, finding, score, entry from (
  select file_id, unnest([{{'finding': 'disguised_entry', 'score': 85, 'entry': d, 'on': d is not null}}, {{'finding': 'executable_entry', 'score': 70, 'entry': x, 'on': d is null and x is not null}},
    {{'finding': 'encrypted', 'score': 45, 'entry': null, 'on': locked}}, {{'finding': 'too_many_entries', 'score': 30, 'entry': null, 'on': n >= 2000}}], recursive := true) from (
  select file_id, arg_min(base, entry_no) filter (prog and doc) as d, arg_min(base, entry_no) filter (prog and not doc) as x, bool_or(encrypted) as locked, count(*) as n from (
    select *, coalesce(outer_ext in ({names(C.EXECUTABLE_EXT)}), false) as prog, coalesce(inner_ext in ({names(C.DOCUMENT_EXT)}), false) as doc from (
      select *, {_named('base')} from (select *, regexp_replace(entry_name, '^.*[/\\\\]', '') as base from archive_entries))) group by file_id)) where "on" """
FILE_SQL = f"""select *, case when pct is null then 'uncertain' when pct >= 60 then 'dangerous' when pct >= 25 then 'suspicious' else 'safe' end as file_level from (
  select *, cast(greatest(0, least(99, case when found and checked and malicious > 0 then (case when malicious >= 10 then 95 when malicious >= 5 then 85 when malicious >= 2 then 70 else 45 end) + local_score // 2
      when found and checked then local_score when blind_disguise then greatest(60, local_score + 30) when local_score >= 25 then local_score else null end)) as integer) as raw,
    case when (found and checked) or blind_disguise or local_score >= 25 then raw end as pct
  from (select f.*, cast(greatest(f.name_score, coalesce(m.score, 0)) as integer) as local_score from ({_BLIND}) f
    left join (select file_id, max(score) as score from ({_FINDINGS}) group by file_id) m on f.file_id = m.file_id))"""


@query(f"select file_id, inner_ext, outer_ext, name_score, name_warning from ({_SCORED})")
def filename_risk(t: Tables) -> DataFrame:
    return X.filename_risk(t["files"]).select("file_id", "inner_ext", "outer_ext", "name_score", "name_warning")


@query("""select file_id, case when size_bytes is null then 'unknown' when size_bytes <= 20971520 then 'under-20MB' when size_bytes <= 52428800 then '20-50MB'
  when size_bytes <= 209715200 then '50-200MB' when size_bytes <= 1048576000 then '200MB-1GB' else 'over-1GB' end as bucket from files""")
def size_bucket(t: Tables) -> DataFrame:
    return t["files"].select("file_id", X.size_bucket(F.col("size_bytes")).alias("bucket"))


@query(f"select file_id, blind_disguise from ({_BLIND})")
def unscannable_disguise(t: Tables) -> DataFrame:
    return X.unscannable(X.filename_risk(t["files"])).select("file_id", "blind_disguise")


@query(f"select file_id, scan_error, name_score, scan_error is null and found and checked as answered from ({_BLIND})")
def unscannable_result(t: Tables) -> DataFrame:
    rows = X.unscannable(X.filename_risk(t["files"]))
    return rows.select("file_id", "scan_error", "name_score", (F.col("scan_error").isNull() & F.col("found") & F.col("checked")).alias("answered"))


_ODD = "select file_id, entry_no, concat(case when entry_no = 1 then concat(chr(10), '`') else '' end, case when entry_no = 2 then repeat(entry_name, 9) when entry_no = 3 then '' else entry_name end) as entry_name from archive_entries"


@query(rf"""with o as ({_ODD}), c as (select *, trim(replace(regexp_replace(entry_name, '[\p{{Cc}}\p{{Cf}}\p{{Zl}}\p{{Zp}}]', '', 'g'), '`', '''')) as clean from o)
  select file_id, entry_no, case when clean = '' then '?' when length(clean) > 80 then substr(clean, 1, 79) || '…' else clean end as shown from c""")
def display_name_clean(t: Tables) -> DataFrame:
    return t.sql(_ODD).select("file_id", "entry_no", X.display_name(F.col("entry_name")).alias("shown"))


_ENGINES = """select file_id, case when malicious > 6 then 'malicious' when malicious > 3 then 'suspicious' else 'undetected' end as category, concat('Trojan.', cast(malicious as string)) as result from files where found"""


@query(f"""select file_id, case category when 'malicious' then 'Detected (' || result || ')' when 'suspicious' then 'Suspicious (' || result || ')' else 'Clean' end as microsoft, 'Clean' as kaspersky from ({_ENGINES})""")
def top_engine_status(t: Tables) -> DataFrame:
    """Labels of named engines from the service's JSON answer."""
    body = t.sql(_ENGINES).select("file_id", F.to_json(F.create_map(F.lit("Microsoft"), F.struct("category", "result"))).alias("body"))
    engines = F.from_json("body", "map<string,struct<category:string,result:string>>")

    def status(name: str):
        e = F.try_element_at(engines, F.lit(name))
        return F.when(e["category"] == "malicious", F.concat(F.lit("Detected ("), e["result"], F.lit(")"))).when(
            e["category"] == "suspicious", F.concat(F.lit("Suspicious ("), e["result"], F.lit(")"))
        ).otherwise("Clean")

    return body.select("file_id", status("Microsoft").alias("microsoft"), status("Kaspersky").alias("kaspersky"))


_NAMED_ENGINES = """select file_id, case file_id % 4 when 0 then 'malicious' when 1 then 'suspicious' when 2 then 'undetected' else 'harmless' end as a,
  case when malicious > 6 then 'malicious' when malicious > 3 then 'suspicious' else 'undetected' end as b, concat('Trojan.', cast(malicious as string)) as result from files where found"""
_LABEL = lambda c: f"case {c} when 'malicious' then 'Detected (' || result || ')' when 'suspicious' then 'Suspicious (' || result || ')' else 'Clean' end"


@query(f"select file_id, {_LABEL('a')} as microsoft, {_LABEL('b')} as kaspersky, 'Clean' as bitdefender from ({_NAMED_ENGINES.replace('as string', 'as varchar')})")
def engine_labels(t: Tables) -> DataFrame:
    """Labels of the three named engines; one that gave no answer reads as clean."""
    answer = lambda c: F.struct(F.col(c).alias("category"), "result")
    body = t.sql(_NAMED_ENGINES).select("file_id", F.to_json(F.create_map(F.lit("Microsoft"), answer("a"), F.lit("Kaspersky"), answer("b"))).alias("body"))
    return X.engine_labels(body, ("Microsoft", "Kaspersky", "BitDefender"))


_HEADS = (
    "4D5A" + "00" * 58 + "40000000" + "50450000", "7F454C46", "CFFAEDFE", "504B0304", "504B0506", "526172211A0700", "377ABCAF271C",
    b"%PDF-1.4 /Launch (x)".hex(), b"%PDF-1.4 /JS(x)".hex(), b"%PDF-1.4 /JSON".hex(), "D0CF11E0A1B11AE1" + "_VBA_PROJECT".encode("utf-16-le").hex(), "4D5A" + "00" * 58 + "FFFFFF7F", "",
)
_NAMES = ".pdf .exe .docx .jpg .txt".split()


def _bytes_sql(encoded: str) -> str:
    """File bytes made of a head by id and the text of a document, and names of five kinds."""
    heads = " ".join(f"when {i} then unhex('{h}')" for i, h in enumerate(_HEADS))
    ends = " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES))
    return f"""select doc_id as file_id, cast(doc_id % {len(_HEADS)} as integer) as head, concat('f', cast(doc_id as varchar(20)), case cast(doc_id % {len(_NAMES)} as integer) {ends} end, case when doc_id % 37 = 0 then '‮' else '' end) as file_name,
      case cast(doc_id % {len(_HEADS)} as integer) {heads} end || {encoded} as content from documents where text is not null"""


def _file_bytes(t: Tables) -> DataFrame:
    return t.sql(_bytes_sql("encode(text, 'UTF-8')"))


_DIGIT = lambda i: f"(strpos('0123456789ABCDEF', substr(h, {i}, 1)) - 1)"
_OFFSET = "cast(" + " + ".join(f"{_DIGIT(121 + i)} * {16 ** p}" for i, p in enumerate((1, 0, 3, 2, 5, 4, 7, 6))) + " as bigint)"
_KIND = f"""case when starts_with(h, '4D5A') and length(h) >= 128 and {_OFFSET} < length(h) / 2 and substr(h, {_OFFSET} * 2 + 1, 8) = '50450000' then 'Windows program'
  when starts_with(h, '7F454C46') then 'Linux program' when substr(h, 1, 8) in ('FEEDFACE', 'FEEDFACF', 'CEFAEDFE', 'CFFAEDFE') then 'macOS program' when substr(h, 1, 8) in ('504B0304', '504B0506') then 'ZIP'
  when starts_with(h, '526172211A0700') or starts_with(h, '526172211A070100') then 'RAR' when starts_with(h, '377ABCAF271C') then '7Z' end"""
_READ = f"select *, {_KIND} as kind, case when file_name like '%.%' then lower(string_split(file_name, '.')[-1]) end as ext from (select *, hex(content) as h from ({_bytes_sql('encode(text)')}))"


@query(f"select file_id, kind from ({_READ})")
def magic_type(t: Tables) -> DataFrame:
    return _file_bytes(t).select("file_id", X.magic_type(F.col("content")).alias("kind"))


_ACTIVE = lambda x: "(" + " or ".join(f"regexp_matches(h, '^(..)*{w.encode().hex().upper()}($|[0-289A-F].|3[A-F]|[46]0|[57][B-F])')" for w in x) + ")"
_BYTE_SQL = f"""with r as ({_READ}), p as (select *, strpos(substr(h, 1, 2048), '{b"%PDF-".hex().upper()}') > 0 as pdf from r)
  select file_name, finding, score from (
    select file_name, 'pdf_launch' as finding, 70 as score from p where pdf and {_ACTIVE(['/Launch'])} union all select file_name, 'pdf_javascript', 45 from p where pdf and {_ACTIVE(['/JavaScript', '/JS'])}
    union all select file_name, 'reversed_name', 85 from p where contains(file_name, '‮') union all select file_name, 'disguised_executable', 85 from p where ends_with(kind, 'program') and not coalesce(ext in ({names(C.EXECUTABLE_EXT)}), false)
    union all select file_name, 'disguised_archive', 30 from p where kind in ('ZIP', 'RAR', '7Z') and ext in ({names(C.DOCUMENT_EXT)}) and ext not in ({names(X.ZIP_DOCUMENTS)})
    union all select file_name, 'office_macros', 50 from p where starts_with(h, 'D0CF11E0A1B11AE1') and contains(h, '{"_VBA_PROJECT".encode("utf-16-le").hex().upper()}'))"""


@query(f"select * from ({_BYTE_SQL}) where starts_with(finding, 'pdf')")
def pdf_active_content(t: Tables) -> DataFrame:
    return X.byte_findings(_file_bytes(t)).where("finding like 'pdf%'")


@query(f"select * from ({_BYTE_SQL}) where not starts_with(finding, 'pdf')")
def claimed_vs_real(t: Tables) -> DataFrame:
    return X.byte_findings(_file_bytes(t)).where("finding not like 'pdf%'")


@query()
def file_source(t: Tables) -> DataFrame:
    """The folder's own files as bytes: their names, sizes, digests and types."""
    return X.read_files(t.spark, t.folder).select("file_name", "length", "digest", X.magic_type(F.col("content")).alias("kind"), "scan_error")


@query(f"select file_id, finding, cast(score as integer) as score, entry from ({_FINDINGS})")
def archive_findings(t: Tables) -> DataFrame:
    return X.archive_findings(t["archive_entries"])


_KINDS = """select file_id, entry_no, case when file_id % 6 = 0 and entry_no = 0 then 'AndroidManifest.xml' when file_id % 6 = 0 and entry_no = 1 then 'classes.dex'
  when file_id % 6 = 3 and entry_no = 0 then '[Content_Types].xml' when file_id % 6 = 3 and entry_no = 1 then 'word/vbaProject.bin' else entry_name end as entry_name from archive_entries"""


@query(f"""select file_id, bool_or(lower(entry_name) = 'androidmanifest.xml') and bool_or(lower(entry_name) = 'classes.dex') as is_apk,
  bool_or(lower(entry_name) in ('[content_types].xml', 'mimetype')) as is_office, bool_or(ends_with(lower(entry_name), 'vbaproject.bin')) as has_macros from ({_KINDS}) group by file_id""")
def archive_kind(t: Tables) -> DataFrame:
    return X.archive_kinds(t.sql(_KINDS))


@query(f"select file_id, finding, cast(max(score) as integer) as score from ({_FINDINGS}) group by file_id, finding")
def best_finding_per_key(t: Tables) -> DataFrame:
    return X.best_findings(X.archive_findings(t["archive_entries"])).select("file_id", "finding", "score")


@query(f"select file_id, local_score from ({FILE_SQL})")
def local_score(t: Tables) -> DataFrame:
    return X.files_with_risk(t["files"], t["archive_entries"]).select("file_id", "local_score")


@query("select file_id, cast(case when malicious >= 10 then 95 when malicious >= 5 then 85 when malicious >= 2 then 70 when malicious >= 1 then 45 else 0 end as integer) as points from files")
def engine_risk(t: Tables) -> DataFrame:
    return t["files"].select("file_id", X.engine_risk(F.col("malicious")).alias("points"))


@query(f"select file_id, pct as file_pct, file_level from ({FILE_SQL})")
def file_risk(t: Tables) -> DataFrame:
    return X.files_with_risk(t["files"], t["archive_entries"]).select("file_id", "file_pct", "file_level")


@query(f"""with a as (select file_id, name_warning as reason, name_score as score, 0 as side from ({_SCORED}) where name_warning is not null
    union all select file_id, finding, max(score), 1 from ({_FINDINGS}) group by file_id, finding)
  select file_id, reason, cast(score as integer) as score, cast(place as integer) as place from (select *, row_number() over (partition by file_id order by score desc, side, reason) as place from a) where place <= 3""")
def top_local_reasons(t: Tables) -> DataFrame:
    return X.top_reasons(t["files"], t["archive_entries"])


_SEEN = "select digest, cast('2024-01-01' as date) + cast(file_id % 15 as int) as day, file_id as answer_id from files where file_id % 2 = 0 and checked"
_ASK = "select file_id, digest, cast('2024-01-10' as date) + cast(file_id % 5 as int) as day from files"


def _last_answers(t: Tables) -> DataFrame:
    """Each file's newest answer for its digest, as of its day and seven days back: file_id, value."""
    asked = t.sql(_ASK).select(F.col("file_id").alias("check_id"), "digest", F.col("day").cast("timestamp").alias("ts"))
    seen = t.sql(_SEEN).select("digest", F.col("day").cast("timestamp").alias("ts"), F.col("answer_id").alias("value"))
    return asof_latest(asked, seen, "digest", "7 days").select(F.col("check_id").alias("file_id"), "value")


@query(f"with s as ({_SEEN}), a as ({_ASK}) select file_id from a where not exists (select 1 from s where s.digest = a.digest and s.day <= a.day and s.day >= a.day - 7)")
def chargeable_files(t: Tables) -> DataFrame:
    """A digest that was answered in the last seven days costs nothing."""
    return _last_answers(t).where("value is null").select("file_id")


@query(f"""with s as ({_SEEN}), a as ({_ASK}), e as (select a.file_id, max(struct_pack(d := s.day, i := s.answer_id)) as last from a left join s on s.digest = a.digest and s.day <= a.day and s.day >= a.day - 7 group by a.file_id)
  select e.file_id, last.i as answer_id, r.local_score, r.file_level from e join ({FILE_SQL}) r on e.file_id = r.file_id""")
def file_evidence(t: Tables) -> DataFrame:
    """Each file with the newest answer for its digest, seven days back, and its local risk."""
    last = _last_answers(t).select("file_id", F.col("value").alias("answer_id"))
    scored = X.files_with_risk(t["files"], t["archive_entries"]).select("file_id", "local_score", "file_level")
    return scored.join(last.hint("merge"), "file_id", "left").select("file_id", "answer_id", "local_score", "file_level")


@query("select file_id, place from (select file_id, cast(row_number() over (partition by size_bytes % 7 order by size_bytes desc, file_id) as integer) as place from files) where place <= 10")
def largest_files(t: Tables) -> DataFrame:
    """Top ten by size in each of seven strata: the sort-and-limit shape."""
    turn = Window.partitionBy(F.col("size_bytes") % 7).orderBy(F.desc("size_bytes"), "file_id")
    return t["files"].select("file_id", F.row_number().over(turn).alias("place")).where("place <= 10")
