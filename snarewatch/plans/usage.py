"""Metering, alert and log queries, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.operators import folds
from snarewatch.operators import links as L
from snarewatch.operators import usage as U
from snarewatch.sources.fixtures import Tables, shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select user_id, cast(ts as date) as day, count(*) filter (kind = 'file') as files_used, count(*) filter (kind = 'link') as links_used,
  cast(sum(tokens) as bigint) as tokens_used, cast(3 as integer) as files_limit, cast(8 as integer) as links_limit from usage_requests group by 1, 2""")
def usage_summary(t: Tables) -> DataFrame:
    return U.usage_summary(t["usage_requests"])


_ADMIT = """select *, trusted_shape or row_number() over (partition by user_id, cast(ts as date), kind, trusted_shape order by ts, request_id)
  <= case when kind = 'file' then 3 else 8 end as admitted from usage_requests"""


@query(f"select request_id, admitted from ({_ADMIT})")
def quota_admission(t: Tables) -> DataFrame:
    return U.quota_admission(t["usage_requests"]).select("request_id", "admitted")


@query("""select request_id, spent, spent < 20000 as allowed from (select request_id, cast(coalesce(sum(tokens) over (partition by user_id, cast(ts as date) order by ts, request_id
  rows between unbounded preceding and 1 preceding), 0) as bigint) as spent from usage_requests)""")
def token_budget(t: Tables) -> DataFrame:
    return U.token_budget(t["usage_requests"]).select("request_id", "spent", "allowed")


@query(f"select user_id, cast(ts as date) as day, arg_min(request_id, (ts, request_id)) as request_id from ({_ADMIT}) where not admitted group by 1, 2")
def notify_once(t: Tables) -> DataFrame:
    return U.notify_once(U.quota_admission(t["usage_requests"]))


@query("""select event_id, user_id, days_left, days_left = 0 as blocked from (select event_id, user_id,
  cast(greatest(7 - floor((epoch_us(ts) // 1000000 - epoch_us(min(ts) over (partition by user_id)) // 1000000) / 86400), 0) as bigint) as days_left from events)""")
def trial_status(t: Tables) -> DataFrame:
    return U.trial_status(t["events"]).drop("ts")


@query("select event_id, strftime(date_trunc('day', ts) + interval 1 day, '%Y-%m-%d') as resets_on, strftime(ts + interval 7 hours, '%d %b %Y, %I:%M %p (UTC+7)') as local_time from events")
def next_reset(t: Tables) -> DataFrame:
    return t["events"].select(
        "event_id",
        F.date_format(F.date_trunc("day", F.col("ts")) + F.expr("interval 1 day"), "yyyy-MM-dd").alias("resets_on"),
        F.date_format(F.col("ts") + F.expr("interval 7 hours"), "dd MMM yyyy, hh:mm a '(UTC+7)'").alias("local_time"),
    )


@query("select event_id, strftime(ts + interval 7 hours, '%d %b %Y, %I:%M %p (UTC+7)') as local_time from events")
def format_local_time(t: Tables) -> DataFrame:
    return next_reset(t).select("event_id", "local_time")


def _gap_sql(rows: str, key: str, seconds: int, op: str) -> str:
    return f"""with recursive r as (select {key}, id, ts, row_number() over (partition by {key} order by ts, id) as n from ({rows})),
  g as (select {key}, id, ts, n, ts as last, true as kept from r where n = 1
    union all select r.{key}, r.id, r.ts, r.n, case when epoch_us(r.ts) - epoch_us(g.last) {op} {seconds * 1000000} then r.ts else g.last end, epoch_us(r.ts) - epoch_us(g.last) {op} {seconds * 1000000}
      from g join r on r.{key} = g.{key} and r.n = g.n + 1)
  select {key}, id from g where kept"""


_CHECKS = "select link_id, check_id as id, ts from link_checks"


@query(_gap_sql(_CHECKS, "link_id", 86400, ">"))
def greedy_gap(t: Tables) -> DataFrame:
    return folds.kept_by_gap(t.sql(_CHECKS), "link_id", 86400, strict=True)


@query(_gap_sql(_CHECKS, "link_id", 3600, ">"))
def verdict_cache(t: Tables) -> DataFrame:
    """Checks that compute a verdict anew: the cached one is older than an hour."""
    return folds.kept_by_gap(t.sql(_CHECKS), "link_id", 3600, strict=True)


_HOT = """select service, event_id as id, ts from (select *, count(*) over (partition by service order by epoch_us(ts) // 1000000 range between 3600 preceding and current row) as recent from backend_failures) where recent >= 3"""


@query(_gap_sql(_HOT, "service", 3600, ">="))
def failure_alerts(t: Tables) -> DataFrame:
    return U.failure_alerts(t["backend_failures"])


_CALLS = "select event_id, ts, user_id % 3 as service, event_type in ('error', 'click') as failed from events"


@query(f"""with i as (select *, sum(case when failed then 0 else 1 end) over (partition by service order by ts, event_id) as island from ({_CALLS}))
  select event_id, service, cast(nth as integer) as nth from (select *, row_number() over (partition by service, island order by ts, event_id) as nth from i where failed) where nth >= 3""")
def failure_streaks(t: Tables) -> DataFrame:
    return U.failure_streaks(t.sql(_CALLS)).drop("ts")


@query(f"""with i as (select *, sum(case when failed then 0 else 1 end) over (partition by service order by ts, event_id) as island from ({_CALLS}))
  select event_id, service, epoch_us(ts) + 30000000 as until_us from (select *, row_number() over (partition by service, island order by ts, event_id) as nth from i where failed) where nth >= 3""")
def outage_windows(t: Tables) -> DataFrame:
    """Each further failure of a streak keeps the service out for thirty seconds more."""
    return U.outages(U.failure_streaks(t.sql(_CALLS)))


_BRAND_CHECKS = "select c.link_id, c.check_id as id, c.ts from link_checks c where c.link_id in (select link_id from links where raw_url like 'https://www.facebook.com/%')"


@query(f"""select link_id, id from ({_gap_sql(_CHECKS + " where link_id not in (select link_id from links where raw_url like 'https://www.facebook.com/%')", "link_id", 3600, ">")}) union all select link_id, id from ({_BRAND_CHECKS})""")
def verdict_cache_full(t: Tables) -> DataFrame:
    """Links of a brand are never cached: each of their checks computes a verdict."""
    known = L.link_parts(t["links"]).where(F.col("reg_domain").isin(*C.BRANDS)).select("link_id", F.lit(True).alias("brand"))
    checks = t.sql(_CHECKS).join(known.hint("merge"), "link_id", "left")
    return folds.kept_by_gap(checks.where("brand is null"), "link_id", 3600, strict=True).unionByName(checks.where("brand").select("link_id", "id"))


@query("""with f as (select user_id, min(ts) as started from events group by user_id)
  select user_id, arg_min(event_id, (ts, event_id)) as event_id from (select e.* from events e join f on f.user_id = e.user_id where epoch_us(e.ts) // 1000000 - epoch_us(f.started) // 1000000 >= 7 * 86400) group by user_id""")
def trial_notice(t: Tables) -> DataFrame:
    """One notice ever: the first event after the trial."""
    return U.trial_notices(t["events"])


_STEPS = """select request_id as event_id, user_id, ts, kind, case when request_id % 6 = 1 then 'refund' when request_id % 20 = 3 then 'charge' when trusted_shape then 'bypass' else 'use' end as step from usage_requests"""
_LIMIT = "case kind when 'file' then 3 else 8 end"
_USED = lambda s: f"case {s}.step when 'charge' then 1 when 'refund' then case when {{0}} > 0 then -1 else 0 end when 'use' then case when {{0}} < {_LIMIT.replace('kind', s + '.kind')} then 1 else 0 end else 0 end"
_ADMITTED = lambda used: f"case step when 'use' then {used} < {_LIMIT} when 'bypass' then true end"


@query(f"""with recursive r as (select *, row_number() over (partition by user_id, cast(ts as date), kind order by ts, event_id) as n, cast(ts as date) as day from ({_STEPS})),
  g as (select r.*, 0 as before, {_USED('r').format('0')} as used from r where n = 1
    union all select r.*, g.used, g.used + {_USED('r').format('g.used')} from g join r on r.user_id = g.user_id and r.day = g.day and r.kind = g.kind and r.n = g.n + 1)
  select event_id, {_ADMITTED('before')} as admitted, cast(used as integer) as used from g""")
def quota_refunds(t: Tables) -> DataFrame:
    """Admission where slots come back and trusted shapes are charged later."""
    return U.folded_quota(t.sql(_STEPS))


@query("select link_id, max(struct_pack(ts := ts, check_id := check_id)).check_id as check_id from link_checks group by link_id")
def upsert_snapshot(t: Tables) -> DataFrame:
    """Three batches put into one written snapshot in turn, in any order of their times, and the second again."""
    path = f"{shared_folder(t.spark)}/snapshot"
    rows = t["link_checks"].select("link_id", "check_id", "ts")
    for i in (0, 1, 2, 1):
        U.merge_into(path, rows.where(F.pmod("check_id", F.lit(3)) == i), "link_id", ("ts", "check_id"), batch_id=i)
    return t.spark.read.parquet(path).select("link_id", "check_id")


@query(f"select link_id, cast(link_id % 4 as integer) as host_group, count(*) as n from link_checks group by 1, 2")
def scan_log(t: Tables) -> DataFrame:
    """Checks appended to a log by day in two batches, and what the log then holds of each link."""
    path = f"{shared_folder(t.spark)}/log"
    rows = t["link_checks"].select("link_id", "check_id", F.col("ts").alias("checked_at"))
    for i in range(2):
        U.append_scan_log(rows.where(F.pmod("check_id", F.lit(2)) == i), path)
    return t.spark.read.parquet(path).groupBy("link_id", F.pmod("link_id", F.lit(4)).cast("int").alias("host_group")).agg(F.count("*").alias("n"))


_TAGGED = r"""select event_id, string_split(line, ' ')[1] as stamp, regexp_extract(line, 'reason=(\S+)', 1) as reason, regexp_extract(line, 'size=(\S+)', 1) as size,
  regexp_extract(line, 'disguised=(\S+)', 1) = 'True' as disguised, not regexp_matches(line, '\[oversize-file\] reason=\S+ size=\S+ disguised=(True|False)$') as odd
  from log_lines where contains(line, '[oversize-file]')"""


@query(_TAGGED)
def log_text_source(t: Tables) -> DataFrame:
    return U.tagged_lines(t["log_lines"])


@query(f"""select reason, size, count(*) as n, count(*) filter (disguised) as n_disguised, count(*) filter (odd) as n_odd, min(stamp) as first, max(stamp) as last,
  round(count(*) filter (disguised) / count(*), 6) as fire_rate from ({_TAGGED}) group by reason, size""")
def oversize_report(t: Tables) -> DataFrame:
    return U.oversize_report(U.tagged_lines(t["log_lines"]))


@query("""select message_id, user_id, length(text) as n_chars, case when starts_with(text, '/') then regexp_extract(text, '^/(\\w+)', 1) else '' end as command,
  case when text = '' then 'empty' else 'text' end as kind from message_text""")
def private_log_projection(t: Tables) -> DataFrame:
    """What may be logged of a message: ids, kind, length and command word, never its text."""
    text = F.col("text")
    return t["message_text"].select(
        "message_id", "user_id", F.length(text).cast("bigint").alias("n_chars"),
        F.when(text.startswith("/"), F.regexp_extract(text, r"^/(\w+)", 1)).otherwise("").alias("command"),
        F.when(text == "", "empty").otherwise("text").alias("kind"),
    )
