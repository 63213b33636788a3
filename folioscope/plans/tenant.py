"""Tenant reports. Users are nations, projects customers, audits orders, crawl jobs lineitems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.conf import PROGRESS, TERMINAL
from folioscope.operators import changes as ch
from folioscope.operators import relational as rel
from folioscope.sources.tables import load

#: What the tables' status letters stand for.
STATUS = {"P": "crawling", "F": "completed", "O": "queued"}
CUTOFF = "1995-01-01"
PLANS = ("free", "pro", "agency")


def _audits(s: SparkSession, d: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return load(s, d, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("project_id"), F.coalesce(status[F.col("o_orderstatus")], F.lit("failed")).alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"), F.col("o_orderpriority").alias("priority"))


def _projects(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").cast("long").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("job_id"), F.col("l_orderkey").alias("audit_id"), F.when(F.col("l_linestatus") == "O", "running").otherwise("completed").alias("status"), F.col("l_shipdate").cast("timestamp_ntz").alias("updated"), F.col("l_quantity").cast("int").alias("retries"))


A = "(SELECT o_orderkey AS audit_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'P' THEN 'crawling' WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score, CAST(o_orderdate AS TIMESTAMP) AS created, o_orderpriority AS priority FROM orders)"
P = "(SELECT c_custkey AS project_id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer)"
J = "(SELECT l_orderkey * 10 + l_linenumber AS job_id, l_orderkey AS audit_id, CASE WHEN l_linestatus = 'O' THEN 'running' ELSE 'completed' END AS status, CAST(l_shipdate AS TIMESTAMP) AS updated, CAST(l_quantity AS INT) AS retries FROM lineitem)"


def _used(df: DataFrame) -> DataFrame:
    """Projects as users with credits: what they have used and their plan's limit."""
    plan = F.element_at(F.array(*[F.lit(p) for p in PLANS]), (F.col("project_id") % 3 + 1).cast("int"))
    limit = F.when(plan == "free", 10).when(plan == "pro", 200).otherwise(1000)
    return df.select("project_id", plan.alias("plan"), limit.alias("credit_limit"), F.when(F.col("project_id") % 7 != 0, F.col("project_id") % 300).cast("long").alias("used"))


U = f"(SELECT project_id, CASE project_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'agency' END AS plan, CASE project_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 200 ELSE 1000 END AS credit_limit, CASE WHEN project_id % 7 <> 0 THEN project_id % 300 END AS used FROM {P})"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"SELECT audit_id, project_id, priority FROM {A} WHERE status = 'completed' AND priority = '1-URGENT'")
def filter_optional_equality(s, d):
    return rel.equal_where(_audits(s, d), status="completed", priority="1-URGENT", project_id=None).select("audit_id", "project_id", "priority")


@query(f"SELECT audit_id, status FROM {A} WHERE status IN ('queued', 'crawling')")
def filter_in_list(s, d):
    return rel.by_keys(_audits(s, d), "status", ["queued", "crawling"]).select("audit_id", "status")


@query(f"SELECT status, COUNT(*) FILTER (score IS NULL) AS n_null, COUNT(*) FILTER (score IS NOT NULL) AS n_known FROM {A} GROUP BY status")
def filter_null_checks(s, d):
    return _audits(s, d).groupBy("status").agg(F.count_if(F.col("score").isNull()).alias("n_null"), F.count_if(F.col("score").isNotNull()).alias("n_known"))


@query(f"SELECT job_id, audit_id FROM {J} WHERE status = 'running' AND updated < TIMESTAMP '1995-09-01'")
def filter_stale_before(s, d):
    return _jobs(s, d).where(ch.stale(None, "status", "running", "updated", F.lit("1995-09-01").cast("timestamp_ntz"))).select("job_id", "audit_id")


@query(f"SELECT project_id, name FROM {P} WHERE name ILIKE '%er#0000001%'")
def search_name_substring(s, d):
    return _projects(s, d).where(rel.contains_text("name", "  ER#0000001 ")).select("project_id", "name")


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = 'brand#12'")
def match_folded_equality(s, d):
    return load(s, d, "part").where(rel.equals_folded("p_brand", " BRAND#12 ")).select("p_partkey", "p_brand")


@query(f"SELECT project_id, CAST(greatest(0, coalesce(credit_limit, 0) - coalesce(used, 0)) AS BIGINT) AS remaining FROM {U}")
def project_remaining_quota(s, d):
    return _used(_projects(s, d)).select("project_id", rel.remaining(F.col("credit_limit"), F.col("used")).cast("long").alias("remaining"))


@query(f"SELECT audit_id, CASE status WHEN 'queued' THEN 0.05::DOUBLE WHEN 'crawling' THEN 0.35::DOUBLE WHEN 'analyzing' THEN 0.75::DOUBLE WHEN 'completed' THEN 1.0::DOUBLE WHEN 'failed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS progress, status IN ('completed', 'failed', 'cancelled') AS terminal FROM {A}")
def progress_and_terminal(s, d):
    progress = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    return _audits(s, d).select("audit_id", F.coalesce(progress[F.col("status")], F.lit(0.0)).alias("progress"), F.col("status").isin(*TERMINAL).alias("terminal"))


@query(f"SELECT audit_id, project_id, created FROM {A} ORDER BY created DESC, audit_id LIMIT 20 OFFSET 40")
def page_newest_first(s, d):
    return rel.page(_audits(s, d), "-created", key="audit_id", skip=40, limit=20).select("audit_id", "project_id", "created")


@query(f"SELECT audit_id, total, total > 20 AS has_more FROM (SELECT audit_id, created FROM {A} WHERE status = 'completed' ORDER BY created DESC, audit_id LIMIT 20), (SELECT COUNT(*) AS total FROM {A} WHERE status = 'completed')")
def page_with_total(s, d):
    return rel.page_with_total(rel.equal_where(_audits(s, d), status="completed"), "-created", key="audit_id").select("audit_id", "total", "has_more")


@query(f"SELECT a.audit_id, a.status FROM {A} a JOIN {P} p USING (project_id) WHERE p.user_id = 7")
def join_owner_two_way(s, d):
    return rel.owned(_audits(s, d), _projects(s, d), "project_id", "project_id", user_id=7).select("audit_id", "status")


@query(f"SELECT j.job_id, j.status, p.user_id FROM {J} j JOIN {A} a USING (audit_id) JOIN {P} p USING (project_id) WHERE p.user_id = 3")
def join_owner_three_way(s, d):
    projects = rel.equal_where(_projects(s, d), user_id=3)
    return _jobs(s, d).select("job_id", "status", "audit_id").join(_audits(s, d).select("audit_id", "project_id"), "audit_id").join(projects, "project_id").select("job_id", "status", "user_id")


@query(f"SELECT a.project_id, COUNT(*) AS n FROM {J} j JOIN {A} a USING (audit_id) WHERE a.status = 'queued' GROUP BY a.project_id")
def join_scope_chunks(s, d):
    scope = rel.equal_where(_audits(s, d), status="queued").select("audit_id", "project_id")
    return _jobs(s, d).select("audit_id").join(scope, "audit_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT project_id, name FROM {P} p WHERE NOT EXISTS (SELECT 1 FROM {A} a WHERE a.project_id = p.project_id AND a.priority = '1-URGENT' AND a.status = 'completed')")
def anti_join_orphans(s, d):
    urgent = _audits(s, d).where("priority = '1-URGENT' and status = 'completed'")
    return rel.orphans(_projects(s, d), urgent, "project_id", "project_id").select("project_id", "name")


@query(f"SELECT DISTINCT p.project_id FROM {P} p JOIN {P} q ON p.user_id = q.user_id AND p.segment = q.segment AND p.project_id % 2 = 0 AND q.project_id % 2 = 1")
def semi_conflict(s, d):
    p = _projects(s, d)
    return rel.conflicts(p.where("project_id % 2 = 0"), p.where("project_id % 2 = 1"), "user_id", "segment").select("project_id")


@query(f"SELECT project_id, string_agg(CAST(audit_id AS VARCHAR), ',' ORDER BY r) AS children FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created DESC, audit_id) AS r FROM {A}) WHERE r <= 20 GROUP BY project_id")
def collect_children(s, d):
    return rel.collect_children(_audits(s, d).select("project_id", "created", "audit_id"), "project_id", "created", "audit_id")


@query(f"SELECT r.audit_id, CASE WHEN a.audit_id IS NULL THEN 'missing' WHEN a.project_id = r.asked THEN 'owned' ELSE 'foreign' END AS outcome FROM (SELECT audit_id + (CASE WHEN audit_id % 3 = 0 THEN 1000000000 ELSE 0 END) AS audit_id, CASE WHEN audit_id % 2 = 0 THEN project_id ELSE project_id + 1 END AS asked FROM {A}) r LEFT JOIN {A} a ON a.audit_id = r.audit_id")
def access_classification(s, d):
    a = _audits(s, d).select("audit_id", "project_id")
    asked = a.select((F.col("audit_id") + F.when(F.col("audit_id") % 3 == 0, 1_000_000_000).otherwise(0)).alias("audit_id"), F.when(F.col("audit_id") % 2 == 0, F.col("project_id")).otherwise(F.col("project_id") + 1).alias("asked"))
    return rel.access(asked, a, "audit_id", "project_id", "asked").select("audit_id", "outcome")


@query(f"SELECT project_id, status, COUNT(*) AS n FROM {A} GROUP BY ALL")
def agg_status_counts(s, d):
    return rel.status_counts(_audits(s, d), "status", "project_id")


@query(f"SELECT status, round(avg(score), 4) AS mean_score, COUNT(score) AS n_scored FROM {A} GROUP BY status")
def agg_avg_non_null(s, d):
    return _audits(s, d).groupBy("status").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count("score").alias("n_scored"))


@query("SELECT l_orderkey, CAST(coalesce(max(l_linenumber), -1) + 1 AS BIGINT) AS next_index FROM lineitem GROUP BY l_orderkey")
def agg_next_index(s, d):
    return rel.next_index(load(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", "l_orderkey").withColumn("next_index", F.col("next_index").cast("long"))


@query(f"""SELECT p.project_id, coalesce(n_audits, 0) AS n_audits, coalesce(n_done, 0) AS n_done, coalesce(n_jobs, 0) AS n_jobs, latest_score FROM {P} p
LEFT JOIN (SELECT project_id, COUNT(*) AS n_audits, COUNT(*) FILTER (status = 'completed') AS n_done, arg_max(score, (created, audit_id)) FILTER (score IS NOT NULL) AS latest_score FROM {A} GROUP BY project_id) a USING (project_id)
LEFT JOIN (SELECT project_id, COUNT(*) AS n_jobs FROM {J} JOIN {A} USING (audit_id) GROUP BY project_id) j USING (project_id)""")
def agg_child_stats(s, d):
    audits = _audits(s, d)
    jobs = _jobs(s, d).select("audit_id").join(audits.select("audit_id", "project_id"), "audit_id")
    children = {
        "audits": (audits, "project_id", [F.count(F.lit(1)).alias("n_audits"), F.count_if(F.col("status") == "completed").alias("n_done"), rel.latest_score("score", "created", "audit_id").alias("latest_score")]),
        "jobs": (jobs, "project_id", [F.count(F.lit(1)).alias("n_jobs")]),
    }
    out = rel.child_stats(_projects(s, d).select("project_id"), "project_id", children)
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_audits", "n_done", "n_jobs")], "latest_score")


@query("SELECT source, COUNT(*) AS n, COUNT(l.quality) AS n_labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def agg_count_embedded(s, d):
    return load(s, d, "documents").select("doc_id", "source").join(load(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"))


@query(f"SELECT project_id, audit_id, status FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created DESC, audit_id DESC) AS r FROM {A}) WHERE r = 1")
def latest_per_key(s, d):
    return rel.latest_per(_audits(s, d).select("project_id", "audit_id", "status", "created"), ["project_id"], "created", "audit_id").select("project_id", "audit_id", "status")


@query(f"""WITH l AS (SELECT 'score' AS list, project_id, max(score) AS v FROM {A} GROUP BY project_id HAVING max(score) IS NOT NULL UNION ALL SELECT 'count', project_id, CAST(COUNT(*) AS DOUBLE) FROM {A} GROUP BY project_id),
r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY v DESC, project_id) AS p FROM l QUALIFY p <= 50), f AS (SELECT project_id, sum(1.0::DOUBLE / (60 + p)) AS f, COUNT(*) AS lists FROM r GROUP BY project_id)
SELECT project_id, round(f / (SELECT max(f) FROM f), 6) AS fused, lists FROM f""")
def rank_fusion_positions(s, d):
    by = _audits(s, d).groupBy("project_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).cast("double").alias("n"))
    lists = by.where("best is not null").select(F.lit("score").alias("list"), "project_id", F.col("best").alias("v")).union(by.select(F.lit("count"), "project_id", "n"))
    return rel.fuse_rankings(lists, "list", "project_id", "v", most=50).select("project_id", F.round("fused", 6).alias("fused"), "lists")


@query("SELECT DISTINCT trim(text) AS prompt FROM benchmark WHERE trim(text) <> '' AND item_id % 2 = 1 AND trim(text) NOT IN (SELECT trim(text) FROM benchmark WHERE item_id % 2 = 0)")
def union_insert_ignore(s, d):
    b = load(s, d, "benchmark").select("item_id", F.trim("text").alias("prompt")).where("prompt <> ''")
    return ch.insert_ignore(b.where("item_id % 2 = 0").select("prompt"), b.where("item_id % 2 = 1").select("prompt"), ["prompt"])


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(['BRASS','COPPER','NICKEL','STEEL','TIN'], lambda x: NOT contains(p_type, x))), ',') AS missing FROM part")
def array_set_difference(s, d):
    kinds = F.array(*map(F.lit, ("BRASS", "COPPER", "NICKEL", "STEEL", "TIN")))
    return load(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(kinds, F.split("p_type", " "))), ",").alias("missing"))


@query(f"SELECT coalesce(o.project_id, n.project_id) AS project_id, CASE WHEN n.project_id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.project_id IS NOT NULL THEN o.balance ELSE n.balance END AS balance, n.project_id IS NOT NULL AS affected FROM (SELECT project_id, name, balance FROM {P} WHERE project_id % 5 <> 0) o FULL OUTER JOIN (SELECT project_id, 'new ' || name AS name, 0.5::DOUBLE AS balance FROM {P} WHERE project_id % 3 = 0) n USING (project_id)")
def upsert_by_key(s, d):
    p = _projects(s, d).select("project_id", "name", "balance")
    new = p.where("project_id % 3 = 0").select("project_id", F.concat(F.lit("new "), "name").alias("name"), F.lit(0.5).alias("balance"))
    return ch.upsert(p.where("project_id % 5 <> 0"), new, ["project_id"], ["name"])


@query(f"SELECT audit_id, CASE WHEN status IN ('queued', 'crawling') AND project_id % 2 = 0 THEN 'crawling' ELSE status END AS status, status IN ('queued', 'crawling') AND project_id % 2 = 0 AS affected FROM {A}")
def claim_pending(s, d):
    return ch.claim(_audits(s, d).select("audit_id", "status", "project_id"), "status", ["queued", "crawling"], "crawling", F.col("project_id") % 2 == 0).select("audit_id", "status", "affected")


@query(f"SELECT a.audit_id, CASE WHEN h.audit_id IS NOT NULL AND a.status = 'crawling' THEN 'failed' ELSE a.status END AS status, h.audit_id IS NOT NULL AND a.status = 'crawling' AS affected FROM {A} a LEFT JOIN (SELECT DISTINCT audit_id FROM {J} WHERE status = 'running' AND updated < TIMESTAMP '1998-01-01') h ON a.audit_id = h.audit_id")
def recover_stale(s, d):
    old = ch.stale(None, "status", "running", "updated", F.lit("1998-01-01").cast("timestamp_ntz"))
    return ch.recover(_jobs(s, d), _audits(s, d).select("audit_id", "status"), "audit_id", "status", "status", old, "crawling", "failed").select("audit_id", "status", "affected")


@query(f"SELECT project_id, CAST(coalesce(CASE WHEN coalesce(used + n <= credit_limit, false) AND n > 0 THEN used + n ELSE used END, -1) AS BIGINT) AS used, coalesce(n <= 0 OR used + n <= credit_limit, false) AS affected FROM (SELECT *, project_id % 11 - 1 AS n FROM {U})")
def quota_single_request(s, d):
    return ch.consume(_used(_projects(s, d)), "used", "credit_limit", F.col("project_id") % 11 - 1).select("project_id", F.coalesce("used", F.lit(-1)).alias("used"), "affected")


@query(f"SELECT job_id, CASE WHEN retries % 6 < 3 THEN 'retry' ELSE 'failed' END AS outcome, CAST(pow(2, retries % 6 + 1) AS DOUBLE) AS backoff FROM {J} WHERE status = 'running'")
def retry_policy(s, d):
    n = F.col("retries") % 6
    return rel.equal_where(_jobs(s, d), status="running").select("job_id", ch.retry(n).alias("outcome"), ch.backoff_seconds(n).alias("backoff"))


@query(f"SELECT p.project_id, coalesce(c.name, p.name) AS name, coalesce(c.segment, p.segment) AS segment, c.project_id IS NOT NULL AS affected FROM {P} p LEFT JOIN (SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 'patched' END AS name, CASE WHEN project_id % 2 = 1 THEN 'OTHER' END AS segment FROM {P} WHERE project_id % 4 < 2) c USING (project_id)")
def coalesce_update(s, d):
    p = _projects(s, d).select("project_id", "name", "segment")
    new = p.where("project_id % 4 < 2").select("project_id", F.when(F.col("project_id") % 2 == 0, "patched").alias("name"), F.when(F.col("project_id") % 2 == 1, "OTHER").alias("segment"))
    return ch.patch(p, new, "project_id")


@query(f"SELECT COUNT(DISTINCT a.audit_id) AS audits_left, COUNT(*) AS jobs_left FROM {J} j JOIN {A} a USING (audit_id) JOIN {P} p USING (project_id) WHERE p.user_id <> 5")
def cascade_delete(s, d):
    left = ch.delete(_projects(s, d), F.col("user_id") == 5)
    _, jobs = ch.cascade(left, (_audits(s, d), "project_id", "project_id"), (_jobs(s, d), "audit_id", "audit_id"))
    return jobs.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("audits_left"), F.coalesce(F.sum("n"), F.lit(0)).alias("jobs_left"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS pseudonym FROM customer")
def hash_pseudonym(s, d):
    from folioscope.functions.text import pseudonym

    return load(s, d, "customer").select("c_custkey", pseudonym(F.col("c_name")).alias("pseudonym"))


@query(f"SELECT project_id, name FROM {P} WHERE user_id = 4 AND segment = 'BUILDING'")
def lookup_by_two_keys(s, d):
    return rel.equal_where(_projects(s, d), user_id=4, segment="BUILDING").select("project_id", "name")


@query(f"SELECT audit_id, job_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY updated DESC, job_id) AS nth FROM {J}) WHERE nth <= 3")
def jobs_of_parent(s, d):
    return ch.latest_first(_jobs(s, d).select("audit_id", "job_id", "updated"), "audit_id", "updated", "job_id").where("nth <= 3").select("audit_id", "job_id", F.col("nth").cast("long").alias("nth"))


@query("SELECT item_id, trim(text) AS prompt FROM benchmark WHERE item_id % 3 <> 0 AND trim(text) <> ''")
def active_prompts(s, d):
    return load(s, d, "benchmark").where("item_id % 3 <> 0").select("item_id", F.trim("text").alias("prompt")).where("prompt <> ''")


@query(f"SELECT 'user' AS scope, a.audit_id, a.project_id FROM {A} a JOIN {P} p USING (project_id) WHERE p.user_id = 7 AND a.status = 'completed' UNION ALL SELECT 'project', a.audit_id, a.project_id FROM {A} a JOIN {P} p USING (project_id) WHERE p.user_id = 3 AND a.project_id = (SELECT min(project_id) FROM {P} WHERE user_id = 3)")
def list_dispatch(s, d):
    """Two listings: a user's completed audits, and all audits of a user's first project; a project of somebody else lists nothing."""
    audits, projects = _audits(s, d), _projects(s, d)
    first = rel.equal_where(projects, user_id=3).agg(F.min("project_id")).first()[0]
    mine = rel.listing(audits, projects, "project_id", "project_id", "user_id", 7, status="completed").select(F.lit("user").alias("scope"), "audit_id", "project_id")
    one = rel.listing(audits, projects, "project_id", "project_id", "user_id", 3, first).select(F.lit("project"), "audit_id", "project_id")
    other = rel.listing(audits, projects, "project_id", "project_id", "user_id", 4, first).select(F.lit("foreign"), "audit_id", "project_id")
    return mine.union(one).union(other)


@query(f"SELECT job_id, strftime(updated, '%Y-%m-%dT%H:%M:%SZ') AS since, strftime(c, '%Y-%m-%dT%H:%M:%SZ') AS cutoff FROM {J}, (SELECT max(updated) - INTERVAL 129600 MINUTE AS c FROM {J}) WHERE status = 'running' AND updated < c")
def stale_since_newest(s, d):
    """Running jobs that began over 90 days before the newest one."""
    jobs = _jobs(s, d)
    now = jobs.agg(ch.cutoff(F.max("updated"), 129_600).alias("c"))  # one row
    return jobs.crossJoin(F.broadcast(now)).where(ch.stale(None, "status", "running", "updated", F.col("c"))).select("job_id", ch.iso_text(F.col("updated")).alias("since"), ch.iso_text(F.col("c")).alias("cutoff"))


@query("SELECT event_type || ':' || user_id AS bucket, COUNT(*) AS hits FROM events GROUP BY 1")
def limiter_keys(s, d):
    from folioscope.operators.limits import limiter_key

    e = load(s, d, "events")
    bucket = F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"))
    named = e.select(F.coalesce(*[F.when(F.col("event_type") == x, limiter_key(x, F.col("user_id").cast("string"))) for x in ("click", "purchase", "view", "search", "signup")], bucket).alias("bucket"))
    return named.groupBy("bucket").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 20")
def name_listing(s, d):
    return rel.page(load(s, d, "nation").select("n_nationkey", "n_name"), "n_name", key="n_nationkey")


@query(f"SELECT EXISTS (SELECT 1 FROM {A} WHERE status = 'crawling') AS found")
def existence_probe(s, d):
    return rel.exists(rel.equal_where(_audits(s, d), status="crawling"))


@query(f"""WITH RECURSIVE r AS MATERIALIZED (SELECT a.project_id, a.audit_id, a.audit_id % 5 AS n, CAST(u.credit_limit AS BIGINT) AS l, row_number() OVER (PARTITION BY a.project_id ORDER BY a.audit_id) AS i FROM {A} a JOIN {U} u USING (project_id)),
f AS (SELECT project_id, audit_id, i, n <= 0 OR n <= l AS granted, CASE WHEN n > 0 AND n <= l THEN n ELSE 0 END AS used FROM r WHERE i = 1 UNION ALL
SELECT r.project_id, r.audit_id, r.i, r.n <= 0 OR f.used + r.n <= r.l, CASE WHEN r.n > 0 AND f.used + r.n <= r.l THEN f.used + r.n ELSE f.used END FROM f JOIN r ON r.project_id = f.project_id AND r.i = f.i + 1)
SELECT project_id, audit_id, granted, used FROM f""")
def state_sequence_fold(s, d):
    a = _audits(s, d).join(_used(_projects(s, d)).select("project_id", "credit_limit"), "project_id").select("project_id", "audit_id", (F.col("audit_id") % 5).alias("n"), F.col("credit_limit").cast("long").alias("credit_limit"))
    return ch.consume_in_order(a, "project_id", "audit_id", "n", "credit_limit")


@query("SELECT o_orderpriority, COUNT(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct FROM orders GROUP BY 1")
def label_share(s, d):
    own = load(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT c_custkey, 'dev-' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS identity FROM (SELECT c_custkey, sha1(unhex('6f1a1a4e5f9e4a2c9d1b2f0f0f2c9d10') || encode(lower(trim(c_name)))) AS h FROM customer)")
def identity_uuid(s, d):
    from folioscope.operators.accounts import local_identity

    return load(s, d, "customer").select("c_custkey", local_identity(F.col("c_name")).alias("identity"))


@query(f"SELECT c.project_id AS subject, CASE WHEN u.project_id IS NULL THEN 'provisioned' WHEN u.project_id % 5 <> 0 THEN 'known' ELSE 'refused' END AS outcome FROM {P} c LEFT JOIN (SELECT project_id FROM {P} WHERE project_id % 2 = 0) u USING (project_id)")
def identity_resolve(s, d):
    from folioscope.operators.accounts import resolve

    p = _projects(s, d).select(F.col("project_id").alias("subject"), F.col("name").alias("email"))
    users = p.where("subject % 2 = 0").withColumn("is_active", F.col("subject") % 5 != 0)
    return resolve(p.union(p), users).select("subject", "outcome")


@query(f"SELECT project_id, plan, CAST(CASE plan WHEN 'pro' THEN 200 WHEN 'agency' THEN 1000 WHEN 'enterprise' THEN 100000 ELSE 10 END AS BIGINT) AS credit_limit FROM (SELECT project_id, CASE WHEN project_id % 4 = 0 THEN 'enterprise' WHEN project_id % 4 = 1 THEN 'unknown' ELSE plan END AS plan FROM {U})")
def plan_change(s, d):
    from folioscope.operators.accounts import change_plan

    u = _used(_projects(s, d)).select("project_id", "plan", "credit_limit")
    new = u.where("project_id % 4 < 2").select("project_id", F.when(F.col("project_id") % 4 == 0, "enterprise").otherwise("unknown").alias("plan"))
    return change_plan(u, new, "project_id").select("project_id", "plan", F.col("credit_limit").cast("long").alias("credit_limit"))


@query("SELECT event_id, CAST(user_id % 600 AS BIGINT) AS status, round(value * 1000, 2) AS duration_ms, CASE WHEN user_id % 600 >= 500 THEN 'warning' ELSE 'info' END AS level FROM events WHERE event_type <> 'view'")
def request_log(s, d):
    from folioscope.operators.accounts import request_log as log

    e = load(s, d, "events")
    path = F.when(F.col("event_type") == "view", "/health").otherwise(F.concat(F.lit("/"), "event_type"))
    logged = log(e.select(path.alias("path"), (F.col("user_id") % 600).alias("status"), F.col("value").alias("seconds"), F.col("event_id").cast("string").alias("client"), "props").withColumnRenamed("props", "agent"))
    return logged.select(F.col("client").cast("long").alias("event_id"), "status", "duration_ms", "level")


@query("SELECT origin, created, CASE WHEN created THEN regexp_replace(origin, '^[a-z]+://', '') END AS name FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*') NOT IN (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') FROM pages WHERE page_id % 5 = 0) AS created FROM pages)")
def project_get_or_create(s, d):
    """A project for each page's site; a new one is named by its host."""
    from folioscope.functions.urls import host, origin
    from folioscope.operators.accounts import get_or_create

    p = load(s, d, "pages").select("page_id", origin(F.col("url")).alias("origin"))
    return get_or_create(p, p.where("page_id % 5 = 0"), ["origin"], name=host(F.col("origin")))


@query()
def ingest_documents(s, d):
    from folioscope.operators import ingest

    docs = load(s, d, "documents")
    chunks = ingest.chunk_rows(docs, "doc_id", "text")
    return ingest.counts(ingest.attach(chunks, ingest.vectors_of(ingest.pending(chunks))), "doc_id")


@query()
def reingest_documents(s, d):
    from folioscope.operators import ingest

    docs = load(s, d, "documents")
    chunks = ingest.chunk_rows(docs, "doc_id", "text")
    return ingest.counts(ingest.reingest(chunks, ingest.chunk_rows(docs.where("doc_id % 10 = 0"), "doc_id", "text"), "doc_id"), "doc_id")


@query(f"""WITH j AS (SELECT audit_id, string_agg(job_id::VARCHAR, ',' ORDER BY r) AS jobs FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY updated DESC, job_id) AS r FROM {J}) WHERE r <= 20 GROUP BY audit_id),
c AS (SELECT l_orderkey AS audit_id, COUNT(*) AS n, COUNT(*) FILTER (l_returnflag = 'N') AS e FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT a.audit_id, a.status, coalesce(j.jobs, '') AS jobs, coalesce(c.n, 0) AS chunk_count, coalesce(c.e, 0) AS embedded_chunk_count FROM {A} a LEFT JOIN j USING (audit_id) LEFT JOIN c USING (audit_id)""")
def audit_detail(s, d):
    """Audits with their newest jobs and two counts; the larger lineitems stand for chunks."""
    chunks = load(s, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("audit_id"), "l_returnflag")
    made = ch.detail(_audits(s, d).select("audit_id", "status"), "audit_id", _jobs(s, d), "job_id", "updated", chunks, F.col("l_returnflag") == "N")
    return made.withColumn("jobs", F.array_join(F.col("jobs").cast("array<string>"), ","))


@query(f"SELECT job_id, CASE WHEN retries % 6 < 3 THEN 'pending' ELSE 'failed' END AS status, retries % 6 < 3 AS again, CASE WHEN audit_id % 3 = 0 THEN 'false' END AS robots_allowed FROM {J}")
def failure_outcome(s, d):
    kind = F.when(F.col("audit_id") % 3 == 0, "robots").otherwise("timeout")
    made = _jobs(s, d).select("job_id", ch.failure(kind, F.col("retries") % 6).alias("f"))
    return made.select("job_id", "f.status", "f.again", F.col("f.robots_allowed").cast("string").alias("robots_allowed"))


@query(f"SELECT job_id, coalesce(left(CASE WHEN retries % 3 = 0 THEN repeat('error ', retries * 20) END, 2000), CASE WHEN retries % 2 = 0 THEN 'old' END) AS error FROM {J}")
def error_texts(s, d):
    n = F.col("retries")
    new = F.when(n % 3 == 0, F.repeat(F.lit("error "), (n * 20).cast("int")))
    return _jobs(s, d).select("job_id", ch.error_after(F.when(n % 2 == 0, "failed").otherwise("running"), new, F.lit("old")).alias("error"))


_ATTEMPTS = f"""(SELECT audit_id AS page, t.* FROM {A}, (VALUES ('primary', 2, 3, 5), ('http', 3, 4, 7), ('browser', 5, 1000000007, 11)) v(transport, a, b, c), LATERAL (SELECT transport, audit_id % a <> 0 AS ok, audit_id % b = 0 AS is_spa, CASE WHEN audit_id % c = 0 THEN '/' || transport || '.xml' END AS sitemap, audit_id % 13 <> 0 AS robots_allowed, CASE WHEN audit_id % 2 = 1 THEN '/robots.xml' END AS robots_sitemap) t)"""


@query(f"""WITH g AS (SELECT * FROM {_ATTEMPTS} WHERE ok AND robots_allowed), f AS (SELECT *, transport = first(transport) OVER w AS is_first, first(is_spa) OVER w AS shell, first(transport) OVER w AS t1, max(transport = 'browser') OVER (PARTITION BY page) AS has_browser FROM g WINDOW w AS (PARTITION BY page ORDER BY CASE transport WHEN 'primary' THEN 1 WHEN 'http' THEN 2 ELSE 3 END))
SELECT page, transport, shell AND t1 <> 'browser' AS is_spa, coalesce(sitemap, robots_sitemap) AS sitemap, shell AND t1 <> 'browser' AND has_browser AS fallback_used FROM f WHERE CASE WHEN shell AND t1 <> 'browser' AND has_browser THEN transport = 'browser' ELSE is_first END""")
def fetch_policy(s, d):
    """Audits as pages with three attempts each, good or not by rule."""
    from folioscope.sources.tables import choose_fetch

    a, made = F.col("page"), None
    for transport, m, spa, site in (("primary", 2, 3, 5), ("http", 3, 4, 7), ("browser", 5, 1_000_000_007, 11)):
        own = _audits(s, d).select(F.col("audit_id").alias("page")).select("page", F.lit(transport).alias("transport"), (a % m != 0).alias("ok"), (a % spa == 0).alias("is_spa"), F.when(a % site == 0, f"/{transport}.xml").alias("sitemap"), (a % 13 != 0).alias("robots_allowed"), F.when(a % 2 == 1, "/robots.xml").alias("robots_sitemap"))
        made = own if made is None else made.union(own)
    return choose_fetch(made, "page").select("page", "transport", "is_spa", "sitemap", "fallback_used")


@query("SELECT page_id FROM pages WHERE page_id % 7 < 5 AND page_id % 3 <> 0 AND strlen(html) <= 5000")
def fetch_accepted(s, d):
    from folioscope.conf import EngineConf
    from folioscope.sources.tables import accepted

    status = F.when(F.col("page_id") % 7 < 5, 200).otherwise(404)
    kind = F.when(F.col("page_id") % 3 != 0, "text/html; charset=utf-8").otherwise("image/png")
    return accepted(load(s, d, "pages").select("page_id", "html", status.alias("status"), kind.alias("content_type")), EngineConf(max_page_bytes=5000)).select("page_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'robots_disallowed' WHEN 'view' THEN 'timeout' WHEN 'search' THEN 'response_too_large' ELSE 'fetch_error' END AS name FROM events")
def error_names(s, d):
    from folioscope.functions.text import error_name

    kind = F.when(F.col("event_type") == "click", "robots").when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "search", "too_large").otherwise("other")
    return load(s, d, "events").select("event_id", error_name(kind).alias("name"))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(text, '. ', repeat(chr(10), 4)), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def text_limit_newlines(s, d):
    from folioscope.functions.text import limit_newlines

    return load(s, d, "documents").select("doc_id", F.sha2(limit_newlines(F.replace(F.col("text"), F.lit(". "), F.lit("\n\n\n\n"))), 256).alias("digest"))
