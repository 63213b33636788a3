"""Queries over stored layouts, stateful streams and queues, networks and suffixes, table functions and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import networks as nw
from folioscope.functions import register as rg
from folioscope.functions import suffixes as sx
from folioscope.functions import urls as ux
from folioscope.operators import changes as ch
from folioscope.operators import relational as rel
from folioscope.plans import tenant as tn
from folioscope.plans.corpus import _HOST, _WILSON
from folioscope.sources.layout import bucketed
from folioscope.sources.tables import load, shared_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- tables stored by key ----------------------------------------------------


def _by_audit(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Audits, jobs and chunks in buckets of their audit."""
    chunks = load(s, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("audit_id"), "l_returnflag")
    return bucketed(tn._audits(s, d), "audits", "audit_id"), bucketed(tn._jobs(s, d), "jobs", "audit_id"), bucketed(chunks, "chunks", "audit_id")


@query(tn.ORACLE["join_owner_three_way"])
def bucketed_owner_three_way(s, d):
    audits, jobs, _ = _by_audit(s, d)
    projects = rel.equal_where(tn._projects(s, d), user_id=3)
    return jobs.select("job_id", "status", "audit_id").join(audits.select("audit_id", "project_id"), "audit_id").join(projects, "project_id").select("job_id", "status", "user_id")


@query(tn.ORACLE["audit_detail"])
def bucketed_audit_detail(s, d):
    audits, jobs, chunks = _by_audit(s, d)
    made = ch.detail(audits.select("audit_id", "status"), "audit_id", jobs, "job_id", "updated", chunks, F.col("l_returnflag") == "N")
    return made.withColumn("jobs", F.array_join(F.col("jobs").cast("array<string>"), ","))


@query(f"SELECT a.audit_id, coalesce(n, 0) AS n_jobs, coalesce(running, 0) AS n_running, newest FROM {tn.A} a LEFT JOIN (SELECT audit_id, COUNT(*) AS n, COUNT(*) FILTER (status = 'running') AS running, max(updated) AS newest FROM {tn.J} GROUP BY audit_id) j USING (audit_id)")
def bucketed_child_stats(s, d):
    """Audits with the counts of their jobs, each table grouped and joined where it lies."""
    audits, jobs, _ = _by_audit(s, d)
    out = rel.child_stats(audits.select("audit_id"), "audit_id", {"jobs": (jobs, "audit_id", [F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("status") == "running").alias("n_running"), F.max("updated").alias("newest")])})
    return out.select("audit_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_jobs", "n_running")], "newest")


@query(f"SELECT project_id, name FROM {tn.P} p WHERE NOT EXISTS (SELECT 1 FROM {tn.A} a WHERE a.project_id = p.project_id AND a.priority = '1-URGENT' AND a.status = 'completed') ORDER BY project_id LIMIT 500")
def orphans_of_one_pass(s, d):
    """What a bounded pass removes first."""
    urgent = tn._audits(s, d).where("priority = '1-URGENT' and status = 'completed'")
    return rel.orphan_pass(tn._projects(s, d), urgent, "project_id", "project_id", "project_id", most=500).select("project_id", "name")


@query(f"SELECT project_id FROM {tn.P} p WHERE EXISTS (SELECT 1 FROM {tn.A} a WHERE a.project_id = p.project_id AND a.priority = '1-URGENT' AND a.status = 'completed')")
def orphans_of_all_passes(s, d):
    """What stays once passes find nothing more."""
    urgent = tn._audits(s, d).where("priority = '1-URGENT' and status = 'completed'")

    def store(frame: DataFrame, n: int) -> DataFrame:
        path = shared_path(s, f"pass{n}")
        frame.write.parquet(path)
        return s.read.schema(frame.schema).parquet(path)

    projects = tn._projects(s, d).select("project_id")
    most = -(-projects.count() // 4)
    return rel.without_orphans(projects, urgent, "project_id", "project_id", "project_id", store, most=most)[0]


# --- networks and suffixes ---------------------------------------------------

#: Networks that addresses are looked up in, some inside others, of both kinds.
NETWORKS = (*ux.BLOCKED, "10.1.0.0/16", "10.1.128.0/17", "192.168.7.0/24", "fe80:1::/32", "fc00:1:2::/47", "fd00::/9", "::ffff:0:0/96", "2001:db8::/33")
ALLOWED = ("10.1.128.0/17", "fd00::/9")
#: How the two kinds of addresses begin, so that many lie in some network.
_FOUR, _SIX = ("10", "192", "172", "224", "8"), ("fe80:1", "fc00:1", "fd7f:2", "2001:db8", "0:0")
_ADDRESSES_SQL = f"""(SELECT event_id, CASE WHEN event_id % 2 = 0 THEN f[event_id // 2 % 5 + 1] || '.' || CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '168' ELSE b1 END || '.' || b2 || '.' || b3 ELSE x[event_id // 2 % 5 + 1] || '::' || substr(h, 1, 4) || ':' || substr(h, 5, 3) END AS address,
CASE WHEN event_id % 2 = 0 THEN 281470681743360::UHUGEINT + ((f[event_id // 2 % 5 + 1]::UHUGEINT * 256 + CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 168 ELSE b1::UHUGEINT END) * 256 + b2::UHUGEINT) * 256 + b3::UHUGEINT
ELSE v[event_id // 2 % 5 + 1] * 79228162514264337593543950336::UHUGEINT + ('0x' || substr(h, 1, 4))::UBIGINT::UHUGEINT * 65536 + ('0x' || substr(h, 5, 3))::UBIGINT::UHUGEINT END AS n, event_id % 2 = 0 AS four
FROM (SELECT event_id, md5(event_id::VARCHAR) AS h, ['10', '192', '172', '224', '8'] AS f, ['fe80:1', 'fc00:1', 'fd7f:2', '2001:db8', '0:0'] AS x, [4269801473::UHUGEINT, 4227858433::UHUGEINT, 4252958722::UHUGEINT, 536939960::UHUGEINT, 0::UHUGEINT] AS v,
('0x' || substr(md5(event_id::VARCHAR), 9, 2))::INT::VARCHAR AS b1, ('0x' || substr(md5(event_id::VARCHAR), 11, 2))::INT::VARCHAR AS b2, ('0x' || substr(md5(event_id::VARCHAR), 13, 2))::INT::VARCHAR AS b3 FROM events))"""


def _addresses(s, d) -> DataFrame:
    h, at = F.md5(F.col("event_id").cast("string")), (F.floor(F.col("event_id") / 2) % 5 + 1).cast("int")
    byte = lambda i: F.conv(F.substring(h, i, 2), 16, 10)
    second = F.when(F.col("event_id") % 3 == 0, "1").when(F.col("event_id") % 3 == 1, "168").otherwise(byte(9))
    four = F.concat_ws(".", F.element_at(F.array(*[F.lit(x) for x in _FOUR]), at), second, byte(11), byte(13))
    six = F.concat(F.element_at(F.array(*[F.lit(x) for x in _SIX]), at), F.lit("::"), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 3))
    return load(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, four).otherwise(six).alias("address"))


def _bounds_sql(nets: tuple[str, ...]) -> str:
    """Rows (cidr, four, bits, low, high) of networks, as numbers of 128 bits."""
    import ipaddress

    rows = []
    for text in nets:
        net = ipaddress.ip_network(text)
        base = 0xFFFF << 32 if net.version == 4 else 0
        four = net.version == 4 or int(net.network_address) >> 32 == 0xFFFF and net.prefixlen >= 96
        rows.append(f"('{text}', {str(four).lower()}, {net.prefixlen + (96 if net.version == 4 else 0)}, {int(net.network_address) + base}::UHUGEINT, {int(net.broadcast_address) + base}::UHUGEINT)")
    return f"(VALUES {', '.join(rows)}) AS t(cidr, four, bits, low, high)"


@query(f"SELECT event_id, address, arg_max(cidr, bits) AS network FROM {_ADDRESSES_SQL} a LEFT JOIN {_bounds_sql(tuple(n for n in NETWORKS if n != '::ffff:0:0/96'))} ON n BETWEEN low AND high AND a.four = t.four GROUP BY event_id, address")
def network_longest_match(s, d):
    """The narrowest network of each address."""
    nets = s.createDataFrame([(n,) for n in NETWORKS if n != "::ffff:0:0/96"], "cidr string")
    return nw.longest_match(_addresses(s, d), "address", nets, "cidr").select("event_id", "address", "network")


@query(f"SELECT event_id, address, EXISTS (SELECT 1 FROM {_bounds_sql(ux.BLOCKED)} WHERE n BETWEEN low AND high AND t.four = a.four) AND NOT EXISTS (SELECT 1 FROM {_bounds_sql(ALLOWED)} WHERE n BETWEEN low AND high AND t.four = a.four) AS blocked FROM {_ADDRESSES_SQL} a")
def network_blocked(s, d):
    """Blocked networks, but for those that are allowed."""
    return _addresses(s, d).withColumn("blocked", nw.blocked(F.col("address"), ux.BLOCKED, ALLOWED))


#: Rules as a published list has them, private ones among them; the hosts of pages get ends that they bear on.
SUFFIX_RULES = ("com", "org", "uk", "co.uk", "ck", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "github.io", "example")
_ENDS = ("co.uk", "ck", "www.ck", "a.kobe.jp", "city.kobe.jp", "github.io", "x.unknown", "com")
_HARD_SQL = f"(SELECT page_id, h || '.' || e[page_id % {len(_ENDS)} + 1] AS host FROM (SELECT page_id, {_HOST} AS h, {list(_ENDS)} AS e FROM pages))"


@query(f"""WITH h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM {_HARD_SQL}), r AS (SELECT unnest({list(SUFFIX_RULES)}) AS rule),
e AS (SELECT host, l, array_to_string(l[i:], '.') AS ending, array_to_string(list_concat(['*'], l[i + 1:]), '.') AS wild, len(l) - i + 1 AS n FROM h, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
b AS (SELECT host, l, coalesce(max(n - 1) FILTER ('!' || ending IN (FROM r)), max(n) FILTER (ending IN (FROM r) OR wild IN (FROM r)), 1) AS held FROM e GROUP BY ALL)
SELECT page_id, host, array_to_string(CASE WHEN held < len(l) THEN l[len(l) - held:] ELSE l[len(l) - 1:] END, '.') AS site FROM {_HARD_SQL} JOIN b USING (host)""")
def suffix_sites(s, d):
    """The registered name of each page's host, moved below hard suffixes."""
    ends = F.array(*[F.lit(e) for e in _ENDS])
    hosts = load(s, d, "pages").select("page_id", F.concat_ws(".", ux.host(F.col("url")), F.element_at(ends, (F.col("page_id") % len(_ENDS) + 1).cast("int"))).alias("host"))
    return sx.registrable_hosts(hosts, "host", s.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string"))


# --- table functions and aggregates ------------------------------------------


@query("SELECT CAST(place AS INT) AS place, o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def table_first_rows(s, d):
    """A table function over partitions of any table, called from SQL."""
    rg.register(s)
    load(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").createOrReplaceTempView("first_rows_input")
    return s.sql("SELECT place, o_custkey, o_orderkey, o_orderdate FROM first_rows(TABLE(SELECT * FROM first_rows_input) PARTITION BY (o_custkey) ORDER BY (o_orderdate DESC, o_orderkey), 3)")


@query(f"SELECT user_id, engine, low FROM (SELECT user_id, engine, {_WILSON} FROM (SELECT user_id, event_type AS engine, COUNT(*) AS runs, COUNT(*) FILTER (value > 50) AS hits FROM events GROUP BY ALL))")
def aggregate_wilson(s, d):
    """A registered Arrow aggregate, called from SQL."""
    rg.register(s)
    load(s, d, "events").createOrReplaceTempView("wilson_input")
    return s.sql("SELECT user_id, event_type AS engine, round(wilson_low(value > 50), 6) AS low FROM wilson_input GROUP BY user_id, event_type")


# --- stateful streams --------------------------------------------------------

_LATE = "3650 days"
_END = "2100-01-01 00:00:00"


def _shuffled(s, d, files: int, at: str = "ts"):
    """events in so many files in no order, the message that ends the stream last, as a stream."""
    from folioscope.streaming import queue, stateful

    base = shared_path(s, "stream")
    events = load(s, d, "events").withColumn(at, F.date_trunc("second", F.col(at).cast("timestamp")))
    events.repartition(files, F.xxhash64("event_id")).write.parquet(f"{base}/in")
    stateful.closing(s, events.schema, at, _END, user_id=-1, event_id=-1).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return base, queue.jobs_stream(s, f"{base}/in", events.schema)


def _worked_off(s, base: str, made: DataFrame, mode: str = "append") -> DataFrame:
    from folioscope.streaming import queue

    queue.run_available(made, f"{base}/out", f"{base}/state", mode)
    return s.read.schema(made.schema).parquet(f"{base}/out")


def _limiter_sql() -> str:
    from folioscope.plans.corpus import ORACLE as C

    return f"SELECT user_id, CAST(\"at\" * 1000000 AS BIGINT) AS \"at\", event_id, allowed, remaining FROM ({C['limiter_sliding']})"


@query(_limiter_sql())
def stream_limiter(s, d, files: int = 3):
    """Sliding-log admission of a stream whose files come in no order."""
    from folioscope.streaming import stateful

    base, events = _shuffled(s, d, files)
    made = stateful.limit_in_order(events, "user_id", "ts", "event_id", 3, 86_400, _LATE).withColumnRenamed("tie", "event_id")
    return _worked_off(s, base, made).where("user_id >= 0")


@query("""SELECT user_id, s * 1000000 AS last_seen FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS s, lead(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) WHERE next IS NULL OR next - s >= 43200""")
def stream_silence(s, d, files: int = 3):
    """Each time that a user was silent for twelve hours or more, told by a timer."""
    from folioscope.streaming import stateful

    base, events = _shuffled(s, d, files)
    return _worked_off(s, base, stateful.silent(events, "user_id", "ts", 43_200, _LATE)).where("user_id >= 0")


def _fails(job: int, attempt: int) -> bool:
    """Every job's number says how often it fails before it succeeds: up to four times, and three end it."""
    return attempt > job % 5


@query("""SELECT event_id, CAST(n AS INT) AS attempt, CAST((floor(epoch(ts)) + CASE n WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 6 END) * 1000000 AS BIGINT) AS "at", CASE WHEN n > event_id % 5 THEN 'completed' WHEN n = 3 THEN 'dead' ELSE 'retry' END AS outcome
FROM events, range(1, 4) AS r(n) WHERE n <= least(event_id % 5 + 1, 3)""")
def stream_retry(s, d, files: int = 3):
    """Failing jobs are tried again when their back-off has passed, and are dead after three failures."""
    from folioscope.streaming import stateful

    base, events = _shuffled(s, d, files)
    return _worked_off(s, base, stateful.with_retries(events, "event_id", "ts", _fails, _LATE)).where("event_id >= 0")


@query("SELECT event_id, user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'crawl' ELSE 'analysis' END AS queue FROM events")
def stream_routed_queues(s, d):
    """Messages of two queues, published in three turns and worked off with late acknowledgement."""
    from folioscope.sources import queues

    base = shared_path(s, "queues")
    events = load(s, d, "events").select("event_id", "user_id", "event_type")
    route = F.when(F.col("event_type").isin("purchase", "signup"), "crawl").otherwise("analysis")
    for turn in range(3):
        queues.publish(events.where(F.col("event_id") % 3 == turn), f"{base}/q", route, ["crawl", "analysis"])
    made = queues.consume(s, f"{base}/q", ["crawl", "analysis"], "event_id long, user_id long")
    return _worked_off(s, base, made)


# --- keys that are created once ----------------------------------------------


@query("""SELECT origin, CASE WHEN min(page_id % 2) = 0 THEN 'first' ELSE 'second' END AS writer, min(page_id % 2) <> 0 AS created FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0) GROUP BY origin HAVING bool_or(page_id % 3 = 0)""")
def project_create_race(s, d):
    """Two writers create projects for pages' sites; the second has read before the first wrote, loses the race and reads again."""
    from folioscope.sources.keyed import KeyedTable

    table = KeyedTable(s, shared_path(s, "projects"), "origin string, writer string", ["origin"])
    pages = load(s, d, "pages").select("page_id", ux.origin(F.col("url")).alias("origin"))

    def other(attempt: int) -> None:
        if attempt == 0:
            table.get_or_create(pages.where("page_id % 2 = 0"), writer=F.lit("first"))

    return table.get_or_create(pages.where("page_id % 3 = 0"), other, writer=F.lit("second"))
