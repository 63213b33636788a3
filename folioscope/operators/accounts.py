"""Identities, plans, profiles and the request log, as functions over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.conf import PLAN_LIMITS
from folioscope.operators.changes import patch

# Fixed value: the namespace of local identities.
NAMESPACE = "6f1a1a4e5f9e4a2c9d1b2f0f0f2c9d10"
#: Longest agent text in the log, and paths that it leaves out.
AGENT_CHARS, QUIET_PATHS = 120, ("/health", "/ready", "/live")


def name_uuid(name: Column, namespace: str = NAMESPACE) -> Column:
    """UUID version 5 of a name, in hex digits with dashes."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def local_identity(email: Column) -> Column:
    return F.concat(F.lit("dev-"), name_uuid(F.lower(F.trim(email))))


def resolve(claims: DataFrame, users: DataFrame) -> DataFrame:
    """claims (subject, email) with outcome: known, refused (not active) or provisioned, and the e-mail that the user then has.

    A claim of an unknown subject makes a free account; repeated claims of one
    subject make one.
    """
    once = claims.groupBy("subject").agg(F.min(F.lower("email")).alias("email"))
    known = users.select("subject", F.col("email").alias("old"), "is_active", F.lit(True).alias("there"))
    out = once.join(known, "subject", "left")
    outcome = F.when(F.col("there").isNull(), "provisioned").when(F.coalesce(F.col("is_active"), F.lit(False)), "known").otherwise("refused")
    email = F.when(F.col("is_active") | F.col("there").isNull(), F.coalesce("email", "old", F.concat("subject", F.lit("@users.noreply.local")))).otherwise(F.col("old"))
    return out.select("subject", outcome.alias("outcome"), email.alias("email"), F.when(F.col("there").isNull(), "free").alias("new_plan"))


def change_plan(users: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Users with the plans of changes (key, plan) and the limits that go with them; an unknown plan counts as free."""
    limits = F.create_map(*[F.lit(x) for kv in PLAN_LIMITS.items() for x in kv])
    known = F.coalesce(limits[F.col("plan")], F.lit(PLAN_LIMITS["free"]))
    return patch(users, changes.withColumn("credit_limit", known), key)


def request_log(requests: DataFrame) -> DataFrame:
    """Rows (path, status, seconds, client, agent) as they are logged: milliseconds to two places, short agents, level by status."""
    shown = requests.where(~F.col("path").isin(*QUIET_PATHS))
    return shown.select("path", "status", F.round(F.col("seconds") * 1000, 2).alias("duration_ms"), "client", F.substring("agent", 1, AGENT_CHARS).alias("agent"), F.when(F.col("status") >= 500, "warning").otherwise("info").alias("level"))


def get_or_create(wanted: DataFrame, old: DataFrame, keys: list[str], **defaults: Column) -> DataFrame:
    """Each wanted key once, with whether its row is there already or new; new ones get the defaults, columns over the keys."""
    there = old.select(*keys).distinct().withColumn("_there", F.lit(True))
    return wanted.select(*keys).distinct().join(there, keys, "left").select(*keys, F.col("_there").isNull().alias("created"), *[F.when(F.col("_there").isNull(), c).alias(n) for n, c in defaults.items()])
