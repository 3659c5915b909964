"""Permission rules: matching, specificity, resolution by bit, and grants that end."""

from __future__ import annotations

import re
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.names import spare
from lorespark.operators.automata import Globs

# Permission bits, and what ranks of rules mean.
BITS = {"READ": 1, "WRITE": 2, "DELETE": 4, "CREATE": 8}
ALL = 15
INLINE_PRIORITY, GRANT_PRIORITY = 200, 250
#: Globs that a task holds at once.
MOST_GLOBS = 200_000
RULES = "rule_id long, pattern string, perms int, deny boolean, priority int, roles array<string>, users array<string>"


def permissions(names: list[str]) -> int:
    """Bits of permission names; an unknown name is an error."""
    unknown = [n for n in names if n.upper() not in (*BITS, "ALL")]
    if unknown:
        raise ValueError(f"unknown permission: {unknown[0]}")
    return reduce(lambda a, n: a | (ALL if n.upper() == "ALL" else BITS[n.upper()]), names, 0)


def permission_bits(names: Column) -> Column:
    """The same over a column of arrays of names."""
    table = F.create_map(*(F.lit(x) for pair in {**BITS, "ALL": ALL}.items() for x in pair))
    one = lambda n: F.coalesce(F.element_at(table, F.upper(n)), F.raise_error(F.concat(F.lit("unknown permission: "), n)).cast("int"))
    return F.aggregate(names, F.lit(0), lambda a, n: a.bitwiseOR(one(n)))


def rule(rule_id: int, pattern: str = "**/*", allow: list[str] | None = None, deny: list[str] | None = None, priority: int = 0, roles: list[str] = (), users: list[str] = ()) -> tuple:
    """A row of RULES that allows or denies."""
    return rule_id, pattern, permissions(deny or allow or []), deny is not None, priority, list(roles), list(users)


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def is_exact(pattern: Column) -> Column:
    """Whether a pattern has no sign of a glob."""
    return ~pattern.rlike(r"[*?\[]")


def specificity(pattern: Column) -> Column:
    """1000 and ten for each slash of an exact path, else ten for each slash less ten for each star and each pair of stars."""
    count = lambda s: F.floor((F.length(pattern) - F.length(F.replace(pattern, F.lit(s), F.lit("")))) / len(s)).cast("int")
    return F.when(is_exact(pattern), 1000 + 10 * count("/")).otherwise(10 * count("/") - 10 * count("*") - 10 * count("**"))


def roles_of(policy: DataFrame) -> DataFrame:
    """``user``, ``role`` of a table of roles with arrays of users."""
    return policy.select("role", F.explode("users").alias("user")).select("user", "role").distinct()


def _fits(shared):
    """Numbers of the globs that each path fits, as the standard library's ``fnmatch`` reads them."""

    def run(batches):
        for batch in batches:
            found = [shared.value.fits(p) for p in batch.column("normal").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.list_(pa.int64()))], ["path", "fits"])

    return run


def matched(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``path`` and ``pattern`` of every distinct path and pattern that fit, whatever the case and the kind of slash.

    Patterns without a sign of a glob, of which notes and grants give many, are joined by
    equality.  Globs are a policy: an automaton of their plain parts walks each distinct
    path once and names the few that are tried on it.  More than ``MOST_GLOBS`` are taken in
    blocks.
    """
    asked = paths.select("path").distinct().where("path is not null").withColumn("normal", normal_path(F.col("path")))
    given = rules.select("pattern").distinct().where("pattern is not null")
    exact = given.where(is_exact(F.col("pattern"))).withColumn("normal", F.lower("pattern"))
    parts = [asked.join(exact, "normal").select("path", "pattern")]
    stream = given.where(~is_exact(F.col("pattern"))).toLocalIterator()
    for block in iter(lambda: [r.pattern for r in islice(stream, MOST_GLOBS)], []):
        names = paths.sparkSession.createDataFrame(list(enumerate(block)), "fit long, pattern string")
        shared = paths.sparkSession.sparkContext.broadcast(Globs([g.lower() for g in block]))
        fits = asked.mapInArrow(_fits(shared), "path string, fits array<long>").select("path", F.explode("fits").alias("fit"))
        parts.append(fits.join(names, "fit").select("path", "pattern"))
    return reduce(DataFrame.union, parts)


def resolve(checks: DataFrame, rules: DataFrame, user_roles: DataFrame, default_deny: bool = True) -> DataFrame:
    """``allowed`` bits of every distinct (``user``, ``path``).

    For each bit the rule with the highest priority, then specificity, then denial, then
    smallest id decides; without a rule the default does.  A null path fits no rule.
    """
    asked = checks.select("user", "path").distinct()
    roles = user_roles.groupBy("user").agg(F.collect_set("role").alias("own"))
    told = rules.select("rule_id", "pattern", "perms", "deny", "priority", "roles", "users", specificity(F.col("pattern")).alias("spec"))
    near = asked.join(matched(asked, rules), "path").join(roles, "user", "left").join(told, "pattern")
    mine = F.arrays_overlap(F.coalesce("own", F.array().cast("array<string>")), "roles") | F.array_contains("users", F.col("user"))
    each = near.where(mine).withColumn("bit", F.explode(F.array(*(F.lit(b) for b in BITS.values())))).where(F.col("perms").bitwiseAND(F.col("bit")) != 0)
    rank = F.struct("priority", "spec", "deny", (-F.col("rule_id")).alias("n"))
    won = each.groupBy("user", "path", "bit").agg(F.max_by("deny", rank).alias("deny"))
    told_bits = won.groupBy("user", "path").agg(F.bit_or("bit").alias("told"), F.bit_or(F.when(F.col("deny"), 0).otherwise(F.col("bit"))).alias("given"))
    otherwise = F.lit(0 if default_deny else ALL)
    told_, given = F.coalesce("told", F.lit(0)), F.coalesce("given", F.lit(0))
    joined = asked.join(told_bits.withColumnsRenamed({"user": "u", "path": "p"}), F.col("user").eqNullSafe(F.col("u")) & F.col("path").eqNullSafe(F.col("p")), "left")
    return joined.select("user", "path", given.bitwiseOR(otherwise.bitwiseAND(F.bitwise_not(told_))).alias("allowed"))


def can(checks: DataFrame, rules: DataFrame, user_roles: DataFrame, default_deny: bool = True) -> DataFrame:
    """``checks`` (``user``, ``path``, ``perms``) with ``granted``: whether all bits are allowed."""
    (allowed,) = spare(checks.columns, "allowed")
    found = resolve(checks, rules, user_roles, default_deny).withColumnRenamed("allowed", allowed)
    return checks.join(found, ["user", "path"]).withColumn("granted", F.col(allowed).bitwiseAND(F.col("perms")) == F.col("perms")).drop(allowed)


def accessible(paths: DataFrame, user: str, rules: DataFrame, user_roles: DataFrame, bit: str = "READ") -> DataFrame:
    """Paths on which the user has the permission."""
    found = resolve(paths.select(F.lit(user).alias("user"), "path"), rules, user_roles)
    return paths.join(found.where(F.col("allowed").bitwiseAND(F.lit(BITS[bit])) != 0).select("path"), "path", "left_semi")


def inline_rules(notes: DataFrame, first_id: int = 1_000_000) -> DataFrame:
    """Rules of notes for their own exact path (``path``, ``perms``, ``deny``, ``users``, ``roles``), above those of the policy."""
    number = F.pmod(F.xxhash64("path", "perms", "deny"), F.lit(1 << 40)) + first_id
    return notes.select(number.alias("rule_id"), normal_path(F.col("path")).alias("pattern"), "perms", "deny", F.lit(INLINE_PRIORITY).alias("priority"), "roles", "users")


def expires_at(kind: Column, start: Column, ttl_minutes: Column) -> Column:
    """End of a temporary grant with a time to live; others have none."""
    return F.when((kind == "TEMPORARY") & ttl_minutes.isNotNull(), start + F.make_dt_interval(mins=ttl_minutes.cast("int")))


def grant_states(log: DataFrame) -> DataFrame:
    """State of each request from its events (``request_id``, ``event``, ``actor``, ``ts``, and the request's columns).

    Only the owner approves, denies or revokes; the first of an approval and a denial
    counts, and a revocation after an approval.
    """
    asked = log.where("event = 'request'").groupBy("request_id").agg(F.min_by(F.struct("requester", "owner", "path", "perms", "kind", "ttl_minutes"), "ts").alias("r"), F.min("ts").alias("requested_at"))
    acted = log.where("event <> 'request'").join(asked.select("request_id", F.col("r.owner").alias("_owner"), "requested_at"), "request_id").where("actor = _owner and ts >= requested_at")
    decided = acted.where("event in ('approve', 'deny')").groupBy("request_id").agg(F.min_by("event", F.struct("ts", "event")).alias("decision"), F.min("ts").alias("decided_at"))
    revoked = acted.where("event = 'revoke'").join(decided, "request_id").where("decision = 'approve' and ts >= decided_at").groupBy("request_id").agg(F.min("ts").alias("revoked_at"))
    whole = asked.join(decided, "request_id", "left").join(revoked, "request_id", "left")
    status = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("decision") == "approve", "approved").when(F.col("decision") == "deny", "denied").otherwise("pending")
    return whole.select("request_id", "r.*", status.alias("status"), "requested_at", "decided_at", "revoked_at", F.when(F.col("decision") == "approve", expires_at(F.col("r.kind"), F.col("decided_at"), F.col("r.ttl_minutes"))).alias("expires_at"))


def active_grants(states: DataFrame, now: Column) -> DataFrame:
    """Approved grants that haven't ended at ``now``; the moment of the end is still inside."""
    return states.where((F.col("status") == "approved") & (F.col("expires_at").isNull() | (now <= F.col("expires_at"))))


def grant_rules(grants: DataFrame, first_id: int = 2_000_000) -> DataFrame:
    """Rules of active grants, above all others."""
    return grants.select((F.pmod(F.xxhash64("request_id"), F.lit(1 << 40)) + first_id).alias("rule_id"), normal_path(F.col("path")).alias("pattern"), "perms", F.lit(False).alias("deny"), F.lit(GRANT_PRIORITY).alias("priority"), F.array().cast("array<string>").alias("roles"), F.array("requester").alias("users"))


def load_policy(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Rules and roles of a policy in YAML: ``roles`` (name to users) and ``rules``."""
    import yaml

    given = yaml.safe_load(source) or {}
    rows = [rule(k, r.get("pattern", "**/*"), **{"deny" if r.get("deny") else "allow": [str(p) for p in r.get("permissions", [])]}, priority=r.get("priority", 0), roles=r.get("roles", []), users=r.get("users", [])) for k, r in enumerate(given.get("rules") or [])]
    pairs = [(u, name) for name, users in (given.get("roles") or {}).items() for u in users]
    return spark.createDataFrame(rows, RULES), spark.createDataFrame(pairs, "user string, role string")


def acl_block(markdown: str) -> str | None:
    """YAML of the first fenced block marked ``acl`` in a note."""
    found = re.search(r"```acl\s*\n(.*?)```", markdown, re.S)
    return found and found[1]
