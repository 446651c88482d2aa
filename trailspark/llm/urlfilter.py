"""Temporal list join: URL captures against dated list entries, in DataFrame operations only.

A list is a log of dated entries: from ``listed_at`` on, ``rule`` (a host, any
parent domain of a host, or host plus leading path) has ``action``: ``block``,
``allow`` or ``remove``.

*Intervals.*  For each rule an entry is valid from its date until the rule's
next entry; ``remove`` only ends its predecessor.  Of several entries of a rule
at one time the strictest holds (block, then allow, then remove).

*As-of join.*  A capture looks up the parent domains of its host and the
leading paths of its URL, and takes of each rule the entry active when it was
fetched.  Only domains of as many labels and paths of as many steps as some rule
of the list has are built, so a URL costs its length times these depths; as a
rule with ``k`` steps has at least ``k`` characters, a list of ``n`` bytes has at
most about the root of ``2 n`` of them.  Intervals are cut at multiples of ``period`` days, so that the lookup
is an equi-join on (rule, period) with a residual range check and rules with
many entries do not multiply the captures.  Only periods in which something was
fetched count, so a capture with a freak date adds one period.  The most specific (longest) active
rule decides; a rule is unique by its text, so there are no ties.

The interval table is broadcast only if its estimated size is under
``broadcast_bytes``; else the join shuffles, and adaptive execution splits a
hot rule or host.  Rows are folded back to captures by partial aggregation.

Hosts are compared in lower case, paths as they are.

Defined cases: null URL or null fetch time matches nothing and is kept, as
``unlisted``; entries with a null rule, date or unknown action are void; an
empty list leaves all captures unlisted, and no captures give no rows; repeated
captures are each returned; URLs of any length are looked up whole.  Only the
three columns named are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import BROADCAST_BYTES

PERIOD_DAYS = 30
STRICTNESS = {"block": 3, "allow": 2, "remove": 1}


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(F.rtrim(host, F.lit("."))), F.lit(""))


def rules_of(url: Column, labels: list[int], depths: list[int]) -> Column:
    """The rules that may hold for a URL: its parent domains of as many ``labels``, and its host with paths of as many steps as ``depths``."""
    host = host_of(url)
    names = F.split(host, r"\.")
    domains = F.transform(F.filter(F.lit(labels).cast("array<int>"), lambda i: i <= F.size(names)), lambda i: F.array_join(F.slice(names, -i, i), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.transform(
        F.filter(F.lit(depths).cast("array<int>"), lambda i: i <= F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths)))


def rule_of(rule: Column) -> Column:
    """A rule with its host in lower case and without a trailing slash."""
    plain = F.rtrim(rule, F.lit("/"))
    host = F.substring_index(plain, "/", 1)
    return F.concat(F.lower(host), F.substr(plain, F.length(host) + 1))


def period_of(at: Column, days: int) -> Column:
    return F.floor(F.unix_timestamp(at) / (days * 86400)).cast("long")


def validity(entries: DataFrame) -> DataFrame:
    """(rule, action, valid_from, valid_to) with a null end where the entry still holds."""
    rank = F.create_map(*(x for k, v in STRICTNESS.items() for x in (F.lit(k), F.lit(v))))
    rows = entries.select(
        rule_of(F.col("rule")).alias("rule"), F.col("listed_at").cast("timestamp").alias("valid_from"), F.try_element_at(rank, F.col("action")).alias("s")
    ).dropna()
    one = rows.groupBy("rule", "valid_from").agg(F.max("s").alias("s"))  # a group is a rule's log: list data, not captures
    end = F.lead("valid_from").over(Window.partitionBy("rule").orderBy("valid_from"))
    action = F.when(F.col("s") == 3, "block").when(F.col("s") == 2, "allow").otherwise("remove")
    return one.withColumn("valid_to", end).select("rule", action.alias("action"), "valid_from", "valid_to").where("action <> 'remove'")


def evaluate(
    captures: DataFrame, entries: DataFrame, *, capture_id: str = "page_id", url: str = "url", fetched_at: str = "fetched_at",
    period_days: int = PERIOD_DAYS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """capture id, url, fetched_at, verdict, rule, listed_at of every capture."""
    rows = captures.select(F.col(capture_id).alias("c"), F.col(url).alias("u"), F.col(fetched_at).cast("timestamp").alias("at"))
    fetched = rows.where("at IS NOT NULL").select(period_of(F.col("at"), period_days).alias("p")).distinct()
    present = fetched.agg(F.sort_array(F.collect_list("p"))).first()[0]  # a number a period of the calendar at most
    from_, to = period_of(F.col("valid_from"), period_days), period_of(F.col("valid_to"), period_days)
    held = F.filter(F.lit(present).cast("array<bigint>"), lambda x: (x >= from_) & (F.col("valid_to").isNull() | (x <= to)))
    list_ = validity(entries).select("rule", "action", "valid_from", "valid_to", F.explode(held).alias("period"))
    depth, n_labels = F.regexp_count("rule", F.lit("/")), F.size(F.split("rule", r"\."))
    size, depths, labels = list_.agg(
        F.coalesce(F.sum(F.octet_length("rule") + 64), F.lit(0)), F.sort_array(F.collect_set(F.when(depth > 0, depth))), F.sort_array(F.collect_set(F.when(depth == 0, n_labels)))
    ).first()
    if size <= broadcast_bytes:
        list_ = F.broadcast(list_)
    nothing = F.array(F.lit(None).cast("string"))
    keys = F.when(F.col("at").isNotNull(), rules_of(F.col("u"), labels, depths))
    asked = rows.withColumn("keys", keys).withColumn("keys", F.when(F.size("keys") > 0, F.col("keys")).otherwise(nothing)).select("c", "u", "at", F.size("keys").alias("n_keys"), F.explode("keys").alias("k"))
    hit = (F.col("k") == F.col("rule")) & (period_of(F.col("at"), period_days) == F.col("period")) & (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    joined = asked.join(list_, hit, "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "action", "valid_from"))).alias("best")
    folded = joined.groupBy("c", "u", "at").agg(best, (F.count("*") / F.first("n_keys")).cast("int").alias("copies"))
    result = folded.select(
        F.col("c").alias(capture_id), F.col("u").alias("url"), F.col("at").alias("fetched_at"),
        F.coalesce(F.col("best.action"), F.lit("unlisted")).alias("verdict"), F.col("best.rule").alias("rule"), F.col("best.valid_from").alias("listed_at"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return result.drop("copy")
