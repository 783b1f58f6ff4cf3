"""URL filters by a temporal join with dated lists (operator 10).

List entries are events: at a time a list adds or removes a domain. The next event of the same list and
domain ends the interval that an addition begins. Each capture is evaluated against the intervals that
hold its fetch time, for its host and each parent domain: an equality join on the domain with the time
as a range. The most specific domain decides, then the latest addition, then the list's name.

Captures carry only keys into the join and nothing is broadcast by hand: a host with a third of the
captures is a skewed key of an equality join, which adaptive execution splits; a list side small enough
is broadcast by Spark itself.

Defined results: an interval includes its begin and excludes its end; of events at one time a removal
wins; events with a null time, domain or list are ignored; a null url, or one without a host, matches
nothing; so does a null fetch time. Repeated captures each give a row. Ports, user names and letter case
do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-case host, null where there is none."""
    host = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)", 2)
    return F.when(host != "", host)


def validity_intervals(events: DataFrame) -> DataFrame:
    """``domain, list, since, until`` from ``domain, list, at, action`` (add or remove); ``until`` null: still active."""
    known = events.where("domain is not null and list is not null and at is not null and action in ('add', 'remove')")
    # one event for each time: a removal, if there is one, else the addition
    once = known.groupBy(F.lower("domain").alias("domain"), "list", "at").agg(F.max("action").alias("action"))
    following = F.lead("at").over(Window.partitionBy("domain", "list").orderBy("at"))
    return once.withColumn("until", following).where("action = 'add'").select("domain", "list", F.col("at").alias("since"), "until")


def filter_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``page_id, host, fetched, n_active, domain, list, since, blocked`` for every capture.

    ``n_active`` counts the active entries that match; ``domain``, ``list`` and ``since`` are the deciding one.
    """
    keyed = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # captures of one host at one time have one verdict, so these are joined once
    asked = keyed.where("host is not null and fetched is not null").select("host", "fetched").distinct().withColumn("domain", F.explode(suffixes))
    active = asked.join(validity_intervals(events), "domain").where("since <= fetched and (until is null or fetched < until)")
    deciding = F.max_by(F.struct("domain", "list", "since"), F.struct(F.length("domain"), "since", "list"))
    verdicts = active.groupBy("host", "fetched").agg(F.count("*").alias("n_active"), deciding.alias("e"))
    rows = keyed.join(verdicts, ["host", "fetched"], "left")
    return rows.select("page_id", "host", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "e.domain", "e.list", "e.since", F.col("e").isNotNull().alias("blocked"))
