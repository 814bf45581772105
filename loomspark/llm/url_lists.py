"""URL filters: dated list entries become validity intervals, and an as-of join finds those active at fetch time.

Column expressions only. An entry (list, value, at, action) adds a host or a domain to a list or removes it; it holds
until the next entry of its list and value. Each interval is laid on the quarters that it touches, each capture on its
quarter and the suffixes of its host (times are kept to the microsecond; a date is its midnight), so the join is an equality of (value, quarter) with a range test; intervals are
broadcast if a count shows that they are few, and dealt out otherwise (plain exchanges, whose hot parts Spark can split).

Defined results: values and hosts are compared in lower case; entries with a null list, value, date or another action
than add or remove are ignored; at the same time a removal wins over an addition; a capture without a host or a date has
no active entry and passes; captures alike in id, URL and date count once; an empty list blocks nothing; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm._common import bounded, checkpoint

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null if it has none."""
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def _quarter(at: Column) -> Column:
    return F.year(at) * 4 + F.quarter(at) - 1


def intervals(entries: DataFrame) -> DataFrame:
    """(list, value, since, until): until is null while the entry is the last one.

    The next entry is sought within the quarter; only the last of each quarter looks further, among the quarters' firsts.
    So no window is over all entries of a value, which may hold any share of the rows.
    """
    rows = entries.select(F.col("list"), F.lower("value").alias("value"), F.col("at").cast("timestamp").alias("at"), F.col("action"))
    rows = rows.where("list is not null and value is not null and at is not null and action in ('add', 'remove')").distinct().withColumn("q", _quarter(F.col("at")))
    key = ["list", "value"]
    inside = Window.partitionBy(*key, "q").orderBy("at", "action")
    firsts = rows.groupBy(*key, "q").agg(F.min("at").alias("first"))
    later = firsts.select(*key, "q", F.lead("first").over(Window.partitionBy(*key).orderBy("q")).alias("later"))
    following = rows.withColumn("next", F.lead("at").over(inside)).join(later, [*key, "q"])
    return following.select(*key, F.col("at").alias("since"), F.coalesce("next", "later").alias("until"), "action").where("action = 'add' and (until is null or until > since)").drop("action")


def active_entries(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, host, fetched_at, n_active, blocked, lists (names in order), values (what matched)."""
    held = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("told"), F.col(at_col).cast("timestamp").alias("at")).distinct()
    held = held.withColumn("host", host_of(F.col("url")))
    last = held.agg(F.max("at")).first()[0]
    spans = intervals(entries).where(F.col("since") <= F.lit(last))
    spans = spans.withColumn("q", F.explode(F.sequence(_quarter(F.col("since")), _quarter(F.least("until", F.lit(last))))))
    spans = checkpoint(spans.select(F.col("value").alias("v"), F.col("q").alias("vq"), "list", "since", "until"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    seen = held.where("host is not null and at is not null").select("id", "url", "at", _quarter(F.col("at")).alias("q"), F.explode_outer(suffixes).alias("suffix"))
    valid = (F.col("suffix") == F.col("v")) & (F.col("q") == F.col("vq")) & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    hits = seen.join(bounded(spans, 100_000), valid).groupBy("id", "url", "at").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.array_join(F.sort_array(F.collect_set("v")), ",").alias("values"))
    same = F.col("c.id").eqNullSafe(F.col("x.id")) & F.col("c.url").eqNullSafe(F.col("x.url")) & F.col("c.at").eqNullSafe(F.col("x.at"))
    out = held.alias("c").join(hits.alias("x"), same, "left")
    return out.select(F.col("c.id").alias(id_col), "host", F.col("c.told").alias(at_col), F.coalesce("n", F.lit(0)).alias("n_active"), F.col("n").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("values", F.lit("")).alias("values"))
