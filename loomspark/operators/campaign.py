"""Review campaigns: packets are checked, proposals made and compared, rejections staged behind a gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators import review

# Outcomes that a packet may carry; a campaign's scenarios: relation and bucket of the groups, how many of them, from how many batches, after how many.
MANUAL = ["", "reject", "keep", "needs-context", "pending"]
PROPOSED = ["", "reject", "keep", "needs-context"]
SCENARIOS = {
    "likely_front": ("disjoint", "likely-reject", 12, 5, 0),
    "likely_mid": ("disjoint", "likely-reject", 12, 5, 5),
    "likely_late": ("disjoint", "likely-reject", 12, 5, 10),
    "needs_context": ("disjoint", "needs-context", 8, 10, 0),
}


def guidance(groups: DataFrame) -> DataFrame:
    """Adds bucket and flags to groups with counts (item_count, exactish, disjoint, zero_overlap, high_score, low_specificity)."""
    n = F.col("item_count")
    none = (F.col("disjoint") == n) & (F.col("zero_overlap") == n)
    bucket = F.when((F.col("exactish") == n) & (n > 0), "alias-check").when(none & (F.col("high_score") > 0), "needs-context").when(none, "likely-reject").otherwise("mixed-review")
    flags = F.array_compact(F.array(
        F.when(F.col("low_specificity") > 0, "has-low-specificity-labels"),
        F.when((F.col("high_score") > 0) & (F.col("disjoint") > 0), "has-high-score-disjoint-pairs"),
        F.when((F.col("zero_overlap") == n) & (n > 0), "all-zero-overlap"),
    ))
    return groups.withColumns({"bucket": bucket, "flags": flags})


def propose(samples: DataFrame) -> DataFrame:
    """Adds assistant_outcome and assistant_confidence from a sample's bucket and flags."""
    zero, high = F.array_contains("flags", "all-zero-overlap"), F.array_contains("flags", "has-high-score-disjoint-pairs")
    reject = (F.col("bucket") == "likely-reject") & ~high
    outcome = F.when(reject, "reject").when(F.col("bucket") == "alias-check", "keep").otherwise("needs-context")
    sure = F.when(reject & zero, "high").when(F.col("bucket").isin("likely-reject", "needs-context", "alias-check"), "medium").otherwise("low")
    return samples.withColumns({"assistant_outcome": outcome, "assistant_confidence": sure})


def packet_key(ids: Column, anchor: Column) -> Column:
    """The review ids joined, else the anchor."""
    return F.coalesce(F.nullif(F.array_join(F.filter(ids, lambda x: x != ""), "|"), F.lit("")), anchor)


def packet_issues(samples: DataFrame) -> DataFrame:
    """(packet, sample, severity, type) of samples (packet, sample, anchor, bucket, review_ids, proposed, manual)."""
    rows = samples.withColumn("key", packet_key(F.col("review_ids"), F.col("anchor")))

    def issue(when: Column, severity: str, kind: str) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type")))

    own = F.array_compact(F.array(
        issue(F.coalesce("anchor", F.lit("")) == "", "error", "missing-anchor"),
        issue(~F.coalesce("proposed", F.lit("")).isin(PROPOSED), "error", "invalid-proposed-outcome"),
        issue(~F.coalesce("manual", F.lit("")).isin(MANUAL), "error", "invalid-manual-outcome"),
        issue(F.coalesce("bucket", F.lit("")) == "", "warning", "missing-bucket"),
        issue(F.size(F.filter("review_ids", lambda x: x != "")) == 0, "warning", "missing-review-ids"),
    ))
    single = rows.select("packet", "sample", F.explode(own).alias("x")).select("packet", "sample", "x.severity", "x.type")
    ids = rows.select("packet", "sample", F.posexplode("review_ids").alias("p", "rid")).where("rid <> ''")
    again = F.row_number().over(Window.partitionBy("packet", "rid").orderBy("sample", "p")) > 1
    repeated = ids.withColumn("again", again).where("again").select("packet", "sample", F.lit("error").alias("severity"), F.lit("duplicate-review-id").alias("type"))
    keys = rows.where("key <> ''").withColumn("again", F.row_number().over(Window.partitionBy("packet", "key").orderBy("sample")) > 1)
    same = keys.where("again").select("packet", "sample", F.lit("warning").alias("severity"), F.lit("duplicate-packet-key").alias("type"))
    return single.unionByName(repeated).unionByName(same)


def adjudicated(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("manual").isin("reject", "keep", "needs-context"))


def packet_status(samples: DataFrame) -> DataFrame:
    """(packet, total, adjudicated, status): empty, pending, partial or complete."""
    judged = F.col("manual").isin("reject", "keep", "needs-context")
    sums = samples.groupBy("packet").agg(F.count("sample").alias("total"), F.count_if(judged).alias("adjudicated"))
    return sums.withColumn("status", F.when(F.col("total") == 0, "empty").when(F.col("adjudicated") == 0, "pending").when(F.col("adjudicated") == F.col("total"), "complete").otherwise("partial"))


def compared(samples: DataFrame, proposals: DataFrame) -> DataFrame:
    """Samples and proposals by packet and key: matched, only in the one, only in the other, and whether they agree."""
    a = samples.withColumn("key", packet_key(F.col("review_ids"), F.col("anchor"))).select("packet", "key", "manual")
    b = proposals.withColumn("key", packet_key(F.col("review_ids"), F.col("anchor"))).select("packet", "key", "assistant_outcome", "assistant_confidence")
    rows = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), ["packet", "key"], "full_outer")
    side = F.when(F.col("_a").isNull(), "proposal-only").when(F.col("_b").isNull(), "sample-only").otherwise("matched")
    return rows.withColumn("side", side).withColumn("agrees", F.when(F.col("manual").isin("reject", "keep", "needs-context"), F.col("manual") == F.col("assistant_outcome"))).drop("_a", "_b")


def rollup(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums and rates of compared rows, over all or by confidence."""
    sums = rows.groupBy(*(by or [])).agg(
        *(F.count_if(F.col("side") == s).alias(s.replace("-", "_")) for s in ("matched", "sample-only", "proposal-only")), F.count("agrees").alias("adjudicated"), F.count_if(F.col("agrees")).alias("agreed"),
        F.count_if((F.col("assistant_outcome") == "reject") & F.col("agrees").isNotNull()).alias("reject_proposed"), F.count_if((F.col("assistant_outcome") == "reject") & F.col("agrees")).alias("reject_confirmed"),
    )
    return sums.withColumns({"agreement": F.round(F.try_divide("agreed", "adjudicated"), 4), "reject_precision": F.round(F.try_divide("reject_confirmed", "reject_proposed"), 4)})


def selected(packets: DataFrame, statuses: list[str] | None = None, scenarios: list[str] | None = None, ids: list[str] | None = None, campaigns: list[str] | None = None) -> DataFrame:
    """Packets (packet, status, scenario, campaign_ids) that fit every filter given."""
    rows = packets if not statuses else packets.where(F.col("status").isin(statuses))
    rows = rows if not ids else rows.where(F.col("packet").isin(ids))
    rows = rows if not scenarios else rows.where(F.col("scenario").isin(scenarios))
    return rows if not campaigns else rows.where(F.arrays_overlap("campaign_ids", F.array(*(F.lit(c) for c in campaigns))))


def scenarios(items: DataFrame | None, names: list[str] | None = None, size: int = 25, groups_of: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(scenario, anchor, batch, turn, ...) of the groups that each scenario of a campaign samples from a queue of items.

    groups_of: the groups of a relation's entries, where these come from elsewhere than from items.

    A scenario's groups are those of one relation, in batches; of the batches that hold a group of its bucket it takes a
    window, and from that its groups in turn. Names that repeat count once; an unknown one raises.
    """
    unknown = set(names or ()) - set(SCENARIOS)
    if unknown:
        raise ValueError(f"unknown scenarios: {', '.join(sorted(unknown))}")
    held: dict[str, DataFrame] = {}
    out = None
    for name in dict.fromkeys(names or SCENARIOS):
        kind, bucket, groups, take, offset = SCENARIOS[name]
        if kind not in held:
            found = groups_of(kind) if groups_of else review.anchors(review.entries(items, [kind]))
            held[kind] = guidance(review.batches(found, size))
        one = review.sampled(held[kind].where(F.col("bucket") == bucket), groups, take, offset).withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def scenario_of(packet: Column) -> Column:
    """The scenario that a packet's name ends in; none for a packet made by hand."""
    out = F.lit("")
    for name in SCENARIOS:
        out = F.when(F.endswith(packet, F.lit(f"-{name}")), name).otherwise(out)
    return out


def packet_of(path: Column) -> Column:
    """The packet that a file of samples is for; null for the latest copy and for summaries, proposals and comparisons."""
    name = F.regexp_extract(path, r"(?:^|/)review-assist-sample-([^/]+)\.md$", 1)
    return F.when((name != "") & (name != "latest") & ~name.rlike("^(summary|proposal|compare)-"), name)


def index(packets: DataFrame, proposals: DataFrame, comparisons: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Packets (packet, total, adjudicated, valid) with status, scenario, whether they have a proposal and a comparison
    (packet), and the campaigns (campaign_id, packet) that they are in, in order.
    """
    has = [f.select("packet").distinct().withColumn(n, F.lit(True)) for f, n in ((proposals, "proposed"), (comparisons, "compared"))]
    listed = campaigns.groupBy("packet").agg(F.sort_array(F.collect_set("campaign_id")).alias("campaign_ids"))
    rows = packets.join(has[0], "packet", "left").join(has[1], "packet", "left").join(listed, "packet", "left")
    total, done = F.col("total"), F.col("adjudicated")
    status = F.when(total <= 0, "empty").when(done <= 0, "pending").when(done >= total, "complete").otherwise("partial")
    none = F.expr("cast(array() as array<string>)")
    return rows.fillna(False, ["proposed", "compared"]).withColumns({"status": status, "pending": total - done, "scenario": scenario_of(F.col("packet")), "campaign_ids": F.coalesce("campaign_ids", none)})


def reject_stage(samples: DataFrame, gate: DataFrame) -> DataFrame:
    """Review ids that people rejected, once each, where the gate (one row with ``gate``) passed."""
    ids = adjudicated(samples).where("manual = 'reject'").select("packet", "sample", F.explode("review_ids").alias("review_id")).where("review_id <> ''")
    first = ids.groupBy("review_id").agg(F.min(F.struct("packet", "sample")).alias("at"))
    return first.join(F.broadcast(gate.select((F.col("gate") == "pass").alias("ready")))).select("review_id", "at.packet", "at.sample", "ready")


def apply_plan(staged: DataFrame) -> DataFrame:
    """What applying would do. It is a preview: nothing is ever enabled by it."""
    return staged.withColumns({"from_status": F.lit("open"), "to_status": F.lit("rejected"), "enabled": F.lit(False)})
