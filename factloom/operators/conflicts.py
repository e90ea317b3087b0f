"""Contradictions of single-valued predicates: finding, judging and settling them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.temporal import earliest_second, overlaps
from factloom.lineage import cut
from factloom.operators.intervals import overlap_counts
from factloom.operators.ontology import Ontology
from factloom.skew import skew_join

POLICIES = ("keep_both", "highest_confidence", "highest_authority", "most_recent_evidence")


def claims_of(facts: DataFrame) -> DataFrame:
    """The different claims: of facts with the same subject, predicate, object and bounds the first stands for all.

    rep (fact_id of the first), seq, subject_id, predicate, object_key, start
    and end in seconds (null for open or unreadable bounds), members.
    """
    return (
        facts.where("subject_id is not null and predicate is not null and fact_id is not null")
        .select("seq", "fact_id", "subject_id", "predicate", "object_key", earliest_second(F.col("valid_from")).alias("start"), earliest_second(F.col("valid_to")).alias("end"))
        .groupBy("subject_id", "predicate", "object_key", "start", "end")
        .agg(F.min_by("fact_id", F.struct("seq", "fact_id")).alias("rep"), F.min("seq").alias("seq"), F.countDistinct("fact_id").alias("members"))
    )


def arrivals(facts: DataFrame) -> DataFrame:
    """Each different fact_id once, as it first arrived: copies by fact_id say nothing new."""
    kept = ["seq", "subject_id", "predicate", "object_key", "valid_from", "valid_to"]
    known = facts.where("subject_id is not null and predicate is not null and fact_id is not null")
    return known.groupBy("fact_id").agg(F.min_by(F.struct(*kept), "seq").alias("f")).select("fact_id", "f.*")


def members_of(facts: DataFrame) -> DataFrame:
    """The claim of each different fact (:func:`claims_of`): fact_id, seq, rep."""
    return _members(cut(arrivals(facts)))


def _members(first: DataFrame) -> DataFrame:
    keys, same = ["subject_id", "predicate", "claim"], F.struct("object_key", "start", "end").alias("claim")  # nulls within a struct are equal
    bounds = [earliest_second(F.col("valid_from")).alias("start"), earliest_second(F.col("valid_to")).alias("end")]
    read = first.select("fact_id", "seq", "subject_id", "predicate", "object_key", *bounds).select("fact_id", "seq", "subject_id", "predicate", same)
    return skew_join(read, claims_of(first).select("subject_id", "predicate", same, "rep"), keys, F.col("fact_id")).select("fact_id", "seq", "rep")


def detect_claims(facts: DataFrame, single_valued: DataFrame | None) -> DataFrame:
    """Pairs of active claims that contradict: fact_a (earlier), fact_b, subject_id, predicate.

    Two claims contradict if a predicate of ``single_valued`` (predicate; None: any) has
    different objects for one subject over periods that share an instant.  Pairs
    are between the first facts of the different claims (:func:`claims_of`);
    :func:`detect` has those of all facts.  The join is on the subject and
    predicate, salted; periods and objects are conditions on it.
    """
    claims = claims_of(_active(facts, single_valued))
    columns = ["seq", "rep", "object_key", "start", "end"]
    a = claims.select("subject_id", "predicate", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = claims.select("subject_id", "predicate", *[F.col(c).alias(f"b_{c}") for c in columns])
    return (
        skew_join(b, a, ["subject_id", "predicate"], F.col("b_rep"))
        .where("(a_seq < b_seq or (a_seq = b_seq and a_rep < b_rep)) and a_object_key <> b_object_key")
        .where(overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
        .select(F.col("a_rep").alias("fact_a"), F.col("b_rep").alias("fact_b"), "subject_id", "predicate", F.col("a_seq").alias("seq_a"), F.col("b_seq").alias("seq_b"))
    )


def _active(facts: DataFrame, single_valued: DataFrame | None) -> DataFrame:
    active = facts.where("status = 'active'")
    return active if single_valued is None else active.join(single_valued, "predicate", "left_semi")


def detect(facts: DataFrame, single_valued: DataFrame | None) -> DataFrame:
    """Every two different active facts that contradict: fact_a (earlier), fact_b, subject_id, predicate, seq_a, seq_b.

    Facts contradict if their claims do (:func:`detect_claims`).  So claims are
    paired, of which there are fewer, and then stand for their members: facts of
    one claim differ in qualifiers, confidence and evidence, and each is a rival
    of its own.
    """
    first = cut(arrivals(_active(facts, single_valued))).withColumn("status", F.lit("active"))
    members = cut(_members(first))
    pairs = detect_claims(first, None).select(F.col("fact_a").alias("claim_a"), F.col("fact_b").alias("claim_b"), "subject_id", "predicate")
    for side, other in (("a", "claim_b"), ("b", "fact_a")):
        each = members.select(F.col("rep").alias(f"claim_{side}"), F.struct("seq", "fact_id").alias(f"of_{side}"), F.col("fact_id").alias(f"fact_{side}"))
        pairs = skew_join(pairs, each, [f"claim_{side}"], F.col(other))
    earlier, later = F.least("of_a", "of_b"), F.greatest("of_a", "of_b")
    return pairs.select(
        earlier["fact_id"].alias("fact_a"), later["fact_id"].alias("fact_b"), "subject_id", "predicate", earlier["seq"].alias("seq_a"), later["seq"].alias("seq_b")
    )


def rival_counts(facts: DataFrame, single_valued: DataFrame) -> DataFrame:
    """Each active claim of a single-valued predicate with the number of claims that contradict it, without forming pairs.

    rep, subject_id, predicate, object_key, members, n_rivals.  It is the number
    of claims of its subject and predicate that share an instant with it, less
    those with its own object.  Where a group has very many claims this tells
    what :func:`detect_claims` would list.  Claims whose end is not after their start
    hold at no instant and are left out.
    """
    claims = cut(claims_of(facts.where("status = 'active'").join(single_valued, "predicate", "left_semi")).where("object_key is not null"))
    every = overlap_counts(claims, ["subject_id", "predicate"], name="n_all")
    return overlap_counts(every, ["subject_id", "predicate", "object_key"], name="n_same").select(
        "rep", "subject_id", "predicate", "object_key", "members", (F.col("n_all") - F.col("n_same")).alias("n_rivals")
    )


def fact_rival_counts(facts: DataFrame, single_valued: DataFrame) -> DataFrame:
    """Each different active fact of a single-valued predicate with the number of facts that contradict it: what :func:`detect` would list.

    fact_id, subject_id, predicate, object_key, n_rivals; as :func:`rival_counts`, but each fact counts.
    """
    bounds = [earliest_second(F.col("valid_from")).alias("start"), earliest_second(F.col("valid_to")).alias("end")]
    each = cut(arrivals(_active(facts, single_valued)).where("object_key is not null").select("fact_id", "subject_id", "predicate", "object_key", *bounds))
    every = overlap_counts(each, ["subject_id", "predicate"], name="n_all")
    return overlap_counts(every, ["subject_id", "predicate", "object_key"], name="n_same").select(
        "fact_id", "subject_id", "predicate", "object_key", (F.col("n_all") - F.col("n_same")).alias("n_rivals")
    )


def scores(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Per fact what the policies compare: confidence, authority (best of its sources), latest (microseconds); null for unknown."""
    trust = sources.where("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.max("authority").alias("authority"))
    stated = evidence.where("fact_id is not null").groupBy("fact_id", "source_id").agg(F.max("extracted_at").alias("latest"))
    measured = skew_join(stated, trust, ["source_id"], F.col("fact_id"), "left").groupBy("fact_id").agg(
        F.max("authority").alias("authority"), F.max(F.unix_micros("latest")).cast("double").alias("latest")
    )
    return facts.groupBy("fact_id").agg(F.max("confidence").alias("confidence")).join(measured, "fact_id", "left")


def judged(pairs: DataFrame, measured: DataFrame, policy: str | Callable[[], Column]) -> DataFrame:
    """``pairs`` with the winner that a policy names: the higher known score; null on a tie or if either is unknown.

    A policy of one's own is a function that builds the winner's fact_id (or
    null) from fact_a, fact_b and confidence_a, authority_a, latest_a and so on.
    """
    if callable(policy):
        out = pairs
        for side in ("a", "b"):
            columns = [F.col(c).alias(f"{c}_{side}") for c in ("confidence", "authority", "latest")]
            out = out.join(measured.select(F.col("fact_id").alias(f"fact_{side}"), *columns), f"fact_{side}", "left")
        return out.withColumn("winner", policy()).select(*[c for c in pairs.columns if c != "winner"], "winner")
    if policy == "keep_both":
        return pairs.withColumn("winner", F.lit(None).cast("string"))
    score = {"highest_confidence": "confidence", "highest_authority": "authority", "most_recent_evidence": "latest"}[policy]
    out = pairs
    for side in ("a", "b"):
        one = measured.select(F.col("fact_id").alias(f"fact_{side}"), F.col(score).alias(f"score_{side}"))
        out = out.join(one, f"fact_{side}", "left")
    winner = F.when(F.col("score_a") > F.col("score_b"), F.col("fact_a")).when(F.col("score_b") > F.col("score_a"), F.col("fact_b"))
    return out.withColumn("winner", winner).drop("score_a", "score_b")


def single_valued(spark: SparkSession, ontology: Ontology | None) -> DataFrame:
    """The predicates of an ontology that have one value at a time."""
    return spark.createDataFrame([(p.name,) for p in ontology.predicates.values() if p.cardinality == "one"] if ontology else [], "predicate string")


def retired(facts: DataFrame, settled: DataFrame, at: Column) -> DataFrame:
    """``facts`` with those that lost (rows of kind superseded, of :func:`settle`) superseded at ``at``."""
    lost = settled.where("kind = 'superseded'").select(F.col("fact_a").alias("fact_id")).distinct().withColumn("__lost", F.lit(True))
    return facts.join(lost, "fact_id", "left").withColumns({
        "superseded_at": F.when(F.col("__lost"), at.cast("timestamp")).otherwise(F.col("superseded_at")),
        "status": F.when(F.col("__lost"), "superseded").otherwise(F.col("status")),
    }).select(*facts.columns)


_FOLDED = "kind string, subject_id string, predicate string, fact_a string, fact_b string, winner string, seq_a long, seq_b long"


def settle(facts: DataFrame, single_valued: DataFrame, measured: DataFrame, policy: str, since: int | None = None) -> DataFrame:
    """Conflicts and superseded facts as they arise when facts arrive one by one in the order of seq.

    A new fact meets the active rivals in the order they arrived.  Each makes a
    conflict; a rival that loses is superseded at once, and the new fact, if it
    loses, is superseded and meets no further rival.  So it may supersede one
    rival and then lose to another.

    Rows of kind ``conflict`` (fact_a, fact_b, winner, seq_a, seq_b) and of kind
    ``superseded`` (fact_a the loser, fact_b the winner).  Facts arriving again
    change nothing.  With ``since``, facts of a seq up to it stand as they are and
    only later ones are judged.  Groups that state one object only have no rivals
    and are left out first, by a count combined on the map side.  The rest is
    sorted by group and read as a stream, of which only the active rivals of the
    current group are held.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    score = {"highest_confidence": "confidence", "highest_authority": "authority", "most_recent_evidence": "latest"}.get(policy)
    first = facts.where("subject_id is not null and fact_id is not null and status = 'active'").join(single_valued, "predicate", "left_semi")
    group_columns = ["subject_id", "predicate"]
    disputed = first.groupBy(*group_columns).agg(F.min("object_key").alias("low"), F.max("object_key").alias("high")).where("low <> high").select(*group_columns)
    arrivals = (
        skew_join(first, disputed, group_columns, F.col("fact_id"), "left_semi").groupBy("fact_id").agg(F.min_by(F.struct("seq", "subject_id", "predicate", "object_key", "valid_from", "valid_to"), "seq").alias("f")).select("fact_id", "f.*")
        .select("seq", "fact_id", "subject_id", "predicate", "object_key", earliest_second(F.col("valid_from")).alias("start"), earliest_second(F.col("valid_to")).alias("end"))
        .join(measured.select("fact_id", (F.col(score) if score else F.lit(None).cast("double")).alias("score")), "fact_id", "left")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rivals = None, []
        for batch in batches:
            out = []
            for seq, fact, subject, predicate, obj, start, end, value in batch[["seq", "fact_id", "subject_id", "predicate", "object_key", "start", "end", "score"]].itertuples(index=False, name=None):
                if (subject, predicate) != group:
                    group, rivals = (subject, predicate), []
                start = None if pd.isna(start) else start
                end = None if pd.isna(end) else end
                value = None if pd.isna(value) else value
                if since is not None and seq <= since:
                    rivals.append((fact, obj, start, end, value, seq))
                    continue
                kept, lost = [], False
                for at, rival in enumerate(rivals):
                    r_fact, r_obj, r_start, r_end, r_value, r_seq = rival
                    apart = r_end is not None and start is not None and r_end <= start or end is not None and r_start is not None and end <= r_start
                    if r_obj == obj or apart:
                        kept.append(rival)
                        continue
                    known = value is not None and r_value is not None
                    winner = fact if known and value > r_value else r_fact if known and value < r_value else None
                    out.append(("conflict", subject, predicate, r_fact, fact, winner, r_seq, seq))
                    if winner == fact:
                        out.append(("superseded", subject, predicate, r_fact, fact, fact, r_seq, seq))
                        continue
                    kept.append(rival)
                    if winner == r_fact:
                        out.append(("superseded", subject, predicate, fact, r_fact, r_fact, seq, r_seq))
                        kept += rivals[at + 1 :]
                        lost = True
                        break
                rivals = kept if lost else [*kept, (fact, obj, start, end, value, seq)]
            yield pd.DataFrame(out, columns=["kind", "subject_id", "predicate", "fact_a", "fact_b", "winner", "seq_a", "seq_b"])

    ordered = arrivals.repartition("subject_id", "predicate").sortWithinPartitions("subject_id", "predicate", "seq", "fact_id")
    return ordered.mapInPandas(fold, _FOLDED)


def numbered(conflicts: DataFrame, detected_at: Column, policy: str, existing: int = 0) -> DataFrame:
    """Conflicts in the form of the store, numbered on from ``existing`` in the order of (seq_b, seq_a).

    Numbers come from ranks within ranges of seq_b and the sizes of the ranges
    before, so no task ranks all conflicts.
    """
    width = 1 << 16
    ranged = conflicts.withColumn("range", F.floor(F.col("seq_b") / width))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("seq_b", "seq_a", "fact_b", "fact_a"))
    return (
        ranged.withColumn("rank", rank).join(before, "range")
        .withColumn("seq", F.col("before") + F.col("rank") + existing)
        .select(
            "seq", F.concat(F.lit("conflict:"), F.col("seq").cast("string")).alias("conflict_id"), "fact_a", "fact_b", "subject_id", "predicate",
            detected_at.cast("timestamp").alias("detected_at"), F.lit(policy).alias("policy"), "winner",
        )
    )


def decide(conflicts: DataFrame, facts: DataFrame, decisions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settle conflicts by ``decisions`` (conflict_id, winner): new conflicts, new facts, and refused decisions.

    A decision counts only if its conflict exists and the winner is one of its
    facts; others come back with a reason.  The losers are superseded at
    ``at`` unless they were before.  Repeated equal decisions count once;
    different winners for one conflict are refused.
    """
    asked = decisions.groupBy("conflict_id").agg(F.min("winner").alias("pick"), F.max("winner").alias("other"))
    joined = asked.join(conflicts.select("conflict_id", "fact_a", "fact_b"), "conflict_id", "left")
    reason = (
        F.when(F.col("fact_b").isNull() & F.col("fact_a").isNull(), "unknown conflict").when(F.col("pick") != F.col("other"), "several winners")
        .when(F.col("pick").isNull() | ~(F.coalesce(F.col("pick") == F.col("fact_a"), F.lit(False)) | F.coalesce(F.col("pick") == F.col("fact_b"), F.lit(False))), "winner is no member")
    )
    checked = joined.withColumn("reason", reason)
    good = checked.where("reason is null")
    settled = conflicts.join(good.select("conflict_id", "pick"), "conflict_id", "left").withColumn("winner", F.coalesce("pick", "winner")).drop("pick")
    losers = good.select(F.when(F.col("pick") == F.col("fact_a"), F.col("fact_b")).otherwise(F.col("fact_a")).alias("fact_id")).where("fact_id is not null").distinct().withColumn("__lost", F.lit(True))
    lost = F.coalesce(F.col("__lost"), F.lit(False)) & (F.col("status") == "active")
    after = facts.join(losers, "fact_id", "left").withColumns(
        {"superseded_at": F.when(lost, at.cast("timestamp")).otherwise(F.col("superseded_at")), "status": F.when(lost, "superseded").otherwise(F.col("status"))}
    ).drop("__lost")
    return settled.select(*conflicts.columns), after.select(*facts.columns), checked.where("reason is not null").select("conflict_id", F.col("pick").alias("winner"), "reason")
