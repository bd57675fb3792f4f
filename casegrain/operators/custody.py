"""Sessions and custody items: state from event logs, amendments, audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What each action needs the item's status to be, and what it makes of it.
ACTIONS = {
    "create": ((None,), "draft"),
    "edit": (("draft",), "draft"),
    "lock": (("draft",), "locked"),
    "amend": (("draft", "locked"), None),
    "void": (("draft", "locked", "voided"), "voided"),
}


def end_sessions(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """sessions (session_id, started_at, summary) with ended_at, whole seconds, and the end's summary where it has one.

    Of several ends of a session the last counts; sessions without one stay open; unreadable times give no duration.
    """
    last = ends.groupBy("session_id").agg(F.max(F.struct("ended_at", "summary")).alias("e"))
    seconds = F.unix_timestamp(F.col("e.ended_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return sessions.join(last, "session_id", "left").select("session_id", "started_at", F.col("e.ended_at").alias("ended_at"), seconds.alias("duration_seconds"), F.coalesce("e.summary", "summary").alias("summary"))


def run_actions(log: DataFrame) -> DataFrame:
    """log (id, seq, action) with the status before each action, whether it is allowed, and the status after it.

    An item is a draft once created; only drafts are edited or locked; voided items are not amended; void is a soft delete.
    A refused action changes nothing, so the status before one is made by the last action that was allowed: create, lock
    and void each are allowed at first use at the latest, which makes that status a matter of their first places.
    """
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda action, seq="seq": F.min(F.when(F.col("action") == action, F.col(seq))).over(w)
    rows = log.withColumn("made", seen("create"))
    effective = rows.withColumn("live", F.col("made").isNotNull())
    locked = F.max(F.when((F.col("action") == "lock") & F.col("live"), 1).otherwise(0)).over(w)
    voided = F.max(F.when((F.col("action") == "void") & F.col("live"), 1).otherwise(0)).over(w)
    status = F.when(~F.col("live"), None).when(voided == 1, "voided").when(locked == 1, "locked").otherwise("draft")
    out = effective.withColumn("before", status)
    allowed, after = F.lit(False), F.col("before")
    for action, (needs, makes) in ACTIONS.items():
        fits = F.col("before").isNull() if needs == (None,) else F.coalesce(F.col("before").isin(*needs), F.lit(False))
        allowed = F.when(F.col("action") == action, fits).otherwise(allowed)
        if makes:
            after = F.when((F.col("action") == action) & fits, makes).otherwise(after)
    return out.withColumn("allowed", allowed).withColumn("after", after).drop("made", "live")


def current(log: DataFrame) -> DataFrame:
    """id and status of each item that was created and isn't voided."""
    last = run_actions(log).groupBy("id").agg(F.max_by("after", "seq").alias("status"))
    return last.where(F.col("status").isNotNull() & (F.col("status") != "voided"))


def amendments(changes: DataFrame, statuses: DataFrame, fields: list[str]) -> DataFrame:
    """Accepted amendments (id, seq, field, new_value) with the value each replaces: of known fields, on items not voided.

    changes has id, seq, field, old_value (the item's value before all of them) and new_value.
    """
    w = Window.partitionBy("id", "field").orderBy("seq")
    open_ = statuses.where("status <> 'voided'").select("id")
    kept = changes.where(F.col("field").isin(*fields)).join(open_, "id", "left_semi")
    return kept.withColumn("old_value", F.coalesce(F.lag("new_value").over(w), "old_value"))


def audit(log: DataFrame) -> DataFrame:
    """One audit row for each allowed lock, amendment or void of a log with actor: id, seq, action, summary."""
    done = run_actions(log).where("allowed and action in ('lock', 'amend', 'void')")
    word = F.when(F.col("action") == "lock", "locked").when(F.col("action") == "amend", "amended").otherwise("voided")
    return done.select("id", "seq", word.alias("action"), F.concat(F.lit("COC item "), word, F.lit(" by "), F.col("actor")).alias("summary"))
