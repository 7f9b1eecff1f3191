"""Selections in a listing, saved decisions, search over commands and the rules of when to ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def span(listing: DataFrame, anchor: str, focus: str) -> DataFrame:
    """(id) of the rows of a listing (pos, id) between two of its rows, both included; none if the focus is not listed, it alone if the anchor is not."""
    ends = listing.agg(F.max(F.when(F.col("id") == anchor, F.col("pos"))).alias("i"), F.max(F.when(F.col("id") == focus, F.col("pos"))).alias("j"))
    ends = ends.select(F.coalesce("i", "j").alias("i"), "j").where("j IS NOT NULL").select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))  # one row at most
    return listing.join(F.broadcast(ends), F.col("pos").between(F.col("lo"), F.col("hi"))).select("id")


def toggle(selected: DataFrame, item: str) -> DataFrame:
    """(id) with the item if it was not selected, else without."""
    one = selected.sparkSession.sql("SELECT :item AS id", {"item": item})
    return selected.where(F.col("id") != item).select("id").union(one.join(selected.select("id"), "id", "left_anti"))


def click(selected: DataFrame, listing: DataFrame, item: str, anchor: str | None = None, ranged: bool = False, toggled: bool = False) -> DataFrame:
    """(id) selected after a click: alone, toggled, as a range from the anchor, or with the range added."""
    if ranged:
        made = span(listing, item if anchor is None else anchor, item)
        return made.union(selected.select("id")).distinct() if toggled else made
    return toggle(selected, item) if toggled else selected.sparkSession.sql("SELECT :item AS id", {"item": item})


def reconciled(selected: DataFrame, listing: DataFrame) -> DataFrame:
    """(id) of the selected that are still listed."""
    return selected.select("id").distinct().join(listing.select("id"), "id", "left_semi")


def in_order(selected: DataFrame, listing: DataFrame) -> DataFrame:
    """The listed rows that are selected."""
    return listing.join(selected.select("id").distinct(), "id", "left_semi")


def dragged(selected: DataFrame, grabbed: str) -> DataFrame:
    """(id, reselect): what a drag moves: the whole selection if the grabbed item is in it, else that item, which is then selected."""
    inside = selected.where(F.col("id") == grabbed).limit(1).select(F.lit(True).alias("_in"))
    alone = selected.sparkSession.sql("SELECT :item AS id", {"item": grabbed}).join(F.broadcast(inside), how="left").where("_in IS NULL").select("id", F.lit(True).alias("reselect"))
    return selected.join(F.broadcast(inside)).select("id", F.lit(False).alias("reselect")).union(alone)


def resumed(items: DataFrame, saved: DataFrame) -> DataFrame:
    """(pos, id, decision) of a queue from saved decisions (id, decision); decisions about items that are gone are dropped."""
    return items.join(saved.select("id", "decision"), "id", "left").select("pos", "id", "decision")


def first_open(queue: DataFrame, cursor: int) -> DataFrame:
    """One row: where a resumed queue goes on: at the cursor, but not past the first item without a decision, or the end."""
    end = F.coalesce(F.max("pos"), F.lit(-1)) + 1
    return queue.agg(F.least(end, F.greatest(F.lit(0), F.lit(cursor)), F.coalesce(F.min(F.when(F.col("decision").isNull(), F.col("pos"))), end)).cast("long").alias("cursor"))


def kept_instead(decisions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, decision) with marked items (of ``ids``, or all) put back to keep."""
    which = F.col("decision") == "mark"
    if ids is None:
        return decisions.withColumn("decision", F.when(which, "keep").otherwise(F.col("decision")))
    named = decisions.join(ids.select("id").distinct().withColumn("_named", F.lit(True)), "id", "left")
    return named.withColumn("decision", F.when(which & F.col("_named"), "keep").otherwise(F.col("decision"))).select("id", "decision")


#: Sort keys (column, falling) that order options stand for.
ORDERS = {"oldest": ("modified", False), "newest": ("modified", True), "largest": ("size", True), "smallest": ("size", False)}


def sort_of(order: str, browser: tuple[str, bool]) -> tuple[str, bool]:
    """The sort key of an order option; other options leave the browser's."""
    return ORDERS.get(order, browser)


def commands(rows: DataFrame, search: str) -> DataFrame:
    """Commands (title, section, words) in which each word of the search occurs, case aside."""
    said = F.lower(F.concat_ws(" ", "title", "section", F.coalesce("words", F.lit(""))))
    out = rows
    for word in search.lower().split():
        out = out.where(F.contains(said, F.lit(word)))
    return out


#: When a user may be asked for a review.
ASK = {"sessions": 2, "successes": 3, "usage_ms": 600_000, "cooldown_ms": 2_592_000_000, "between": 5, "quiet_ms": 600_000}


def may_ask(states: DataFrame, now: int, version: str) -> DataFrame:
    """Adds refusal: why a user must not be asked now, or null: rated, first-session, recent-error, asked-recently, few-tasks, little-use."""
    asked = F.col("last_asked_at").isNotNull()
    why = (
        F.when(F.col("rated_version") == version, "rated").when(F.col("sessions") < ASK["sessions"], "first-session").when(now - F.col("last_problem_at") < ASK["quiet_ms"], "recent-error")
        .when(asked & (now - F.col("last_asked_at") < ASK["cooldown_ms"]), "asked-recently").when(asked & (F.col("successes_since") < ASK["between"]), "few-tasks")
        .when(~asked & (F.col("successes") < ASK["successes"]) & (F.col("usage_ms") < ASK["usage_ms"]), "little-use")
    )
    return states.withColumn("refusal", why)
