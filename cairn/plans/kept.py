"""Registered queries of what is kept up to date: arrivals, saved similarity, reviews, each with SQL written independently of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar as S, similar_index as I
from ..sources.catalog import table
from ..streaming import arrivals as A, jobs as J, reviews as R
from .queries import _FP, query


@query("""WITH s AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS snapshot, user_id FROM events), d AS (SELECT snapshot, lag(snapshot) OVER w AS last, lead(snapshot) OVER w AS next FROM (SELECT DISTINCT snapshot FROM s) WINDOW w AS (ORDER BY snapshot))
SELECT snapshot, user_id, 'added' AS event FROM s JOIN d USING (snapshot) WHERE last IS NOT NULL AND NOT EXISTS (FROM s p WHERE p.snapshot = last AND p.user_id = s.user_id)
UNION ALL SELECT next, user_id, 'removed' FROM s JOIN d USING (snapshot) WHERE next IS NOT NULL AND NOT EXISTS (FROM s n WHERE n.snapshot = next AND n.user_id = s.user_id)""")
def arrivals_stream(spark, d):
    """Each day's users are a snapshot. The stream stops half-way and goes on from its checkpoint."""
    rows = table(spark, d, "events").select(F.datediff("ts", F.lit("1970-01-01")).alias("snapshot"), "user_id").distinct()
    path, middle = A.scratch(spark), rows.agg(F.expr("(min(snapshot) + max(snapshot)) div 2")).first()[0] or 0
    for part in (F.col("snapshot") <= middle, F.col("snapshot") > middle):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        A.differences(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path, "user_id")
    return A.differences_in(spark, path)


@query(f"""WITH RECURSIVE {_FP}, e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM h x JOIN h y ON x.vec_id <> y.vec_id AND bit_count(xor(x.b, y.b)) <= 18),
w(id, r) AS (SELECT a, a FROM e UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.id) SELECT id::VARCHAR AS key, min(r::VARCHAR) AS root FROM w GROUP BY id""")
def similar_updates(spark, d):
    """The state of a first run without each hundredth vector takes these in; the groups are those of all vectors."""
    versions = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding", (F.col("vec_id") % 100 == 0).alias("later"))
    path, prints = A.scratch(spark), lambda v: v.select("key", S.fingerprint("embedding").alias("h"))
    for generation, now in enumerate((versions.where("NOT later"), versions)):
        I.update(spark, path, now, prints, 18, generation)
    return I.groups(spark, path, versions, 1)


#: Decisions are a string of signs (. none, k, t), steps a string of places with the sign that was there before.
@query("""WITH RECURSIVE m AS (SELECT user_id, event_id, 5 + user_id % 4 AS k, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n, epoch_ms(ts) AS ms, event_id % 7 = 0 AS guarded, event_id % 11 = 0 AS again,
  CASE event_type WHEN 'click' THEN 'keep' WHEN 'purchase' THEN 'trash' WHEN 'error' THEN 'undo' ELSE CASE WHEN event_id % 2 = 0 THEN 'go' ELSE 'jump' END END AS act, CASE WHEN event_id % 2 = 0 THEN event_id % 3 - 1 ELSE event_id % 5 END AS to_ FROM events),
r(user_id, event_id, n, pos, last, dec, steps, outcome) AS (SELECT DISTINCT user_id, NULL::BIGINT, 0::BIGINT, 0::BIGINT, -1000000000000::BIGINT, repeat('.', k), '', NULL::VARCHAR FROM m UNION ALL
  SELECT user_id, event_id, n, CASE WHEN no IS NOT NULL THEN pos WHEN act IN ('keep', 'trash') THEN pos + 1 WHEN act = 'undo' THEN back WHEN act = 'go' THEN least(k, greatest(0, pos + to_)) ELSE least(k, greatest(0, to_)) END,
    CASE WHEN no IS NULL AND act IN ('keep', 'trash') THEN ms ELSE last END,
    CASE WHEN no IS NOT NULL THEN dec WHEN act IN ('keep', 'trash') THEN left(dec, pos) || left(act, 1) || substr(dec, pos + 2) WHEN act = 'undo' THEN left(dec, back) || right(steps, 1) || substr(dec, back + 2) ELSE dec END,
    CASE WHEN no IS NOT NULL THEN steps WHEN act IN ('keep', 'trash') THEN steps || pos || substr(dec, pos + 1, 1) WHEN act = 'undo' THEN left(steps, length(steps) - 2) ELSE steps END, coalesce(no, act)
  FROM (SELECT m.*, r.pos, r.last, r.dec, r.steps, try_cast(substr(right(r.steps, 2), 1, 1) AS BIGINT) AS back, CASE WHEN m.act IN ('keep', 'trash') THEN CASE WHEN r.pos >= m.k THEN 'finished' WHEN m.again THEN 'repeat' WHEN m.ms - r.last < 45 THEN 'bounce' WHEN m.act = 'trash' AND m.guarded THEN 'protected' END
        WHEN m.act = 'undo' AND r.steps = '' THEN 'nothing' END AS no FROM r JOIN m ON m.user_id = r.user_id AND m.n = r.n + 1))
SELECT user_id::VARCHAR AS session, event_id AS seq, outcome, pos::INT AS cursor, (length(dec) - length(replace(dec, 'k', '')))::INT AS kept, (length(dec) - length(replace(dec, 't', '')))::INT AS marked FROM r WHERE n > 0""")
def review_stream(spark, d):
    """Each user reviews five to eight items; kinds of events are decisions, moves and undo."""
    e, k = table(spark, d, "events"), F.col("event_id")
    moves = F.when(k % 2 == 0, "go").otherwise("jump")
    action = F.when(F.col("event_type") == "click", "keep").when(F.col("event_type") == "purchase", "trash").when(F.col("event_type") == "error", "undo").otherwise(moves)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    no_items = F.lit(None).cast("array<string>")
    acts = e.select(F.col("user_id").cast("string").alias("session"), k.alias("seq"), at.alias("at_ms"), action.alias("action"), no_items.alias("items"), F.when(k % 2 == 0, k % 3 - 1).otherwise(k % 5).cast("int").alias("index"), (k % 7 == 0).alias("guarded"), (k % 11 == 0).alias("repeat"))
    ids = F.transform(F.sequence(F.lit(1), 5 + F.col("user_id") % 4), lambda i: i.cast("string"))
    begun = e.groupBy("user_id").agg(F.min(at).alias("at")).select(F.col("user_id").cast("string"), F.lit(-1).cast("long"), F.col("at") - 1, F.lit("items"), ids, F.lit(0), F.lit(False), F.lit(False))
    path = A.scratch(spark)
    acts.union(begun).write.parquet(f"{path}/in")
    with R.rocksdb(spark):
        return J.collected(R.reviews(spark.readStream.schema(acts.schema).parquet(f"{path}/in")), "append").where("outcome <> 'items'")
