"""Training-log analysis."""

from pyspark.sql import functions as F

from molframe.catalog.base import LOG_SQL, register, rounded, table, training_log
from molframe.operators import runlog as R

PATIENCE = 5


@register("global_step", f"WITH {LOG_SQL} SELECT run, step, event_id FROM log")
def steps(spark, sf_dir):
    return training_log(spark, sf_dir).select("run", "step", "event_id")


WINDOW_SQL = f"""
{LOG_SQL},
windows AS (SELECT run, (step + 6) // 7 AS "window", avg(loss) AS avg_loss, count(*) AS n_steps FROM log GROUP BY 1, 2)
"""


@register("windowed_loss", f'WITH {WINDOW_SQL} SELECT run, "window", round(avg_loss, 6) AS avg_loss, n_steps FROM windows')
def windows(spark, sf_dir):
    return R.windowed_loss(training_log(spark, sf_dir), 7).withColumn("avg_loss", rounded("avg_loss"))


@register(
    "last_window_loss",
    f"""
    WITH {WINDOW_SQL}
    SELECT run, max("window") AS "window", round(arg_max(avg_loss, "window"), 6) AS last_loss FROM windows GROUP BY 1
    """,
)
def last_window(spark, sf_dir):
    return R.last_window_loss(training_log(spark, sf_dir), 7).withColumn("last_loss", rounded("last_loss"))


# The stopping rule walked epoch by epoch.
STOP_SQL = f"""
{LOG_SQL},
seen AS (
  SELECT run, step, loss, min(loss) OVER (PARTITION BY run ORDER BY step) AS best FROM log),
firsts AS (
  SELECT run, step, loss, best,
         max(CASE WHEN loss < prev OR prev IS NULL THEN step END)
           OVER (PARTITION BY run ORDER BY step) AS best_step
  FROM (SELECT *, lag(best) OVER (PARTITION BY run ORDER BY step) AS prev FROM seen)),
stops AS (
  SELECT run, min(step) AS stop_epoch FROM firsts
  WHERE loss - best > 0 AND step - best_step > {PATIENCE} GROUP BY 1),
ends AS (
  SELECT log.run, max(stop_epoch) AS stop_epoch, coalesce(max(stop_epoch), max(step)) AS last
  FROM log LEFT JOIN stops ON log.run = stops.run GROUP BY 1),
stopped AS (
  SELECT ends.run, stop_epoch, best_step AS best_epoch, best AS best_loss
  FROM ends JOIN firsts ON ends.run = firsts.run AND ends.last = firsts.step)
"""


@register("early_stop", f"WITH {STOP_SQL} SELECT * FROM stopped")
def stop(spark, sf_dir):
    return R.early_stop(training_log(spark, sf_dir), PATIENCE, epoch="step")


@register(
    "best_epoch",
    f"""
    WITH {LOG_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss DESC, step) AS r FROM log)
    SELECT run, step AS best_epoch, loss AS best_score, event_id AS test_score FROM ranked WHERE r = 1
    """,
)
def best(spark, sf_dir):
    return R.best_epoch(training_log(spark, sf_dir), "loss", "max", epoch="step", test="event_id")


@register(
    "improvement_trail",
    f"""
    WITH {LOG_SQL}, prior AS (
      SELECT run, step, loss, min(loss) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log)
    SELECT run, step, loss FROM prior WHERE before IS NULL OR loss < before
    """,
)
def trail(spark, sf_dir):
    return R.improvement_trail(training_log(spark, sf_dir).select("run", "step", "loss"), "loss", epoch="step")


@register(
    "topk_checkpoints",
    f"""
    WITH {LOG_SQL}
    SELECT * FROM (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS rank FROM log)
    WHERE rank <= 5
    """,
)
def topk(spark, sf_dir):
    kept = R.topk_checkpoints(training_log(spark, sf_dir).select("run", "step", "loss"))
    return kept.withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "best_checkpoint",
    f"""
    WITH {LOG_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS r FROM log)
    SELECT run, step AS best_step, loss AS best_loss FROM ranked WHERE r = 1
    """,
)
def best_saved(spark, sf_dir):
    return R.best_checkpoint(training_log(spark, sf_dir))


@register(
    "latest_per_run",
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
    """,
)
def latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return R.latest(events, "user_id", ["ts", "event_id"]).drop("ts")
