"""Queries over ``events``, read as a log: user is the track, ts the clock, event_type the register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.music import bin_value, nearest_bin
from seqmill.operators import align, analysis, augment, sequence
from seqmill.plans.registry import query
from seqmill.session import table

HOUR = 3_600_000_000
EV = """ev AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents FROM events
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query(f"""WITH {EV} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS tracks, CAST(sum(cents) AS BIGINT) AS cents,
  round((max(us) - min(us)) / 1e6, 6) AS seconds FROM ev GROUP BY 1""")
def event_type_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("tracks"), F.sum("cents").alias("cents"), F.round((F.max("us") - F.min("us")) / 1e6, 6).alias("seconds"))


@query(f"""WITH {EV} SELECT event_id, user_id, CAST(coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clock FROM ev""")
def running_clock(spark, sf_dir):
    return sequence.running_clock(events(spark, sf_dir), "user_id", ["event_id"], "cents").select("event_id", "user_id", "clock")


@query(f"""WITH {EV}, i AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS UNBOUNDED PRECEDING) AS island FROM ev)
  SELECT user_id, min(event_id) AS event_id, CAST(sum(cents) AS BIGINT) AS amount, count(*) AS merged
  FROM i WHERE event_type = 'view' GROUP BY user_id, island""")
def merge_waits(spark, sf_dir):
    return sequence.merge_runs(events(spark, sf_dir), "user_id", ["event_id"], F.col("event_type") == "view", "cents")


@query(f"""WITH {EV}, c AS (SELECT *, lag(cents // 1000) OVER w AS previous, row_number() OVER w AS n FROM ev
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
  SELECT event_id, user_id, event_type, cents // 1000 AS state, previous FROM c WHERE n = 1 OR previous IS DISTINCT FROM cents // 1000""")
def state_cdc(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("state", F.floor(F.col("cents") / 1000).cast("long"))
    return sequence.changes(e, ["user_id", "event_type"], ["event_id"], "state").select("event_id", "user_id", "event_type", "state", "previous")


@query(f"""WITH {EV}, c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p,
  first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS header FROM ev)
  SELECT user_id, count(*) FILTER (coalesce(p, header) <> event_type) AS changed, count(DISTINCT event_type) - 1 AS beyond_first FROM c GROUP BY 1""")
def patch_change_cdc(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf_dir).withColumns({"p": F.lag("event_type").over(w), "header": F.first("event_type").over(w)})
    return e.groupBy("user_id").agg(F.count_if(F.coalesce("p", "header") != F.col("event_type")).alias("changed"), (F.countDistinct("event_type") - 1).alias("beyond_first"))


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) <= {6 * HOUR} THEN 0 ELSE 1 END AS s FROM ev),
  n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(us) AS begins, max(us) AS ends FROM n GROUP BY 1, 2""")
def onset_sessions(spark, sf_dir):
    s = sequence.sessions(events(spark, sf_dir), ["user_id"], ["event_id"], "us", 6 * HOUR)
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("us").alias("begins"), F.max("us").alias("ends"))


INTERVALS = """iv AS (SELECT * FROM (SELECT event_id, user_id, us, cents, event_type, lead(us) OVER w AS ends, coalesce(lead(event_type) OVER w = 'click', false) AS retriggered
  FROM ev WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'click')"""


def _intervals(spark, sf_dir):
    kind = F.col("event_type")
    return sequence.intervals(events(spark, sf_dir), ["user_id"], ["event_id"], "us", kind == "click", kind == "view").withColumnRenamed("end", "ends")


@query(f"WITH {EV}, {INTERVALS} SELECT event_id, user_id, us AS begins, ends, retriggered FROM iv")
def note_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir).select("event_id", "user_id", F.col("us").alias("begins"), "ends", "retriggered")


@query(f"""WITH {EV}, l AS (SELECT max(us) AS m FROM ev), s AS (SELECT user_id, event_type, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY event_id), m) - us AS d FROM ev, l),
  a AS (SELECT user_id, CAST(coalesce(sum(d) FILTER (event_type IN ('click', 'view')), 0) AS BIGINT) AS active, CAST(sum(d) AS BIGINT) AS total FROM s GROUP BY 1)
  SELECT *, round(active / greatest(total, 1), 6) AS fraction, round(2 * active / greatest(total, 1), 6) AS counted_twice FROM a""")
def active_state_fraction(spark, sf_dir):
    e = events(spark, sf_dir)
    last = e.agg(F.max("us")).first()[0]  # the end of the log, one number
    on = F.col("event_type").isin("click", "view")
    a = sequence.active_time(e, ["user_id"], ["event_id"], "us", on, F.lit(last))
    share = F.col("active") / F.greatest(F.col("total"), F.lit(1))
    return a.withColumns({"fraction": F.round(share, 6), "counted_twice": F.round(2 * share, 6)})


@query(f"""WITH {EV} SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN cents END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM ev""")
def asof_state(spark, sf_dir):
    value = F.when(F.col("event_type") == "purchase", F.col("cents"))
    return sequence.as_of(events(spark, sf_dir), ["user_id"], ["event_id"], value).select("event_id", "user_id", "state")


GRID = f"""gr AS (SELECT event_id, user_id, s, s // {24 * HOUR} AS w, CAST(floor((s - (s // {24 * HOUR}) * {24 * HOUR}) / {1.5 * HOUR} + 0.5) AS BIGINT) AS b0 FROM
  (SELECT event_id, user_id, us - 1704067200000000 AS s FROM ev)),
  g2 AS (SELECT event_id, user_id, CASE WHEN b0 >= 16 THEN w + 1 ELSE w END AS bar, CASE WHEN b0 >= 16 THEN 0 ELSE b0 END AS beat FROM gr)"""


@query(f"""WITH {EV}, {GRID}, m AS (SELECT *, greatest(bar - coalesce(lag(bar) OVER q, -1), 0) AS bars, lag(beat) OVER q AS pb FROM g2 WINDOW q AS (PARTITION BY user_id ORDER BY event_id)),
  k AS (SELECT *, bars > 0 OR pb IS DISTINCT FROM beat AS new_beat FROM m)
  SELECT event_id, user_id, bar, beat, bars, new_beat, new_beat AND beat = 8 AND (CASE WHEN bars > 0 THEN 0 ELSE coalesce(pb, 0) END) < 8 AS half_beat FROM k""")
def grid_quantize(spark, sf_dir):
    e = events(spark, sf_dir)
    bar, beat = sequence.grid(F.col("us") - F.lit(1704067200000000), 24 * HOUR)
    return sequence.grid_marks(e.select("event_id", "user_id", bar.alias("bar"), beat.alias("beat")), ["user_id"], ["event_id"], "bar", "beat")


HIST = f"hi AS (SELECT user_id, (us - 1704067200000000) // {HOUR} AS bin, count(*) AS n FROM ev GROUP BY 1, 2)"


def _histogram(spark, sf_dir):
    return analysis.histogram(events(spark, sf_dir), "user_id", F.col("us") - F.lit(1704067200000000), HOUR)


@query(f"WITH {EV}, {HIST} SELECT * FROM hi")
def onset_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


ACF = "ac AS (SELECT a.user_id, b.bin - a.bin AS lag, CAST(sum(a.n * b.n) AS BIGINT) AS acf FROM hi a JOIN hi b ON a.user_id = b.user_id AND b.bin - a.bin BETWEEN 1 AND 48 GROUP BY 1, 2)"


@query(f"WITH {EV}, {HIST}, {ACF} SELECT * FROM ac")
def onset_autocorr(spark, sf_dir):
    return analysis.autocorrelation(_histogram(spark, sf_dir), "user_id", 1, 48)


@query(f"""WITH {EV}, {HIST}, {ACF}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY acf DESC, lag) AS k FROM ac),
  p AS (SELECT r.user_id, r.lag, r.acf AS y1, coalesce(a.acf, 0) AS y0, coalesce(b.acf, 0) AS y2 FROM r LEFT JOIN ac a ON a.user_id = r.user_id AND a.lag = r.lag - 1
    LEFT JOIN ac b ON b.user_id = r.user_id AND b.lag = r.lag + 1 WHERE k = 1)
  SELECT user_id, lag AS peak, y1 AS acf, round(lag + CASE WHEN y0 - 2 * y1 + y2 < 0 AND lag > 1 AND lag < 48 THEN 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2) ELSE 0 END, 6) AS period FROM p""")
def tempo_peak(spark, sf_dir):
    return analysis.peak(analysis.autocorrelation(_histogram(spark, sf_dir), "user_id", 1, 48), "user_id", 1, 48)


@query(f"""WITH {EV}, {HIST}, {ACF}, s AS (SELECT h.user_id, count(*) AS bins, CAST(sum(n) AS BIGINT) AS onsets FROM hi h GROUP BY 1),
  m AS (SELECT s.user_id, onsets, coalesce(max(acf) FILTER (lag = 12), 0) AS s2, coalesce(max(acf) FILTER (lag = 18), 0) AS s3, coalesce(max(acf) FILTER (lag = 24), 0) AS s4
    FROM s LEFT JOIN ac USING (user_id) GROUP BY 1, 2)
  SELECT user_id, s2, s3, s4, CASE WHEN onsets < 12 THEN 4 WHEN s2 >= s3 AND s2 >= s4 THEN CASE WHEN greatest(s3, s4) > 0 AND s2 < 1.5 * greatest(s3, s4) THEN 4 WHEN s4 > 0.7 * s2 THEN 4 ELSE 2 END
    WHEN s3 >= s4 THEN CASE WHEN greatest(s2, s4) > 0 AND s3 < 1.5 * greatest(s2, s4) THEN 4 ELSE 3 END ELSE 4 END AS beats FROM m""")
def meter_strength(spark, sf_dir):
    h = _histogram(spark, sf_dir)
    return analysis.meter(h, analysis.autocorrelation(h, "user_id", 1, 48), "user_id", 6)


@query(f"""WITH {EV}, {HIST}, ph AS (SELECT user_id, bin % 24 AS phase, CAST(sum(n) AS BIGINT) AS score FROM hi GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, phase) AS k FROM ph)
  SELECT user_id, phase, score FROM r WHERE k = 1""")
def beat_phase(spark, sf_dir):
    return analysis.beat_phase(_histogram(spark, sf_dir), "user_id", 24)


PCH = f"pc AS (SELECT event_type, user_id % 12 AS pc, CAST(sum(greatest(1, cents)) AS BIGINT) AS weight FROM ev GROUP BY 1, 2)"


def _pitch_classes(spark, sf_dir):
    return analysis.pitch_classes(events(spark, sf_dir), "event_type", F.col("user_id"), F.col("cents"))


@query(f"WITH {EV}, {PCH} SELECT * FROM pc")
def pitch_class_hist(spark, sf_dir):
    return _pitch_classes(spark, sf_dir)


#: The profiles, major and minor, written out: the SQL takes nothing from the operator.
PROFILES = """pf AS (SELECT 0 AS minor, [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88] AS v UNION ALL SELECT 1, [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]),
  pr AS (SELECT root, minor, (p + root) % 12 AS pc, CAST(v[p + 1] AS DOUBLE) AS v FROM pf, range(12) r(root), range(12) q(p))"""


@query(f"""WITH {EV}, {PCH}, {PROFILES}, t AS (SELECT DISTINCT event_type FROM ev),
  k AS (SELECT t.event_type, root, minor, corr(coalesce(weight, 0), v) AS r FROM t CROSS JOIN pr LEFT JOIN pc ON pc.event_type = t.event_type AND pc.pc = pr.pc GROUP BY 1, 2, 3),
  s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(r, 9) DESC, root, minor) AS n FROM k)
  SELECT event_type, CAST(root AS INTEGER) AS key_index, minor = 1 AS is_minor, round(r, 6) AS score FROM s WHERE n = 1""")
def key_profile_corr(spark, sf_dir):
    return analysis.key(_pitch_classes(spark, sf_dir), "event_type")


STATS = f"""st AS (SELECT user_id, count(*) AS n, avg(cents) AS mean, coalesce(stddev_pop(cents), 0) AS spread,
  CASE WHEN count(*) <= 1 THEN 0 ELSE count(*) / greatest(1.0, (max(us) - min(us)) / {float(HOUR)}) END AS density FROM ev GROUP BY 1)"""


def _stats(spark, sf_dir):
    return analysis.channel_stats(events(spark, sf_dir), "user_id", "cents", "us", HOUR)


@query(f"WITH {EV}, {STATS} SELECT user_id, n, round(mean, 6) AS mean, round(spread, 6) AS spread, round(density, 6) AS density FROM st")
def channel_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "spread", "density")])


@query(f"""WITH {EV}, {STATS} SELECT user_id, CASE WHEN user_id % 10 = 6 THEN 'DRUMS' WHEN user_id % 10 = 9 THEN 'PERC' WHEN mean IS NULL THEN 'UNK' WHEN mean < 2400 THEN 'BASS'
  WHEN mean >= 2600 AND density >= 0.1 THEN 'LEAD' WHEN mean >= 2600 THEN 'COUNTER' ELSE 'HARM' END AS role FROM st""")
def channel_roles(spark, sf_dir):
    u = F.col("user_id") % 10
    role = analysis.role(u == 6, u == 9, F.col("mean"), F.col("density"), low=2400, high=2600, dense=0.1)
    return _stats(spark, sf_dir).select("user_id", role.alias("role"))


FEATURES = """fe AS (SELECT user_id, count(*) FILTER (event_type = 'click') / greatest(count(*), 1) AS pan_rate, coalesce(max(cents) FILTER (event_type = 'view'), 0) AS max_fb,
  count(DISTINCT event_type) - 1 AS ic_rate, count(*) FILTER (event_type = 'purchase') / greatest(count(*), 1) AS dac_frac, count(*) FILTER (event_type = 'error') / greatest(count(*), 1) AS psg_frac,
  CAST(max(CASE WHEN cents > 49000 THEN 1 ELSE 0 END) AS INTEGER) AS ssg_eg, count(*) FILTER (cents % 100 = 0) / greatest(count(*), 1) AS lfo_frac, count(*) FILTER (cents % 50 = 0) / greatest(count(*), 1) AS ch3_frac FROM ev GROUP BY 1)"""
CLUSTER = "CASE WHEN pan_rate > 0.3 OR lfo_frac > 0.10 OR ch3_frac > 0.15 THEN 5 WHEN ic_rate > 4 OR ssg_eg > 0 THEN 4 WHEN dac_frac > 0.2 THEN 3 WHEN psg_frac > 0.2 THEN 2 ELSE 1 END"


def _features(spark, sf_dir):
    e = events(spark, sf_dir)
    share = lambda c: F.count_if(c) / F.greatest(F.count("*"), F.lit(1))
    kind = F.col("event_type")
    return e.groupBy("user_id").agg(
        share(kind == "click").alias("pan_rate"), F.coalesce(F.max(F.when(kind == "view", F.col("cents"))), F.lit(0)).alias("max_fb"), (F.countDistinct("event_type") - 1).alias("ic_rate"),
        share(kind == "purchase").alias("dac_frac"), share(kind == "error").alias("psg_frac"), F.max(F.when(F.col("cents") > 49000, 1).otherwise(0)).alias("ssg_eg"),
        share(F.col("cents") % 100 == 0).alias("lfo_frac"), share(F.col("cents") % 50 == 0).alias("ch3_frac"),
    )


LIMITS = {"pan_rate": 0.3, "lfo_frac": 0.10, "ch3_frac": 0.15, "ic_rate": 4, "dac_frac": 0.2, "psg_frac": 0.2}


@query(f"""WITH {EV}, {FEATURES} SELECT user_id, round(pan_rate, 6) AS pan_rate, max_fb, ic_rate, round(dac_frac, 6) AS dac_frac, round(psg_frac, 6) AS psg_frac, ssg_eg,
  round(lfo_frac, 6) AS lfo_frac, round(ch3_frac, 6) AS ch3_frac FROM fe""")
def feature_vector(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select(*[F.round(c, 6).alias(c) if c.endswith(("rate", "frac")) and c != "ic_rate" else F.col(c) for c in f.columns])


@query(f"WITH {EV}, {FEATURES} SELECT user_id, {CLUSTER} AS cluster FROM fe")
def rule_clusters(spark, sf_dir):
    return _features(spark, sf_dir).select("user_id", analysis.cluster(LIMITS).alias("cluster"))


@query(f"WITH {EV}, {FEATURES} SELECT {CLUSTER} AS cluster, count(*) AS n FROM fe GROUP BY 1")
def cluster_counts(spark, sf_dir):
    return rule_clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, pts AS (SELECT user_id, event_type, event_id, us, cents * 7 // 50000 AS bucket, max(us) OVER (PARTITION BY user_id, event_type) AS stops FROM ev),
  c AS (SELECT *, lag(bucket) OVER w AS p, row_number() OVER w AS n FROM pts WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS part FROM c WHERE n = 1 OR p IS DISTINCT FROM bucket)
  SELECT user_id, event_type, part, bucket, us AS begins, coalesce(lead(us) OVER (PARTITION BY user_id, event_type ORDER BY event_id), stops) AS ends FROM k WHERE part <= 8""")
def envelope_split(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"bucket": F.floor(F.col("cents") * 7 / 50000).cast("long"), "stops": F.max("us").over(W.partitionBy("user_id", "event_type"))})
    s = sequence.split_envelope(e, ["user_id", "event_type"], ["event_id"], "us", "bucket", "stops")
    return s.select("user_id", "event_type", F.col("part").cast("long").alias("part"), "bucket", F.col("us").alias("begins"), F.col("until").alias("ends"))


@query(f"""WITH {EV}, s AS (SELECT user_id, cents - lag(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM ev)
  SELECT user_id, count(step) AS n, round(count(*) FILTER (abs(step) <= 1200) / greatest(count(step), 1), 6) AS small, round(avg(abs(step)), 6) AS mean_abs FROM s GROUP BY 1""")
def interval_stats(spark, sf_dir):
    s = sequence.steps(events(spark, sf_dir), ["user_id"], ["event_id"], "cents")
    return s.groupBy("user_id").agg(F.count("step").alias("n"), F.round(F.count_if(F.abs("step") <= 1200) / F.greatest(F.count("step"), F.lit(1)), 6).alias("small"), F.round(F.avg(F.abs("step")), 6).alias("mean_abs"))


@query(f"""WITH {EV}, m AS (SELECT user_id, event_type = 'view' AS h, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM ev),
  r AS (SELECT user_id, i, count(*) FILTER (h) AS n FROM m GROUP BY 1, 2) SELECT user_id, max(n) AS longest FROM r GROUP BY 1""")
def longest_run(spark, sf_dir):
    return sequence.longest_run(events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "view")


@query(f"""WITH {EV}, s AS (SELECT user_id, cents - lag(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM ev)
  SELECT user_id, count(*) >= 4 AND coalesce(bool_or(d > 0), false) AND coalesce(bool_or(d < 0), false) AS both_ways FROM s GROUP BY 1""")
def direction_change(spark, sf_dir):
    s = sequence.steps(events(spark, sf_dir), ["user_id"], ["event_id"], "cents")
    up, down = (F.coalesce(F.bool_or(c), F.lit(False)) for c in (F.col("step") > 0, F.col("step") < 0))
    return s.groupBy("user_id").agg(((F.count("*") >= 4) & up & down).alias("both_ways"))


# -- two versions of one log ----------------------------------------------------------------------

PAIRS = f"""a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ev),
  b AS (SELECT user_id, us + (event_id % 7 - 3) * 1000000 AS us, cents + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS cents, event_id FROM ev),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM b),
  pa AS (SELECT a.user_id, a.k, a.us AS us_a, b2.us AS us_b, b2.us - a.us AS d_on, b2.cents - a.cents AS d_pitch FROM a JOIN b2 USING (user_id, k))"""


def _pairs(spark, sf_dir):
    a = events(spark, sf_dir)
    b = a.select("user_id", "event_id", (F.col("us") + (F.col("event_id") % 7 - 3) * 1000000).alias("us"), (F.col("cents") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).alias("cents"))
    return align.by_index(a, b, "user_id", ["event_id"], "us", "cents")


@query(f"WITH {EV}, {PAIRS} SELECT user_id, k, d_on, d_pitch FROM pa")
def tolerance_align(spark, sf_dir):
    return _pairs(spark, sf_dir).select("user_id", "k", "d_on", "d_pitch")


@query(f"""WITH {EV}, {PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(d_on), k) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM pa)
  SELECT user_id, n, round(avg(d_on), 6) AS mean_on, round(median(d_on), 6) AS median_on, max(abs(d_on)) FILTER (r = least(CAST(floor(0.95 * n) AS BIGINT), n - 1) + 1) AS p95_on,
  max(abs(d_on)) AS max_on, count(*) FILTER (d_pitch <> 0) AS mismatches FROM o GROUP BY user_id, n""")
def drift_stats(spark, sf_dir):
    return align.drift(_pairs(spark, sf_dir), "user_id")


@query(f"WITH {EV}, {PAIRS}, r AS (SELECT *, coalesce(lead(us_b) OVER (PARTITION BY user_id ORDER BY k) < us_b, false) AS x FROM pa) SELECT user_id, count(*) FILTER (x) AS reordered FROM r GROUP BY 1")
def reorder_flag(spark, sf_dir):
    r = sequence.reorders(_pairs(spark, sf_dir), ["user_id"], ["k"], "us_b")
    return r.groupBy("user_id").agg(F.count_if("reordered").alias("reordered"))


@query(f"""WITH {EV}, {INTERVALS} SELECT e.event_id, coalesce((SELECT arg_max(coalesce(i.ends, 9223372036854775807), i.event_id) FROM iv i WHERE i.user_id = e.user_id AND i.us <= e.us) > e.us, false) AS inside
  FROM ev e WHERE event_type = 'purchase'""")
def interval_probe(spark, sf_dir):
    points = events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "us")
    return sequence.last_before(points, _intervals(spark, sf_dir).select("user_id", F.col("us").alias("begins"), "ends"), "user_id", "us", "begins", "ends").select("event_id", "inside")


BINS = augment.WAIT_BINS


@query(f"""WITH {EV}, bl AS (SELECT list_sort(list_distinct(list_transform(range(64), lambda k: CAST(round(exp(ln(3000000) * k / 63)) AS BIGINT)))) AS l), q AS (SELECT event_id, cents, l, list_position(list_transform(l, lambda b: b >= cents), true) AS p FROM ev, bl),
  u AS (SELECT *, CASE WHEN p IS NULL OR p = 0 THEN len(l) ELSE p END AS up FROM q),
  n AS (SELECT event_id, l, CASE WHEN up > 1 AND cents - l[up - 1] < l[up] - cents THEN up - 2 ELSE up - 1 END AS bin FROM u)
  SELECT event_id, CAST(bin AS INTEGER) AS bin, CAST(l[bin + 1] AS INTEGER) AS wait FROM n""")
def wait_bins(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", nearest_bin(F.col("cents"), BINS).alias("bin"))
    return e.withColumn("wait", bin_value(F.col("bin"), BINS))


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ev), r AS (SELECT user_id, event_id, k, value AS ema, false AS spike FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, CAST(0.98 AS DOUBLE) * r.ema + (1 - CAST(0.98 AS DOUBLE)) * o.value, o.value > 5 * r.ema FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, event_id, round(ema, 9) AS ema, spike FROM r""")
def ema_spike(spark, sf_dir):
    """Exponential mean of each track's values, and values beyond five times it."""
    return analysis.ema(events(spark, sf_dir), "user_id", ["event_id"], "value", 0.98, 5.0)
