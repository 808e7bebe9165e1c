"""Queries over made onsets: tempo, beats, phases and tempo maps, with the whole rule written out in SQL.

A user is a track. Each event gives three onsets, so many bins of ten milliseconds after one another,
with an offset within the bin by the event's value; for every other user the second half of the
events has another step, so that its tempo changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.operators import sections, tracks
from seqmill.plans.logs import EV, events
from seqmill.plans.registry import query
from seqmill.session import stored

MADE = f"""{EV}, od AS (SELECT user_id, event_id, cents, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  st AS (SELECT *, CASE WHEN user_id % 2 = 0 AND 2 * k > n THEN 55 + user_id % 17 ELSE 40 + user_id % 30 END AS step FROM od),
  af AS (SELECT *, coalesce(sum(3 * step) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st),
  onsets AS (SELECT user_id, CAST((before + r * step) * 441 + (cents + r) % 3 * 147 AS BIGINT) AS pos FROM af, range(3) x(r)),
  ends AS (SELECT user_id, max(pos) + 22050 AS total FROM onsets GROUP BY 1)"""


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notes of one channel, and the tracks' lengths."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf_dir).withColumns({"k": F.row_number().over(w), "n": F.count("*").over(W.partitionBy("user_id"))})
    u = F.col("user_id")
    e = e.withColumn("step", F.when((u % 2 == 0) & (2 * F.col("k") > F.col("n")), 55 + u % 17).otherwise(40 + u % 30))
    e = e.withColumn("before", F.coalesce(F.sum(3 * F.col("step")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2))))
    at = ((F.col("before") + F.col("r") * F.col("step")) * 441 + (F.col("cents") + F.col("r")) % 3 * 147).cast("long")
    notes = stored(e.select(F.concat(F.lit("user"), u.cast("string")).alias("track_id"), F.lit(0).alias("channel"), at.alias("sample_on")), "onsets")
    return notes, notes.groupBy("track_id").agg((F.max("sample_on") + 22050).alias("total_samples"))


def _tempi(name: str, stretches: str, least: bool = True) -> str:
    """CTEs that give the ``tempo`` of each stretch (user_id, b, e) of a relation; null where it has none of its own."""
    return f"""{name}_s AS MATERIALIZED (SELECT DISTINCT user_id, b, e FROM {stretches} WHERE b IS NOT NULL AND e IS NOT NULL),
  {name}_h AS MATERIALIZED (SELECT user_id, b, e, least((pos - b) // 441, (e - b) // 441) AS bin, count(*) AS c FROM {name}_s JOIN onsets USING (user_id) WHERE pos >= b AND pos < e GROUP BY ALL),
  {name}_r AS MATERIALIZED (SELECT x.user_id, x.b, x.e, y.bin - x.bin AS lag, sum(x.c * y.c) AS r FROM {name}_h x JOIN {name}_h y ON x.user_id = y.user_id AND x.b = y.b AND x.e = y.e AND y.bin - x.bin BETWEEN 20 AND least(120, (x.e - x.b) // 441) GROUP BY ALL),
  {name}_p AS MATERIALIZED (SELECT user_id, b, e, max({{'r': r, 'l': -lag}}) AS top FROM {name}_r GROUP BY ALL),
  {name}_q AS MATERIALIZED (SELECT p.user_id, p.b, p.e, -top.l AS lag, top.r AS r, coalesce(max(n.r) FILTER (n.lag = -top.l - 1), 0) AS lo, coalesce(max(n.r) FILTER (n.lag = -top.l + 1), 0) AS hi FROM {name}_p p LEFT JOIN {name}_r n ON n.user_id = p.user_id AND n.b = p.b AND n.e = p.e GROUP BY ALL),
  {name}_n AS MATERIALIZED (SELECT user_id, b, e, sum(c) AS n FROM {name}_h GROUP BY ALL),
  {name} AS MATERIALIZED (SELECT s.user_id, s.b, s.e, CASE WHEN {"s.e - s.b < 661500 OR coalesce(n, 0) < 8 THEN NULL WHEN" if least else "coalesce(n, 0) < 8 THEN 120.0 WHEN"} q.lag IS NULL THEN 120.0
    ELSE greatest(50.0, least(300.0, 6000.0 / (q.lag + CASE WHEN q.lag > 20 AND q.lag < least(120, (s.e - s.b) // 441) AND lo + hi - 2 * q.r <> 0 THEN 0.5 * (lo - hi) / (lo + hi - 2 * q.r) ELSE 0 END))) END AS tempo
    FROM {name}_s s LEFT JOIN {name}_n USING (user_id, b, e) LEFT JOIN {name}_q q USING (user_id, b, e))"""


def _cut(name: str, stretches: str) -> str:
    """CTEs of one round of cuts: ``{name}`` has the stretches of a relation (user_id, b, e, depth), those that change tempo in two."""
    out = [
        f"{name}_a AS (SELECT user_id, b, (b + e) // 2 AS e FROM {stretches} UNION ALL SELECT user_id, (b + e) // 2, e FROM {stretches})",
        _tempi(f"{name}_t", f"{name}_a"),
        f"""{name}_0 AS MATERIALIZED (SELECT s.user_id, s.b, s.e, x.tempo AS x, y.tempo AS y, s.b + 661500 AS low, s.e - 661500 AS high, false AS done FROM {stretches} s JOIN {name}_t x ON x.user_id = s.user_id AND x.b = s.b AND x.e = (s.b + s.e) // 2
      JOIN {name}_t y ON y.user_id = s.user_id AND y.b = (s.b + s.e) // 2 AND y.e = s.e WHERE s.e - s.b >= 1323000 AND x.tempo IS NOT NULL AND y.tempo IS NOT NULL AND abs(x.tempo - y.tempo) >= 0.06 * greatest(x.tempo, y.tempo))""",
    ]
    for k in range(8):
        out += [
            f"{name}_a{k} AS (SELECT user_id, b, (low + high) // 2 AS e FROM {name}_{k} WHERE NOT done UNION ALL SELECT user_id, (low + high) // 2, e FROM {name}_{k} WHERE NOT done)",
            _tempi(f"{name}_t{k}", f"{name}_a{k}"),
            f"""{name}_{k + 1} AS MATERIALIZED (SELECT c.user_id, c.b, c.e, c.x, c.y, CASE WHEN stop OR abs(l - x) > abs(r - y) THEN low ELSE (low + high) // 2 END AS low, CASE WHEN stop OR abs(l - x) <= abs(r - y) THEN high ELSE (low + high) // 2 END AS high, stop AS done
          FROM (SELECT c.*, p.tempo AS l, q.tempo AS r, done OR NOT (low < (low + high) // 2 AND (low + high) // 2 < high) OR p.tempo IS NULL OR q.tempo IS NULL AS stop FROM {name}_{k} c
            LEFT JOIN {name}_t{k} p ON p.user_id = c.user_id AND p.b = c.b AND p.e = (low + high) // 2 LEFT JOIN {name}_t{k} q ON q.user_id = c.user_id AND q.b = (low + high) // 2 AND q.e = c.e) c)""",
        ]
    out.append(f"""{name} AS MATERIALIZED (SELECT s.user_id, s.b, s.e FROM {stretches} s ANTI JOIN {name}_8 c ON c.user_id = s.user_id AND c.b = s.b AND c.e = s.e
      UNION ALL SELECT user_id, b, (low + high) // 2 FROM {name}_8 UNION ALL SELECT user_id, (low + high) // 2, e FROM {name}_8)""")
    return ",\n  ".join(out)


#: A stretch without a tempo of its own is left out before it is cut and after.
MAP = f"""WITH {MADE}, w0 AS (SELECT user_id, CAST(0 AS BIGINT) AS b, total AS e FROM ends), {_tempi("t0", "w0")}, v0 AS (SELECT user_id, b, e FROM t0 WHERE tempo IS NOT NULL), {_cut("c1", "v0")},
  {_tempi("t1", "c1")}, v1 AS (SELECT user_id, b, e FROM t1 WHERE tempo IS NOT NULL), {_cut("c2", "v1")}, {_tempi("t2", "c2")}, {_tempi("tw", "w0", least=False)},
  mp AS (SELECT user_id, b, e, tempo FROM t2 WHERE tempo IS NOT NULL UNION ALL SELECT user_id, b, e, tempo FROM tw WHERE user_id NOT IN (SELECT user_id FROM t2 WHERE tempo IS NOT NULL))"""


@query(f"""{MAP} SELECT 'user' || user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY b) - 1 AS INTEGER) AS section, round(b / 44100, 6) AS second, round(tempo, 6) AS tempo FROM mp""")
def tempo_map(spark, sf_dir):
    """Sections of each track by tempo."""
    r = tracks.rhythm(*_made(spark, sf_dir))
    return r.select("track_id", F.posexplode("sections").alias("section", "s")).select("track_id", "section", F.round("s.second", 6).alias("second"), F.round("s.tempo", 6).alias("tempo"))


#: The comb of a beat: of all shifts the one that meets most onsets, moved back to the first onset, or snapped to it.
def _phases(name: str, stretches: str) -> str:
    """CTEs that give the ``phase`` of each stretch (user_id, b, e, tempo), in seconds from its begin."""
    return f"""{name}_h AS MATERIALIZED (SELECT s.user_id, s.b, s.e, tempo, least((pos - s.b) // 441, (s.e - s.b) // 441) AS bin, count(*) AS c, min(pos - s.b) AS first FROM {stretches} s JOIN onsets USING (user_id) WHERE pos >= s.b AND pos < s.e GROUP BY ALL),
  {name}_n AS (SELECT user_id, b, e, tempo, sum(c) AS n, min(first) / 44100 AS first, 60 / tempo AS beat, 60 / tempo * 44100 / 441 AS period, (e - b) // 441 + 1 AS bins FROM {name}_h GROUP BY ALL),
  {name}_k AS (SELECT *, unnest(range(greatest(1, CAST(round_even(period, 0) AS BIGINT)))) AS shift FROM {name}_n WHERE n >= 4),
  {name}_g AS MATERIALIZED (SELECT user_id, b, e, shift, CAST(round_even(shift + unnest(range(CAST(floor(bins / period) AS BIGINT) + 2)) * period, 0) AS BIGINT) AS bin FROM {name}_k),
  {name}_m AS (SELECT g.user_id, g.b, g.e, shift, sum(coalesce(c, 0)) AS met FROM {name}_g g LEFT JOIN {name}_h h ON h.user_id = g.user_id AND h.b = g.b AND h.e = g.e AND h.bin = g.bin GROUP BY ALL),
  {name}_b AS (SELECT user_id, b, e, -max({{'m': met, 's': -shift}}).s * 441 / 44100 AS start FROM {name}_m GROUP BY ALL),
  {name}_c AS (SELECT n.*, start - greatest(0, ceil((start - first) / beat)) * beat AS back FROM {name}_n n JOIN {name}_b USING (user_id, b, e)),
  {name} AS MATERIALIZED (SELECT user_id, b, e, greatest(0, CASE WHEN first - back > 0 AND first - back < beat / 8 THEN first ELSE back END) AS phase FROM {name}_c)"""


METER = """bp AS (SELECT user_id, tempo, CAST(greatest(60, least(240, ceil(tempo - 0.5))) AS BIGINT) AS bpm, e AS total FROM tw), hb AS (SELECT user_id, least(pos // 441, total // 441) AS bin, count(*) AS c FROM onsets JOIN ends USING (user_id) GROUP BY ALL),
  lg AS (SELECT user_id, k, least(CAST(round_even(k * (44100 * 60.0 / bpm) / 441, 0) AS BIGINT), total // 441) AS lag FROM bp, range(2, 5) r(k)),
  rk AS (SELECT lg.user_id, k, coalesce(sum(x.c * y.c), 0) AS r FROM lg LEFT JOIN (hb x JOIN hb y ON x.user_id = y.user_id) ON x.user_id = lg.user_id AND y.bin = x.bin + lg.lag GROUP BY ALL),
  rr AS (SELECT user_id, max(r) FILTER (k = 2) AS two, max(r) FILTER (k = 3) AS three, max(r) FILTER (k = 4) AS four FROM rk GROUP BY 1), nn AS (SELECT user_id, count(*) AS n FROM onsets GROUP BY 1),
  mt AS (SELECT user_id, CASE WHEN n < 12 THEN 4 WHEN two >= greatest(three, four) THEN CASE WHEN two >= 1.5 * greatest(three, four) AND four <= 0.7 * two THEN 2 ELSE 4 END WHEN three > four AND three >= 1.5 * greatest(two, four) THEN 3 ELSE 4 END AS beats FROM rr JOIN nn USING (user_id))"""


@query(f"""WITH {MADE}, w0 AS (SELECT user_id, CAST(0 AS BIGINT) AS b, total AS e FROM ends), {_tempi("tw", "w0", least=False)}, {METER}, {_phases("ph", "tw")}
  SELECT 'user' || user_id AS track_id, round(bp.tempo, 6) AS tempo, CAST(bpm AS INTEGER) AS bpm, CAST(beats AS INTEGER) AS beats, round(coalesce(phase, 0), 6) AS first_beat FROM bp JOIN mt USING (user_id) LEFT JOIN ph USING (user_id)""")
def track_rhythm(spark, sf_dir):
    """Tempo, beats in a bar and first beat of each track."""
    r = tracks.rhythm(*_made(spark, sf_dir))
    return r.select("track_id", F.round("tempo", 6).alias("tempo"), "bpm", "beats", F.round("first_beat", 6).alias("first_beat"))


@query(f"""{MAP}, {_phases("ph", "mp")} SELECT 'user' || user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY b) - 1 AS INTEGER) AS section, round(b / 44100 + coalesce(phase, 0), 6) AS first_beat FROM mp LEFT JOIN ph USING (user_id, b, e)""")
def section_phases(spark, sf_dir):
    """First beat of each section, by its own onsets."""
    notes, heads = _made(spark, sf_dir)
    r = stored(tracks.rhythm(notes, heads), "rhythm")
    maps = sections.tempo_maps(notes, sections.boundaries(r, heads))
    return maps.select("track_id", "section", F.round("first_beat", 6).alias("first_beat"))
