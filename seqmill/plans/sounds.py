"""Queries over made sounds, and over what lands in a folder in two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmill.functions import music
from seqmill.operators import pitch
from seqmill.plans.logs import EV, events
from seqmill.plans.registry import query
from seqmill.session import scratch_path, table
from seqmill.sources import landing


@query(f"WITH {EV} SELECT event_id, CAST(45 + cents % 36 AS INTEGER) AS midi FROM ev")
def tone_pitch(spark, sf_dir):
    """Each event as a tone of 64 ms with two overtones: the pitch that is heard."""
    e = events(spark, sf_dir).withColumn("hz", 110 * F.pow(F.lit(2.0), (F.col("cents") % 36) / 12))
    turn = lambda i, k: F.sin(i * k * 2 * F.pi() * F.col("hz") / 8000)
    wave = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: (turn(i, 1) + turn(i, 2) / 2 + turn(i, 3) / 4).cast("float"))
    sounds = e.select(F.col("event_id").cast("string").alias("path"), F.lit(8000).alias("rate"), wave.alias("samples"))
    heard = pitch.track(pitch.frames(sounds, 512, 512))
    return heard.select(F.col("path").cast("long").alias("event_id"), music.hz_to_midi(F.col("refined")).alias("midi"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS run, coalesce(html, '') AS html FROM pages), n AS (SELECT run, count(*) AS new, count(DISTINCT html) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.run < p.run AND q.html = p.html)) AS contents FROM p GROUP BY 1)
  SELECT page_id, CAST(run AS INTEGER) AS run, new, contents FROM p JOIN n USING (run)""")
def landed_pages(spark, sf_dir):
    """A third of the pages lands, then all of them: each has landed once, and the second run brought the others."""
    path = scratch_path(spark, "landed")
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    runs = [landing.land(p, path, "page_id", "html") for p in (pages.where("page_id % 3 = 0"), pages, pages)]
    counts = spark.createDataFrame([(r["run"], r["new"], r["contents"]) for r in runs[:2]], "run int, new long, contents long")
    return landing.read(spark, path).select("page_id", "run").join(F.broadcast(counts), "run")
