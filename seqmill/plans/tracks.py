"""Queries over binary register logs. The logs are made from ``events``: each user's rows become one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.functions import music
from seqmill.operators import analysis, chips, prepare_text, score, tokens
from seqmill.plans.logs import EV, events
from seqmill.plans.registry import query
from seqmill.session import stored
from seqmill.sources import vgm


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows of logs: a click keys a note on the first channel on, a view keys it off; each waits before."""
    e = events(spark, sf_dir)
    midi = 48 + F.col("cents") % 24
    wait = 735 * (1 + F.col("event_id") % 5)
    fnum = music.midi_to_fnumber(midi, F.lit(4))
    row = lambda k, t, r, v: F.struct(F.lit(k).alias("k"), F.lit(t).cast("tinyint").alias("type"), F.lit(r).cast("smallint").alias("register"), v.cast("int").alias("value"))
    on = F.array(row(0, vgm.WAIT, 0, wait), row(1, vgm.PORT0, 0xA4, F.lit(4 << 3) + F.shiftright(fnum, 8)), row(2, vgm.PORT0, 0xA0, fnum.bitwiseAND(255)), row(3, vgm.PORT0, 0x28, F.lit(0xF0)))
    off = F.array(row(0, vgm.WAIT, 0, wait), row(1, vgm.PORT0, 0x28, F.lit(0)))
    rest = F.array(row(0, vgm.WAIT, 0, wait), row(1, vgm.PSG, 0, 0x80 + F.col("cents") % 64))
    rows = F.when(F.col("event_type") == "click", on).when(F.col("event_type") == "view", off).otherwise(rest)
    flat = e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("track_id"), "event_id", F.explode(rows).alias("x"))
    return flat.select("track_id", (F.col("event_id") * 4 + F.col("x.k")).alias("seq"), "x.type", "x.register", "x.value", F.lit(0).cast("long").alias("sample_pos"), F.lit(None).cast("long").alias("pcm_offset"), F.lit(None).cast("string").alias("error"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vgm.write_tracks(_rows(spark, sf_dir))


LOG = f"""WITH {EV}, w AS (SELECT *, CAST(sum(735 * (1 + event_id % 5)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clock FROM ev)"""


@query(f"""{LOG} SELECT 'user' || user_id AS track_id, CAST(sum(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 0 END) AS BIGINT) AS fm_writes, count(*) FILTER (event_type NOT IN ('click', 'view')) AS psg_writes,
  count(*) AS waits, max(clock) AS samples FROM w GROUP BY 1""")
def log_roundtrip(spark, sf_dir):
    """Rows to bytes to rows: what the files hold when they are read back."""
    e = vgm.read_events(_files(spark, sf_dir))
    t = F.col("type")
    return e.groupBy("track_id").agg(F.count_if(t == vgm.PORT0).alias("fm_writes"), F.count_if(t == vgm.PSG).alias("psg_writes"), F.count_if(t == vgm.WAIT).alias("waits"), F.sum(F.when(t == vgm.WAIT, F.col("value"))).alias("samples"))


@query(f"""{LOG} SELECT 'user' || user_id AS track_id, '1.71' AS version_string, max(clock) AS total_samples, round(max(clock) / 44100, 6) AS seconds, bool_or(event_type = 'click') AS has_fm_notes FROM w GROUP BY 1""")
def log_headers(spark, sf_dir):
    h = vgm.read_headers(_files(spark, sf_dir))
    return h.select("track_id", "version_string", "total_samples", F.round("seconds", 6).alias("seconds"), "has_fm_notes")


@query(f"""{LOG} SELECT 'user' || user_id AS track_id, CAST(sum(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 0 END) AS BIGINT) AS fm_writes, CAST(0 AS BIGINT) AS ends, max(clock) AS samples, bool_or(event_type = 'click') AS has_fm_notes FROM w GROUP BY 1""")
def log_bounds(spark, sf_dir):
    """Logs without an end mark, followed by more: they end where their header says."""
    unmarked = F.concat(F.expr("substring(content, 1, length(content) - 1)"), F.unhex(F.lit("64")), F.unhex(F.lit("5228F0627066")))
    files = stored(_files(spark, sf_dir).withColumn("content", unmarked), "logs")
    e, t = vgm.read_events(files), F.col("type")
    counts = e.groupBy("track_id").agg(F.count_if(t == vgm.PORT0).alias("fm_writes"), F.count_if(t == vgm.END).alias("ends"), F.sum(F.when(t == vgm.WAIT, F.col("value"))).alias("samples"))
    return counts.join(vgm.read_headers(files).select("track_id", "has_fm_notes"), "track_id")


NOTES = f"""{LOG}, t AS (SELECT user_id, max(clock) AS stops FROM w GROUP BY 1), g AS (SELECT user_id, event_type, clock, cents, lead(clock) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM w WHERE event_type IN ('click', 'view'))
  , n AS (SELECT g.user_id, 48 + cents % 24 AS pitch, clock AS sample_on, coalesce(nxt, stops) AS sample_off FROM g JOIN t USING (user_id) WHERE event_type = 'click')"""


@query(f"{NOTES} SELECT 'user' || user_id AS track_id, CAST(pitch AS INTEGER) AS pitch, sample_on, sample_off FROM n")
def log_notes(spark, sf_dir):
    """Notes of the first FM channel, by the decoder."""
    n = chips.decode_notes(vgm.read_events(_files(spark, sf_dir)))
    return n.where("channel = 0").select("track_id", "pitch", "sample_on", "sample_off")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(_files(spark, sf_dir), "logs")
    e = vgm.read_events(files)
    heads = vgm.read_headers(files).where("error IS NULL")
    notes = stored(score.split_notes(score.reclassify(chips.decode_notes(e))), "notes")
    tracks = heads.select("track_id", F.lit(120).alias("bpm"), F.lit(0).alias("key_index"), F.lit(False).alias("is_minor"), F.lit(4).alias("beats"), F.lit(None).cast("int").alias("composer"), F.lit(None).cast("int").alias("game"), F.lit(None).cast("int").alias("context"), F.col("loop").isNotNull().alias("has_loop"))
    stats = analysis.channel_stats(notes.withColumn("key", F.struct("track_id", "channel")), "key", "pitch", "sample_on", 44100)
    c = F.col("key.channel")
    roles = stats.select("key.track_id", "key.channel", analysis.role(c == chips.DRUM, c == chips.NOISE, F.col("mean"), F.col("density")).alias("role"))
    return score.encode(notes, score.hardware_changes(e, heads), tracks, roles)


@query(f"""{NOTES} SELECT 'user' || user_id AS track_id, count(*) AS notes FROM n GROUP BY 1""")
def log_encode(spark, sf_dir):
    """Notes that come back out of the token sequences: none is lost."""
    back = score.decode(_encoded(spark, sf_dir))
    return back.where("channel = 0").groupBy("track_id").agg(F.count("*").alias("notes"))


#: Note texts of the logs: the pitch of a written F-number, on the scale and clock of note texts; the nearest bin of each wait.
TEXT = f"""{LOG}, bl AS (SELECT list_sort(list_distinct(list_transform(range(64), lambda k: CAST(round(exp(ln(3000000) * k / 63)) AS BIGINT)))) AS l),
  q AS (SELECT w.*, l, 735 * (1 + event_id % 5) AS wait, list_position(list_transform(l, lambda b: b >= 735 * (1 + event_id % 5)), true) AS up, 48 + cents % 24 AS pitch FROM w, bl),
  b AS (SELECT *, CAST(CASE WHEN wait - l[up - 1] < l[up] - wait THEN up - 2 ELSE up - 1 END AS BIGINT) AS bin, round_even(440 * power(2, (pitch - 69) / 12) * 144 * 65536 / 7670454, 0) AS fnum FROM q),
  m AS (SELECT *, CAST(round_even(69 + 12 * log2(fnum * 7670453 / (144 * 131072) / 440), 0) AS BIGINT) AS midi FROM b),
  nt AS (SELECT *, ['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'][midi % 12 + 1] || (midi // 12 - 1) AS note FROM m),
  kv AS (SELECT event_id, lag(event_type) OVER w = 'click' AND lag(midi) OVER w <> midi AS bends FROM nt WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  tt AS (SELECT user_id, event_id, event_type, bin, midi, unnest(range(3)) AS k, unnest(['<WAIT:' || bin || '>', CASE WHEN event_type = 'click' AND bends THEN 'CH1:PITCH:' || note END,
    CASE event_type WHEN 'click' THEN 'CH1:ON:' || note WHEN 'view' THEN 'CH1:OFF' ELSE 'PSG:' || format('{{:02X}}', 128 + cents % 64) END]) AS token FROM nt LEFT JOIN kv USING (event_id))"""
#: A pitch that is written while the key is down bends the note before the key strikes again.


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.note_tokens(vgm.read_events(_files(spark, sf_dir)))


@query(f"{TEXT} SELECT token, count(*) AS n FROM tt WHERE token IS NOT NULL GROUP BY 1")
def note_text_counts(spark, sf_dir):
    """Logs as note texts: how often each occurs."""
    return _texts(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""{TEXT}, c AS (SELECT token, count(*) AS n FROM tt WHERE token NOT LIKE '<%' GROUP BY 1 HAVING count(*) >= 2)
  SELECT CAST(4 AS BIGINT) AS special, CAST(61 AS BIGINT) AS waits, count(*) FILTER (token LIKE 'CH%') AS notes, count(*) FILTER (token NOT LIKE 'CH%') AS writes, 65 + count(*) AS size FROM c""")
def note_vocabulary(spark, sf_dir):
    """The vocabulary of note texts, by kind."""
    return tokens.vocabulary_summary(tokens.build_vocabulary(_texts(spark, sf_dir)))


@query(f"""{TEXT}, rc AS (SELECT user_id, event_id, event_type, pitch, sum(l[bin + 1]) OVER (PARTITION BY user_id ORDER BY event_id) AS clock, sum(l[bin + 1]) OVER (PARTITION BY user_id) AS stops FROM nt),
  rk AS (SELECT *, lead(clock) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM rc WHERE event_type IN ('click', 'view'))
  SELECT 'user' || user_id AS track_id, CAST(pitch AS INTEGER) AS pitch, CAST(clock AS BIGINT) AS sample_on, CAST(coalesce(nxt, stops) AS BIGINT) AS sample_off FROM rk WHERE event_type = 'click'""")
def note_text_roundtrip(spark, sf_dir):
    """Writes to note texts, to ids, to texts, to writes, to bytes, to notes: every note comes back, at the waits' bins."""
    texts = stored(_texts(spark, sf_dir), "texts")
    vocabulary = stored(tokens.build_vocabulary(texts, least=1), "vocabulary")
    back = tokens.token_strings(tokens.encode(texts, vocabulary, marks=True), vocabulary)
    logs = vgm.write_tracks(tokens.note_writes(back, changes_only=True))
    return chips.decode_notes(vgm.read_events(logs)).where("channel < 6").select("track_id", "pitch", "sample_on", "sample_off")


@query(f"""WITH {EV}, mi AS (SELECT event_id, CAST(cents % 128 AS INTEGER) AS midi, 440 * power(2, (cents % 128 - 69) / 12) AS hz FROM ev), tr AS (SELECT *, CAST(b AS INTEGER) AS block, round_even(hz * (144 * power(2, 21 - b)) / 7670453, 0) AS fnum FROM mi, range(8) r(b)),
  er AS (SELECT event_id, midi, hz, b, block, fnum, abs(fnum * 7670453 / (144 * power(2, 21 - b)) - hz) AS error FROM tr WHERE fnum BETWEEN 1 AND 2047 UNION ALL SELECT event_id, midi, hz, 0, 0, 0, 1e9 FROM mi)
  SELECT event_id, midi, CAST(fnum AS INTEGER) AS fnum, block, CASE WHEN fnum = 0 THEN -1 ELSE CAST(round_even(69 + 12 * log2(fnum * 7670453 / (144 * power(2, 21 - block)) / 440), 0) AS INTEGER) END AS sounds FROM er QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY error, block) = 1""")
def least_error_tuning(spark, sf_dir):
    """F-number and block of least error for each event's pitch, and the pitch that they sound."""
    e = events(spark, sf_dir).select("event_id", (F.col("cents") % 128).cast("int").alias("midi"))
    tuned = e.withColumn("t", music.least_error(F.col("midi"))).select("event_id", "midi", "t.fnum", "t.block")
    return tuned.withColumn("sounds", music.fnumber_to_midi(F.col("fnum"), F.col("block"), music.TEXT_CLOCK, music.TEXT_SCALE))


#: Sequences from strings: ids of the vocabulary, marks, the track's name decides on validation.
CODED = """vc AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 64 AS id FROM {strings} WHERE token NOT LIKE '%WAIT:%' GROUP BY 1 HAVING count(*) >= 2)"""
HASHED = "CASE WHEN CAST('0x' || substr(md5('user' || user_id), 1, 8) AS BIGINT) % 10000 < {below} THEN 'val' ELSE 'train' END"


def _digested(found: prepare_text.Texts) -> DataFrame:
    text = F.array_join(F.transform("ids", lambda t: t.cast("string")), ",")
    return found.sequences.select("track_id", "shift", "split", F.size("ids").alias("n"), F.md5(text.cast("binary")).alias("ids"))


@query(f"""{TEXT}, kt AS (SELECT * FROM tt WHERE token IS NOT NULL), {CODED.format(strings="kt")}, du AS (SELECT user_id, max(clock) / 44100 AS seconds, bool_or(event_type = 'click') AS notes FROM w GROUP BY 1), fu AS (SELECT user_id FROM du WHERE seconds >= 3.0 AND notes),
  sh AS (SELECT user_id, s FROM (SELECT user_id, min(midi) FILTER (token LIKE 'CH%:O%:%' OR token LIKE 'CH%:P%') AS low, max(midi) FILTER (token LIKE 'CH%:O%:%' OR token LIKE 'CH%:P%') AS high FROM kt GROUP BY 1), range(-5, 7) r(s) WHERE s = 0 OR low IS NULL OR (low + s >= 21 AND high + s <= 108)),
  mv AS (SELECT kt.user_id, s, event_id, k, bin, CASE WHEN token LIKE 'CH%:O%:%' OR token LIKE 'CH%:P%' THEN regexp_replace(token, '[^:]+$', ['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'][(midi + s) % 12 + 1] || ((midi + s) // 12 - 1)) ELSE token END AS token FROM kt JOIN sh USING (user_id)),
  cd AS (SELECT user_id, s, event_id, k, CASE WHEN token LIKE '<%' THEN 4 + bin ELSE id END AS id FROM mv LEFT JOIN vc USING (token)),
  sq AS (SELECT user_id, s, list_concat(list_concat([CAST(1 AS BIGINT)], coalesce(list(id ORDER BY event_id, k) FILTER (id IS NOT NULL), [])), [2]) AS ids FROM cd SEMI JOIN fu USING (user_id) GROUP BY 1, 2)
  SELECT 'user' || user_id AS track_id, CAST(s AS INTEGER) AS shift, {HASHED.format(below=2000)} AS split, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS ids FROM sq WHERE len(ids) >= 32 AND user_id IN (SELECT user_id FROM sq WHERE s = 0 AND len(ids) >= 32)""")
def prepare_v3(spark, sf_dir):
    """Note texts of all tracks that a table of measures lets pass, in all the keys that their notes allow."""
    files = stored(_files(spark, sf_dir), "logs")
    heads = vgm.read_headers(files).select("track_id", F.col("seconds").alias("duration"), F.col("has_fm_notes"))
    found = prepare_text.prepare(files, 3, vocabulary=stored(tokens.build_vocabulary(_texts(spark, sf_dir)), "vocabulary"), validation=0.2, measures=heads, shortest=3.0)
    return _digested(found)


@query(f"""{TEXT}, r1 AS (SELECT user_id, event_id, unnest(CASE event_type WHEN 'click' THEN ['WAIT:' || bin, 'P0:A4:' || format('{{:02X}}', 32 + CAST(fnum AS BIGINT) // 256), 'P0:A0:' || format('{{:02X}}', CAST(fnum AS BIGINT) % 256), 'P0:28:F0'] WHEN 'view' THEN ['WAIT:' || bin, 'P0:28:00', NULL, NULL] ELSE ['WAIT:' || bin, 'SN:00:' || format('{{:02X}}', 128 + cents % 64), NULL, NULL] END) AS token, unnest(range(4)) AS k, bin FROM nt),
  kt AS (SELECT * FROM r1 WHERE token IS NOT NULL), {CODED.format(strings="kt")}, cd AS (SELECT user_id, event_id, k, CASE WHEN token LIKE 'WAIT%' THEN 4 + bin ELSE id END AS id FROM kt LEFT JOIN vc USING (token)),
  sq AS (SELECT user_id, list_concat(list_concat([CAST(1 AS BIGINT)], coalesce(list(id ORDER BY event_id, k) FILTER (id IS NOT NULL), [])), [2]) AS ids FROM cd GROUP BY 1)
  SELECT 'user' || user_id AS track_id, CAST(0 AS INTEGER) AS shift, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS ids FROM sq WHERE len(ids) >= 32""")
def prepare_v1(spark, sf_dir):
    """Register texts of all tracks, by a vocabulary counted from them."""
    return _digested(prepare_text.prepare(_files(spark, sf_dir), 1)).drop("split")


@query(f"""{TEXT}, kt AS (SELECT * FROM tt WHERE token IS NOT NULL), {CODED.format(strings="kt")}, cd AS (SELECT user_id, CASE WHEN token LIKE '<%' THEN 4 + bin ELSE id END AS id FROM kt LEFT JOIN vc USING (token)),
  sq AS (SELECT user_id, count(id) + 2 AS n FROM cd GROUP BY 1), t AS (SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS tokens, greatest(1, CAST(floor(0.05 * count(*)) AS BIGINT)) AS val FROM sq WHERE n >= 32)
  SELECT files AS total_files, tokens AS total_tokens, val AS val_seqs, files - val AS train_seqs, (SELECT count(*) FROM sq WHERE n < 32) AS skipped_files, (SELECT count(*) FROM vc) + 65 AS vocab_size FROM t""")
def prepare_v2(spark, sf_dir):
    """Note texts of all tracks, written as flat arrays: the description beside them."""
    from seqmill.session import scratch_path

    path = scratch_path(spark, "texts")
    prepare_text.prepare(_files(spark, sf_dir), 2).write(path, seq_len=4096)
    keys = ["total_files", "total_tokens", "val_seqs", "train_seqs", "skipped_files", "vocab_size"]
    return spark.read.json(f"{path}/train/meta").select(*keys)
