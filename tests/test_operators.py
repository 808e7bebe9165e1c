import math

import pytest
from pyspark.sql import functions as F

from seqmill.functions import music, text
from seqmill.operators import align, analysis, augment, corpus
from seqmill.streaming import logs as streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_pitch_functions(spark):
    df = spark.range(24, 112).select(F.col("id").cast("int").alias("m"))
    back = df.withColumn("b", music.best_block(F.col("m"))).withColumn("f", music.midi_to_fnumber(F.col("m"), F.col("b")))
    assert back.where(music.fnumber_to_midi(F.col("f"), F.col("b")) != F.col("m")).count() == 0
    assert df.where(music.name_to_midi(music.midi_name(F.col("m"))) != F.col("m")).count() == 0
    row = one(spark, music.midi_name(F.lit(60)), music.db_to_velocity(F.lit(0.0)), music.db_to_velocity(F.lit(60.0)), music.fnumber_to_midi(F.lit(0), F.lit(4)), music.psg_velocity(F.lit(15)))
    assert tuple(row) == ("C4", 15, 0, -1, 0)


def test_bins(spark):
    bins = music.wait_bins()
    assert bins[0] == 1 and bins[-1] == 3_000_000 and bins == sorted(set(bins))
    near = lambda v: min(range(len(bins)), key=lambda k: (abs(bins[k] - v), -k))
    values = [0, 1, 2, 3, 5, 735, 882, 10**6, 10**7] + [(a + b) // 2 for a, b in zip(bins[:20], bins[1:21], strict=True)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r.b for r in df.select(music.nearest_bin(F.col("v"), bins).alias("b")).collect()] == [near(v) for v in values]
    got = one(spark, *[music.snap_tempo(F.lit(x)) for x in (59.0, 100.5, 100.51, 300.0)])
    assert tuple(got) == (60, 100, 101, 240)


def test_names(spark):
    got = one(spark, text.split_names(F.lit("A (x), Bob and Carol; d, (E)")), text.normal_name(F.lit(" Sonic (USA) ")), text.normal_name(F.lit("Game (Jungle Mix)")), text.largest_page(F.lit("x?page=3&page=12")), text.largest_page(F.lit("x")), text.safe_file_name(F.lit("é a/b.vgm")))
    assert tuple(got) == (["Bob", "Carol"], "sonic", "game", 12, 0, "é_a_b.vgm")


def test_cluster_bounds_and_order(spark):
    base = dict(pan_rate=0.0, max_fb=0, ic_rate=0.0, dac_frac=0.0, psg_frac=0.0, ssg_eg=0.0, lfo_frac=0.0, ch3_frac=0.0)
    cases = [({}, 1), ({"psg_frac": 0.35}, 1), ({"psg_frac": 0.36}, 2), ({"dac_frac": 0.399}, 1), ({"dac_frac": 0.41}, 3), ({"ssg_eg": 1.0}, 4), ({"ic_rate": 0.51, "dac_frac": 0.9}, 4), ({"pan_rate": 1.1, "ssg_eg": 1.0}, 5), ({"pan_rate": 1.0}, 1), ({"lfo_frac": 0.11}, 5), ({"ch3_frac": 0.06}, 5)]
    df = spark.createDataFrame([base | c | {"want": w} for c, w in cases])
    assert df.where(analysis.cluster() != F.col("want")).count() == 0


def test_augmentation_stops_at_the_ends(spark):
    t = [augment.TEMPO[0], augment.TEMPO[0] + 180, augment.KEY[0] + 11, augment.KEY[0] + 12, augment.PITCH[0], augment.PITCH[0] + 87, augment.VELOCITY[0], augment.VELOCITY[0] + 15, 1]
    df = spark.createDataFrame([(t,)], "t array<int>")
    up, tempo, vel = df.select(augment.transpose(F.col("t"), 3), augment.shift_tempo(F.col("t"), 1.5), augment.shift_velocity(F.col("t"), 1)).first()
    k, p, v = augment.KEY[0], augment.PITCH[0], augment.VELOCITY[0]
    assert up == [4, 184, k + 2, k + 15, p + 3, p + 87, v, v + 15, 1]
    assert tempo == [4 + 30, 184, *t[2:]] and vel == [*t[:6], v + 1, v + 15, 1]
    assert df.select(F.lit(1).alias("id"), "t").transform(lambda d: augment.fan_out(d, "t")).count() == 18


def test_windows(spark):
    df = spark.createDataFrame([(k, list(range(10 * k, 10 * k + 10))) for k in range(65)], "id int, t array<int>")
    got = augment.windows(df, "id", "t", 64).orderBy("window").collect()
    assert len(got) == 10
    flat = list(range(650))
    for w in got:
        at = w.window * 65
        assert w.input_ids == flat[at : at + 64] and w.labels == [-100 if x == 0 else x for x in flat[at + 1 : at + 65]]
    padded = augment.windows(spark.createDataFrame([(1, [1, 0, 2, 0, 3])], "id int, t array<int>"), "id", "t", 4).first()
    assert padded.labels == [-100, 2, -100, 3]


def test_greedy_alignment(spark):
    a = spark.createDataFrame([("x", 60, 0), ("x", 60, 100), ("x", 62, 200), ("x", 60, 900)], "ch string, pitch long, on long")
    b = spark.createDataFrame([("x", 60, 10), ("x", 60, 90), ("x", 64, 200), ("y", 1, 1)], "ch string, pitch long, on long")
    got = sorted(((r.ch, r.pitch, r.on_a, r.on_b) for r in align.greedy(a, b, "ch", 50).collect()), key=str)
    want = [("x", 60, 0, 10), ("x", 60, 100, 90), ("x", 60, 900, None), ("x", 62, 200, None), ("x", 64, None, 200), ("y", 1, None, 1)]
    assert got == sorted(want, key=str)


def test_first_wins_and_bounds(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "id int, t string")
    assert sorted(r.id for r in corpus.first_wins(df.where("t IS NOT NULL"), F.col("t"), ["id"]).collect()) == [1]
    with pytest.raises(ValueError):
        corpus.nearest_l1(df, "id", "t", spark.createDataFrame([(k, [0.0]) for k in range(129)], "lib int, vec array<double>"))
    assert corpus.entropy(spark.createDataFrame([(1, k % 4) for k in range(40)], "k int, t int"), "k", "t").first().bits == 2.0


def test_mean_of_a_track(spark):
    df = spark.createDataFrame([(t, k, float(k % 7 + (50 if k == 30 else 0))) for t in (1, 2) for k in range(40)], "t int, k int, v double")
    got = {(r.t, r.k): r for r in analysis.ema(df, "t", ["k"], "v", 0.98, 5.0).collect()}
    mean = None
    for k in range(40):
        v = k % 7 + (50 if k == 30 else 0)
        assert got[1, k].spike == (mean is not None and v > 5 * mean)
        mean = v if mean is None else 0.98 * mean + 0.02 * v
        assert math.isclose(got[1, k].ema, mean, abs_tol=1e-8)


# -- streams against batches ----------------------------------------------------------------------


@pytest.fixture
def log(spark, tmp_path):
    """Rows in four files, read one file a batch."""
    rows = [(k, k % 5, ["click", "view", "purchase", "click"][(k * 7 // 3) % 4], (k * k) % 9) for k in range(400)]
    schema = "event_id long, user_id long, kind string, value long"
    base = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600))
    for f in range(4):
        base.where(f"event_id DIV 100 = {f}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(str(tmp_path / "in"))

    def run(out):
        q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("seen").collect()

    return base, stream, run


def test_stream_of_intervals(log):
    from seqmill.operators import sequence

    base, stream, run = log
    on, off = F.col("kind") == "click", F.col("kind") == "view"
    got = {(r.key, r.begins, r.ends, r.retriggered) for r in run(streams.intervals(stream, "user_id", "event_id", "event_id", on, off))}
    batch = sequence.intervals(base.withColumn("clock", F.col("event_id")), ["user_id"], ["event_id"], "clock", on, off).where("end IS NOT NULL")
    assert got == {(r.user_id, r.clock, r.end, r.retriggered) for r in batch.collect()}


def test_stream_of_changes(log):
    from seqmill.operators import sequence

    base, stream, run = log
    got = {(r.track, r.register, r.seq, r.value) for r in run(streams.register_changes(stream, "user_id", "kind", "event_id", "value"))}
    batch = sequence.changes(base, ["user_id", "kind"], ["event_id"], "value")
    assert got == {(r.user_id, r.kind, r.event_id, r.value) for r in batch.collect()}


def test_stream_of_windows(log):
    base, stream, run = log
    got = {(r.kind, r.begins): r.n for r in run(streams.onset_windows(stream, "ts", ["kind"]))}
    batch = {(r.kind, r.w.start): r.n for r in base.groupBy("kind", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and len(batch) - len(got) <= 6


def test_stream_of_notes(spark, tmp_path):
    """Both chips on state: register writes that come in four batches give the notes that one batch gives."""
    import random

    from seqmill.operators import chips

    rng, rows = random.Random(4), []
    for t in ("a", "b", "c"):
        for k in range(400):
            kind = rng.choice([0, 0, 0, 1, 2, 2, 3, 3, 5])
            register, value = {0: (rng.choice([0x28, 0x28, 0xA4, 0xA0, 0xB0, 0x40, 0x4C, 0x2B]), rng.choice([0, 0xF0, 0xF1, 1, 0x22, 0x69, 200])), 1: (rng.choice([0xA4, 0xA0]), rng.randrange(256)), 2: (0, rng.choice([0x80, 0x90, 0x9F, 0x05, 0xA3, 0xB1, 0xBF, 0xE4, 0xF3, 0xFF])), 3: (0, rng.randrange(1, 900)), 5: (0x2A, 7)}[kind]
            rows.append((t, k, kind, register, value, rng.randrange(9) if kind == 5 else None, None))
        rows.append((t, 400, 4, 0, 0, None, None))
    base = spark.createDataFrame(rows, "track_id string, seq int, type int, register int, value int, pcm_offset long, error string")
    for f in range(4):
        base.where(f"seq DIV 101 = {f}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = streams.decode_notes(stream).writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["track_id", "emit", "channel", "pitch", "velocity", "sample_on", "sample_off", "patch", "dac_sample_id", "noise_mode"]
    want = chips.decode_notes(base).select(*columns).collect()
    assert len(want) > 60 and sorted(map(str, spark.table("heard").select(*columns).collect())) == sorted(map(str, want))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # all tracks have ended


def test_what_is_idle_is_put_out_and_forgotten(spark, tmp_path):
    """On a trigger that comes again: a track that ends leaves no state, one that stops leaves none after a while."""
    import time

    schema = "track_id string, seq int, type int, register int, value int, pcm_offset long"
    on = lambda t, k: [(t, k, 0, 0xA4, 0x22, None), (t, k + 1, 0, 0xA0, 0x69, None), (t, k + 2, 0, 0x28, 0xF0, None), (t, k + 3, 3, 0, 735, None)]
    rows = [*on("a", 0), *on("b", 0), ("b", 4, 4, 0, 0, None), ("b", 5, 0, 0x28, 0xF0, None)]  # an end, and a row after it
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    numbered = stream.selectExpr("CAST(ascii(track_id) AS long) AS track", "CAST(register AS string) AS register", "seq", "value")
    begun = [
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="300 milliseconds").start()
        for name, out in (("stopped", streams.decode_notes(stream, idle=3000)), ("values", streams.register_changes(numbered, "track", "register", "seq", "value", idle=3000)))
    ]
    try:
        until, seen = time.time() + 60, [set(), set()]
        while time.time() < until and not (seen[0] == {"a", "b"} and all(q.lastProgress and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0 for q in begun)):
            time.sleep(0.3)
            seen[0] = {r.track_id for r in spark.table("stopped").collect()}
        assert seen[0] == {"a", "b"} and spark.table("stopped").count() == 2
        assert spark.table("values").count() == 2 * 4 + 1 and all(q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0 for q in begun)
    finally:
        for q in begun:
            q.stop()


def test_differences_as_files(spark, tmp_path):
    from seqmill.operators import chips, diff

    rows = [{"track_id": "t", "emit": k, **chips.Note(k % 2, 100 * k, 60 + k, 9, 100 * k + 50).__dict__} for k in range(10)]
    a = spark.createDataFrame(rows, chips.NOTE_SCHEMA)
    b = a.where("emit <> 8").withColumn("sample_on", F.when(F.col("emit") == 2, 5000).otherwise(F.col("sample_on") + 3).cast("long"))
    diff.write(a, b, str(tmp_path))
    pairs = spark.read.option("header", "true").csv(str(tmp_path / "pairs"))
    assert {(r.channel, int(r.k)) for r in pairs.collect()} == {("FM1", k) for k in range(1, 5)} | {("FM2", k) for k in range(1, 6)} and "d_on_ms" in pairs.columns
    got = {r.name: r for r in spark.read.json(str(tmp_path / "summary")).collect()}
    assert (got["FM1"].count_a, got["FM1"].count_b, got["FM1"].dropped, got["FM1"].inserted) == (5, 4, 1, 0) and (got["FM2"].mean_on, got["FM2"].max_on, got["FM2"].reorders) == (3.0, 3, 0)


def test_sound_files(spark, tmp_path):
    import wave

    from seqmill.sources import wav

    for name, width, channels, raw in (("a", 2, 1, (1 << 14).to_bytes(2, "little") + (-(1 << 14)).to_bytes(2, "little", signed=True)), ("b", 3, 2, (1 << 22).to_bytes(3, "little") + (0).to_bytes(3, "little")), ("c", 1, 1, b"ab")):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(8000)
            f.writeframes(raw)
    (tmp_path / "d.wav").write_bytes(b"junk")
    got = {r.path[-5]: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert got["a"].samples == [0.5, -0.5] and got["b"].samples == [0.25] and got["a"].rate == 8000 and got["c"].error and got["d"].error


def test_drum_writes(spark):
    from seqmill.sources import vgm

    rows = [("t", k, 5, 0x2A, k, 0, o, None) for k, o in enumerate([4, 5, 6, 2, 3, 3])] + [("t", 9, 3, 0, 5, 0, None, None)]
    got = vgm.drum_writes(spark.createDataFrame(rows, vgm.EVENT_SCHEMA)).orderBy("seq").collect()
    assert [r.seek for r in got] == [True, False, False, True, False, True]


def test_samples_and_orders(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    a, b = ({r.k for r in corpus.sample(df.repartition(n), "k", 50).collect()} for n in (1, 7))
    assert a == b and len(a) == 50
    split = corpus.split_share(df, "k")
    assert split.where("split = 'val'").count() == 50 and corpus.split_share(df.limit(3), "k").where("split = 'val'").count() == 1
    assert corpus.split_share(df.limit(0), "k").count() == 0
    whole = [r.k for r in corpus.resume(df, "k", 0).collect()]
    assert [r.k for r in corpus.resume(df, "k", 990).collect()] == whole[990:]


def test_searches(spark):
    df = spark.createDataFrame([("Alpha_01_Intro",), ("alpha_02_Boss",), ("Alpha_03_End",), ("Beta_01_x",)], "name string")
    pick = lambda g, t: [r.name for r in corpus.by_hints(df, "name", g, t).collect()]
    assert pick("alpha", "end") == ["Alpha_03_End"] and pick("ALPHA", "nothing") == ["Alpha_03_End"] and pick("beta", "q") == ["Beta_01_x"] and pick("gamma", "q") == []
    assert corpus.search(df, "name", "BETA").count() == 1


def test_names_lose_regions_and_revisions(spark):
    from seqmill.functions import text

    want = {"Sonic (USA)": "sonic", " Sonic (Rev A) ": "sonic", "Sonic (rev01)": "sonic", "Sonic (Rev)": "sonic (rev)", "Sonic (Japan)": "sonic", "Sonic (E)": "sonic", "Sonic (Unl) x": "sonic (unl) x", "Sonic (World) (J)": "sonic (world)", "(U)": "", "Sonic (Proto)": "sonic (proto)", "\tSonic\u3000": "sonic"}
    df = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r.name: r.n for r in df.select("name", text.normal_name(F.col("name")).alias("n")).collect()} == want


def test_pack_links(spark):
    from seqmill.functions import text

    html = '<a href="/files/a.zip">x</a><a href="https://o.org/files/b.ZIP">y</a><a href="/files/c.txt">z</a><a href="/other/d.zip">w</a><a href="/files/a.zip">x</a>'
    got = spark.createDataFrame([(html,), ("none",), (None,)], "html string").select(text.pack_links(F.col("html"), "https://h.net/").alias("l")).collect()
    assert [r.l for r in got] == [["https://h.net/files/a.zip", "https://o.org/files/b.ZIP"], [], None]


def test_too_few_tokens_for_a_window(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "id int, t array<int>")
    with pytest.raises(ValueError):
        augment.windows(df, "id", "t", 8)
    with pytest.raises(ValueError):
        augment.windows(df.limit(0), "id", "t", 8)
    assert augment.windows(df, "id", "t", 3).count() == 1


def test_tally_by_definition(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(1)
    rows = [(k, [rng.choice("abcdefg") for _ in range(rng.randint(0, 40))]) for k in range(100)] + [(100, [None, None, "a"])]
    for r in spark.createDataFrame(rows, "k int, t array<string>").select("k", corpus.tally(F.col("t")).alias("c")).collect():
        counts = Counter(rows[r.k][1])
        n = sum(counts.values())
        assert (r.c.n, r.c.distinct, r.c.repeated) == (n, len(counts), sum(c > 1 for c in counts.values()))
        assert abs(r.c.bits - (math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n if n else 0)) < 1e-9


def test_variants_of_one_sequence_by_hand(spark):
    """Up by 0 to 11 half tones; pitches stop at the top, keys turn within their mode."""
    ids = [1, 4 + 60, 185 + 11, 185 + 12, 379, 379 + 85, 467, 482, 500]
    rows = augment.fan_out(spark.createDataFrame([(1, ids)], "id int, ids array<int>"), "ids").collect()
    got = {r.variant: r.ids for r in rows}
    assert len(rows) == len(got) == 18
    assert [got[f"key+{s}"] for s in range(12)] == [[1, 64, 185 + (11 + s) % 12, 197 + s, 379 + s, min(464 + s, 466), 467, 482, 500] for s in range(12)]
    assert got["tempo0.85"][1] == 4 + 102 - 60 and got["tempo1.15"][1] == 4 + 138 - 60 and got["tempo0.92"][1] == 4 + 110 - 60
    assert got["velocity-1"][6:] == [467, 481, 500] and got["velocity+1"][6:] == [468, 482, 500]
