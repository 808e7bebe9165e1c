"""The whole preparation over made files, drum playback, prompts, dictionaries and token files."""

import json

import pytest
from pyspark.sql import functions as F

from seqmill.operators import augment, chips, library, prepare, report, score, sections, synth
from seqmill.sources import flat, vgm, vtok

WAIT, P0, P1, PSG, DAC = vgm.WAIT, vgm.PORT0, vgm.PORT1, vgm.PSG, vgm.DAC


def song(game, author, title, seconds=12, pitches=8, drum=None, channels=2):
    """A file of a scale on some FM channels, at 120 to the minute, with a drum on each beat."""
    rows, fnums = [], [divmod((4 << 11) + round(617 * 2 ** (k / 12)), 256) for k in range(pitches)]  # semitones
    bank = bytes(range(64)) if drum is not None else b""
    if drum is not None:
        rows.append((P0, 0x2B, 0x80, 0, -1))
    for beat in range(seconds * 2):
        for c in range(channels):
            high, low = fnums[(beat + c) % pitches]
            rows += [(P0, 0xA4 + c, high, 0, -1), (P0, 0xA0 + c, low, 0, -1), (P0, 0x28, 0xF0 + c, 0, -1)]
        if drum is not None:
            rows.append((DAC, 0x2A, 0, 0, drum))
        rows.append((WAIT, 0, 22050, 0, -1))
        rows += [(P0, 0x28, c, 0, -1) for c in range(channels)]
    return vgm.write_bytes(rows, bank=bank, tags={"game_en": game, "author_en": author, "track_en": title})


@pytest.fixture(scope="module")
def files(spark):
    rows = []
    for g in range(9):  # nine games, of 12, 11, ... 4 tracks
        rows += [(f"game{g}/{k:02}.vgm", song(f"Game {g} (USA)", "Ann Bee, Cid Dee" if g % 2 else "Ann Bee", ("Boss", "Title", "Stage 1")[k % 3], drum=(g + k) % 10)) for k in range(12 - g)]
    rows += [("short.vgm", song("Game 0", "Ann Bee", "x", 5)), ("mono.vgm", song("Game 0", "", "", channels=1)), ("flat.vgm", song("None", "Unknown", "", pitches=2)), ("bad.vgm", b"no log")]
    return spark.createDataFrame([(t, bytearray(c)) for t, c in rows], "track_id string, content binary")


def test_prepare(spark, files, tmp_path):
    p = prepare.prepare(files, held=2, share=0.1)
    listed = {r.track_id: r for r in p.files.collect()}
    assert len(listed) == 76 and listed["bad.vgm"].error and listed["bad.vgm"].split is None
    assert (listed["short.vgm"].reason, listed["mono.vgm"].reason, listed["flat.vgm"].reason) == ("short", "few_channels", "few_pitches")
    # games by size: 0 (14 files) to 8; after the five largest, 5 and 6 are held out
    held = {t for t, r in listed.items() if r.split == "holdout"}
    assert held == {f"game{g}/{k:02}.vgm" for g in (5, 6) for k in range(12 - g)}
    others = [t for t, r in listed.items() if r.split in ("train", "val")]
    assert sum(listed[t].split == "val" for t in others) == int(0.1 * len(others)) and len(others) == 75 - len(held)
    rows = p.sequences.collect()
    train = [t for t in others if listed[t].split == "train" and listed[t].reason is None]
    assert sorted((r.track_id, r.variant) for r in rows if r.split == "train") == sorted((t, v) for t in train for v in [f"key{s:+d}" for s in augment.SHIFTS] + [f"tempo{f}" for f in augment.TEMPI] + ["velocity-1", "velocity+1"])
    assert sorted(r.track_id for r in rows if r.split != "train") == sorted(t for t, r in listed.items() if r.split in ("val", "holdout") and r.reason is None)
    names = [r.name for r in p.composers.orderBy("id").collect()]
    assert names == ["Ann Bee", "Cid Dee"]
    games = {r.name: r.id for r in p.games.collect()}
    assert games["game 0"] == 0 and games["game 8"] == 8
    heads = [r for r in rows if r.split == "train" and r.variant == "key+0" and r.track_id.startswith("game")]
    assert len(heads) > 30
    for one in heads:
        g, k = int(one.track_id[4]), int(one.track_id[6:8])
        assert one.tokens[0] == score.BOS and one.tokens[1] == 4 + 60 and one.tokens[3] == 209 and one.tokens[4:8] == [492, 825 + g, (891, 892, 890)[k % 3], 896] and one.tokens[-1] == score.EOS
    drums = p.drums.collect()
    assert [r.slot for r in drums] == list(range(8)) and drums[0].n >= drums[-1].n
    got = {r.split: r for r in p.counts().collect()}
    assert got["train"].sequences == 18 * got["train"].encoded_files and got["holdout"].files == len(held) and got["val"].tokens == sum(len(r.tokens) for r in rows if r.split == "val")
    # a curated list decides the games and their order
    curated = spark.createDataFrame([([{"games": [{"gd3_name_hint": "Game 2"}, {"gd3_name_hint": "GAME 1 (Rev A)"}]}, {"games": [{"gd3_name_hint": "game 2 (Europe)"}, {"gd3_name_hint": "Zed"}]}],)], library.CURATED)
    assert [(r.name, r.hint, r.id) for r in library.curated_names(curated).orderBy("id").collect()] == [("game 2", "Game 2", 0), ("game 1", "GAME 1 (Rev A)", 1), ("zed", "Zed", 2)]
    assert {r.name: r.id for r in prepare.games(vgm.read_headers(files), curated).collect()} == {"game 2": 0, "game 1": 1, "zed": 2}
    # sinks: a flat array by split, and token files
    val = p.sequences.where("split = 'val'")
    path = str(tmp_path / "val")
    n = flat.write(val, "track_id", "tokens", path, vocabulary=1024, split="val")
    assert n > 1000
    assert n == got["val"].tokens and flat.meta(spark, path) == {"tokens": n, "vocabulary": 1024, "split": "val"}
    whole = [t for r in sorted((r for r in rows if r.split == "val"), key=lambda r: r.track_id) for t in r.tokens]
    assert [r.token for r in flat.stretch(spark, path, 100, 50).orderBy("position").collect()] == whole[100:150]
    assert flat.read_windows(spark, path, 99).count() == n // 100
    written = vtok.write(val.withColumn("name", F.concat(F.lit("v/"), F.regexp_replace("track_id", "/", "_"))), "name", "tokens", 1024, str(tmp_path / "files")).collect()
    back = vtok.read(spark, str(tmp_path / "files")).collect()
    assert sum(r.n for r in written) == n and sorted(len(r.tokens) for r in back) == sorted(r.n for r in written) and all(r.error is None for r in back)
    assert not list((tmp_path / "files").rglob("*.part"))
    empty = prepare.prepare(files.limit(0))
    assert empty.sequences.count() == 0 and empty.counts().count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([("a", [1, 5, 6, 7]), ("b", [])], "track_id string, tokens array<int>")
    assert {r.track_id: r.tokens for r in prepare.prompt(df, 2).collect()} == {"a": [1, 5], "b": [1]}
    wanted = spark.createDataFrame([("ann bee",), ("Bee",), ("Dee",), ("nobody",)], "name string")
    listed = spark.createDataFrame([("Ann Bee", 0), ("Bee", 1), ("Cid Dee", 2)], "name string, id int")
    assert {r.name: r.tokens for r in prepare.named_prompt(wanted, listed, 492, None).collect()} == {"ann bee": [1, 492], "Bee": [1, 493], "Dee": [1, 494], "nobody": [1]}
    assert prepare.named_prompt(wanted, listed, 825, 889).where("name = 'nobody'").first().tokens == [1, 889]


def note(c, on, off, pitch=60, patch=None, slot=None, emit=0, track="t"):
    return {"track_id": track, "emit": emit, **chips.Note(c, on, pitch, 15, off, patch=patch).__dict__, "slot": slot}


def test_drums_are_played_and_switched(spark):
    patch = [0, 0, 0, 0, 3, *[10, 31, 0, 0, 0, 0, 1, 0, 0, 0, 0] * 4]
    rows = [note(6, 1000, 1735, None, None, 1, 0), note(5, 5000, 8000, 62, patch, None, 1), note(6, 10_000, 10_735, None, None, 0, 2), note(6, 10_020, 10_735, None, None, 1, 3), note(6, 20_000, 20_735, None, None, 7, 4)]
    df = spark.createDataFrame(rows, chips.NOTE_SCHEMA + ", slot int")
    kit = spark.createDataFrame([(0, bytearray(b"\x10" * 9)), (1, bytearray(b"\x20" * 6)), (2, None)], "slot int, pcm binary")
    events = vgm.read_events(synth.synthesise(df, kit)).collect()
    modes = [(r.sample_pos, r.value) for r in events if r.register == 0x2B and r.type == P0]
    assert modes == [(1000, 0x80), (5000, 0), (10_000, 0x80)]
    hits = [(r.sample_pos, r.pcm_offset, r.value) for r in events if r.type == DAC]
    assert hits == [(1000 + 5 * k, 9 + k, 0x20) for k in range(6)] + [(10_000 + 5 * k, k, 0x10) for k in range(4)] + [(10_020 + 5 * k, 9 + k, 0x20) for k in range(6)]
    back = chips.decode_notes(vgm.read_events(synth.synthesise(df, kit))).orderBy("sample_on").collect()
    assert [(r.channel, r.sample_on, r.dac_sample_id) for r in back] == [(6, 1000, 9), (5, 5000, None), (6, 10_000, 0), (6, 10_020, 9)]


def test_drum_kit_and_files(spark, tmp_path):
    notes = spark.createDataFrame([note(6, k, k + 1, None, emit=k, track=t) | {"dac_sample_id": d} for k, (t, d) in enumerate([("b", 2), ("a", 2), ("c", 5), ("a", 50)])], chips.NOTE_SCHEMA + ", slot int")
    slots = library.drum_slots(notes)
    assert [(r.dac_sample_id, r.n, r.slot) for r in slots.orderBy("slot").collect()] == [(2, 2, 0), (5, 1, 1), (50, 1, 2)]
    banks = spark.createDataFrame([("a", bytearray(b"01")), ("b", bytearray(b"0123456789")), ("c", bytearray(b"abcdefgh"))], "track_id string, pcm binary")
    assert {r.slot: bytes(r.pcm) for r in library.drum_kit(notes, banks, slots, 4).collect()} == {0: b"2345", 1: b"fgh"}
    library.save(slots, str(tmp_path / "slots"))
    assert library.load(spark, str(tmp_path / "slots")).count() == 3
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "games_v6.json").write_text(json.dumps({"driver_groups": [{"games": [{"gd3_name_hint": "X"}]}]}))
    found = library.find(spark, "games", str(tmp_path / "none"), str(tmp_path / "old"))
    assert found.endswith("old/games_v6.json") and library.find(spark, "other", str(tmp_path / "old")) is None
    assert [r.name for r in library.curated_names(library.load(spark, found, library.CURATED)).collect()] == ["x"]


def test_tempo_maps_by_section(spark):
    on = [round(k * 22050) for k in range(60)] + [1_323_000 + 4410 + round(k * 26460) for k in range(50)]
    notes = spark.createDataFrame([note(0, x, x + 10, emit=k) for k, x in enumerate(on)], chips.NOTE_SCHEMA + ", slot int")
    heads = spark.createDataFrame([("t", 2_646_000)], "track_id string, total_samples long")
    rhythm = spark.createDataFrame([("t", [{"second": 0.0, "tempo": 120.0}, {"second": 30.0, "tempo": 100.0}])], "track_id string, sections array<struct<second: double, tempo: double>>")
    s = sections.boundaries(rhythm, heads)
    assert [(r.begin, r.end) for r in s.orderBy("section").collect()] == [(0, 1_323_000), (1_323_000, 2_646_000)]
    got = sections.tempo_maps(notes, s).orderBy("section").collect()
    assert [(r.second, r.tempo) for r in got] == [(0.0, 120.0), (30.0, 100.0)] and got[0].first_beat == 0.0 and got[1].first_beat == pytest.approx(30.1)


def test_modes_by_hand(spark):
    voice = lambda ams, fms, pan, ssg, am: [0, 0, ams, fms, pan, *[10, 31, 0, 0, 0, 0, 1, 0, 0, ssg, am] * 4]
    rows = [note(0, 0, 9, patch=voice(1, 2, 1, 0, 1)), note(1, 0, 9, patch=voice(1, 0, 2, 9, 0)), note(2, 5, 9, patch=voice(0, 0, 3, 7, 0))]
    bent = note(7, 0, 9) | {"bends": [{"sample": k, "a": a, "b": None} for k, a in enumerate([5, 6, 5, 7])]}
    slid = note(8, 0, 9) | {"bends": [{"sample": k, "a": a, "b": None} for k, a in enumerate([5, 6, 7, 8])]}
    rows += [bent, slid, note(10, 0, 9, None) | {"noise_mode": 3}, note(10, 20, 29, None) | {"noise_mode": 4}]
    df = spark.createDataFrame(rows, chips.NOTE_SCHEMA + ", slot int")
    got = {(r.channel, r.mode) for r in sections.mode_ranges(df, F.lit(True)).collect()}
    assert got == {(0, "VIB"), (0, "TRE"), (0, "L"), (1, "SSG"), (1, "R"), (7, "VIB"), (10, "PERIO"), (10, "CH2")}
    assert {(r.channel, r.mode) for r in sections.mode_ranges(df).collect()} == got - {(0, "VIB"), (0, "TRE")}


def test_names_of_registers_and_times(spark):
    cases = [(P0, 0x22, "LFO"), (P1, 0xA1, "FNUM_LOW_5"), (P0, 0xB6, "PAN_AMS_FMS_3"), (P1, 0x44, "TL_2_4"), (P0, 0x28, "KEY"), (P1, 0x28, "REG_28"), (PSG, 0, "PSG"), (WAIT, 0, None), (P0, 0x33, "REG_33")]
    df = spark.createDataFrame([(k, r) for k, r, _ in cases], "k int, r int")
    assert [x[0] for x in df.select(report.register_name(F.col("k"), F.col("r"))).collect()] == [n for *_, n in cases]
    row = spark.range(1).select(report.percent(F.lit(0.1234)), report.milliseconds(F.lit(441)), report.milliseconds(F.lit(-441), True), report.bpm_guess(F.lit(22050)), report.bpm_guess(F.lit(0)), report.is_effect(F.lit(True), F.lit(4.9)), report.is_effect(F.lit(True), F.lit(5.0)), report.is_effect(F.lit(None).cast("boolean"), F.lit(9.0))).first()
    assert tuple(row) == ("12.3%", "10.0 ms", "-10.0 ms", "60 / 120 / 240", None, True, False, True)
