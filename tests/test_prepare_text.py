"""The first three preparations against their rules, one file at a time."""

import hashlib

import pytest
from test_tracks import plain_note_tokens

from seqmill.functions.music import FLATS
from seqmill.operators import prepare_text, tokens
from seqmill.sources import flat, vgm


def note(c, midi, value=0xF0):
    """Writes that tune a channel to a pitch and key it on."""
    hz = 440 * 2 ** ((midi - 69) / 12)
    block = next(b for b in range(8) if round(hz * 144 * 2 ** (21 - b) / 7670453) <= 2047)
    f = round(hz * 144 * 2 ** (21 - block) / 7670453)
    port, at, key = (0, c, c) if c < 3 else (1, c - 3, c + 1)
    return [(port, 0xA4 + at, block * 8 + f // 256, 0, -1), (port, 0xA0 + at, f % 256, 0, -1), (0, 0x28, value | key, 0, -1), (3, 0, 735, 0, -1), (0, 0x28, key, 0, -1)]


def log(notes):
    return vgm.write_bytes([r for c, m in notes for r in note(c, m)] + [(4, 0, 0, 0, -1)])


LOGS = {
    "low": log([(0, 24), (1, 28)] * 8),
    "high": log([(3, 104), (4, 100)] * 8),
    "wide": log([(0, 22), (5, 107)] * 8),
    "mid": log([(0, 60), (2, 64), (5, 67)] * 8),
    "once": log([(0, 61), (2, 65), (5, 68)] * 2),
    "short": log([(0, 60)]),
    "plain": vgm.write_bytes([r for k in range(40) for r in [(0, 0x30, k % 4, 0, -1), (3, 0, 100, 0, -1)]] + [(4, 0, 0, 0, -1)]),
    "none": vgm.write_bytes([(4, 0, 0, 0, -1)]),
    "bad": b"no log",
}


def moved(strings, by):
    out = []
    for t in strings:
        part = t.split(":")
        if t.startswith("CH") and len(part) == 3 and part[2] != "X":
            name = part[2].rstrip("0123456789")
            midi = FLATS.index(name) + 12 * (int(part[2][len(name) :]) + 1) + by
            if by and not 21 <= midi <= 108:
                return None
            part[2] = FLATS[midi % 12] + str(midi // 12 - 1)
        out.append(":".join(part))
    return out


def by_rule(least=32, keys=range(-5, 7)):
    strings = {t: plain_note_tokens([r[:3] for r in vgm.events(data, 0x100)[0]]) for t, data in LOGS.items() if t != "bad"}
    counts = {}
    for own in strings.values():
        for t in own:
            if not t.startswith("<"):
                counts[t] = counts.get(t, 0) + 1
    kept = sorted((t for t, n in counts.items() if n >= 2), key=lambda t: (-counts[t], t))
    ids = {t: 65 + k for k, t in enumerate(kept)} | {f"<WAIT:{k}>": 4 + k for k in range(61)}
    out = {}
    for track, own in strings.items():
        found = {s: [1, *(ids[t] for t in m if t in ids), 2] for s in [0, *keys] if (m := moved(own, s)) is not None}
        if len(found[0]) >= least:
            out |= {(track, s): x for s, x in found.items() if len(x) >= least}
    return out


def files(spark):
    return spark.createDataFrame(list(LOGS.items()), "track_id string, content binary")


def test_third_version(spark):
    found = prepare_text.prepare(files(spark), 3, validation=0.3)
    rows = found.sequences.collect()
    want = by_rule()
    assert {(r.track_id, r["shift"]): r.ids for r in rows} == want and len(rows) == len(want)
    assert {s for t, s in want if t == "wide"} == {-1, 0, 1} and {s for t, s in want if t == "plain"} == set(range(-5, 7)) and ("short", 0) not in want
    val = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 10_000 < 3000
    assert all((r.split == "val") == val(r.track_id) for r in rows)
    assert {r.track_id for r in found.skipped.collect()} == set(LOGS) - {t for t, _ in want}


def test_a_moved_note_may_be_known_and_a_sequence_too_short_goes(spark):
    want = by_rule(least=12)
    assert max(len(x) for (t, s), x in want.items() if t == "once") > min(len(x) for (t, s), x in want.items() if t == "once")
    rows = prepare_text.prepare(files(spark), 3, least_tokens=12).sequences.collect()
    assert {(r.track_id, r["shift"]): r.ids for r in rows} == want


def test_filters(spark):
    f = files(spark)
    side = spark.createDataFrame([("low", 4.9, True), ("high", 300.0, True), ("wide", 10.0, False), ("mid", 5.0, None), ("once", None, True)], "track_id string, duration double, has_fm_notes boolean")
    left = lambda **k: {r.track_id for r in prepare_text.wanted(f, side, **k).collect()}
    assert left() == set(LOGS) - {"low", "wide"}
    assert left(fm_notes=False, longest=200.0) == set(LOGS) - {"low", "high", "once"}
    assert left(shortest=0.0) == set(LOGS) - {"wide"}
    assert {r.track_id for r in prepare_text.prepare(f, 3, measures=side, fm_notes=True).sequences.collect()} == {t for t, _ in by_rule() if t not in ("low", "wide")} - {"low"}


def test_flat_arrays(spark, tmp_path):
    found = prepare_text.prepare(files(spark), 2, validation=0.4)
    meta = found.write(str(tmp_path), seq_len=64)
    want = {t: x for (t, s), x in by_rule().items() if s == 0}
    assert meta["total_files"] == len(want) == meta["train_seqs"] + meta["val_seqs"] and meta["val_seqs"] == int(0.4 * len(want)) and meta["augmented_sequences"] == 0
    assert meta["total_tokens"] == sum(map(len, want.values())) and meta["skipped_files"] == len(LOGS) - len(want)
    for split in ("train", "val"):
        tracks = sorted(r.track_id for r in found.sequences.where(f"split = '{split}'").collect())
        whole = [x for t in tracks for x in want[t]]
        about = flat.meta(spark, f"{tmp_path}/{split}")
        assert about["tokens"] == len(whole) == meta[f"{split}_tokens"] and about["seq_len"] == 64
        assert [r.token for r in flat.stretch(spark, f"{tmp_path}/{split}", 3, 40).orderBy("position").collect()] == whole[3:43]


def test_first_version_and_a_given_vocabulary(spark):
    own = tokens.build_vocabulary(tokens.event_tokens(vgm.read_events(files(spark)).where("track_id = 'plain'")))
    rows = prepare_text.prepare(files(spark), 1, vocabulary=own).sequences.collect()
    assert {r.track_id for r in rows} == {"plain"} and len(rows[0].ids) == 82
    assert {x for x in rows[0].ids if x >= 65} == {65, 66, 67, 68}


def test_nothing_to_prepare(spark, tmp_path):
    empty = files(spark).where("track_id IN ('none', 'bad')")
    for version in (1, 2, 3):
        found = prepare_text.prepare(empty, version)
        assert found.sequences.count() == 0 and found.skipped.count() == 2
    with pytest.raises(ValueError):
        found.write(str(tmp_path))
    with pytest.raises(ValueError):
        prepare_text.prepare(empty, 7)
