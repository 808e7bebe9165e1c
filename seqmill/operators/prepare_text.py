"""From register logs to training sequences over data-driven vocabularies: the first three preparations.

Two passes: tokens as strings are counted into a vocabulary, then looked up. The first version takes
registers as they are, the second takes notes, the third filters by a table of measures and adds each
track in all the keys that its notes allow. Strings are looked up once, whatever the number of keys: a
note is carried as its channel, kind and pitch, and moved to each key by a table over the vocabulary's
notes, which has a place for each channel, kind and pitch, however large the corpus.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.functions.music import name_to_midi
from seqmill.operators import corpus, tokens
from seqmill.session import stored
from seqmill.sources import flat, vgm

LEAST_TOKENS = 32
VALIDATION = 0.05
SEED = 42
KEYS = (-5, 6)  # of the third version, both ends included
LOW, HIGH = 21, 108  # pitches that a moved note must keep within
SHORTEST = 5.0  # seconds
CHANNELS, PITCHES = 6, 128


@dataclass
class Texts:
    """``sequences``: track_id, shift, split, ids; the vocabulary (token, n, id); ``skipped``: tracks that gave none."""

    sequences: DataFrame
    vocabulary: DataFrame
    skipped: DataFrame

    def counts(self) -> dict:
        """Files, sequences and tokens in all and by split, as the description of a corpus has them."""
        n = F.size("ids").cast("long")
        part = lambda c, split: F.coalesce(F.sum(F.when(F.col("split") == split, c)), F.lit(0))
        row = self.sequences.agg(
            F.count_if(F.col("shift") == 0).alias("total_files"), F.count("*").alias("total_sequences"), F.count_if(F.col("shift") != 0).alias("augmented_sequences"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"),
            part(n, "train").alias("train_tokens"), part(n, "val").alias("val_tokens"), part(F.lit(1), "train").alias("train_seqs"), part(F.lit(1), "val").alias("val_seqs"),
        )
        size = self.vocabulary.count() + 4 + len(tokens.BINS)
        return row.first().asDict() | {"skipped_files": self.skipped.count(), "vocab_size": size}

    def write(self, path: str, **about: object) -> dict:
        """Flat arrays ``path/train`` and ``path/val``, each with its description; no sequence at all is a ValueError."""
        found = self.counts()
        if not found["total_tokens"]:
            raise ValueError("no file gives a sequence")
        ordered = self.sequences.withColumn("place", F.concat_ws("\0", "track_id", F.format_string("%03d", F.col("shift") + 500)))
        for split in ("train", "val"):
            flat.write(ordered.where(F.col("split") == split), "place", "ids", f"{path}/{split}", **found, **about)
        return found


def wanted(files: DataFrame, measures: DataFrame, shortest: float = SHORTEST, longest: float | None = None, fm_notes: bool = True) -> DataFrame:
    """Files that a side table (track_id, duration, has_fm_notes) does not speak against; what it does not know stays."""
    m = measures.groupBy("track_id").agg(F.max("duration").alias("__d"), F.max("has_fm_notes").alias("__n"))
    joined = files.join(m, "track_id", "left")
    long = F.coalesce("__d", F.lit(999.0))
    fine = (long >= shortest) & (F.lit(True) if longest is None else long <= longest) & (F.coalesce("__n", F.lit(True)) if fm_notes else F.lit(True))
    return joined.where(F.isnull("__d") & F.isnull("__n") | fine).drop("__d", "__n")


def _note_code(token: Column) -> Column:
    """A note's number below nought by channel, kind and pitch; null for what has no pitch."""
    part = F.split(token, ":")
    kind = F.when(F.get(part, F.lit(1)) == "ON", 0).when(F.get(part, F.lit(1)) == "PITCH", 1)
    named = token.rlike(r"^CH[1-6]:(ON|PITCH):[A-G]b?\d+$")
    pitch = name_to_midi(F.get(part, F.lit(2)))
    return F.when(named & pitch.between(0, PITCHES - 1), -(1 + ((F.substring(token, 3, 1).cast("int") - 1) * 2 + kind) * PITCHES + pitch))


def _note_table(vocabulary: DataFrame) -> list[int | None]:
    """Ids of all notes by their number: of channels, kinds and pitches there are 1,536."""
    found = {-r["code"]: r["id"] for r in vocabulary.select(_note_code(F.col("token")).alias("code"), "id").where("code IS NOT NULL").collect()}
    return [found.get(k) for k in range(1, CHANNELS * 2 * PITCHES + 1)]


def in_keys(strings: DataFrame, vocabulary: DataFrame, keys: tuple[int, int] = KEYS, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``track_id, shift, ids`` of note tokens, between marks: as they are, and in each key that keeps all notes in range.

    A token that the vocabulary does not have gives nothing; a moved note may be one that it has.
    """
    code = _note_code(F.col("token"))
    plain = strings.join(corpus.small(vocabulary.select("token", "id")), "token", "left")
    known = F.when(F.col("token").rlike(tokens.IS_WAIT), 4 + F.regexp_extract("token", r"(\d+)", 1).try_cast("int")).otherwise(F.col("id"))
    coded = plain.withColumn("code", F.coalesce(code, known).cast("int"))
    pitch = F.when(code.isNotNull(), F.pmod(-code - 1, F.lit(PITCHES)))
    arrays = coded.groupBy("track_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("seq", "code")))), lambda x: x["code"]).alias("codes"), F.min(pitch).alias("lowest"), F.max(pitch).alias("highest")
    )
    shifts = F.filter(F.sequence(F.lit(keys[0]), F.lit(keys[1])), lambda s: (s == 0) | F.isnull("lowest") | ((F.col("lowest") + s >= low) & (F.col("highest") + s <= high)))
    table = F.from_json(F.lit(json.dumps(_note_table(vocabulary))), "array<int>")  # folds to a constant
    each = arrays.withColumn("shift", F.explode(F.array_distinct(F.concat(shifts, F.array(F.lit(0))))))
    moved = F.transform("codes", lambda c: F.when(c >= 0, c).otherwise(F.get(table, -c - 1 + F.col("shift"))))
    ids = F.concat(F.array(F.lit(corpus.BOS)), F.filter(moved, lambda t: t.isNotNull()), F.array(F.lit(corpus.EOS)))
    return each.select("track_id", F.col("shift").cast("int").alias("shift"), ids.alias("ids"))


def prepare(
    files: DataFrame,
    version: int,
    vocabulary: DataFrame | None = None,
    drums: bool = False,
    least_tokens: int = LEAST_TOKENS,
    least_count: int = 2,
    validation: float = VALIDATION,
    keys: tuple[int, int] = KEYS,
    measures: DataFrame | None = None,
    shortest: float = SHORTEST,
    longest: float | None = None,
    fm_notes: bool = True,
) -> Texts:
    """``files`` (track_id, content) by version 1, 2 or 3; without a vocabulary it is counted from them.

    Sequences of fewer than ``least_tokens`` ids, marks included, are left out; a track whose own
    sequence is too short has no other. Versions 1 and 2 take a fixed share of the tracks for
    validation, version 3 decides by the track's name alone and filters by ``measures``.
    """
    if version not in (1, 2, 3):
        raise ValueError("versions 1, 2 and 3 are prepared here")
    if version == 3 and measures is not None:
        files = wanted(files, measures, shortest, longest, fm_notes)
    events = vgm.read_events(files).where("error IS NULL")
    strings = stored((tokens.event_tokens if version == 1 else tokens.note_tokens)(events, drums), "strings")
    if vocabulary is None:
        vocabulary = stored(tokens.build_vocabulary(strings, least_count), "vocabulary")
    if version == 3:
        coded = in_keys(strings, vocabulary, keys)
    else:
        coded = tokens.encode(strings, vocabulary, marks=True).select("track_id", F.lit(0).alias("shift"), "ids")
    coded = stored(coded.withColumn("__whole", F.size("ids") >= least_tokens), "coded")
    whole = coded.where("shift = 0 AND __whole").select("track_id")
    kept = coded.where("__whole").join(whole, "track_id", "left_semi").drop("__whole")
    sequences = corpus.hash_split(kept, "track_id", validation) if version == 3 else corpus.split_share(kept, "track_id", validation, SEED)
    skipped = files.select("track_id").join(whole, "track_id", "left_anti")
    return Texts(sequences.select("track_id", "shift", "split", "ids"), vocabulary, skipped)
