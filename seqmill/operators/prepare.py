"""From register logs to training sequences: the whole preparation as one plan.

Headers, events and notes are read once and stored; dictionaries come from the corpus or from a
curated list; tracks that pass the gate are analysed and encoded; games that are held out, and a share
of the other tracks, are kept from training; what is trained on is changed in eighteen ways and
repeated by its hardware profile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.functions.text import context
from seqmill.operators import analysis, augment, chips, corpus, library, report, score, tracks
from seqmill.session import stored
from seqmill.sources import vgm

COMPOSERS, GAMES = 128, 64
DRUM_SHARE = 0.50  # a track of more drum tokens than that says little of anything else
COMPOSER, GAME = score.UNK_COMPOSER - COMPOSERS, score.UNK_GAME - GAMES  # first token ids


@dataclass
class Prepared:
    """``sequences``: split, track_id, variant, copy, tokens; dictionaries; ``files``: track_id, split, reason, error."""

    sequences: DataFrame
    files: DataFrame
    composers: DataFrame
    games: DataFrame
    drums: DataFrame
    notes: DataFrame

    def counts(self) -> DataFrame:
        """Files, encoded files, sequences and tokens by split."""
        return report.split_counts(self.files.where("split IS NOT NULL"), self.files.where("split IS NOT NULL AND reason IS NULL"), self.sequences)


def _names(heads: DataFrame, column: str) -> DataFrame:
    return heads.where(F.col(column).isNotNull() & (F.lower(column) != "unknown"))


def composers(heads: DataFrame, most: int = COMPOSERS) -> DataFrame:
    return corpus.top_names(_names(heads, "author_en"), "author_en", most)


def games(heads: DataFrame, curated: DataFrame | None = None, most: int = GAMES) -> DataFrame:
    """``name, id``: games of a curated list in its order, or else the most frequent of the corpus, by normalised names."""
    if curated is not None:
        return library.curated_names(curated).where(F.col("id") < most).select("name", "id")
    from seqmill.functions.text import normal_name

    counts = _names(heads, "game_en").groupBy(normal_name(F.col("game_en")).alias("name")).agg(F.count("*").alias("n"))
    return library._ranked(counts, most, "name", "id").select("name", "id")


def _context_token(title: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in score.CONTEXTS.items() for x in kv]), context(title))


def split(heads: DataFrame, game: DataFrame, unknown: int, skip: int = 5, held: int = 8, share: float = 0.05, seed: int = 42) -> DataFrame:
    """``track_id, split``: holdout for the tracks of the games ranked after the ``skip`` largest, val for a share of the others, else train."""
    named = heads.select("track_id").join(game, "track_id").withColumn("id", F.nullif("id", F.lit(unknown)).cast("string"))
    out = corpus.hold_out(named, "id", skip, held).where("held_out").select("id")
    marked = stored(named.join(F.broadcast(out.withColumn("held", F.lit(True))), "id", "left").select("track_id", F.coalesce("held", F.lit(False)).alias("held")), "held")  # as many rows as games are held out
    rest = corpus.split_share(marked.where("NOT held"), "track_id", share, seed)
    return rest.select("track_id", "split").unionByName(marked.where("held").select("track_id", F.lit("holdout").alias("split")))


def drum_share(tokens: Column) -> Column:
    """Share of a sequence's tokens that are drum hits."""
    return F.size(F.filter(tokens, lambda t: (t >= score.DAC_HIT) & (t < score.DAC_HIT + score.DAC_SLOTS))) / F.greatest(F.size(tokens), F.lit(1))


def prepare(files: DataFrame, curated: DataFrame | None = None, augmented: bool = True, skip: int = 5, held: int = 8, share: float = 0.05, seed: int = 42) -> Prepared:
    """``files``: track_id, content. Files that cannot be read have an error and no split."""
    all_heads = stored(vgm.read_headers(files, notes=False), "heads")
    heads = all_heads.where("error IS NULL")
    events = stored(vgm.read_events(files).where("error IS NULL"), "events")
    notes = stored(score.split_notes(score.reclassify(chips.decode_notes(events))), "notes")
    names, titles, drums = composers(heads), games(heads, curated), library.drum_slots(notes)
    by = corpus.look_up(heads, "track_id", "author_en", names, COMPOSERS).select("track_id", (F.col("id") + COMPOSER).cast("int").alias("composer"))
    game = library.game_ids(heads, "track_id", "game_en", titles, GAMES)
    splits = stored(split(heads, game, GAMES, skip, held, share, seed), "splits")
    gate = tracks.gate(notes, heads)
    wanted = stored(gate.join(splits, "track_id"), "gate")
    kept = wanted.where("reason IS NULL").select("track_id")
    own = notes.join(kept, "track_id", "left_semi")
    heard = stored(tracks.analyse(own, heads), "analysis")
    cards = heads.join(kept, "track_id", "left_semi").join(heard, "track_id").join(by, "track_id").join(game.withColumnRenamed("id", "game"), "track_id").select(
        "track_id", "bpm", F.coalesce("key_index", F.lit(0)).alias("key_index"), F.coalesce("is_minor", F.lit(False)).alias("is_minor"), "beats", "composer", (F.col("game") + GAME).cast("int").alias("game"),
        _context_token(F.col("track_en")).alias("context"), F.col("loop").isNotNull().alias("has_loop"),
    )
    roles = heard.select("track_id", F.explode("roles").alias("channel", "role"))
    hardware = score.hardware_changes(events.join(kept, "track_id", "left_semi"), heads.join(kept, "track_id", "left_semi"))
    coded = stored(score.encode(own, hardware, cards, roles, drums).join(splits, "track_id").withColumn("heavy", drum_share(F.col("tokens")) > DRUM_SHARE), "encoded")
    encoded = coded.where("NOT heavy").drop("heavy")
    profile = chips.features(events, notes, heads).select("track_id", analysis.cluster().alias("cluster"))
    train = encoded.where("split = 'train'")
    changed = augment.fan_out(train, "tokens") if augmented else train.withColumn("variant", F.lit("key+0"))
    repeated = augment.repeat_by(changed.join(profile, "track_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(1))), F.col("cluster"))
    others = encoded.where("split <> 'train'").withColumns({"variant": F.lit("key+0"), "copy": F.lit(0)})
    columns = ["split", "track_id", "variant", "copy", "tokens"]
    sequences = repeated.select(*columns).unionByName(others.select(*columns))
    heavy = coded.where("heavy").select("track_id", F.lit("drums").alias("heavy"))
    listed = all_heads.select("track_id", "error").join(wanted, "track_id", "left").join(heavy, "track_id", "left").select("track_id", "split", F.coalesce("reason", "heavy").alias("reason"), "error")
    return Prepared(sequences, listed, names, titles, drums, notes)


def prompt(sequences: DataFrame, n: int) -> DataFrame:
    """``track_id, tokens``: the first n tokens of each sequence; an empty one gives the begin mark."""
    t = F.col("tokens")
    return sequences.select("track_id", F.when(F.size(t) > 0, F.slice(t, 1, n)).otherwise(F.array(F.lit(score.BOS))).alias("tokens"))


def named_prompt(wanted: DataFrame, listed: DataFrame, first: int, unknown: int | None) -> DataFrame:
    """``name, tokens``: the begin mark and the token of a listed name.

    ``listed``: name, id. A name is looked up whole, without regard to case, else as a part of a listed
    name, the one with the smallest id. Unknown ones give ``unknown``, or the begin mark alone.
    """
    own, dim = wanted.select(F.col("name").alias("__own")), corpus.small(listed.select("name", "id"))
    part = F.contains(F.lower("name"), F.lower("__own"))
    hits = own.join(dim, part).groupBy("__own").agg(F.min(F.struct((F.lower("name") != F.lower("__own")).alias("p"), "id")).alias("h"))  # a dictionary of bounded size
    found = own.distinct().join(hits, "__own", "left")
    token = F.coalesce(F.col("h.id") + first, F.lit(unknown).cast("int"))
    return found.select(F.col("__own").alias("name"), F.filter(F.array(F.lit(score.BOS), token.cast("int")), lambda x: x.isNotNull()).alias("tokens"))
