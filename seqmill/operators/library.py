"""Dictionaries that a corpus gives: drum samples, voices, and curated names; and how they are kept.

Each is a top-k over grouped counts with a written tie-break, of bounded size whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.text import normal_name
from seqmill.operators import corpus
from seqmill.operators.chips import DRUM
from seqmill.operators.score import DAC_SLOTS, patch_vector

VOICES = 128  # entries of a voice library
SAMPLE_BYTES = 8192  # bytes of a drum sample that are kept


def _ranked(counts: DataFrame, most: int, key: str, name: str) -> DataFrame:
    """The ``most`` largest counts, numbered from 0; ties by key."""
    top = counts.orderBy(F.col("n").desc(), key).limit(most)
    return top.withColumn(name, (F.row_number().over(W.orderBy(F.col("n").desc(), key)) - 1).cast("int"))  # ``most`` rows


def drum_slots(notes: DataFrame, slots: int = DAC_SLOTS) -> DataFrame:
    """``dac_sample_id, n, slot``: the most frequent drum samples of the corpus, as encode() wants them."""
    hits = notes.where((F.col("channel") == DRUM) & F.col("dac_sample_id").isNotNull())
    return _ranked(hits.groupBy("dac_sample_id").agg(F.count("*").alias("n")), slots, "dac_sample_id", "slot")


def drum_kit(notes: DataFrame, banks: DataFrame, slots: DataFrame, most: int = SAMPLE_BYTES) -> DataFrame:
    """``slot, pcm``: of each slot the sample bytes as the first track by name that plays it has them.

    ``banks``: track_id, pcm. Tracks whose bank ends before the sample do not count.
    """
    played = notes.where(F.col("channel") == DRUM).select("track_id", "dac_sample_id").join(corpus.small(slots.select("dac_sample_id", "slot")), "dac_sample_id").select("track_id", "slot", "dac_sample_id").distinct()
    have = played.join(banks, "track_id").where(F.col("dac_sample_id") < F.length("pcm"))
    first = have.groupBy("slot", "dac_sample_id").agg(F.min("track_id").alias("track_id"))  # an id before the bytes: banks are not moved around
    return first.join(banks, "track_id").select("slot", F.substring("pcm", F.col("dac_sample_id").cast("int") + 1, F.lit(most)).alias("pcm"))


def final_patches(notes: DataFrame) -> DataFrame:
    """``track_id, channel, patch``: the last voice of each FM channel of a track."""
    voiced = notes.where("channel < 6 AND patch IS NOT NULL")
    return voiced.groupBy("track_id", "channel").agg(F.max_by("patch", F.struct("sample_on", "emit")).alias("patch"))


def fingerprint(patch: Column) -> Column:
    """A voice's key of fixed width: a digest of its values in order; null has none."""
    text = F.array_join(F.transform(patch, lambda v: v.cast("string")), ",", "-")
    return F.unhex(F.md5(text.cast("binary")))


def voice_library(patches: DataFrame, most: int = VOICES) -> DataFrame:
    """``lib, print, patch, n``: the voices that most channels end with, by fingerprint; ties by the voice's own values."""
    counts = patches.where("patch IS NOT NULL").groupBy(fingerprint(F.col("patch")).alias("print")).agg(F.first("patch").alias("patch"), F.count("*").alias("n"))
    return _ranked(counts, most, "patch", "lib").select("lib", "print", "patch", "n")


def to_library(patches: DataFrame, key: str, patch: str, library: DataFrame, vector: Column | None = None) -> DataFrame:
    """``key, lib``: the library's entry of a voice, or else the one nearest in L1, the first of equally near ones.

    No voice, or an empty library: 0. ``vector`` maps the library's column ``patch`` to what is compared.
    """
    near = vector if vector is not None else patch_vector(F.col("patch"))
    own = patches.select(key, F.col(patch).alias("patch"), fingerprint(F.col(patch)).alias("print"))
    known = corpus.small(library.select(fingerprint(F.col("patch")).alias("print"), F.col("patch").alias("known"), F.col("lib").alias("same")))
    exact = own.join(known, "print", "left").withColumn("same", F.when(F.col("known") == F.col("patch"), F.col("same")))  # equal prints are looked at
    rest = corpus.nearest_l1(exact.select(key, "same", near.alias("vec")).withColumn("k", F.struct(key, "same")), "k", "vec", library.select("lib", near.alias("vec")))
    return rest.select(f"k.{key}", F.coalesce("k.same", F.col("lib").cast("int"), F.lit(0)).alias("lib"))


def curated_names(groups: DataFrame) -> DataFrame:
    """``name, hint, id``: names of a curated list in its order; of names that are the same when normalised the first.

    ``groups``: one row with ``driver_groups``, an array of structs with ``games``, structs with ``gd3_name_hint``.
    """
    flat = groups.select(F.posexplode("driver_groups").alias("g", "group")).select("g", F.posexplode("group.games").alias("k", "game"))
    hints = flat.select("g", "k", F.col("game.gd3_name_hint").alias("hint")).where("hint IS NOT NULL").withColumn("name", normal_name(F.col("hint")))
    first = hints.groupBy("name").agg(F.min(F.struct("g", "k", "hint")).alias("f"))
    return first.select("name", "f.hint", (F.row_number().over(W.orderBy("f.g", "f.k")) - 1).cast("int").alias("id"))  # a list made by hand


def game_ids(tracks: DataFrame, key: str, game: str, listed: DataFrame, unknown: int) -> DataFrame:
    """``key, id`` of each track's game by its normalised name; ``unknown`` for others."""
    named = tracks.select(key, normal_name(F.col(game)).alias("name"))
    return named.join(corpus.small(listed.select("name", "id")), "name", "left").select(key, F.coalesce("id", F.lit(unknown)).alias("id"))


# -- files ----------------------------------------------------------------------------------------


def save(dimension: DataFrame, path: str) -> None:
    """A dictionary as JSON lines; small by construction, so one file."""
    dimension.coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dictionary of save(), or one JSON document: then ``schema`` tells its form."""
    reader = spark.read.option("multiLine", schema is not None)
    return (reader.schema(schema) if schema else reader).json(path)


CURATED = "driver_groups array<struct<games: array<struct<gd3_name_hint: string>>>>"


def find(spark: SparkSession, name: str, *folders: str, versions: tuple[str, ...] = ("v7", "v6", "v4")) -> str | None:
    """The first of ``{name}_{version}.json`` that exists, by folder and then version; any file system of Spark's."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        for version in versions:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}_{version}.json")
            if path.getFileSystem(conf).exists(path):
                return path.toString()
    return None
