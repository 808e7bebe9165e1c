"""Data-driven event vocabularies: events as strings, waits in bins, and notes abstracted from writes and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions.music import FLATS, TEXT_CLOCK, TEXT_SCALE, bin_value, fnumber_to_midi, least_error, midi_name, name_to_midi, nearest_bin, wait_bins
from seqmill.functions.text import event_key
from seqmill.operators import corpus
from seqmill.sources.vgm import DAC, END, PORT0, PORT1, PSG, WAIT

KINDS = {PORT0: "P0", PORT1: "P1", PSG: "SN", DAC: "DAC"}
BINS = wait_bins()


def _merged(events: DataFrame, drums: bool) -> DataFrame:
    """Without ends (and drum samples), waits in a row joined: those around a dropped row as well."""
    kept = events.where("error IS NULL").where(F.col("type") != END)
    kept = kept if drums else kept.where(F.col("type") != DAC)
    w = W.partitionBy("track_id").orderBy("seq")
    wait = F.col("type") == WAIT
    marked = kept.withColumn("__new", F.when(wait & F.coalesce(F.lag("type").over(w) == WAIT, F.lit(False)), 0).otherwise(1))
    grouped = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy("track_id", "__run").agg(
        F.min("seq").alias("seq"), F.first("type").alias("type"), F.first("register").alias("register"), F.when(F.first("type") == WAIT, F.sum("value")).otherwise(F.first("value")).alias("value")
    ).drop("__run")


def event_tokens(events: DataFrame, drums: bool = False) -> DataFrame:
    """``track_id, seq, token``: one string for each event, ``WAIT:n`` with the bin's number for waits."""
    merged = _merged(events, drums)
    kind = F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k).cast("tinyint"), F.lit(v))]), F.col("type"))
    token = F.when(F.col("type") == WAIT, F.concat(F.lit("WAIT:"), nearest_bin(F.col("value"), BINS).cast("string"))).otherwise(event_key(kind, F.col("register").cast("int"), F.col("value")))
    return merged.select("track_id", "seq", token.alias("token"))


#: A wait's token, in either vocabulary.
IS_WAIT = r"^<?WAIT:\d+>?$"


def _channel_of_key(value: Column) -> Column:
    """Channel 1 to 6 of a key write; null for the two numbers that no channel has."""
    n = value.bitwiseAND(7)
    return F.when(n <= 2, n + 1).when(n.between(4, 6), n)


def note_tokens(events: DataFrame, drums: bool = False) -> DataFrame:
    """``track_id, seq, token``: frequency and key writes become notes, all other writes stay as they are.

    A key-on gives ``CHn:ON:name`` (``X`` where no pitch is set), a key-off ``CHn:OFF``, a low frequency
    byte that changes the pitch while the key is down ``CHn:PITCH:name``; frequency writes themselves put
    out nothing, but part the waits around them. Waits are ``<WAIT:n>``, sound bytes ``PSG:XX``, other
    writes ``FMp:RR:XX``. Of sample bytes nothing is kept unless ``drums`` asks for them.
    """
    merged = _merged(events, drums)
    reg, value, fm = F.col("register").cast("int"), F.col("value"), F.col("type").isin(PORT0, PORT1)
    port = F.when(F.col("type") == PORT1, 1).otherwise(0)
    low, high = fm & reg.between(0xA0, 0xA2), fm & reg.between(0xA4, 0xA6)
    keyed = F.when((F.col("type") == PORT0) & (reg == 0x28), _channel_of_key(value))
    channel = F.when(low | high, reg % 4 + 1 + 3 * port).otherwise(keyed)
    e = merged.withColumns({"ch": channel, "low": F.when(low, value), "high": F.when(high, value), "on": F.when(keyed.isNotNull(), (value.bitwiseAND(0xF0) != 0).cast("int"))})
    w = W.partitionBy("track_id", "ch").orderBy("seq")
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    e = e.withColumns({"l": last("low"), "h": last("high"), "down": last("on")})
    fnum, block = F.col("l") + 256 * F.col("h").bitwiseAND(7), F.shiftright("h", 3).bitwiseAND(7)
    e = e.withColumn("pitch", F.when(fnum == 0, 0).otherwise(fnumber_to_midi(fnum, block, TEXT_CLOCK, TEXT_SCALE)))
    # the pitch that a channel has been found at: by its low frequency bytes and its key-ons
    found = F.when((F.col("on") == 1) | F.col("low").isNotNull(), F.col("pitch"))
    before = F.coalesce(F.last(found, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumn("before", before)
    name, note = F.concat(F.lit("CH"), F.col("ch").cast("string")), midi_name(F.col("pitch"), FLATS)
    bend = (F.col("down") == 1) & (F.col("pitch") != F.col("before")) & (F.col("pitch") > 0)
    token = (
        F.when(F.col("on") == 1, F.concat_ws(":", name, F.lit("ON"), F.when(F.col("pitch") > 0, note).otherwise("X"))).when(F.col("on") == 0, F.concat_ws(":", name, F.lit("OFF")))
        .when(F.col("low").isNotNull(), F.when(bend, F.concat_ws(":", name, F.lit("PITCH"), note))).when(F.col("high").isNotNull(), F.lit(None))
        .when(F.col("type") == WAIT, F.when(value > 0, F.concat(F.lit("<WAIT:"), nearest_bin(value, BINS).cast("string"), F.lit(">"))))
        .when(F.col("type") == PSG, F.format_string("PSG:%02X", value)).otherwise(F.format_string("FM%d:%02X:%02X", port, reg, value))
    )
    return e.select("track_id", "seq", token.alias("token")).where("token IS NOT NULL")


_ROW = "struct<type: tinyint, register: smallint, value: int>"


def _row(kind: Column | int, register: Column | int, value: Column | int) -> Column:
    part = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(part(kind).cast("tinyint").alias("type"), part(register).cast("smallint").alias("register"), part(value).cast("int").alias("value"))


def note_writes(tokens: DataFrame, changes_only: bool = False) -> DataFrame:
    """Event rows (as read_events() gives them) of note_tokens()'s tokens, with an end for each track.

    A note is tuned to the F-number and block of least error and written as the high byte, the low byte
    and the key; ``X`` sounds as middle C. With ``changes_only`` a channel that already has a pitch is
    not tuned to it again. Strings that are no tokens give nothing.
    """
    part = F.split("token", ":")
    hexed = lambda k: F.conv(F.get(part, F.lit(k)), 16, 10).cast("int")
    kind = F.when(F.col("token").rlike(r"^CH[1-6]:(ON|PITCH):(X|[A-G][#b]?-?\d+)$"), F.get(part, F.lit(1))).when(F.col("token").rlike("^CH[1-6]:OFF$"), "OFF")
    t = tokens.select("track_id", "seq", "token", kind.alias("kind"), F.when(kind.isNotNull(), F.substring("token", 3, 1).cast("int")).alias("ch"))
    note = F.get(part, F.lit(2))
    t = t.withColumn("tuned", F.when(F.col("kind").isin("ON", "PITCH"), least_error(F.when(note == "X", 60).otherwise(name_to_midi(note)))))
    along = W.partitionBy("track_id", "ch").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    held = F.last("tuned", ignorenulls=True).over(along).eqNullSafe(F.col("tuned")) if changes_only else F.lit(False)
    t = t.withColumn("held", held)
    port, place = F.when(F.col("ch") <= 3, PORT0).otherwise(PORT1), (F.col("ch") - 1) % 3
    key = F.when(F.col("ch") <= 3, F.col("ch") - 1).otherwise(F.col("ch"))
    fnum, block = F.col("tuned.fnum"), F.col("tuned.block")
    none = F.array().cast(f"array<{_ROW}>")
    tune = F.when(F.col("held"), none).otherwise(F.array(_row(port, 0xA4 + place, block * 8 + F.shiftright(fnum, 8)), _row(port, 0xA0 + place, fnum.bitwiseAND(255))))
    rows = (
        F.when(F.col("kind") == "ON", F.concat(tune, F.array(_row(PORT0, 0x28, key + 0xF0)))).when(F.col("kind") == "PITCH", tune).when(F.col("kind") == "OFF", F.array(_row(PORT0, 0x28, key)))
        .when(F.col("token").rlike(IS_WAIT), F.array(_row(WAIT, 0, bin_value(F.regexp_extract("token", r"(\d+)", 1).cast("int"), BINS))))
        .when(F.col("token").rlike("^PSG:[0-9A-F]{2}$"), F.array(_row(PSG, 0, hexed(1))))
        .when(F.col("token").rlike("^FM[01]:[0-9A-F]{2}:[0-9A-F]{2}$"), F.array(_row(F.when(F.substring("token", 3, 1) == "1", PORT1).otherwise(PORT0), hexed(1), hexed(2)))).otherwise(none)
    )
    w = W.partitionBy("track_id").orderBy("seq")
    ends = F.when(F.lead("seq").over(w).isNull(), F.array(_row(END, 0, 0))).otherwise(none)
    flat = t.withColumn("rows", F.concat(rows, ends)).select("track_id", "seq", F.posexplode("rows").alias("k", "r")).select("track_id", "seq", "k", "r.*")
    w = W.partitionBy("track_id").orderBy("seq", "k")
    waited = F.sum(F.when(F.col("type") == WAIT, F.col("value")).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    return flat.select(
        "track_id", (F.row_number().over(w) - 1).alias("seq"), "type", "register", "value", F.coalesce(waited, F.lit(0)).cast("long").alias("sample_pos"), F.lit(None).cast("long").alias("pcm_offset"), F.lit(None).cast("string").alias("error")
    )


def build_vocabulary(tokens: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """``token, n, id``: special ids 0..3, a wait bin each, then tokens by frequency."""
    events = tokens.where(~F.col("token").rlike(IS_WAIT))
    return corpus.vocabulary(events, "token", least, most, offset=4 + len(BINS))


def vocabulary_summary(vocabulary: DataFrame) -> DataFrame:
    """One row: how many ids are special, waits, notes and other writes, and all of them."""
    note = F.col("token").rlike("^CH[1-6]:(ON|OFF|PITCH)")
    counts = vocabulary.agg(F.count_if(note).alias("notes"), F.count_if(~note).alias("writes"))
    return counts.select(F.lit(4).cast("long").alias("special"), F.lit(len(BINS)).cast("long").alias("waits"), "notes", "writes", (4 + len(BINS) + F.col("notes") + F.col("writes")).alias("size"))


def encode(tokens: DataFrame, vocabulary: DataFrame, marks: bool = False) -> DataFrame:
    """``track_id, ids``: known tokens alone, in order; with ``marks`` between those of begin and end."""
    wait = F.col("token").rlike(IS_WAIT)
    known = tokens.join(corpus.small(vocabulary.select("token", "id")), "token", "left")
    known = known.withColumn("id", F.when(wait, 4 + F.regexp_extract("token", r"(\d+)", 1).try_cast("int")).otherwise(F.col("id")))
    # a track of unknown tokens alone has its marks
    kept = known if marks else known.where("id IS NOT NULL")
    own = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("seq", "id")))
    ids = kept.groupBy("track_id").agg(F.transform(F.array_sort(own), lambda x: x["id"].cast("int")).alias("ids"))
    return ids.withColumn("ids", F.concat(F.array(F.lit(corpus.BOS)), "ids", F.array(F.lit(corpus.EOS)))) if marks else ids


def token_strings(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``track_id, seq, token`` of ids of note tokens; special and unknown ids give nothing."""
    flat = ids.select("track_id", F.posexplode("ids").alias("seq", "id"))
    named = flat.join(corpus.small(vocabulary.select("id", "token")), "id", "left")
    wait = F.concat(F.lit("<WAIT:"), (F.col("id") - 4).cast("string"), F.lit(">"))
    return named.select("track_id", "seq", F.when(F.col("id").between(4, 3 + len(BINS)), wait).otherwise(F.col("token")).alias("token")).where("token IS NOT NULL")


def decode_events(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``track_id, place, type, register, value`` from ids of event tokens; special and unknown ids give nothing."""
    flat = ids.select("track_id", F.posexplode("ids").alias("place", "id"))
    named = flat.join(corpus.small(vocabulary.select("id", "token")), "id", "left")
    wait = F.col("id").between(4, 3 + len(BINS))
    part = F.split("token", ":")
    kind = F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(v), F.lit(k))]), F.element_at(part, 1))
    number = lambda k: F.conv(F.element_at(part, k), 16, 10).cast("int")
    row = F.when(wait, F.struct(F.lit(WAIT).alias("type"), F.lit(0).alias("register"), bin_value(F.col("id") - 4, BINS).alias("value"))).when(
        F.col("token").isNotNull(), F.struct(kind.alias("type"), number(2).alias("register"), number(3).alias("value"))
    )
    return named.select("track_id", "place", row.alias("r")).where("r IS NOT NULL").select("track_id", "place", "r.*")
