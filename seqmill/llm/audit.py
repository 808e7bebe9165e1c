"""Filter interaction audit: what each of several filters removes, in each order that they can have.

A document is a mask of the filters that it fails. The first four are functions of the text; the fifth,
"identical to a smaller id's text", needs the smallest id of each text, which grouped aggregation over
digests finds. Documents then come down to cells (part, mask) with counts, 32 a part at most, and all
that follows works on cells.

Long form: each cell is unpivoted against every step of every order. A running bit-or over the steps
before tells whether an earlier filter has taken the cell's documents away. Conditional sums give the
figures of a step, and a window over all rows of a filter gives its total.

Skew: no text is shuffled. Rows are counted by digest and id first, so mass copies shrink within the
task that reads them; the smallest id of a text is matched by (digest, id), never by digest alone, so
that a text that a third of all rows hold is spread over tasks.

Odd input: a null text is empty, a null source is the empty string. A null id is neither smaller nor
greater than another: its row fails no ``E`` and has no label. Rows repeated with their id are counted
each, and are no duplicates of each other; an id that is labelled twice is good (toxic) if any row says
so. An empty table gives no rows. Columns besides the four that are read do not matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.session import stored

FILTERS = "ABCDE"
#: Fixed values of the filters: words; distinct words and capitals per cent; characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SIGNS)]
    mask = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask.bitwiseOR(F.when(fail, 1 << k).otherwise(0))
    return mask


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many documents fail just these filters."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    read = docs.select(
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"),
    )
    rows = read.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.groupBy("id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    marked = rows.join(marks, "id", "left").fillna(False, ["good", "toxic"])
    # of each text, part and label: how many rows, how many of no id, and the smallest id with its rows
    texts = stored(
        marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("id").alias("id"), F.min_by("n", "id").alias("first")
        ),
        "texts",
    )
    smallest = texts.groupBy("digest").agg(F.min("id").alias("id"))
    kept = texts.join(smallest, ["digest", "id"], "left_semi")
    fifth = F.col("mask").bitwiseOR(F.lit(16))
    signed = texts.select("part", fifth.alias("mask"), "good", "toxic", (F.col("n") - F.col("nameless")).alias("n"))
    signed = signed.unionByName(texts.select("part", "mask", "good", "toxic", F.col("nameless").alias("n")))
    signed = signed.unionByName(kept.select("part", "mask", "good", "toxic", F.col("first").alias("n")))
    signed = signed.unionByName(kept.select("part", fifth.alias("mask"), "good", "toxic", (-F.col("first")).alias("n")))
    within = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return signed.groupBy("part", "mask").agg(F.sum("n").alias("n"), within("good"), within("toxic"))


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Cells ``(part, mask, n, good, toxic)`` -> a row for each part, order and step, zeros included.

    ``filters`` names the bits of the mask from the lowest on, a letter each; at most eight, as the orders
    are all their permutations. ``(part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley)``.
    """
    if not 0 < len(filters) <= 8 or len(set(filters)) < len(filters) or not filters.isalnum():
        raise ValueError("one to eight filters, each with a letter of its own")
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    long = found.select("part", "mask", "n", "good", "toxic", F.explode(orders).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)"))
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0
    total = lambda when, name, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).alias(name)
    steps = long.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "filter").agg(
        total(~fails & ~gone, "kept"),
        total(fails & ~gone, "removed"),
        total(fails & gone, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(fails & ~gone, "good_lost", "good"),
        total(fails & ~gone, "toxic_lost", "toxic"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))
