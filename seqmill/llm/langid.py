"""Language identification by fusion of evidence, in one application of Bayes' rule.

Four kinds of evidence are taken as independent given the language:

- the text: a multinomial over hashed byte trigrams for each language, counted by grouped
  aggregation over all labelled rows of the training folds. Every language with any labelled letters
  is learned; its table is smoothed towards the mean of all languages by as much as it has different
  trigrams, so one of little text is sure of what it has seen and leaves the rest to the others;
- the language that markup declares (``<html lang="fr">``), with a reliability counted over all rows
  whose text alone is sure, by grouped aggregation;
- the suffix of the address (``.de``, or a path that starts with ``/fr/``), likewise;
- the host: a prior from all its rows' text posteriors, summed by grouped aggregation, smoothed
  towards that of the host's suffix, which is smoothed towards that of the corpus. A row's own
  posterior is taken out of its host's sum, so that it does not speak twice.

Besides the languages learned there is ``und``, whose text is uniform over trigrams: what no
language explains better. Text evidence is tempered: neighbouring trigrams say much the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmill.session import fresh, small_batches, stored

BUCKETS = 1 << 13
FOLDS, HELD_OUT = 5, 0
FLAT = 0.5  # share of the even distribution in what tables are smoothed towards
LANGUAGES = 500  # languages at most, a bound on the table; beyond it learning stops with an error
TEMPER = 0.3  # weight of a trigram's log likelihood
RELIABLE = {"declared": 0.9, "says": 0.8}  # how often a language declared by markup or address is the right one, before any rows are counted
RELIABLE_WEIGHT = 20.0  # rows that this counts for
SURE = 0.99  # probability by text alone from which a row says whether its declarations are right
HOST_WEIGHT, SUFFIX_WEIGHT = 10.0, 50.0  # rows that the level above counts for
UND_PRIOR = 1e-4
ACCEPT = 0.5  # smallest probability that a kept row is in one of the languages learned, whichever
HOT_SHARE, SALTS = 100, 64  # a host with a hundredth of all rows (there are a hundred at most) is joined in so many parts
CHUNK = 1 << 20  # bytes of a text scored at a time
#: Country suffixes that say a language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

MARKUP = r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})"
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)"
PATH_LANGUAGE = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]+/([a-z]{2})(?:[/?#]|$)"


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a text, lower-cased, without digits, runs of other bytes joined."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        letters = (part >= 97) & (part <= 122) | (part >= 128)
        keep = letters | np.append(True, letters[:-1])  # of other bytes in a row only the first
        b = np.where(letters, part, 32)[keep].astype(np.uint32)
        b = np.concatenate([[32], b, [32]]).astype(np.uint32)
        if letters.any():
            x = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
            yield (x >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]  # the last is und
    table: np.ndarray  # (languages, BUCKETS) log probabilities, tempered

    def log_likelihoods(self, text: str | None) -> np.ndarray:
        """Of the text under each language, less the largest; no letters: all zero."""
        out = np.zeros(len(self.languages))
        for b in buckets(text):
            out += self.table[:, b].sum(axis=1)
        return out - out.max()


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of what a task holds: a row for each language and bucket at most."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for b in buckets(text.as_py()):
                own += np.bincount(b, minlength=BUCKETS)
    for lang, own in held.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])


def learn_text(labelled: DataFrame, languages: list[str]) -> TextModel:
    """``labelled(lang, text)`` -> model of those of the languages whose texts have letters. The counts are at most languages x BUCKETS."""
    known = labelled.where(F.col("lang").isin(languages) & F.col("text").isNotNull()).select("lang", "text")
    found = known.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found.lang.unique())
    counts = np.zeros((len(languages), BUCKETS))
    for k, lang in enumerate(languages):
        own = found[found.lang == lang]
        counts[k, own.bucket.to_numpy(np.int64)] = own.n.to_numpy(float)
    flat = np.full((1, BUCKETS), 1 / BUCKETS)
    table = np.log(np.vstack([smoothed(counts), flat]))
    return TextModel([*languages, "und"], TEMPER * table)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the trigrams of each language, a row each, from counts.

    What a language has not seen goes by the mean of all languages and by the even distribution; its
    weight is the share of first occurrences, the number of different trigrams against all of them.
    """
    if not len(counts):
        return counts
    n, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    mean = (counts / n).mean(axis=0, keepdims=True)
    return (counts + kinds * ((1 - FLAT) * mean + FLAT / BUCKETS)) / (n + kinds)


_PARTS = ("ll", "declared", "says", "host", "suffix")


def evidence_columns(text: str, address: str | None = None, host: str | None = None, markup: str | None = None) -> dict[str, Column]:
    """What else speaks of a row's language: declared by markup, said by suffix or path, host and its suffix. Missing: null."""
    none = F.lit(None).cast("string")
    column = lambda c: F.col(f"`{c}`").cast("string") if c else None
    empty = lambda c: F.nullif(c, F.lit(""))
    declared = empty(F.lower(F.regexp_extract(column(markup or text), MARKUP, 1)))
    where = column(address)
    name = F.lower(empty(F.regexp_extract(where, HOST, 1))) if address else column(host) if host else none
    suffix = F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)) if (address or host) else none
    path = empty(F.regexp_extract(where, PATH_LANGUAGE, 1)) if address else none
    spoken = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    return {"declared": declared, "says": F.coalesce(path, F.try_element_at(spoken, suffix)), "host": name, "suffix": suffix}


def _log_odds(r: float, n: int) -> tuple[float, float]:
    """Log likelihood of a declaration under the language it names, and under each of the n-1 others."""
    return float(np.log(r)), float(np.log((1 - r) / max(1, n - 1)))


def _plus(ll: Column, said: Column, languages: list[str], r: float) -> Column:
    """Log likelihoods with a declaration added; one of no language known here says nothing."""
    right, wrong = _log_odds(r, len(languages))
    at = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in languages[:-1]]), said), F.lit(0)) if len(languages) > 1 else F.lit(0)
    return F.when(at > 0, F.transform(ll, lambda x, i: x + F.when(i == at - 1, right).otherwise(wrong))).otherwise(ll)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _likelihoods(model: TextModel):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.log_likelihoods(t) for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")


def _own(ll: Column) -> Column:
    """Posterior from a row's own evidence, as an array."""
    top = F.array_max(ll)
    e = F.transform(ll, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(df: DataFrame, key: str | None, n: int) -> DataFrame:
    sums = [F.sum(F.element_at("own", k + 1)).alias(f"s{k}") for k in range(n)]
    grouped = df.groupBy(key) if key else df.groupBy()
    return grouped.agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias("sums"))


@dataclass
class Priors:
    """Summed posteriors of the corpus, of suffixes and of hosts."""

    corpus: list[float]
    suffixes: DataFrame  # suffix, sums
    hosts: DataFrame  # host, suffix, sums


def _mixed(sums: Column, above: Column, weight: float) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(sums.alias("s"), above.alias("a")), lambda z: (z["s"] + weight * z["a"]) / (total + weight))


def host_priors(rows: DataFrame, n: int) -> Priors:
    """``rows(own, host, suffix)`` -> sums by level; a null host or suffix has no level of its own."""
    by_host = stored(_sums(rows.where(F.col("host").isNotNull()).withColumn("key", F.struct("host", "suffix")), "key", n).select("key.host", "key.suffix", "sums"), "hosts")
    corpus = _sums(rows, None, n).first()["sums"]
    suffixes = _sums(by_host.where(F.col("suffix").isNotNull()).select("suffix", F.col("sums").alias("own")), "suffix", n)
    return Priors(list(corpus), suffixes, by_host)


def posterior(ll: np.ndarray, own: np.ndarray, host_sums: np.ndarray | None, suffix_prior: np.ndarray) -> np.ndarray:
    """Fuse the row's own evidence with its host's prior, its own share taken out."""
    prior = suffix_prior
    if host_sums is not None:
        rest = np.maximum(host_sums - own, 0)
        prior = (rest + HOST_WEIGHT * suffix_prior) / (rest.sum() + HOST_WEIGHT)
    return _softmax(ll + np.log(np.maximum(prior, 1e-12)))


def _fuse(base: np.ndarray):
    """Log likelihoods, the host's sums, the suffix' prior -> posterior."""

    def run(ll: pd.Series, sums: pd.Series, above: pd.Series) -> pd.Series:
        out = []
        for x, s, a in zip(ll, sums, above, strict=True):
            x = np.asarray(x, float)
            s = None if s is None else np.asarray(s, float)
            a = base if a is None else np.asarray(a, float)
            out.append(posterior(x, _softmax(x), s, a))
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"ll": pd.Series, "sums": pd.Series, "above": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")


@dataclass
class Identifier:
    model: TextModel
    text: str = "text"
    address: str | None = None
    host: str | None = None
    markup: str | None = None

    def evidence(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """``df`` with a column for each of _PARTS, and the names of these."""
        small_batches(df.sparkSession)
        names = dict(zip(_PARTS, fresh(*_PARTS), strict=True))
        text = F.coalesce(F.col(f"`{self.text}`").cast("string"), F.lit(""))
        columns = {"ll": _likelihoods(self.model)(text), **evidence_columns(self.text, self.address, self.host, self.markup)}
        return df.withColumns({names[k]: c for k, c in columns.items()}), names

    def reliabilities(self, seen: DataFrame, names: dict[str, str]) -> dict[str, float]:
        """How often declarations agree with the text, where this is sure."""
        languages = self.model.languages
        if len(languages) == 1:
            return dict(RELIABLE)
        own = _own(F.col(names["ll"]))
        known = F.array(*[F.lit(x) for x in languages])
        best = F.element_at(known, F.array_position(own, F.array_max(own)).cast("int"))
        sure = seen.where((F.array_max(own) >= SURE) & (best != "und")).select(best.alias("best"), *[F.col(names[k]).alias(k) for k in RELIABLE])
        counted = [f for k in RELIABLE for c in [F.col(k).isin(languages[:-1])] for f in (F.count_if(c).alias(f"{k}_n"), F.count_if(c & (F.col(k) == F.col("best"))).alias(k))]
        row = sure.agg(*counted).first()
        return {k: (row[k] + RELIABLE_WEIGHT * r) / (row[f"{k}_n"] + RELIABLE_WEIGHT) for k, r in RELIABLE.items()}

    def fuse(self, seen: DataFrame, names: dict[str, str]) -> tuple[DataFrame, str]:
        """Rows with evidence(), of all of the corpus and stored, with the column of posteriors, and its name."""
        languages, rates = self.model.languages, self.reliabilities(seen, names)
        full, result, salt, sums, above_name, host = fresh("ll", "posterior", "salt", "sums", "above", "host")
        ll = F.col(names["ll"])
        for kind, r in rates.items():
            ll = _plus(ll, F.col(names[kind]), languages, r)
        seen = seen.withColumn(full, ll)
        priors = host_priors(seen.select(_own(F.col(full)).alias("own"), F.col(names["host"]).alias("host"), F.col(names["suffix"]).alias("suffix")), len(languages))
        corpus = np.array(priors.corpus) + 1.0
        if len(languages) > 1:
            corpus[-1] = UND_PRIOR * corpus[:-1].sum()
        base = corpus / corpus.sum()
        above = F.array(*[F.lit(float(x)) for x in base])
        levels = priors.suffixes.select("suffix", _mixed(F.col("sums"), above, SUFFIX_WEIGHT).alias("above"))
        # a host's sums add up to its rows; hosts with many of all rows, and rows of no host, are dealt to several parts
        rows = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x)
        hot = [r["host"] for r in priors.hosts.where(rows >= max(1.0, sum(priors.corpus) / HOT_SHARE)).select("host").collect()]
        parts = F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        hosts = priors.hosts.join(levels, "suffix", "left").select(F.col("host").alias(host), F.col("sums").alias(sums), F.coalesce("above", above).alias(above_name), F.explode(parts).alias(salt))
        own = F.col(names["host"])
        dealt = seen.withColumn(salt, F.when(own.isNull() | own.isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
        joined = dealt.join(hosts.withColumnRenamed(host, names["host"]), [names["host"], salt], "left")
        return joined.withColumn(result, _fuse(base)(full, sums, above_name)), result

    def best(self, column: str) -> tuple[Column, Column]:
        """Language and its posterior, from a column of posteriors or of log likelihoods."""
        p = F.col(column)
        known = F.array(*[F.lit(x) for x in self.model.languages])
        return F.element_at(known, F.array_position(p, F.array_max(p)).cast("int")), F.array_max(p)

    def accepted(self, column: str) -> Column:
        """Is the row in one of the languages learned? A short text may be in either of two."""
        return 1 - F.element_at(column, len(self.model.languages)) >= ACCEPT


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **columns: str) -> Identifier:
    """From the rows of ``docs`` that carry a language, held-out fold left out.

    Every language with a letter of labelled text is learned; more than LANGUAGES of them are an error.
    Rows without id are trained on.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.coalesce(fold(F.col(f"`{doc_id}`")), F.lit(1)).alias("fold")).where((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in rows.where("lang <> 'und'").select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled; raise langid.LANGUAGES, which bounds the table")
    return Identifier(learn_text(rows, languages), text, **columns)


def identify(df: DataFrame, how: Identifier, id_col: str = "doc_id") -> DataFrame:
    """``(id, language, posterior, text_language, accepted)`` for each row.

    Null and empty texts say nothing: their host and the corpus decide. With no languages learned all
    rows are ``und``. Repeated rows count each; no rows give no rows.
    """
    (key,) = fresh("id")
    scored, names = how.evidence(df.select(F.col(f"`{id_col}`").alias(key), *[F.col(f"`{c}`") for c in dict.fromkeys(c for c in (how.text, how.address, how.host, how.markup) if c)]))
    fused, result = how.fuse(stored(scored.select(key, *names.values()), "language"), names)
    language, top = how.best(result)
    return fused.select(F.col(key).alias(id_col), language.alias("language"), F.round(top, 6).alias("posterior"), how.best(names["ll"])[0].alias("text_language"), how.accepted(result).alias("accepted"))


def keep_identified(df: DataFrame, how: Identifier) -> DataFrame:
    """The rows that are in one of the languages learned with a probability of ACCEPT at least, as they were."""
    seen, names = how.evidence(df)
    fused, result = how.fuse(stored(seen, "language"), names)
    return fused.where(how.accepted(result)).select(*[F.col(f"`{c}`") for c in df.columns])
