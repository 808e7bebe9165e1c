"""Scalar functions over names, hashes and token ids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of compound names; what a name may end with in parentheses: a region, a revision, or what starts with a region's letter.
NAME_SEPARATORS = r",|;|\band\b"
NAME_SUFFIX = r"japan|usa|us|europe|world|rev\s*[a-z0-9]+|[jue][^)]*"
REGION_SUFFIX = rf"(?i)\s*\(({NAME_SUFFIX})\)\s*$"
#: The context of a track by words of its title, the first that is found, Japanese words before English ones.
CONTEXT_WORDS = (
    ("boss", "ボス|ファイト"),
    ("title", "タイトル|オープニング"),
    ("credits", "エンディング|スタッフ"),
    ("gameover", "ゲームオーバー"),
    ("boss", r"\b(boss|battle|fight|combat|versus|vs\.?)\b"),
    ("title", r"\b(title|opening|intro|name\s*entry|player\s*select|character\s*select)\b"),
    ("credits", r"\b(staff|ending|credit|outro|epilogue|fin(?:ale?)?)\b"),
    ("gameover", r"\b(game\s*over|continue|death)\b"),
)


def split_names(name: Column) -> Column:
    """Names of a compound credit, without parentheses; single letters and empty parts go."""
    parts = F.transform(F.split(name, NAME_SEPARATORS), lambda x: F.trim(F.regexp_replace(x, r"\([^)]*\)", "")))
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~F.startswith(x, F.lit("(")))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_name(name: Column) -> Column:
    """In lower case, without the last suffix in parentheses that names a region or a revision."""
    return F.lower(_stripped(F.regexp_replace(_stripped(name), REGION_SUFFIX, "")))


def context(title: Column) -> Column:
    """``boss, title, credits, gameover, level`` or ``unknown`` from a track's title; null is unknown.

    Titles of under three characters, of digits, or of no ASCII letter or sign at all without a known
    word say nothing.
    """
    t = _stripped(F.coalesce(title, F.lit("")))
    out = F.lit("level")
    for k, (name, words) in reversed(list(enumerate(CONTEXT_WORDS))):
        if k == 3:  # between the Japanese words and the English ones
            out = F.when(~t.rlike(r"[\x00-\x08\x0E-\x1B\x21-\x7F]"), "unknown").otherwise(out)
        out = F.when((F.lower(t) if k > 3 else t).rlike(words), name).otherwise(out)
    return F.when((F.length(t) < 3) | t.rlike(r"(?U)^\d+$"), "unknown").otherwise(out)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def hash_bucket(key: Column, buckets: int = 10_000) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def event_key(kind: Column, register: Column, value: Column) -> Column:
    return F.format_string("%s:%02X:%02X", kind, register, value)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\-.]", "_")


def packed_bits(tokens: Column, vocabulary: int) -> Column:
    """Bytes of that many ids at the fewest bits each."""
    return F.ceil(tokens * max(1, (vocabulary - 1).bit_length()) / 8).cast("long")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def absolute(link: Column, site: str) -> Column:
    """A link with the site before it where it has none."""
    return F.when(link.rlike("(?i)^https?://"), link).otherwise(F.concat(F.lit(site.rstrip("/") + "/"), F.ltrim(link, F.lit("/"))))


def pack_links(html: Column, site: str, mark: str = "/files/") -> Column:
    """Absolute links to packs: those with the mark in them that end in .zip, each once, in order."""
    packs = F.filter(links(html), lambda x: F.contains(x, F.lit(mark)) & F.endswith(F.lower(x), F.lit(".zip")))
    return F.array_distinct(F.transform(packs, lambda x: absolute(x, site)))


def largest_page(url: Column, name: str = "page") -> Column:
    found = F.regexp_extract_all(url, F.lit(rf"[?&]{name}=(\d+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("int"))), F.lit(0))
