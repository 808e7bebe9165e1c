"""Queries over documents and the relational tables, read as a corpus of token sequences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.functions import text as names
from seqmill.functions.music import duration_bucket
from seqmill.operators import augment, corpus, quantiles
from seqmill.plans.registry import query
from seqmill.session import table

TOK = "tk AS (SELECT doc_id, lang, source, unnest(string_split(text, ' ')) AS token FROM documents)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", "source", F.explode(F.split("text", " ")).alias("token"))


@query("""SELECT doc_id, source, substr(sha256(text), 1, 16) AS content FROM documents
  QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) = 1""")
def content_dedup(spark, sf_dir):
    h = F.sha2("text", 256)
    d = _docs(spark, sf_dir).select("doc_id", "source", h.alias("h"))
    return corpus.first_wins(d, F.col("h"), ["source", "doc_id"]).select("doc_id", "source", F.substring("h", 1, 16).alias("content"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 500 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return corpus.hash_split(d, "key").select("doc_id", "split")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM s)
  SELECT source, n, k BETWEEN 6 AND 13 AS held_out FROM r""")
def group_holdout(spark, sf_dir):
    return corpus.hold_out(_docs(spark, sf_dir), "source")


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), q AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS d, len(list_filter(w, lambda x: length(x) <= 2)) AS s FROM t)
  SELECT doc_id, n AS tokens, CASE WHEN n < 32 THEN 'short' WHEN d < 5 THEN 'few_distinct' WHEN s / n > 0.5 THEN 'small_words' END AS reason FROM q""")
def quality_gate(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w"))
    n = F.size("w")
    short = F.size(F.filter("w", lambda x: F.length(x) <= 2))
    reason = corpus.gate((n < 32, "short"), (F.size(F.array_distinct("w")) < 5, "few_distinct"), (short / n > 0.5, "small_words"))
    return t.select("doc_id", n.cast("long").alias("tokens"), reason.alias("reason"))


@query("SELECT d.doc_id, coalesce(l.quality, 1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1 AND coalesce(l.toxic, 0) = 0 AND d.n_chars BETWEEN 50 AND 100000")
def metadata_filter(spark, sf_dir):
    d = _docs(spark, sf_dir).where(F.col("n_chars").between(50, 100_000)).select("doc_id")
    side = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = d.join(side, "doc_id", "left").withColumns({"quality": F.coalesce("quality", F.lit(1)), "toxic": F.coalesce("toxic", F.lit(0))})
    return joined.where("quality = 1 AND toxic = 0").select("doc_id", "quality")


VOCAB = f"{TOK}, vo AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS id FROM (SELECT token, count(*) AS n FROM tk GROUP BY 1 HAVING count(*) >= 2))"


def _vocab(spark, sf_dir):
    return corpus.vocabulary(_tokens(spark, sf_dir), "token")


@query(f"WITH {VOCAB} SELECT token, n, id FROM vo")
def vocab_build(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query(f"WITH {VOCAB} SELECT doc_id, count(*) AS tokens, count(*) FILTER (id IS NULL) AS unknown, CAST(sum(coalesce(id, 3)) AS BIGINT) AS id_sum FROM tk LEFT JOIN vo USING (token) GROUP BY 1")
def vocab_encode(spark, sf_dir):
    ids = corpus.encode(_tokens(spark, sf_dir), "token", _vocab(spark, sf_dir))
    return ids.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_if(F.col("id") == 3).alias("unknown"), F.sum("id").cast("long").alias("id_sum"))


@query(f"WITH {VOCAB}, e AS (SELECT doc_id, coalesce(id, 3) AS id FROM tk LEFT JOIN vo USING (token)) SELECT id, count(*) AS n, any_value(token) AS token FROM e LEFT JOIN (SELECT id, token FROM vo) USING (id) GROUP BY 1")
def vocab_decode(spark, sf_dir):
    v = _vocab(spark, sf_dir)
    counts = corpus.encode(_tokens(spark, sf_dir), "token", v).groupBy("id").agg(F.count("*").alias("n"))
    return corpus.decode(counts, v)


NAMED = r"""na AS (SELECT p_partkey, p_name, list_filter(list_transform(regexp_split_to_array(p_name, ',|;|\band\b'), lambda x: trim(regexp_replace(x, '\([^)]*\)', '', 'g'))),
  lambda x: length(x) > 1 AND NOT starts_with(x, '(')) AS parts FROM (SELECT p_partkey, p_brand || ' and ' || p_type || '; ' || p_name AS p_name FROM part))"""


def _names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat("p_brand", F.lit(" and "), "p_type", F.lit("; "), "p_name").alias("p_name"))


TOP = f"{NAMED}, tn AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name) - 1 AS id FROM (SELECT unnest(parts) AS name, count(*) AS n FROM na GROUP BY 1) ORDER BY n DESC, name LIMIT 128)"


@query(f"WITH {TOP} SELECT name, n, id FROM tn")
def topk_names(spark, sf_dir):
    return corpus.top_names(_names(spark, sf_dir), "p_name", 128)


@query(f"""WITH {TOP}, c AS (SELECT p_partkey, p_name AS name, 0 AS pos FROM na UNION ALL SELECT p_partkey, unnest(parts), generate_subscripts(parts, 1) FROM na),
  h AS (SELECT p_partkey, arg_min(id, pos) AS id FROM c JOIN tn USING (name) GROUP BY 1) SELECT p_partkey, coalesce(id, 128) AS id FROM part LEFT JOIN h USING (p_partkey)""")
def author_lookup(spark, sf_dir):
    n = _names(spark, sf_dir)
    return corpus.look_up(n, "p_partkey", "p_name", corpus.top_names(n, "p_name", 128), 128)


#: What stands after a name, and what is left of it; written out, so the SQL needs no pattern.
SUFFIXES = ((" (Europe) ", ""), (" (Rev A)", ""), (" (REV 01) ", ""), (" (USA, Korea)", ""), (" (World)", ""), (" (Beta)", " (beta)"), ("(J)", ""), (" (Rev)", " (rev)"), (" [USA]", " [usa]"), ("", ""))


@query("SELECT lower(p_name) || CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{left}'" for k, (_, left) in enumerate(SUFFIXES)) + " END AS name, count(*) AS n FROM part GROUP BY 1")
def name_normalize(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(x) for x, _ in SUFFIXES]), (F.col("p_partkey") % 10 + 1).cast("int"))
    raw = F.concat(F.lit("  "), "p_name", suffix)
    return table(spark, sf_dir, "part").groupBy(names.normal_name(raw).alias("name")).agg(F.count("*").alias("n"))


#: Titles, and the context that each has; the page says which of them.
TITLES = (("Boss Battle 2", "boss"), ("Final Fight", "boss"), ("Stage 1 vs. Boss", "boss"), ("Title Screen", "title"), ("Character Select", "title"), ("Staff Roll", "credits"), ("Finale", "credits"), ("Game Over", "gameover"), ("Continue?", "gameover"), ("Green Hill", "level"),
  ("ボス戦", "boss"), ("タイトル", "title"), ("エンディング A", "credits"), ("ゲームオーバー", "gameover"), ("緑の丘", "unknown"), ("12", "unknown"), ("01234", "unknown"), ("", "unknown"), ("緑の丘 2", "level"), ("Embossed Vsync", "level"))


@query("SELECT page_id, CASE page_id % 20 " + " ".join(f"WHEN {k} THEN '{c}'" for k, (_, c) in enumerate(TITLES)) + " END AS context FROM pages")
def context_rules(spark, sf_dir):
    title = F.element_at(F.array(*[F.lit(t) for t, _ in TITLES]), (F.col("page_id") % 20 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", names.context(title).alias("context"))


BUCKET = "CASE WHEN s < 30 THEN '0-30' WHEN s < 60 THEN '30-60' WHEN s < 120 THEN '60-120' WHEN s < 180 THEN '120-180' WHEN s < 300 THEN '180-300' ELSE '300+' END"


@query(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM (SELECT n_chars / 20 AS s FROM documents) GROUP BY 1")
def duration_buckets(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(duration_bucket(F.col("n_chars") / 20).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (n_chars >= 20) AS valid, count(*) FILTER (n_chars < 20) AS invalid, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean,
  count(*) FILTER ({BUCKET.replace(' s ', ' n_chars / 20 ')} = '0-30') AS under_30, (SELECT list(doc_id ORDER BY doc_id)[1:50] FROM documents WHERE n_chars < 20) AS errors FROM documents""")
def validation_stats(spark, sf_dir):
    d = _docs(spark, sf_dir)
    bad = [r.doc_id for r in d.where("n_chars < 20").orderBy("doc_id").limit(50).select("doc_id").collect()]  # the report names fifty
    n = F.col("n_chars")
    stats = d.agg(F.count("*").alias("total"), F.count_if(n >= 20).alias("valid"), F.count_if(n < 20).alias("invalid"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"), F.count_if(duration_bucket(n / 20) == "0-30").alias("under_30"))
    return stats.withColumn("errors", F.array(*map(F.lit, bad)).cast("array<bigint>") if bad else F.lit(None).cast("array<bigint>"))


COVER = "s AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT n, count(*) AS groups FROM s GROUP BY 1)"


@query(f"WITH {COVER} SELECT n, groups, CAST(sum(groups) OVER (ORDER BY n DESC) AS BIGINT) AS groups_so_far, round(sum(n * groups) OVER (ORDER BY n DESC) / sum(n * groups) OVER (), 6) AS covered FROM b")
def coverage_curve(spark, sf_dir):
    return corpus.coverage(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(f"WITH {COVER} SELECT " + ", ".join(f"count(*) FILTER (n <= {k}) AS up_to_{k}" for k in (1, 2, 5, 10, 20, 30, 50)) + " FROM s")
def count_ecdf(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return s.agg(*[F.count_if(F.col("n") <= k).alias(f"up_to_{k}") for k in (1, 2, 5, 10, 20, 30, 50)])


def _grams(n: int) -> str:
    gram = " || chr(1) || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) AS gram FROM t WHERE len(w) >= {n}),
  c AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY 1, 2) SELECT doc_id, count(*) AS grams, count(*) FILTER (c > 1) AS repeated, round(count(*) FILTER (c > 1) / count(*), 6) AS share FROM c GROUP BY 1"""


@query(_grams(2))
def bigram_repeat(spark, sf_dir):
    return corpus.gram_repeats(_docs(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w")), "doc_id", "w", 2)


@query(_grams(3))
def trigram_repeat(spark, sf_dir):
    return corpus.gram_repeats(_docs(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w")), "doc_id", "w", 3)


ENTROPY = f"""{TOK}, c AS (SELECT doc_id, token, count(*) AS c FROM tk GROUP BY 1, 2), en AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS "distinct",
  round(CASE WHEN sum(c) < 10 THEN 0 ELSE log2(sum(c)) - sum(c * log2(c)) / sum(c) END, 6) AS bits FROM c GROUP BY 1)"""


@query(f"WITH {ENTROPY} SELECT * FROM en")
def token_entropy(spark, sf_dir):
    return corpus.row_entropy(_docs(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w")), "doc_id", "w")


@query(f"""WITH {ENTROPY}, m AS (SELECT lang, avg(n) AS n, avg(bits) AS bits FROM en JOIN documents USING (doc_id) GROUP BY 1), a AS (SELECT n, bits FROM m WHERE lang = 'en')
  SELECT lang, round(m.n, 6) AS mean_tokens, round(m.bits, 4) AS mean_bits, round(m.n - a.n, 6) AS gap_tokens, abs(m.bits - a.bits) < 0.5 AS close FROM m, a""")
def musicality_gap(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.split("text", " ").alias("w"))
    e = corpus.row_entropy(docs.select(F.struct("doc_id", "lang").alias("key"), "w"), "key", "w").select("key.lang", "n", "bits")
    m = e.groupBy("lang").agg(F.avg("n").alias("n"), F.avg("bits").alias("bits"))
    english = lambda c: F.max(F.when(F.col("lang") == "en", F.col(c))).over(W.partitionBy())  # noqa: E731  a row for each language
    joined = m.withColumns({"an": english("n"), "ab": english("bits")})
    return joined.select("lang", F.round("n", 6).alias("mean_tokens"), F.round("bits", 4).alias("mean_bits"), F.round(F.col("n") - F.col("an"), 6).alias("gap_tokens"), (F.abs(F.col("bits") - F.col("ab")) < 0.5).alias("close"))


IDS = "iq AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) * 37 % 600 AS INTEGER)) AS ids FROM documents)"


def _ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.transform(F.split("text", " "), lambda w: (F.length(w) * 37 % 600).cast("int")).alias("ids"))


SIZE = 512
PACKED = f"""{IDS}, fl AS (SELECT doc_id, unnest(ids) AS t, generate_subscripts(ids, 1) AS k FROM iq), po AS (SELECT t, row_number() OVER (ORDER BY doc_id, k) - 1 AS p FROM fl),
  wi AS (SELECT p // {SIZE + 1} AS "window", list(t ORDER BY p) AS a FROM po GROUP BY 1 HAVING count(*) = {SIZE + 1})"""


@query(f"""WITH {PACKED} SELECT "window", md5(array_to_string(a[1:{SIZE}], ',')) AS inputs, md5(array_to_string(list_transform(a[2:{SIZE + 1}], lambda t: CASE WHEN t = 0 THEN -100 ELSE t END), ',')) AS labels FROM wi""")
def window_pack(spark, sf_dir):
    w = augment.windows(_ids(spark, sf_dir), "doc_id", "ids", SIZE)
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda t: t.cast("string")), ",").cast("binary"))
    return w.select("window", joined("input_ids").alias("inputs"), joined("labels").alias("labels"))


@query(f"""WITH {PACKED}, r AS (SELECT "window", a[1:{SIZE}] AS a FROM wi WHERE "window" % 2 = 0), u AS (SELECT "window", unnest(a) AS t FROM r), c AS (SELECT "window", t, count(*) AS c FROM u WHERE t <> 0 GROUP BY 1, 2),
  h AS (SELECT "window", CASE WHEN sum(c) < 10 THEN 0 ELSE round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) END AS bits FROM c GROUP BY 1),
  s AS (SELECT "window", len(list_filter(a, lambda t: t < 0 OR t >= 500)) AS out_of_range, round(len(list_filter(a, lambda t: t = 0)) / len(a), 6) AS padding, len(list_distinct(a)) AS "distinct" FROM r)
  SELECT "window", out_of_range, padding, "distinct", coalesce(bits, 0) AS bits, "distinct" <= 2 AS degenerate, padding > 0.9 AS mostly_padding, coalesce(bits, 0) < 1 AS low_entropy FROM s LEFT JOIN h USING ("window")""")
def window_diagnostics(spark, sf_dir):
    w = augment.windows(_ids(spark, sf_dir), "doc_id", "ids", SIZE)
    return corpus.window_report(w, "input_ids", vocabulary_size=500, every=2)


def _digest(df, *keys):
    return df.select("doc_id", *keys, F.md5(F.array_join(F.transform("ids", lambda t: t.cast("string")), ",").cast("binary")).alias("ids"))


T_KEY = "CASE WHEN t BETWEEN 379 AND 466 THEN greatest(379, least(466, t + {s})) WHEN t BETWEEN 185 AND 208 THEN 185 + (t - 185) // 12 * 12 + ((t - 185) % 12 + {s} + 12) % 12 ELSE t END"
T_TEMPO = "CASE WHEN t BETWEEN 4 AND 184 THEN 4 + greatest(0, least(180, CAST(ceil((t + 56) * CAST({s} AS DOUBLE) - 0.5) AS INTEGER) - 60)) ELSE t END"
T_VEL = "CASE WHEN t BETWEEN 467 AND 482 THEN greatest(467, least(482, t + {s})) ELSE t END"


def _augment_sql(template: str, values, name: str) -> str:
    arms = " UNION ALL ".join(f"SELECT doc_id, '{name.format(v)}' AS variant, list_transform(ids, lambda t: {template.format(s=v)}) AS ids FROM iq" for v in values)
    return arms


def _hashed(arms: str) -> str:
    return f"WITH {IDS}, va AS ({arms}) SELECT doc_id, variant, md5(array_to_string(ids, ',')) AS ids FROM va"


@query(_hashed(_augment_sql(T_KEY, (3,), "key{:+d}")))
def transpose_augment(spark, sf_dir):
    return _digest(_ids(spark, sf_dir).select("doc_id", F.lit("key+3").alias("variant"), augment.transpose(F.col("ids"), 3).alias("ids")), "variant")


@query(_hashed(_augment_sql(T_TEMPO, (1.15,), "tempo{}")))
def tempo_augment(spark, sf_dir):
    return _digest(_ids(spark, sf_dir).select("doc_id", F.lit("tempo1.15").alias("variant"), augment.shift_tempo(F.col("ids"), 1.15).alias("ids")), "variant")


@query(_hashed(_augment_sql(T_VEL, (1,), "velocity{:+d}")))
def velocity_augment(spark, sf_dir):
    return _digest(_ids(spark, sf_dir).select("doc_id", F.lit("velocity+1").alias("variant"), augment.shift_velocity(F.col("ids"), 1).alias("ids")), "variant")


@query(_hashed(" UNION ALL ".join((_augment_sql(T_KEY, (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11), "key{:+d}"), _augment_sql(T_TEMPO, (0.85, 0.92, 1.08, 1.15), "tempo{}"), _augment_sql(T_VEL, (-1, 1), "velocity{:+d}")))))
def additive_fanout(spark, sf_dir):
    return _digest(augment.fan_out(_ids(spark, sf_dir), "ids"), "variant")


@query("""WITH c AS (SELECT d.doc_id, coalesce(1 + l.quality + 3 * l.toxic, 1) AS cluster FROM documents d LEFT JOIN labels l USING (doc_id)), r AS (SELECT *, CASE cluster WHEN 2 THEN 5 WHEN 5 THEN 10 ELSE 1 END AS n FROM c)
  SELECT doc_id, cluster, CAST(unnest(range(0, n)) AS INTEGER) AS copy FROM r""")
def weighted_oversample(spark, sf_dir):
    joined = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = joined.select("doc_id", F.coalesce(1 + F.col("quality") + 3 * F.col("toxic"), F.lit(1)).alias("cluster"))
    return augment.repeat_by(c, F.col("cluster"))


@query("""WITH l AS (SELECT embedding AS v, count(*) AS n, min(vec_id) AS lib FROM embeddings GROUP BY 1 ORDER BY n DESC, lib LIMIT 128), p AS (SELECT e.vec_id, l.lib, round(list_sum(list_transform(list_zip(e.embedding, l.v), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))), 9) AS d FROM embeddings e, l)
  SELECT vec_id, lib, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, lib) = 1""")
def patch_nearest_l1(spark, sf_dir):
    """Each vector's nearest of the 128 most frequent ones."""
    e = table(spark, sf_dir, "embeddings")
    library = e.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("lib")).orderBy(F.col("n").desc(), "lib").limit(128)
    return corpus.nearest_l1(e, "vec_id", "embedding", library.select("lib", F.col("embedding").cast("array<double>").alias("vec")))


@query("""WITH l AS (SELECT DISTINCT name FROM (VALUES ('src1'), ('src2'), ('src2'), ('lost')) t(name)), o AS (SELECT lower(trim(source)) AS name, count(*) AS n FROM documents GROUP BY 1)
  SELECT coalesce(o.name, l.name) AS name, coalesce(n, 0) AS n, l.name IS NOT NULL AS listed FROM o FULL JOIN l ON o.name = l.name""")
def curated_match(spark, sf_dir):
    listed = spark.createDataFrame([("SRC1 (USA)",), ("src2",), (" src2 ",), ("Lost",)], "name string")
    return corpus.curated(_docs(spark, sf_dir), "source", listed)


LINKS = "li AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages)"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(names.links(F.col("html"))).alias("link")).where(F.startswith("link", F.lit("/")))


@query(f"WITH {LINKS} SELECT page_id, link, count(*) AS n FROM li WHERE starts_with(link, '/') GROUP BY 1, 2")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(url, '[?&]page=(\\d+)', 1), lambda x: CAST(x AS INTEGER))), 0) AS last_page FROM pages")
def page_max_num(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.largest_page(F.col("url")).alias("last_page"))


@query(f"""WITH {LINKS}, a AS (SELECT DISTINCT link FROM li WHERE starts_with(link, '/') AND page_id % 2 = 0), b AS (SELECT DISTINCT link FROM li WHERE starts_with(link, '/') AND page_id % 2 = 1)
  SELECT link, link IN (SELECT link FROM a) AS known FROM (SELECT link FROM a UNION SELECT link FROM b)""")
def url_union(spark, sf_dir):
    even = F.col("page_id") % 2 == 0
    return _links(spark, sf_dir).groupBy("link").agg(F.bool_or(even).alias("known"))


@query("""SELECT o_orderpriority, count(*) AS n, round(median(o_totalprice), 6) AS median, round(avg(o_totalprice), 6) AS mean, max(o_totalprice) AS largest,
  round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS looped, count(*) FILTER (o_totalprice <= 100000) AS fits FROM orders GROUP BY 1""")
def loop_stats(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    middle = quantiles.quantiles(o, ["o_orderpriority"], "o_totalprice", {"median": 0.5}).withColumn("median", F.round("median", 6))
    return o.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean"), F.max(p).alias("largest"),
        F.round(F.count_if(F.col("o_orderstatus") == "P") / F.count("*"), 6).alias("looped"), F.count_if(p <= 100_000).alias("fits"),
    ).join(middle, "o_orderpriority")


@query("""SELECT lang, min(n_chars) AS least, round(median(n_chars), 6) AS median, round(avg(n_chars), 6) AS mean, max(n_chars) AS most, count(*) FILTER (n_chars < 100) AS sfx,
  round(100.0 * count(*) FILTER (n_chars BETWEEN 100 AND 5000) / count(*), 6) AS band FROM documents GROUP BY 1""")
def duration_stats(spark, sf_dir):
    d, n = _docs(spark, sf_dir), F.col("n_chars")
    middle = quantiles.quantiles(d, ["lang"], "n_chars", {"median": 0.5}).withColumn("median", F.round("median", 6))
    return d.groupBy("lang").agg(
        F.min(n).alias("least"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("most"), F.count_if(n < 100).alias("sfx"),
        F.round(100.0 * F.count_if(n.between(100, 5000)) / F.count("*"), 6).alias("band"),
    ).join(middle, "lang")


@query("""SELECT source, lang, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(median(n_chars), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 1.0), 6) AS p100 FROM documents GROUP BY ALL""")
def length_quantiles(spark, sf_dir):
    """Lengths of texts by source and language, at four shares."""
    q = quantiles.quantiles(_docs(spark, sf_dir), ["source", "lang"], "n_chars", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    return q.select("source", "lang", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95", "p100")])


@query("""WITH p AS (SELECT conv_id, max(turn) AS e FROM conversations WHERE role IN ('system', 'user') AND turn < 2 GROUP BY 1)
  SELECT c.conv_id, c.turn - coalesce(e, -1) - 1 AS turn, length(text) AS n FROM conversations c LEFT JOIN p USING (conv_id) WHERE c.turn > coalesce(e, -1)""")
def prompt_strip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    end = F.coalesce(F.max(F.when(F.col("role").isin("system", "user") & (F.col("turn") < 2), F.col("turn"))).over(W.partitionBy("conv_id")), F.lit(-1))
    return c.withColumn("e", end).where("turn > e").select("conv_id", (F.col("turn") - F.col("e") - 1).alias("turn"), F.length("text").cast("long").alias("n"))


@query("""WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings), l AS (SELECT vec_id, token, round(CAST(x AS DOUBLE) * 20, 3) AS logit FROM u),
  r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS k FROM l), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM r WHERE k <= 16),
  p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM p)
  SELECT vec_id, token, round(p, 6) AS p FROM c WHERE round(c, 9) < 0.9""")
def topp_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "x"))
    logits = e.select("vec_id", F.col("token").cast("long").alias("token"), F.round(F.col("x").cast("double") * 20, 3).alias("logit"))
    return corpus.nucleus(logits, "vec_id", "logit", "token", 0.9, 16)


STEPS = """st AS (SELECT doc_id, words, row_number() OVER (ORDER BY doc_id NULLS FIRST, words) - 1 AS step FROM (SELECT doc_id, coalesce(len(string_split(text, ' ')), 0) AS words FROM documents))"""


def _steps(spark, sf_dir):
    """Training takes one document a step, by doc_id; no task numbers them all."""
    words = F.coalesce(F.array_size(F.split("text", " ")), F.lit(0)).cast("long")
    one = _docs(spark, sf_dir).select(F.struct("doc_id", words.alias("words")).alias("doc"), F.lit(1).alias("n"))
    return augment.positions(one, "doc", "n")[0].select("doc.doc_id", "doc.words", F.col("start").alias("step"))


@query(f"""WITH {STEPS}
  SELECT doc_id, step, words, round(CASE WHEN step < 500 THEN 3e-4 * step / 500 ELSE 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * least(1.0, (step - 500) / 9500.0))) END, 12) AS lr FROM st""")
def lr_schedule(spark, sf_dir):
    """The rate at which the words of each step's document are learned."""
    s = F.col("step")
    warm, peak, low = 500, 3e-4, 3e-5
    done = F.least(F.lit(1.0), (s - warm) / 9500.0)
    lr = F.when(s < warm, peak * s / warm).otherwise(low + 0.5 * (peak - low) * (1 + F.cos(F.pi() * done)))
    return _steps(spark, sf_dir).select("doc_id", "step", "words", F.round(lr, 12).alias("lr"))


@query(f"""WITH {STEPS}, q AS (SELECT *, CAST(least(8192, 1024 + floor((8192 - 1024) * least(1.0, step / 5000.0) / 256) * 256) AS BIGINT) AS seq_len FROM st)
  SELECT doc_id, step, seq_len, least(words, seq_len) AS kept FROM q""")
def curriculum_len(spark, sf_dir):
    """How long a sequence may be at each step, and how many words of the step's document stay."""
    n = F.least(F.lit(8192), 1024 + F.floor((8192 - 1024) * F.least(F.lit(1.0), F.col("step") / 5000.0) / 256) * 256)
    return _steps(spark, sf_dir).withColumn("seq_len", n.cast("long")).select("doc_id", "step", "seq_len", F.least("words", "seq_len").alias("kept"))


@query(f"""WITH {IDS}, u AS (SELECT unnest(ids) AS t FROM iq) SELECT CASE WHEN t BETWEEN 4 AND 184 THEN 'tempo' WHEN t BETWEEN 185 AND 208 THEN 'key' WHEN t BETWEEN 379 AND 466 THEN 'pitch' WHEN t BETWEEN 467 AND 482 THEN 'velocity' ELSE 'other' END AS kind,
  count(*) AS n, round(CAST(sum(CASE WHEN t BETWEEN 467 AND 482 THEN 3.0 ELSE 1.0 END) AS DOUBLE), 6) AS weight FROM u GROUP BY 1""")
def rare_token_weight(spark, sf_dir):
    t = F.col("t")
    kind = corpus.gate((t.between(4, 184), "tempo"), (t.between(185, 208), "key"), (t.between(379, 466), "pitch"), (t.between(467, 482), "velocity"))
    u = _ids(spark, sf_dir).select(F.explode("ids").alias("t"))
    return u.groupBy(F.coalesce(kind, F.lit("other")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(t.between(467, 482), 3.0).otherwise(1.0)), 6).alias("weight"))


@query("""WITH s AS (SELECT coalesce(lang, 'all') AS lang, raw, tokens FROM (SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS raw, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP (lang)))
  SELECT lang, raw, tokens, CAST(ceil(tokens * 10 / 8) AS BIGINT) AS packed, 11 + 2 * tokens AS flat, round(raw / (11 + 2 * tokens), 6) AS ratio FROM s""")
def size_report(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", F.octet_length("text").alias("b"), F.size(F.split("text", " ")).alias("t"))
    s = d.rollup("lang").agg(F.sum("b").alias("raw"), F.sum("t").alias("tokens")).withColumn("lang", F.coalesce("lang", F.lit("all")))
    flat = 11 + 2 * F.col("tokens")
    return s.select("lang", "raw", "tokens", names.packed_bits(F.col("tokens"), 1024).alias("packed"), flat.alias("flat"), F.round(F.col("raw") / flat, 6).alias("ratio"))
