"""The registered queries of this subpackage: each applies one operator to its
whole table and derives the contract's columns from the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, extraction, jaccard_join, licenses, mixing, neighbours, packing, quality, sharding, toxicity, url_rules, whitening
from .labelled import crc_mod
from .util import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN length(text) > 0 THEN 0.05::DOUBLE + 0.95::DOUBLE *
      (length(regexp_replace(text, '[^\p{L} ]', '', 'g'))::DOUBLE / greatest(length(text), 1)::DOUBLE) ELSE 1.0::DOUBLE END AS w
  FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
    [5, 2, 1][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT]::BIGINT AS w
  FROM s),
l AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM r),
v AS (
  SELECT *, (total - capped)::DOUBLE / open::DOUBLE AS lev FROM l),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT lev FROM v WHERE lev * w <= 3 * source_size
      ORDER BY 3 * source_size / w::DOUBLE, rank LIMIT 1) * w) AS target
  FROM v),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id::VARCHAR, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""


@register("op5_mix_sources", OP5_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@register("op10_shard_bytes")
def op10_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sharded = sharding.shard_by_bytes(docs.select("doc_id", "text"), keep_text=False)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""


@register("op2_url_rules", OP2_SQL)
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, url_rules.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@register("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs)


#: the result that the windows, fingerprints and blocks must come to: every window in line with a shared
#: shingle, verified exactly
OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ip AS (SELECT item_id, w, len(w) AS m, unnest(range(0, len(w) - 4)) AS off FROM iw WHERE len(w) >= 5),
i AS (SELECT item_id, m, off, array_to_string(w[off + 1:off + 5], ' ') AS shingle FROM ip),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS pos FROM dw WHERE len(w) >= 5),
d AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS shingle FROM dp),
v AS (SELECT DISTINCT doc_id, item_id, m, greatest(0, pos - off) AS start FROM d JOIN i USING (shingle)),
c AS (SELECT v.doc_id, v.item_id, v.start, v.m, d.shingle, count(*) AS c
      FROM v JOIN d ON d.doc_id = v.doc_id AND d.pos >= v.start AND d.pos <= v.start + v.m - 5 GROUP BY ALL),
n AS (SELECT doc_id, item_id, start, m, sum(c) AS size FROM c GROUP BY ALL),
ic AS (SELECT item_id, shingle, count(*) AS ci FROM i GROUP BY ALL),
o AS (SELECT c.doc_id, c.item_id, c.start, c.m, sum(least(c, ci)) AS common FROM c JOIN ic ON c.item_id = ic.item_id AND c.shingle = ic.shingle GROUP BY ALL),
s AS (SELECT doc_id, item_id, start, m AS n_words, common::DOUBLE / (size + m - 4 - common)::DOUBLE AS similarity
      FROM o JOIN n USING (doc_id, item_id, start, m) WHERE 100 * common >= 80 * (size + m - 4 - common)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM s)
SELECT doc_id, item_id, start::INTEGER AS start, n_words::INTEGER AS n_words, similarity FROM r WHERE k = 1
"""


@register("op9_decontaminate", OP9_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def _scored(df: DataFrame, mod: int, held_out: int) -> DataFrame:
    return df.select("doc_id", (crc_mod(F.col("doc_id"), mod) == held_out).alias("held_out"), "score",
                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), mod=5, held_out=0)
    return _scored(toxicity.score_documents(docs, model, keep_text=False), 5, 0)


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), mod=3, held_out=1)
    return _scored(quality.score_documents(docs, model, keep_text=False), 3, 1)


@register("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@register("op3_extract_text")
def op3_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract_text(pages).select("page_id", "url", "text", "n_chars")


@register("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies at source/lang/<a hundred ids>/<id>.txt."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(
        "/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("cast(doc_id div 100 AS string)"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return licenses.scan_licenses(docs)


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT lang, phrase, f, k, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
h AS (SELECT x.*, string_split(phrase, ' ') AS ws FROM x),
c AS (SELECT h.lang, h.phrase, h.f AS a, h.k, h.cut, l.f AS l, r.f AS r, t.n,
        ((1000::HUGEINT * h.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM h JOIN f AS l ON l.lang = h.lang AND l.phrase = array_to_string(h.ws[:h.cut], ' ')
      JOIN f AS r ON r.lang = h.lang AND r.phrase = array_to_string(h.ws[h.cut + 1:], ' ') JOIN t ON t.lang = h.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM c),
k AS (SELECT * FROM b WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM f AS o WHERE o.lang = b.lang AND o.k > b.k
        AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.f >= 100 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


@register("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.collocations(docs).drop("cut")


#: a public vocabulary: byte pairs with word ends, 49,408 ids
TOKENIZER = "word_bpe_49k.json"


@register("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path(TOKENIZER), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
