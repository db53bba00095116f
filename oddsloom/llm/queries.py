"""The registered queries of this package, each with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.llm.collocations import collocations
from oddsloom.llm.common import QUERIES, read, register  # noqa: F401
from oddsloom.llm.embedding_dedup import embedding_dedup
from oddsloom.llm.exact_dedup import exact_dedup, halves
from oddsloom.llm.language import identify
from oddsloom.llm.licences import TEMPLATES, scan_licences
from oddsloom.llm.minhash import near_duplicates
from oddsloom.llm.mixing import mix
from oddsloom.llm.packing import pack
from oddsloom.llm.privacy import find_private
from oddsloom.llm.secrets import BASE, MORE, secret_report
from oddsloom.llm.suffix_dedup import remove_repeats
from oddsloom.llm.vector_codes import compress
from oddsloom.llm.warc import round_trip

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """The file of a public vocabulary, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op5_binary_packing")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), tokenizer=tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1
           THEN ':' || md5(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) ELSE '' END), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
      FROM d GROUP BY source),
fill(k, remaining, open_w, fixed) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size)::DOUBLE, sum(w)::BIGINT, 0::BIGINT FROM s
  UNION ALL
  SELECT k + 1, r, ow, n FROM (
    SELECT any_value(k) AS k, any_value(fixed) AS fixed,
           1.5::DOUBLE * sum(source_size)::DOUBLE - 2 * coalesce(sum(source_size) FILTER (is_full), 0)::DOUBLE AS r,
           coalesce(sum(w) FILTER (NOT is_full), 1)::BIGINT AS ow, count(*) FILTER (is_full) AS n
    FROM (SELECT *, remaining * w / open_w > 2 * source_size AS is_full FROM fill, s))
  WHERE n <> fixed),
lvl AS (SELECT remaining, open_w FROM fill ORDER BY k DESC LIMIT 1),
t AS (SELECT source, source_size, least(remaining * w / open_w, 2.0::DOUBLE * source_size) AS target FROM s, lvl),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, sum(size) AS hs FROM d GROUP BY source, h),
c AS (SELECT source, h, hs, sum(hs) OVER (PARTITION BY source ORDER BY h) AS upto FROM g)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
       least(2, p.passes + CASE WHEN 2 * c.upto - c.hs <= 2 * (p.target - p.passes * p.source_size) THEN 1 ELSE 0 END)::BIGINT AS copies,
       d.size * least(2, p.passes + CASE WHEN 2 * c.upto - c.hs <= 2 * (p.target - p.passes * p.source_size) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""


@register("op9_mixing", MIX_SQL)
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm),
b AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS middle FROM documents)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256,
       CASE WHEN d.doc_id <= b.middle THEN 0 ELSE 1 END AS batch
FROM d JOIN g ON d.norm = g.norm, b
"""


@register("op10_exact_dedup", EXACT_SQL)
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return exact_dedup(docs, in_snapshot=halves(docs))


LINK_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
u AS (SELECT * FROM v WHERE usable),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component, v.vec_id) AS component_id,
       v.vec_id = coalesce(c.component, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""


@register("op1_embedding_dedup", LINK_SQL)
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


WARC_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, url, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
h AS (SELECT payload_digest, min(page_id) AS head FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, q.url, q.payload_bytes, q.payload_digest, true AS intact,
       CASE WHEN h.head <> q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN h.head <> q.page_id THEN h.head END AS refers_to
FROM q LEFT JOIN h ON h.payload_digest = q.payload_digest
"""


@register("op2_warc", WARC_SQL)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


@register("op7_dart_minhash")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Shingles weigh as often as the text has them.
    return near_duplicates(read(spark, sf_dir, "documents"), counts=True)


@register("op4_language_crf")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


@register("op8_disclosure")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(read(spark, sf_dir, "documents"))


_ROWS = ", ".join(f"({k}, '{licence}', '{notice}')" for k, (licence, notice) in enumerate(TEMPLATES))
LICENCE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         '/' || coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || (doc_id // 100) || '/' || doc_id AS path
  FROM documents),
tv AS (SELECT template, licence, w AS word, count(*) AS n
       FROM (SELECT template, licence, unnest(regexp_split_to_array(lower(notice), '[^a-z0-9]+')) AS w
             FROM (VALUES {_ROWS}) AS v(template, licence, notice))
       WHERE w <> '' GROUP BY ALL),
u AS (SELECT doc_id, -1 AS no, text AS unit FROM d
      UNION ALL SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) FROM d),
t AS (SELECT doc_id, no, list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda w: w <> '') AS toks FROM u),
w AS (SELECT doc_id, no, unnest(toks) AS word FROM t),
tf AS (SELECT doc_id, no, word, count(*) AS n FROM w GROUP BY ALL),
nl AS (SELECT 1 + count(*) AS whole FROM t WHERE no >= 0 AND len(toks) > 0),
df AS (SELECT v.word, count(tf.word) AS n FROM (SELECT DISTINCT word FROM tv) v LEFT JOIN tf ON tf.word = v.word AND tf.no >= 0 GROUP BY v.word),
idf AS (SELECT word, ln(whole / (1 + n)) + 1 AS idf, ln(whole) + 1 AS other FROM df, nl),
tw AS (SELECT template, licence, tv.word, tv.n * idf AS v FROM tv JOIN idf ON idf.word = tv.word),
tn AS (SELECT template, sqrt(sum(v * v)) AS norm FROM tw GROUP BY template),
un AS (SELECT doc_id, no, sum(CASE WHEN idf.idf IS NOT NULL THEN (tf.n * idf.idf) ** 2 ELSE tf.n * o.other ** 2 END) AS square
       FROM tf LEFT JOIN idf ON idf.word = tf.word, (SELECT max(other) AS other FROM idf) o GROUP BY doc_id, no),
sc AS (SELECT tf.doc_id, tf.no, tw.template, tw.licence, sum(tf.n * idf.idf * tw.v / tn.norm) AS dot
       FROM tf JOIN idf ON idf.word = tf.word JOIN tw ON tw.word = tf.word JOIN tn ON tn.template = tw.template GROUP BY ALL),
m AS (SELECT sc.doc_id, sc.no, licence, round(dot / sqrt(square), 9) AS score FROM sc JOIN un ON un.doc_id = sc.doc_id AND un.no = sc.no
      WHERE round(dot / sqrt(square), 9) >= 0.7),
b AS (SELECT doc_id, no, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY score DESC, licence) AS r FROM m) WHERE r = 1),
o AS (SELECT doc_id, count(*) FILTER (no >= 0) AS n_notices, bool_or(no < 0) AS whole FROM b GROUP BY doc_id),
ob AS (SELECT doc_id, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r FROM b) WHERE r = 1),
f AS (SELECT d.doc_id, d.path, coalesce(o.n_notices, 0)::BIGINT AS n_notices, ob.licence AS own_licence, ob.score AS own_score, coalesce(o.whole, false) AS is_licence_file
      FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN ob ON ob.doc_id = d.doc_id),
dirs AS (SELECT directory, licence FROM (
  SELECT regexp_replace(path, '/[^/]*$', '') AS directory, own_licence AS licence,
         row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY own_score DESC, own_licence) AS r FROM f WHERE is_licence_file) WHERE r = 1),
a AS (SELECT f.doc_id, max_by(dirs.licence, len(dirs.directory)) AS from_licence, max_by(dirs.directory, len(dirs.directory)) AS from_directory
      FROM f JOIN dirs ON starts_with(f.path, dirs.directory || '/') WHERE f.own_licence IS NULL GROUP BY f.doc_id)
SELECT f.doc_id, f.path, f.n_notices, f.own_licence, f.own_score, f.is_licence_file, coalesce(f.own_licence, a.from_licence) AS licence, a.from_directory
FROM f LEFT JOIN a ON a.doc_id = f.doc_id
"""


@register("op6_licences", LICENCE_SQL)
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no paths: source, language and a hundred ids a folder stand for a file tree.
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    path = F.concat_ws("/", F.lit(""), part("source"), part("lang"), F.expr("doc_id div 100"), F.col("doc_id"))
    return scan_licences(read(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", path=path)


@register("op3_suffix_dedup")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f1 AS (SELECT lang, w[i] AS phrase, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM g WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM g WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
inside AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, f2.x AS first, f2.y AS rest FROM f2
  LEFT JOIN inside s ON s.lang = f2.lang AND s.x = f2.x AND s.y = f2.y WHERE s.longer IS NULL OR 100 * s.longer < 50 * f2.f
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f, 1, x, y || ' ' || z FROM f3
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f, 2, x || ' ' || y, z FROM f3),
parts AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, x || ' ' || y, f FROM f2),
s AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM c JOIN parts l ON l.lang = c.lang AND l.phrase = c.first JOIN parts r ON r.lang = c.lang AND r.phrase = c.rest),
b AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, n.n, t.score FROM t JOIN n ON n.lang = t.lang WHERE t.rank <= 2000
"""


@register("op13_collocations", COLLOCATION_SQL)
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    # The base kinds as they are worded, their lengths asked for afterwards.
    rules = [(BASE[0].kind, BASE[0].pattern, 12, 2), ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0)]
    rules += [(rule.kind, rule.pattern, rule.least, rule.group) for rule in MORE]
    quoted = lambda p: p.replace("'", "''")
    found = " UNION ALL ".join(
        f"""SELECT rid, {k} AS no, '{kind}' AS kind, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS upto,
               length(regexp_extract(m, '{quoted(p)}', {group})) >= {least} AS fits
        FROM (SELECT rid, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT rid, regexp_extract_all(text, '{quoted(p)}') AS m, string_split_regex(text, '{quoted(p)}') AS g FROM d) WHERE len(m) > 0)"""
        for k, (kind, p, least, group) in enumerate(rules)
    )
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    f AS ({found}),
    s AS (SELECT rid, no, upto - length(m) AS start, kind || ':' || CAST(upto - length(m) AS BIGINT) || ':' || CAST(upto AS BIGINT) AS span FROM f WHERE fits),
    a AS (SELECT rid, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
                 string_agg(span, ',' ORDER BY start, no) FILTER (no < 3) AS base, string_agg(span, ',' ORDER BY start, no) AS spans FROM s GROUP BY rid)
    SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a ON a.rid = d.rid"""


@register("op12_secrets", _secret_sql())
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))


def _code_sql() -> str:
    # A chain of tables: each round's codebooks, then the assignment they give.
    steps = ["""
    v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label,
             list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    w AS (SELECT len(e) // 8 AS w FROM v WHERE rid = 1),
    x AS MATERIALIZED (SELECT rid, vec_id, label, p, e[p * w + 1 : (p + 1) * w] AS x FROM v, w, range(8) t(p)),
    b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, x AS c FROM x WHERE rid <= 16)"""]
    for t in range(7):
        steps.append(f"""
    a{t} AS MATERIALIZED (SELECT rid, p, d // 16 AS d, d % 16 AS k FROM (
      SELECT x.rid, x.p, min(16 * list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + b.k) AS d
      FROM x JOIN b{t} b ON b.p = x.p GROUP BY x.rid, x.p))""")
        if t < 6:
            steps.append(f"""
    m{t} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT a.p, a.k, i, sum(x.x[i])::HUGEINT AS s, count(*) AS n FROM a{t} a JOIN x ON x.rid = a.rid AND x.p = a.p, w, range(1, w + 1) r(i) GROUP BY ALL) GROUP BY p, k),
    b{t + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c::BIGINT[], b.c) AS c FROM b{t} b LEFT JOIN m{t} m ON m.p = b.p AND m.k = b.k)""")
    return "WITH " + ",".join(steps) + """,
    c AS (SELECT rid, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY rid),
    l AS (SELECT v.label, sum(c.error)::BIGINT AS label_error FROM c JOIN v ON v.rid = c.rid GROUP BY v.label),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b6)
    SELECT v.vec_id, v.label, c.code, c.error, l.label_error, h.codebooks_sha256
    FROM v JOIN c ON c.rid = v.rid JOIN l ON l.label IS NOT DISTINCT FROM v.label, h"""


@register("op11_vector_codes", _code_sql())
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))
