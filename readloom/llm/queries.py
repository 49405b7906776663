"""The ten operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lines, lm, mixing, neardup, neighbours, quality, toxicity, urls, warc
from .store import crc_fold, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to source weights 5, 2, 1, repeating: how many words of each the mix takes.

    A null or blank text has size 0 and nothing is taken of it; a null source is a source, the last; long texts count whole;
    repeated rows are dealt copies one by one; an empty table gives no rows. Columns are selected by name, so others don't clash.
    """
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of each one whose id is divisible by 50.

    Vectors that are null, zero or hold null or non-finite components take no part; ties go by the smaller id; a repeated row
    counts once; a query with fewer than 5 candidates gets all; an empty table gives no rows; other columns are ignored.
    """
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of line runs of 50 words or more.

    A null text stays null with no lines; an empty one has one line; the earliest copy by id (nulls last), text and line stays;
    rows with equal id and text count as one document and are cut alike; an empty table gives no rows.
    """
    return lines.drop_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies (five-word shingles, similarity 0.8 or more) of every document.

    A null or blank text is a class of its own; a shorter text than five words is one shingle; equal texts and repeated rows
    share a class; class_id is the smallest id in it, nulls last; an empty table gives no rows.
    """
    found = neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), "class_id", "class_size")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every text under a unigram base and the log-bilinear model, both learnt from six folds of seven.

    A null or empty text is one token, the end; unseen tokens have the share of one; long texts count whole; a null id is in the
    fold of 'null'; repeated rows score alike; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 7) == 2
    model, counts = lm.fit(docs.filter(~held_out))
    out = lm.score(docs, model, counts)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from labelled rows of four folds of five.

    Null and empty texts have no windows, and so the score of a text without toxic ones; long texts count whole; equal texts
    score alike; without labels every score is 0.5; a label's document may repeat; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark window of eight words, and the items that these are from.

    Null texts have no words; items of fewer words are one window; null items match nothing; ids that repeat count once;
    repeated rows are each marked; an empty benchmark or table gives no hits or no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text from a factorisation machine, learnt from labelled rows of four folds of five.

    Null and empty texts have only structure features, a null n_chars one of its own; long texts count whole; equal rows score
    alike; without both labels every score is constant; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text", "n_chars"), model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url: the longest rule, else trust and distrust along links.

    A null url, or one without '://', has an empty host and path, fits no rule and is allowed; a null html has no links;
    repeated pages are judged alike; an empty table gives no rows; other columns are ignored.
    """
    return urls.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, normalised and read back: what kind of record it has become.

    A null html is an empty payload; of equal payloads of 100 bytes or more the smallest id is the response (a row repeated with
    that id too); a null id revisits where another has one; long payloads stay whole; an empty table gives no rows.
    """
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_neighbours, op3_line_dedup, op4_near_dedup, op5_language_model, op6_toxicity, op7_decontamination, op8_quality, op9_urls, op10_warc)}

def _urls_sql() -> str:
    """The rules, and the rounds of both walks one after another."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    rules = [(text, what, *text.split("/", 1)) for text, what in sorted(urls.RULES, key=lambda r: -len(r[0]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[2], r[3])} THEN '{r[k]}'" for r in rules) + " END"

    def walk(name: str, seed: str, src: str, dst: str) -> str:
        out = [f"{name}s AS (SELECT host AS node, {seed} / (good + bad) AS seed FROM sd WHERE {seed} > 0)", f"{name}l AS (SELECT {src} AS src, {dst} AS dst, weight / sum(weight) OVER (PARTITION BY {src}) AS share FROM e)", f"{name}0 AS (SELECT node, seed AS rank FROM {name}s)"]
        for i in range(urls.ROUNDS):
            out.append(f"{name}{i + 1} AS (SELECT node, sum(rank) AS rank FROM (SELECT dst AS node, rank * share * {urls.DAMPING} AS rank FROM {name}{i} JOIN {name}l ON node = src UNION ALL SELECT node, seed * (1 - {urls.DAMPING}) FROM {name}s) GROUP BY node)")
        return ",\n".join(out)

    return rf"""
WITH p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ru AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM p),
ln AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?((?:https?:)?//[^"''\s>]*)', 1)) AS link FROM p WHERE host <> ''),
up AS (SELECT DISTINCT host, regexp_extract(host, '^[^.]*\.(.*\..*)$', 1) AS parent FROM p WHERE host LIKE '%.%'),
e AS (SELECT src, dst, CAST(sum(weight) AS DOUBLE) AS weight FROM (
  SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, 1 AS weight FROM ln
  UNION ALL SELECT * FROM (SELECT host AS src, parent AS dst, 1 FROM up WHERE parent <> '' UNION SELECT parent, host, 1 FROM up WHERE parent <> '')) WHERE dst <> '' AND dst <> src GROUP BY ALL),
sd AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad FROM ru WHERE host <> '' AND ruled IS NOT NULL GROUP BY host),
{walk('t', 'good', 'src', 'dst')},
{walk('d', 'bad', 'dst', 'src')}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.rank, 0) > {urls.RATIO} * coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ru LEFT JOIN t{urls.ROUNDS} t ON ru.host = t.node LEFT JOIN d{urls.ROUNDS} d ON ru.host = d.node
"""


ORACLES = {
    "op9_urls": _urls_sql(),
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, pos - 1 AS pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM l),
win AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.upto >= a.before + 50 GROUP BY a.doc_id, a.pos
        UNION SELECT a.doc_id, max(b.pos) AS s, a.pos AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.before <= a.upto - 50 GROUP BY a.doc_id, a.pos),
t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT win.*, array_to_string(ls[s + 1:e + 1], chr(10)) AS g FROM win JOIN t USING (doc_id)),
f AS (SELECT g, min(doc_id * 1000000 + s) AS least FROM c GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM c JOIN f USING (g) WHERE doc_id * 1000000 + s > least),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN hit ON l.doc_id = hit.doc_id AND l.pos = hit.pos WHERE hit.pos IS NULL GROUP BY l.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
""",
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
""",
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE k / (x.n + y.n - k) >= 0.8),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON r.node = sym.a)
SELECT doc_id, min(node) AS class_id, count(*) AS class_size FROM r GROUP BY doc_id
""",
    "op7_decontamination": r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bx),
ns AS (SELECT DISTINCT n FROM win),
dx AS (SELECT r, ns.n, w, unnest(range(1, len(w) - ns.n + 2)) AS i FROM dw, ns WHERE len(w) >= ns.n),
dg AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dx),
hit AS (SELECT dg.r, dg.n, dg.i, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(its.n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
}
