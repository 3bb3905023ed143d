"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.bpe import encode_decode
from tidewright.llm.decontaminate import scan_documents
from tidewright.llm.exact_dedup import exact_duplicates
from tidewright.llm.html_text import extract
from tidewright.llm.language_id import held_out, identify, learn
from tidewright.llm.near_dedup import near_duplicates
from tidewright.llm.resampling import resample
from tidewright.llm.token_counts import count_tokens
from tidewright.llm.url_filter import RULES, judge, ruled_urls
from tidewright.llm.warc import read_records, write_archives

#: Share of the corpus that importance resampling draws.
RESAMPLE_SHARE = 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return resample(_table(spark, sf_dir, "documents"), good, RESAMPLE_SHARE)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_documents(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False, with_text=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = learn(docs.where(~held_out("doc_id")))
    named = identify(docs.select("doc_id", "text"), samples)
    return named.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_pretokens", "n_tokens")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_archives(_table(spark, sf_dir, "pages"))
    found = read_records(folder, index, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_url_filter decides by rules alone."""
    judged = ruled_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "by_rule")


QUERIES = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_decontamination,
        op3_exact_dedup,
        op4_html_extraction,
        op5_bpe,
        op6_language_id,
        op7_token_counts,
        op8_warc,
        op9_minhash,
        op10_url_filter,
        url_rules,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Longer rules first; no two of one length fit one URL.
_FITS = " ".join(
    f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
    for r, _ in sorted(RULES, key=lambda x: -len(x[0]))
)
_SAYS = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES = {
    "op2_decontamination": rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS name, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w
  FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT name, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT name, size, w[k:k + size - 1] AS g
  FROM (SELECT name, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM sized)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_ALNUM}') AS w
  FROM documents),
places AS (
  SELECT r, size, k, w[k:k + size - 1] AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT r, k, size, name FROM places JOIN windows USING (size, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT r, name FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
""",
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT page_id, n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM g
""",
    "url_rules": rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {_FITS} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {_SAYS} END AS by_rule FROM r
""",
    "op9_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(g, 'string_agg', ' ') AS g
  FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: w[k:k + 4])) AS g
        FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
                    FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
  JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id,
       doc_id = coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
}
