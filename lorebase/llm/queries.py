"""The registered queries of this subpackage and their SQL, where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.warc import read_warc, write_warc

    return read_warc(write_warc(read(spark, sf_dir, "pages"))).drop("url", "payload")


OP2_SQL = """
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.jaccard_join import ngram_jaccard

    return ngram_jaccard(read(spark, sf_dir, "documents"), words=3, percent=90)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.jpeg import media_columns

    return media_columns(read(spark, sf_dir, "documents"), with_media=False)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.licenses import scan_licences

    return scan_licences(read(spark, sf_dir, "documents")).withColumn("notices", F.to_json("notices"))


def tokenizer_file() -> str:
    """The tokenizer of the contracts; every machine has it in the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.wavelet import read_tokens, write_tokens

    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), tokenizer_file()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.suffix_dedup import repeated_substrings

    return repeated_substrings(read(spark, sf_dir, "documents"), with_text=False)


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.curriculum import curriculum_mix

    return curriculum_mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op11_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.two_fit import best_two_fit

    return best_two_fit(read(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.divergence import source_divergence

    return source_divergence(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
size AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM held GROUP BY lang, source),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (coalesce(o.total, 0) + s.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorebase.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op12_source_divergence": OP12_SQL}
