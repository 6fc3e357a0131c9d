"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.bpe import digests, encode_decode
from shelfspark.llm.common import documents
from shelfspark.llm.content_sort import content_sort
from shelfspark.llm.langid import identify
from shelfspark.llm.license_scan import license_scan
from shelfspark.llm.lm_score import lm_score
from shelfspark.llm.mixing import mix
from shelfspark.llm.ngram_join import ngram_join
from shelfspark.llm.perplexity import quality_rules
from shelfspark.llm.prefix_trie import prefix_trie
from shelfspark.llm.spelling import spelling_variants
from shelfspark.llm.token_counts import token_counts
from shelfspark.llm.token_files import read_token_files, write_token_files
from shelfspark.llm.toxicity import toxicity
from shelfspark.storage import fresh_path


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from ``labels``."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    return identify(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the text they decode to."""
    return digests(encode_decode(documents(spark, sf_dir), tokenizer("word_bpe_49k.json")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and perplexity of each document, and whether it is kept."""
    return quality_rules(documents(spark, sf_dir))


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of ``documents``; the largest id of equal texts stays."""
    return content_sort(documents(spark, sf_dir), keep="largest").drop("row_key")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates."""
    return ngram_join(documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(documents(spark, sf_dir)).drop("source")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of each document that is covered best, and how many there are."""
    found = license_scan(documents(spark, sf_dir))
    best = F.reduce(
        "licenses", F.get("licenses", F.lit(0)), lambda a, b: F.when(b["coverage"] > a["coverage"], b).otherwise(a)
    )
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), best.alias("best")).select(
        "doc_id", "n_licenses", "best.license", "best.coverage", "best.first_word", "best.last_word"
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the binary files they were written to."""
    folder = fresh_path(spark, "tokens")
    manifest = write_token_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), folder)
    return read_token_files(manifest, folder, with_ids=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("enter_arcs", "exit_arcs")


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under the language model."""
    return lm_score(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their near words and the forms they may stand for."""
    return spelling_variants(documents(spark, sf_dir))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of the reflected polynomial 0xEDB88320, and the CRC-32 of a text's UTF-8 bytes by it.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(
            list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table"""


def crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_concat([4294967295],
            list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)),
            lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""


SQL = {
    "op6_content_sort": f"""
        WITH norm AS (SELECT doc_id, {LOWER} AS t FROM documents),
        groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM norm JOIN groups USING (t)""",
    "op8_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(text, '') AS text,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        keyed AS (
            SELECT doc_id, source, size,
                   -ln((('0x' || substr(md5('mix' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
                   / (1.0::DOUBLE / (1.0::DOUBLE + least(1.0::DOUBLE,
                       len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / greatest(size, 1)))) AS k
            FROM sized),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighed AS (
            SELECT source, source_size,
                   [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
            FROM sources),
        levels AS (  -- the level at which each source would stop, and what is left for the rest there
            SELECT *, 2.0 * source_size / w AS stop,
                   coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
                   sum(w) OVER (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
                   1.5::DOUBLE * sum(source_size) OVER () AS total
            FROM weighed),
        level AS (SELECT coalesce(max((total - fixed) / open) FILTER (WHERE (total - fixed) / open <= stop), 0) AS level FROM levels),
        targets AS (
            SELECT source, source_size, least(2.0::DOUBLE * source_size, w * level)::DOUBLE AS target
            FROM weighed, level),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM targets),
        summed AS (
            SELECT doc_id, size, source_size, target, epochs,
                   round(target - epochs * source_size)::BIGINT AS rest,
                   coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + least(greatest(rest - ahead, 0), size))::BIGINT AS taken
        FROM summed""",
    "op11_prefix_trie": rf"""
        WITH crc AS ({CRC_TABLE}),
        turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT conv_id, {crc32("conv_id::VARCHAR")} % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM turns), crc),
        taken AS (
            SELECT c.conv_id, t.i AS d, t.digest, t.text
            FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= c.h),
        kept AS (SELECT conv_id, count(*) AS n FROM taken GROUP BY conv_id),
        rebuilt AS (
            SELECT * FROM taken
            UNION ALL
            SELECT c.conv_id, t.i - c.h + coalesce(k.n, 0), t.digest, t.text
            FROM turns t JOIN convs c USING (conv_id) LEFT JOIN kept k USING (conv_id) WHERE t.i > c.h),
        members AS (
            SELECT conv_id, d, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix,
                   len(regexp_extract_all(text, '[^ 	-
]+')) AS words
            FROM rebuilt
            UNION ALL
            SELECT conv_id, 0, '', 0 FROM convs),
        ends AS (
            SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
            FROM (SELECT * FROM members QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY prefix),
        nodes AS (
            SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved
            FROM members GROUP BY prefix, d),
        children AS (SELECT left(prefix, 32 * (d - 1)) AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        below AS (
            SELECT m.prefix, sum((c.n IS NULL)::BIGINT)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
            FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d LEFT JOIN children c ON c.prefix = n.prefix
            GROUP BY m.prefix)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               b.n_leaves, b.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM nodes n JOIN below b USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN ends e USING (prefix)
        LEFT JOIN nodes p ON n.d > 0 AND p.prefix = left(n.prefix, 32 * (n.d - 1))""",
    "op13_spelling_variants": rf"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, length(run) AS size, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        hashed AS (SELECT run, size, n, {crc32("doc_id || ':' || run")} AS h FROM counted, crc),
        words AS (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word,
                   sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
        shorter AS (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
            SELECT DISTINCT s.word AS a, w.word AS b FROM shorter s JOIN words w ON w.word = s.rest
            UNION ALL
            SELECT a.word, b.word FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word),
        near AS (SELECT a AS word, b AS near FROM pairs UNION ALL SELECT b, a FROM pairs),
        best AS (
            SELECT e.word, count(*) AS n_near, min({{'less': -w.n, 'near': e.near}}) AS best
            FROM near e JOIN words w ON w.word = e.near GROUP BY e.word),
        named AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN -best.less >= 5 * n THEN best.near END AS form,
                   CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
            FROM words LEFT JOIN best USING (word)),
        steps AS (
            SELECT word, word AS root, form AS next FROM named
            UNION ALL
            SELECT s.word, n.word, n.form FROM steps s JOIN named n ON n.word = s.next)
        SELECT word, form, root, n, n_near, form_n FROM named JOIN steps USING (word) WHERE next IS NULL""",
}

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_content_sort": op6_content_sort,
    "op7_ngram_join": op7_ngram_join,
    "op8_mix_sources": op8_mix_sources,
    "op9_license_scan": op9_license_scan,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lm_score": op12_lm_score,
    "op13_spelling_variants": op13_spelling_variants,
}
