"""The registered ``opN_`` queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, bradley_terry, chat_tree, contamination, html_main, lang_zstd, line_spread, ppm, quality_cascade, simhash_anchor, token_align, turn_repair, warc_index
from .common import crc_mod, held_out, table


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = bradley_terry.fit(docs, labels, train=crc_mod("doc_id", 3) != 1)
    scored = bradley_terry.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit_language_model(docs: DataFrame) -> lang_zstd.DictionaryModel:
    return lang_zstd.fit(docs, train=crc_mod("doc_id", 5) != 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_zstd.identify(docs, fit_language_model(docs))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score(table(spark, sf_dir, "documents"), train=crc_mod("doc_id", 10) != 0)
    return scored.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_ids", "best_item_id", F.round("containment", 6).alias("containment"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.clean(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.md5("text").alias("clean_md5"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.extract(pages.select(F.struct("page_id", "url").alias("page"), "html"), "page").select("page.page_id", "page.url", "text", "n_chars")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchor.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_index.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def byte_bpe_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), *byte_bpe_files())
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.read_back(chat_tree.pack(chat_tree.with_probe(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_ranking": op1_quality_ranking,
        "op2_language_id": op2_language_id,
        "op3_ppm": op3_ppm,
        "op4_quality_rules": op4_quality_rules,
        "op5_decontamination": op5_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_html_text": op7_html_text,
        "op8_simhash": op8_simhash,
        "op9_warc": op9_warc,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_turn_repair": op11_turn_repair,
        "op12_token_align": op12_token_align,
        "op13_chat_tree": op13_chat_tree,
    }


OP5_SQL = """
WITH words AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+') FROM benchmark),
clean AS (SELECT side, rid, id, list_filter(ws, lambda x: x <> '') AS ws FROM words),
shingles AS (SELECT DISTINCT side, rid, id, unnest(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM clean WHERE len(ws) > 0),
items AS (SELECT min(id) AS item_id, list_sort(ss) AS ss FROM (SELECT rid, id, list(s) AS ss FROM shingles WHERE side = 'i' GROUP BY rid, id) GROUP BY list_sort(ss)),
parts AS (SELECT item_id, len(ss) AS n, unnest(ss) AS s FROM items),
shares AS (SELECT d.rid, d.id AS doc_id, item_id, count(*) / n AS share FROM shingles d JOIN parts p ON d.side = 'd' AND d.s = p.s GROUP BY d.rid, d.id, item_id, n HAVING share >= 0.8)
SELECT doc_id, list(item_id ORDER BY share DESC, item_id) AS item_ids, first(item_id ORDER BY share DESC, item_id) AS best_item_id, round(max(share), 6) AS containment
FROM shares GROUP BY rid, doc_id"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT digest, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_cascade.oracle_sql(),
        "op5_decontamination": OP5_SQL,
        "op6_line_dedup": line_spread.oracle_sql(),
        "op9_warc": OP9_SQL,
    }
