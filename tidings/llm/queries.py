"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import (
    conversation_repair,
    decontamination,
    licenses,
    mixing,
    near_duplicates,
    periodic_runs,
    pivot_index,
    preferences,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_counts,
    token_files,
)
from tidings.llm.common import scratch_folder, stored, table

WORD_TOKENIZER = "word_bpe_49k.json"
SECRET_VOCABULARY = "byte_bpe_50k.tiktoken"
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_license_scan", licenses.license_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality_classifier.train_ranking(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, ranking)


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path(SECRET_VOCABULARY))


def token_digest(
    spark: SparkSession, docs: DataFrame, remembered: int = token_files.REMEMBERED, together: int | None = None
) -> DataFrame:
    """Write token files of the rows below the shared folder, and read their digest back."""
    path = scratch_folder(spark, "tokens")
    vocabulary = public_tokenizers.path(WORD_TOKENIZER)
    token_files.write_token_files(docs, path, vocabulary, END_ID, remembered=remembered, together=together)
    written = token_files.read_token_files(spark, path)
    crc = token_files.ids_crc32(F.col("tokens"))
    # Stored, so that token lists are read back in short batches; the digest is a few numbers a document.
    return stored(written.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32")), "digest")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = quality_rules.trusted_ratios(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, ratios)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


_RENDER = "'<|turn|>' || role || chr(10) || {} || '<|end|>' || chr(10)"
_PREFERENCE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS answer FROM t WHERE role = 'assistant' GROUP BY 1),
pair AS (SELECT a.conv_id, a.last, b.answer AS other FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
swapped AS (SELECT t.*, CASE WHEN turn = last THEN other ELSE text END AS lent FROM t JOIN pair USING (conv_id)),
cut AS (SELECT conv_id, coalesce(min(CASE WHEN text <> lent THEN turn END), max(turn) + 1) AS cut FROM swapped GROUP BY 1),
r AS (SELECT conv_id, turn, cut, role, length(role) AS m, {_RENDER.format("text")} AS c, {_RENDER.format("lent")} AS j
  FROM swapped JOIN cut USING (conv_id)),
w AS (SELECT *, coalesce(sum(length(c)) OVER before, 0) AS cs, coalesce(sum(length(j)) OVER before, 0) AS js FROM r
  WINDOW before AS (PARTITION BY conv_id, turn < cut ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, count(*) FILTER (turn < cut) AS n_prompt_turns,
  coalesce(string_agg(c, '' ORDER BY turn) FILTER (turn < cut), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY turn) FILTER (turn >= cut), '') AS chosen,
  coalesce(string_agg(j, '' ORDER BY turn) FILTER (turn >= cut), '') AS rejected,
  coalesce(string_agg(CAST(cs + m + 9 AS BIGINT) || ':' || CAST(cs + length(c) AS BIGINT), ',' ORDER BY turn)
    FILTER (turn >= cut AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(js + m + 9 AS BIGINT) || ':' || CAST(js + length(j) AS BIGINT), ',' ORDER BY turn)
    FILTER (turn >= cut AND role = 'assistant'), '') AS rejected_mask
FROM w GROUP BY conv_id
"""


@query("op7_preference_format", _PREFERENCE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.exchanged_answers(table(spark, sf_dir, "conversations"))
    formatted = preferences.format_preferences(pairs)

    def listed(mask: str):
        spans = F.transform(mask, lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string")))
        return F.array_join(spans, ",").alias(mask)

    return formatted.select(
        "pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", listed("chosen_mask"), listed("rejected_mask")
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTAMINATION_SQL = rf"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM it, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM d, (SELECT DISTINCT m FROM iw) l, unnest(range(1, len(w) - m + 2)) t(i)),
hits AS (SELECT DISTINCT doc_id, i, m, id FROM dw JOIN iw USING (m, k)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) t(p) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids
  FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op8_decontaminate", _CONTAMINATION_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS k
  FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY ALL
  HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


@query("op10_near_duplicates", _NEAR_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


_VECTOR_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM e
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


@query("op11_pivot_index", _VECTOR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of which repeat some of their words up to the end (by checksum of the id)."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_words")
    first = F.when(n > 0, F.pmod(g, n)).cast("int")
    period = 1 + F.floor((n - F.col("_first")) / (3 + F.pmod(g, F.lit(8)))).cast("int")
    source = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("_words", F.when(i < F.col("_first"), i).otherwise(
            F.col("_first") + F.pmod(i - F.col("_first"), F.col("_period"))
        )),
    )
    chosen = docs.select("doc_id", "text", F.when(F.pmod(h, F.lit(10)) == 0, words).alias("_words"))
    placed = chosen.withColumn("_first", first).withColumn("_period", period)
    text = F.when(n > 0, F.array_join(source, " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    line = F.transform(
        "runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    )
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    named = found.withColumn("_g", greatest).select("*", "_g.*")
    return named.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("col2")).alias("start"),
        F.col("length"),
        (-F.col("col3")).alias("period"),
        F.expr("1000 * length DIV -col3").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given another role, by checksum."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.pmod(F.crc32(F.concat_ws(":", *spaced).cast("binary")), F.lit(20))
    rows = conversations.select(
        "conv_id", "turn", fate.alias("fate"),
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    kept = rows.where("fate <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return kept.drop("_copy")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(damaged(conversations), conversations)
