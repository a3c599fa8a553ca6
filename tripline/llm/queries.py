"""The registered queries of the operators, over whole tables, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm import (
    alignment,
    bpe,
    chat,
    clustering,
    decontam,
    language,
    mixing,
    quality,
    rules,
    simhash,
    token_counts,
    token_files,
    toxicity,
)
from tripline.llm.common import bounded_batches, crc_remainder, table
from tripline.operators.workdir import WorkDir


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@bounded_batches
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from profiles of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder("doc_id", 5) == 0
    profiles = language.learn_profiles(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.predicted(profiles, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@bounded_batches
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they come from."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontam.find_contamination(docs, items, work=WorkDir.for_session(spark))
    hit = decontam.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@bounded_batches
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


@bounded_batches
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token ids in rANS blocks, read back."""
    work = WorkDir.for_session(spark)
    files = token_files.write(
        table(spark, sf_dir, "documents"), work.new_path("tokens"), work, _tokenizer("word_bpe_49k.json")
    )
    return token_files.digests(spark, files)


@bounded_batches
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder("doc_id", 4) == 2
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), quality.score(model, spark).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@bounded_batches
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the learned decision list."""
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.learn_rules(docs, table(spark, sf_dir, "labels")))


@bounded_batches
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", toxicity.severity(model, spark).alias("found")).select("doc_id", "found.*")


@bounded_batches
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), WorkDir.for_session(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@bounded_batches
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    work = WorkDir.for_session(spark)
    found = mixing.mix(work.store(mixing.sized(docs).drop("text"), "sized"), work)
    return found.select(
        "doc_id",
        F.col(mixing.SIZE).alias("size"),
        F.col(mixing.SOURCE_SIZE).alias("source_size"),
        F.col(mixing.TARGET).alias("target"),
        (F.col(mixing.SIZE) * F.col(mixing.COPIES)).alias("taken"),
        F.col(mixing.COPIES).alias("copies"),
    )


_CONTROL_TEXT = "</s>[INST] ok [/INST]"


@bounded_batches
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted as token ids and read back."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", _CONTROL_TEXT), (-1, 1, "assistant", _CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    tokenizer = _tokenizer("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(conversations.unionByName(extra), tokenizer), tokenizer)


@bounded_batches
def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the text they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


@bounded_batches
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight exact integer clusters of all embeddings."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"), WorkDir.for_session(spark))


@bounded_batches
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers."""
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, WorkDir.for_session(spark), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_token_alignment": op13_token_alignment,
}



def _cluster_rounds(rounds: int) -> str:
    """SQL of the assignments ``a0`` to ``a<rounds>`` and the centroids each is made with."""
    apart = "list_sum([(v[j] - c[j]) * (v[j] - c[j]) for j in range(1, 65)])"
    parts = []
    for n in range(rounds + 1):
        if n:
            parts.append(f"""
        c{n} AS MATERIALIZED (
            SELECT cluster, coalesce(moved, c) AS c FROM c{n - 1} LEFT JOIN (
                SELECT cluster, list(CAST((s - ((s % size) + size) % size) // size AS BIGINT) ORDER BY j) AS moved
                FROM (SELECT cluster, j, sum(v[j]) AS s, count(*) AS size
                      FROM a{n - 1}, (SELECT unnest(range(1, 65)) AS j) GROUP BY cluster, j)
                GROUP BY cluster) USING (cluster))""")
        parts.append(f"""
        a{n} AS MATERIALIZED (
            SELECT row, vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
            FROM (SELECT row, vec_id, v, cluster, {apart} AS distance FROM kept, c{n}) GROUP BY row, vec_id, v)""")
    return ",".join(parts)


#: DuckDB SQL where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": """
        WITH lowered AS (
            SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
            FROM documents),
        items AS (
            SELECT item_id, words, least(10, len(words)) AS width FROM (
                SELECT item_id, regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
                FROM benchmark WHERE text IS NOT NULL)
            WHERE len(words) > 0),
        windows AS (
            SELECT DISTINCT item_id, width, array_to_string(words[i:i + width - 1], ' ') AS content
            FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i FROM items)),
        places AS (
            SELECT doc_id, width, i, array_to_string(words[i:i + width - 1], ' ') AS content
            FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS i
                  FROM lowered, (SELECT DISTINCT width FROM windows) WHERE len(words) >= width)),
        found AS (SELECT doc_id, p.width, i, item_id FROM places p JOIN windows w
                  ON p.width = w.width AND p.content = w.content),
        hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit
                 FROM (SELECT doc_id, unnest(range(i, i + width)) AS word FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM lowered LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op10_chat_formatting": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS content FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{_CONTROL_TEXT}'
            UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL_TEXT}'),
        sized AS (
            SELECT *, length(regexp_replace(content, '{chat.ESCAPE_PATTERN}', '\1\\\2\3', 'g'))
                + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9
                  ELSE 19 + length(regexp_replace(role, '{chat.ESCAPE_PATTERN}', '\1\\\2\3', 'g')) END AS chars
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || content || chr(10), '' ORDER BY turn NULLS FIRST, role, content))
                   AS turns_sha256,
               CAST(coalesce(sum(length(content)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(content, '' ORDER BY turn NULLS FIRST, role, content)
                   FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op12_centroid_clusters": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id,
                   [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY hash, v) - 1 AS INTEGER) AS cluster, v AS c
            FROM (SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS hash FROM kept)
            ORDER BY hash, v LIMIT 8),{_cluster_rounds(10)}
        SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a10 JOIN c10 USING (cluster)
    """,
}
