"""One query for each operator over its whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightgrid.llm import chat, counts, decontaminate, languages, packing, pages, personal, repair, sharding, simhash, tokenfiles, topk, whitening
from nightgrid.llm.common import only
from nightgrid.llm.registry import QUERIES, SQL, query, table  # noqa: F401


@query("op4_elias_fano_files")
def op4(spark, folder):
    """Ids of all documents written to Elias-Fano files and read back."""
    manifest = tokenfiles.write_token_files(table(spark, folder, "documents"))
    return tokenfiles.read_token_files(manifest, with_ids=False)


@query("op8_best_fit_packing")
def op8(spark, folder):
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op7_byte_shards")
def op7(spark, folder):
    """All documents in 40 contiguous shards of near-equal bytes."""
    placed = sharding.shard_documents(only(table(spark, folder, "documents"), "doc_id", "text"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_covering_simhash")
def op5(spark, folder):
    """Fingerprint and component of every document."""
    return simhash.near_copies(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op10_edit_decontamination")
def op10(spark, folder):
    """Every benchmark item in every document, within its edit budget."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_language_id")
def op3(spark, folder):
    """Language of every document, learned from the labelled ones outside the held-out fold."""
    docs = only(table(spark, folder, "documents"), "doc_id", "text", "lang")
    model = languages.learn(docs)
    held_out = F.coalesce(languages.fold(F.col("doc_id")) == 2, F.lit(False))
    return (languages.identify(docs, model)
            .select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.accepted"))


@query("op9_host_text")
def op9(spark, folder):
    """Main text of every page."""
    return pages.main_text(table(spark, folder, "pages"), evidence=True, stable=True)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS codes FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.codes AS DOUBLE[]), CAST(c.codes AS DOUBLE[])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.codes) = len(c.codes) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query("op1_impact_top_k", TOP_K_SQL)
def op1(spark, folder):
    """The five best inner products for every fiftieth vector, against all."""
    return topk.search_every(table(spark, folder, "embeddings"))


CONTROLS = r"(<\\*\|turn\|>|<\\*\|says\|>|<\\*\|done\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*\|endoftext\|>)"
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     c AS (SELECT conv_id, count(*) AS n_turns,
                  coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '') AS said,
                  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
                  sum(24 + length(role) + length(text) + len(regexp_extract_all(role, '{CONTROLS}')) + len(regexp_extract_all(text, '{CONTROLS}'))) AS formatted_chars
           FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c
"""


@query("op2_chat_masks", CHAT_SQL)
def op2(spark, folder):
    """All conversations and one made of control strings, formatted, masked and read back."""
    turns = only(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    hostile = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(hostile))
    return chat.digests(formatted).drop("n_tokens", "loss_tokens")


@query("op6_unigram_counts")
def op6(spark, folder):
    """Tokens of every document under the unigram vocabulary."""
    return counts.token_counts(table(spark, folder, "documents"))


@query("op11_weighted_whitening")
def op11(spark, folder):
    """Leading whitened components of every embedding; a deviation that does not fit a long is null."""
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query("op12_structure_repair", repair.sql())
def op12(spark, folder):
    """Faults and cheapest repair of every conversation after damage."""
    turns = only(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    return repair.digests(repair.repair(repair.damage(turns), turns))


@query("op13_personal_data")
def op13(spark, folder):
    """Spans of personal data in every document: those of the patterns, counted and digested, and with those the model adds."""
    docs = only(table(spark, folder, "documents"), "doc_id", "text")
    return personal.report(personal.detect(docs, personal.learn(docs)))
