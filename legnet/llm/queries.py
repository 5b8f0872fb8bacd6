"""The registered queries of this subpackage and the SQL they equal, where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from legnet.llm import (
    bpe, byte_bpe, conversation_sql, corpus_sql, html_extract, mixing, ngram_join, phrases, pii,
    prefix_trie, quality, quality_sql, repair, sharding, syncmers, warc,
)
from legnet.llm.batches import read_table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_jump_shards(spark, sf):
    rows = sharding.assign(read_table(spark, sf, "documents"), 16)
    return rows.withColumn("law", F.lit("key"))


@query
def op8_word_bpe(spark, sf):
    docs = read_table(spark, sf, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_prefix_trie(spark, sf):
    return prefix_trie.conversation_trie(read_table(spark, sf, "conversations"))


@query
def op12_lightest_repair(spark, sf):
    rows = repair.damage(read_table(spark, sf, "conversations"))
    return repair.repair(rows, lost=rows["lost"])


@query
def op13_byte_bpe(spark, sf):
    docs = read_table(spark, sf, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)


@query
def op9_anchor_pii(spark, sf):
    return pii.find(read_table(spark, sf, "documents"))


@query
def op5_closed_syncmers(spark, sf):
    return syncmers.edited_likeness(read_table(spark, sf, "documents"))


@query
def op7_warc_index(spark, sf):
    return warc.round_trip(read_table(spark, sf, "pages"))


@query
def op4_distribution_rules(spark, sf):
    rows = quality.judge(read_table(spark, sf, "documents"))
    return rows.withColumns(
        {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    )


SQL["op4_distribution_rules"] = quality_sql.SQL


@query
def op1_raked_mixture(spark, sf):
    rows = mixing.weights(read_table(spark, sf, "documents"))
    return rows.withColumns({c: F.round(c, 9) for c in ("rate", "probability", "shortfall", "gap")})


SQL["op1_raked_mixture"] = f"""WITH {mixing.sql()}
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 9) AS rate,
  round(probability, 9) AS probability, round(shortfall, 9) AS shortfall, sampled, round(gap, 9) AS gap
FROM mixed"""


@query
def op3_parity_sketch_join(spark, sf):
    return ngram_join.join(read_table(spark, sf, "documents"))


@query
def op6_tree_model_text(spark, sf):
    return html_extract.extract(read_table(spark, sf, "pages"))


@query
def op10_phrase_automata(spark, sf):
    return phrases.dedup(read_table(spark, sf, "documents"))


SQL["op3_parity_sketch_join"] = corpus_sql.JACCARD
SQL["op7_warc_index"] = corpus_sql.ARCHIVE
SQL["op10_phrase_automata"] = corpus_sql.PHRASES
SQL["op11_prefix_trie"] = conversation_sql.TRIE
SQL["op12_lightest_repair"] = conversation_sql.REPAIR
