"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import bottom_k, chat_windows, decontamination, exact_dedup, jaccard_join, line_dedup, packing, quality, sharding, toxicity, turn_repair, whitening
from panelweave.llm import token_counts as counts
from panelweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_bpe() -> str:
    """The vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(table(spark, folder, "documents").select("doc_id", "text"), word_bpe())


@query
def op7_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    placed = sharding.shard_documents(docs, sharding.uniform_tree(40), sharding.uniform_tree(41))
    return placed.withColumn("law", F.lit("key"))


@query
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/documents.parquet"
    dedup = exact_dedup.ExactDedup(spark, scratch_path(spark, "dedup_state"))
    dedup.absorb(path)
    return dedup.report(path)


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""


@query
def op6_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat_windows.read_back(chat_windows.chat_windows(turns.unionByName(probe), word_bpe()))


@query
def op5_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_shared_lines(docs, removed="removed_lines").select("doc_id", "text", "removed_lines")


ORACLES["op5_line_spread"] = f"""
WITH l AS (
  SELECT doc_id, source, pos, u.line AS line, trim(u.line) AS norm
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)
), s AS (
  SELECT norm, min(doc_id) AS first FROM l WHERE norm <> ''
  GROUP BY norm HAVING count(DISTINCT coalesce(source, '')) >= {line_dedup.MIN_SITES}
), k AS (
  SELECT l.*, s.norm IS NOT NULL AND l.doc_id <> s.first AS gone FROM l LEFT JOIN s ON l.norm = s.norm
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS removed_lines
FROM k GROUP BY doc_id
"""


@query
def op2_pack(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, folder, "documents"), word_bpe())
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


@query
def op1_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op9_clause_grammar(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op10_universe_partition(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query
def op4_containment(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_block_matrix(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_edit_lattice(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turn_repair.report(turn_repair.damaged(turns), turns)


@query
def op13_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, folder, "documents"))


def _shingles(id_: str, source: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x20\x09-\x0D]+')"
    each = "list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))"
    return f"SELECT {id_}, unnest(list_distinct({each})) AS s FROM (SELECT {id_}, {words} AS w FROM {source}) WHERE len(w) > 0"


ORACLES["op4_containment"] = f"""
WITH d AS ({_shingles("doc_id", "documents")}), b AS ({_shingles("item_id", "benchmark")}),
k AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS held_shingles
FROM d JOIN b USING (s) JOIN k USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= {decontamination.SHARE} * item_shingles
"""
