"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.llm import (
    chat,
    embedding_dedup,
    language,
    line_dedup,
    mixing,
    pieces,
    prefix_trie,
    quality,
    simhash,
    suffix_dedup,
    topk,
    warc,
    whitening,
)
from breezeline.session import materialise, scratch_path

PIECE_MODEL = "piece_bpe_32k.model"


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without strings of 100 bytes that start earlier in the corpus."""
    done = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=100)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back, repeated payloads as revisits."""
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    read = warc.read_archives(spark, path, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
last AS (SELECT html, max(page_id) AS page_id FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN last.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last.page_id <> p.page_id THEN last.page_id END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN last ON p.html = last.html AND p.n >= 1000
"""


def op3_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when sources weigh 5, 2, 1 in turn."""
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's piece ids and of their decoded text."""
    model = pieces.read_model(spark, public_tokenizers.path(PIECE_MODEL))
    done = pieces.encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, F.col("doc_id"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels outside of the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.learn_and_score(docs, labels)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of largest inner product for every fiftieth vector, against all rows."""
    return topk.search_own(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


OP6_SQL = """
WITH each AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM each WHERE x IS NULL OR NOT isfinite(x)),
one AS (
  SELECT vec_id, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM each
  WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM one q JOIN one c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 3-word shingles and groups linked within 2 bits."""
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=3, max_bits=2)


def op8_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and dropped per document."""
    done = line_dedup.drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP8_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.owner <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal label linked at a cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least_cosine=0.98)


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text."""
    return language.learn_and_predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four components of largest variance, each with unit variance."""
    done = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)
    return done.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


ODD_TURN = "\\### Assistant: </turn> ok"  # holds all control strings


def op12_formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, written, and read back: digests of its turns and of the text under its mask."""
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TURN).alias("text"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = materialise(chat.format_trees(chat.as_reply_trees(rows.unionByName(odd)), branches=1, unique_ids=True))
    read = made.select(
        F.col("tree_id").alias("conv_id"), chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


OP12_SQL = r"""
WITH row_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS name FROM row_),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(length('### ' || name || ': ' || body || '</turn>') + 1) AS BIGINT) AS formatted_chars
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars FROM told
"""


def op13_prefix_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.rebuilt_prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 bit by bit over the decimal's characters; a list element of -1 is one shift
OP13_SQL = """
WITH turn_ AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id),
coded AS (
  SELECT *, list_prepend(4294967295, flatten(list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))) AS codes
  FROM turn_),
headed AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(codes, lambda a, e:
           CASE WHEN e >= 0 THEN xor(CAST(a AS BIGINT), CAST(e AS BIGINT))
                ELSE xor(CAST(a AS BIGINT) >> 1, (CAST(a AS BIGINT) & 1) * 3988292384) END)) % 6 AS h FROM coded),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(f.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM headed c LEFT JOIN turn_ f ON f.conv_id = c.conv_id - c.conv_id % 100),
stepped AS (
  SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
member AS (
  SELECT conv_id, n, depth, md5(CAST(list_slice(turns, 1, depth) AS VARCHAR)) || '/' || depth AS key,
         CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].text) END AS size FROM stepped),
node AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM member GROUP BY key, depth),
above AS (
  SELECT v.key, v.depth, v.n_convs, v.size, a.key AS up, a.depth AS up_depth
  FROM node v JOIN member a ON a.conv_id = v.conv_id AND a.depth <= v.depth),
child AS (SELECT up, count(*) AS n_children FROM above WHERE up_depth = depth - 1 GROUP BY up),
summed AS (
  SELECT a.up, sum((a.n_convs - 1) * a.size) AS saved_tokens, count(*) FILTER (c.up IS NULL) AS n_leaves
  FROM above a LEFT JOIN child c ON c.up = a.key GROUP BY a.up)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN summed s ON s.up = n.key LEFT JOIN child c ON c.up = n.key
LEFT JOIN above a ON a.key = n.key AND a.up_depth = n.depth - 1 LEFT JOIN node p ON p.key = a.up
"""


QUERIES = {
    "op1_repeated_strings": op1_repeated_strings,
    "op2_web_archives": op2_web_archives,
    "op3_mixed_sources": op3_mixed_sources,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_quality_scores": op5_quality_scores,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_repeated_lines": op8_repeated_lines,
    "op9_near_vectors": op9_near_vectors,
    "op10_languages": op10_languages,
    "op11_whitened_vectors": op11_whitened_vectors,
    "op12_formatted_conversations": op12_formatted_conversations,
    "op13_prefix_nodes": op13_prefix_nodes,
}
ORACLES = {
    "op2_web_archives": OP2_SQL,
    "op6_nearest_vectors": OP6_SQL,
    "op8_repeated_lines": OP8_SQL,
    "op12_formatted_conversations": OP12_SQL,
    "op13_prefix_nodes": OP13_SQL,
}
