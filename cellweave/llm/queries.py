"""The ``opN_<name>`` queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.language import learn, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


#: All pairs that share a shingle, counted; components by a recursive query.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
z AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT z.y, r.root FROM r JOIN z ON z.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


#: All pairs of sound vectors.
OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(embedding, lambda c: abs(c))) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM c LEFT JOIN n ON n.x = c.vec_id
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.tokenfile import read_token_files, write_token_files

    return read_token_files(write_token_files(_table(spark, sf_dir, "documents")))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.spotsigs import neighbour_fingerprints

    return neighbour_fingerprints(_table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.pieces import encode_pieces

    return encode_pieces(_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.chat import format_chats

    return format_chats(_table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, k, string_agg(x, chr(10)) OVER (PARTITION BY conv_id ORDER BY k) AS s FROM t),
c AS (SELECT conv_id, max(k) AS n, arg_max(s, k) AS s FROM p GROUP BY conv_id),
o AS (SELECT s, min(conv_id) AS conv_id, min(n) AS n FROM c GROUP BY s)
SELECT o.conv_id, CAST(o.n AS BIGINT) AS n_turns, o.s AS rendered FROM o
WHERE NOT EXISTS (SELECT 1 FROM p JOIN c USING (conv_id) WHERE p.k < c.n AND p.s = o.s)
"""

QUERIES = {"op1_packing": op1_packing, "op2_main_text": op2_main_text, "op3_language": op3_language, "op4_pii": op4_pii, "op5_minhash": op5_minhash, "op6_embeddings": op6_embeddings, "op7_token_files": op7_token_files, "op8_spotsigs": op8_spotsigs, "op9_pieces": op9_pieces, "op10_chat": op10_chat}
ORACLES: dict[str, str] = {"op5_minhash": OP5_SQL, "op6_embeddings": OP6_SQL, "op10_chat": OP10_SQL}
