"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import bpe, chat, interpolation, langid, minmax, packing, posting, projections, resampling, urls
from quaestor.llm.common import fold

# The rules that the URL query applies.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: The turns of the conversation that is added to the table: control strings in both roles.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
VOCABULARY = "word_bpe_49k.json"


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, conversations, pages, embeddings, labels = map(_table, ("documents", "conversations", "pages", "embeddings", "labels"))


def vocabulary() -> str:
    """The place of the public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` under a model that four of five folds teach."""
    return interpolation.scored_by_folds(documents(spark, sf_dir))


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in sequences of 4096 ids, mixed in the sources' own proportions."""
    return packing.packed(documents(spark, sf_dir), vocabulary(), with_ids=False)


def op3_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learnt from three of four folds."""
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 4) == 2)
    held = F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 4 = 2")
    return langid.predicted(docs, docs.where("not held_out")).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits")


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ``conversations`` and one of control strings, read back from their formatted texts."""
    turns = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and draw of all ``documents``; the target is what ``labels`` calls good."""
    return resampling.resampled(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``."""
    return urls.judged(pages(spark, sf_dir), urls.rule_table(spark, RULES))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded texts of all ``documents``."""
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents`` by distinct four-word shingles, similarity 0.8 or more."""
    return minmax.near_duplicates(documents(spark, sf_dir), n=4, percent=80)


def op9_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest ``embeddings`` of every row whose id 100 divides."""
    vectors = embeddings(spark, sf_dir)
    return posting.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all ``embeddings``, cosine 0.95 or more."""
    return projections.near_vectors(embeddings(spark, sf_dir), threshold=0.95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_deleted_interpolation, op2_mixture_packing, op3_ppm_language_id, op4_chat_round_trip, op5_importance_resampling, op6_url_rules, op7_bpe_codec, op8_minmax_dedup, op9_posting_lists, op10_sorted_projections)
    return {f.__name__: f for f in found}


URL_SQL = r"""
WITH r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a AS (SELECT rowid AS i, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT row_number() OVER () AS rowid, page_id, url FROM pages)),
b AS (SELECT i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM a),
m AS (SELECT i, h || p AS rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(h) + length(p) DESC, length(h) DESC, verdict DESC) AS k FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM b LEFT JOIN m ON m.i = b.i AND m.k = 1
"""


#: The lengths follow the grammar: 3 for the beginning, 15 round a user's text, 5 round an assistant's, 16 and the role round others;
#: an escaped turn has a mark and a second character for each of five.
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
h AS (SELECT *, regexp_matches(text, '</?s>|\[/?INST\]|\[ROLE |\[/ROLE\]') AS hard FROM t),
n AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END + length(text) + CASE WHEN hard THEN 1 + length(regexp_replace(text, '[^~\[\]<>]', '', 'g')) ELSE 0 END AS chars FROM h)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM n GROUP BY conv_id
"""

SHINGLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS id, doc_id AS reach FROM s UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.reach)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM s JOIN (SELECT id, min(reach) AS c FROM r GROUP BY 1) c ON c.id = s.doc_id
"""

COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.v FROM r JOIN l ON l.u = r.reach)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN (SELECT id, min(reach) AS c FROM r GROUP BY 1) c ON c.id = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_round_trip": CHAT_SQL, "op6_url_rules": URL_SQL, "op8_minmax_dedup": SHINGLE_SQL, "op10_sorted_projections": COSINE_SQL}
