"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, ship_code


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, benchmark item) pairs: at least 0.8 of the item's five-word shingles are in the text."""
    from .decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import encode_documents, ids_crc32

    return ids_crc32(encode_documents(read_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search_twentieth

    return search_twentieth(read_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_held_out

    return score_held_out(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_private

    return find_private(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    out = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_held_out

    return score_held_out(read_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_held_out

    return predict_held_out(read_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import remove_repeated_passages

    out = remove_repeated_passages(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import encode_vectors, with_label_errors

    coded = encode_vectors(read_table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded.rows).select("vec_id", "code", "error", "label_error", F.lit(coded.sha256()).alias("codebooks_sha256"))


OP7_SQL = r"""
WITH src AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, i AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM src)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM ln),
d AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, (d.key IS NOT NULL AND k.doc_id <> d.last) AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return f(spark, sf_dir)

    return run


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\f\r]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY lang, x),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, x1, x2, count(*) AS a FROM (SELECT lang, ws[i] AS x1, ws[i + 1] AS x2 FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)) GROUP BY lang, x1, x2 HAVING count(*) >= 10),
f3 AS (SELECT lang, x1, x2, x3, count(*) AS a FROM (SELECT lang, ws[i] AS x1, ws[i + 1] AS x2, ws[i + 2] AS x3 FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
  GROUP BY lang, x1, x2, x3 HAVING count(*) >= 10),
c2 AS (SELECT f2.lang, x1 || ' ' || x2 AS phrase, f2.a, u.f AS l, v.f AS r, CAST((1000000::HUGEINT * a * a) // (u.f::HUGEINT * v.f) AS BIGINT) AS score
  FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = x1 JOIN f1 v ON v.lang = f2.lang AND v.x = x2
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.x1 = f2.x1 AND f3.x2 = f2.x2 AND 100 * f3.a >= 50 * f2.a)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.x2 = f2.x1 AND f3.x3 = f2.x2 AND 100 * f3.a >= 50 * f2.a)),
k3 AS (SELECT f3.lang, f3.x1 || ' ' || f3.x2 || ' ' || f3.x3 AS phrase, f3.a, u.f AS u1, q.a AS q1, p.a AS p2, v.f AS v2,
    CAST((1000000::HUGEINT * f3.a * f3.a) // (u.f::HUGEINT * q.a) AS BIGINT) AS s1, CAST((1000000::HUGEINT * f3.a * f3.a) // (p.a::HUGEINT * v.f) AS BIGINT) AS s2
  FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x1 JOIN f1 v ON v.lang = f3.lang AND v.x = f3.x3
    JOIN f2 p ON p.lang = f3.lang AND p.x1 = f3.x1 AND p.x2 = f3.x2 JOIN f2 q ON q.lang = f3.lang AND q.x1 = f3.x2 AND q.x2 = f3.x3),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, if(s1 <= s2, u1, p2), if(s1 <= s2, q1, v2), least(s1, s2) FROM k3),
o AS (SELECT c.*, n.n, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c JOIN n ON n.lang = c.lang)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS own FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (g), range(13) t(k) WHERE g.doc_id > f.own),
e AS (SELECT doc_id, ws[i] AS x, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT e.doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY e.i) AS t FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""



def _op13_sql(rounds: int = 4) -> str:
    """Lloyd's rounds in plain SQL: every part against every entry."""
    ctes = [
        """k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS (SELECT rid, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM k, range(4) t(part))",
        "c0 AS (SELECT part, rid - 1 AS e, v FROM p WHERE rid <= 256)",
    ]
    for r in range(rounds + 1):
        d = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)"
        ctes.append(f"a{r} AS (SELECT p.rid, p.part, any_value(p.v) AS v, min(CAST({d} AS BIGINT) * 256 + c.e) AS m FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.rid, p.part)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT part, m % 256 AS e, j, floor(sum(v[j]) / count(*)) AS x FROM a{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY part, m % 256, j)")
            ctes.append(f"n{r} AS (SELECT part, e, list(x ORDER BY j) AS v FROM s{r} GROUP BY part, e)")
            ctes.append(f"c{r + 1} AS (SELECT c.part, c.e, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n ON c.part = n.part AND c.e = n.e)")
    ctes.append(f"f AS (SELECT rid, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    ctes.append(f"b AS (SELECT sha256(string_agg(CAST(CAST(v[j] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, j)) AS codebooks_sha256 FROM c{rounds}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (rid), b"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _query(f) for f in (op1_decontaminate, op2_token_files, op3_packing, op4_topk, op5_toxicity, op6_pii, op7_line_dedup, op8_lm_scoring, op9_near_dedup, op10_language_id, op11_collocations, op12_substring_dedup, op13_vector_codes)
}
ORACLE_SQL = {"op4_topk": OP4_SQL, "op7_line_dedup": OP7_SQL, "op11_collocations": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_vector_codes": _op13_sql()}
