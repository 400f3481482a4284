"""Registered queries of this subpackage: each operator on its whole table, with its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope.llm import (decontaminate, embedding_dedup, fingerprints, language_id, line_dedup, merkle, packing, secret_scan, sharding, simhash, token_files,
                           url_filter, whitening)
from tickscope.sources.workdir import new_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_files")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_read(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_embedding_dedup, op2_secret_scan, op3_url_filter, op4_language_id, op5_best_fit_packing, op6_line_dedup, op7_simhash,
    op8_sharding, op9_decontamination, op10_token_files, op11_merkle_manifest,
    op12_document_fingerprints, op13_embedding_whitening)}

SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Unsigned checksum of the decimal id: bitwise, eight steps a digit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""


def _leaf(n_chars: str) -> str:
    each = {"n_chars": n_chars}
    return "sha256(" + " || ".join(f"coalesce(strlen(({each.get(c, c)})::VARCHAR) || ':' || ({each.get(c, c)})::VARCHAR, '-')" for c in merkle.FIELDS) + ")"


ORACLE: dict[str, str] = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') tree, {_leaf("n_chars")} leaf,
            CASE WHEN {CRC32} % 7 = 0 THEN {_leaf("n_chars + 1")} END tampered FROM documents),
        l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 i, count(*) OVER (PARTITION BY tree) n FROM d),
        t(tree, level, i, h, n) AS (SELECT tree, 0, i, leaf, n FROM l UNION ALL
            SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, i // 2, n),
        s AS MATERIALIZED (SELECT tree, level height, h subroot, row_number() OVER (ORDER BY tree) - 1 i, count(*) OVER () n FROM t WHERE n = 1),
        u(level, i, h, n) AS (SELECT 0, i, subroot, n FROM s UNION ALL
            SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2, n),
        p AS (SELECT tree, level, i, n, h FROM t WHERE n > 1 UNION ALL SELECT s.tree, s.height + u.level, u.i, u.n, u.h FROM s, u WHERE u.n > 1),
        w AS MATERIALIZED (SELECT l.doc_id, l.tree, l.i, x.level, x.i j, x.h, (CASE WHEN x.level < s.height THEN l.i >> x.level ELSE s.i >> (x.level - s.height) END) mine
            FROM l JOIN s USING (tree) JOIN p x ON x.tree = l.tree AND x.i = xor(CASE WHEN x.level < s.height THEN l.i >> x.level ELSE s.i >> (x.level - s.height) END, 1)),
        top AS (SELECT tree, s.height + max(u.level) height FROM s, u GROUP BY tree, s.height),
        f(tree, i, level, h) AS (SELECT tree, i, 0, coalesce(tampered, leaf) FROM l UNION ALL
            SELECT f.tree, f.i, f.level + 1, sha256(CASE WHEN w.j < w.mine THEN w.h || f.h WHEN w.j > w.mine THEN f.h || w.h ELSE f.h END)
            FROM f JOIN top USING (tree) LEFT JOIN w ON w.tree = f.tree AND w.i = f.i AND w.level = f.level WHERE f.level < top.height),
        q AS (SELECT tree, i, string_agg(h, '' ORDER BY level) siblings FROM w GROUP BY tree, i)
        SELECT l.doc_id, l.leaf, s.subroot, root.h AS root, sha256(coalesce(q.siblings, '')) proof_sha256, f.h folded_root, f.h = root.h AS verified
        FROM l JOIN s USING (tree) JOIN top USING (tree) JOIN f ON f.tree = l.tree AND f.i = l.i AND f.level = top.height
            LEFT JOIN q ON q.tree = l.tree AND q.i = l.i, (SELECT h FROM u WHERE n = 1) root""",
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) n FROM embeddings),
        l AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a vec_id, min(b) component_id FROM r GROUP BY 1)
        SELECT c.vec_id, count(l.b) n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN l ON l.a = c.vec_id GROUP BY c.vec_id, c.component_id""",
    "op6_line_dedup": f"""
        WITH l AS (SELECT doc_id, generate_subscripts(x, 1) i, unnest(x) line FROM (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) x FROM documents)),
        k AS (SELECT doc_id, i, line, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT k.*, f.key IS NOT NULL AS lost FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) n_lines, count(*) FILTER (lost) n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) kept_sha256
        FROM m GROUP BY doc_id""",
}
