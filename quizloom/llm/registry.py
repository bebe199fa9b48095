"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, merkle, mixing, neardup, packing, pages, quality, sharding, suffixes, tokens, topk, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.kept_digests(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embedding_neighbours(_table(spark, sf_dir, "embeddings"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffixes": op2_suffixes,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op6_neardup": op6_neardup,
    "op7_pages": op7_pages,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_merkle": op12_merkle,
    "op13_packing": op13_packing,
}



def _merkle_sql(leaf_levels: int = 5, group_levels: int = 4) -> str:
    """Trees of so many levels above the leaves of a source (enough for 16 ** 5), and above the sources."""
    field = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')".format
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    byte = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    crc = f"xor(list_reduce({codes}, lambda a, b: {byte}, 4294967295), 4294967295)"
    parts = [
        f"""docs AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS touched FROM documents)""",
        "p0 AS (SELECT *, coalesce(touched, leaf) AS f, '' AS proof, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs)",
        "a0 AS (SELECT grp, i, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM p0)",
    ]

    def climb(nodes: str, paths: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"{nodes}{k}r AS (SELECT grp, i // 16 AS i, n, list(h ORDER BY i) AS hs FROM {nodes}{k} GROUP BY grp, i // 16, n)")
            up = f"CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END"
            parts.append(f"{nodes}{k + 1} AS (SELECT grp, i, {up} AS h, (n + 15) // 16 AS n FROM {nodes}{k}r)")
            before, after = "array_to_string(hs[1 : p.i % 16], '')", "array_to_string(hs[p.i % 16 + 2 : 16], '')"
            step = f"CASE WHEN n > 1 THEN sha256({before} || f || {after}) ELSE f END AS f, CASE WHEN n > 1 THEN proof || {before} || {after} ELSE proof END AS proof, p.i // 16 AS i"
            parts.append(f"{paths}{k + 1} AS (SELECT p.* EXCLUDE (f, proof, i), {step} FROM {paths}{k} p JOIN {nodes}{k}r r ON r.grp = p.grp AND r.i = p.i // 16)")

    climb("a", "p", leaf_levels)
    parts += [
        f"b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, h, count(*) OVER () AS n, grp AS name FROM a{leaf_levels})",
        f"q0 AS (SELECT p.* EXCLUDE (grp, i), '' AS grp, b.i AS i, b.h AS subroot FROM p{leaf_levels} p JOIN b0 b ON b.name = p.grp)",
    ]
    climb("b", "q", group_levels)
    return f"""
        WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{group_levels} q JOIN b{group_levels} b ON b.i = q.i
    """


# What SQL can say of a query's rows is said whole; where it can't (trained cutoffs, draws,
# vocabularies, slots of a filled table), tests hold the query against brute force.
ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(h, CAST((k // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_neardup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
        ), e AS (
            SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), l AS (
            SELECT a, b FROM p UNION ALL SELECT b, a FROM p
        ), reach(v, c) AS (
            SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM reach r JOIN l ON r.v = l.a
        )
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM s JOIN (SELECT v, min(c) AS component_id FROM reach GROUP BY v) ON v = doc_id
    """,
    "op12_merkle": _merkle_sql(),
}
