"""The registered queries of the subpackage: thin ``opN_<name>`` wrappers over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (embedding_dedup, language_id, learned_partitions, license_scan, merkle_manifest, minhash_join, passage_chains, prefix_trie, secrets_scan,
               sequence_packing, source_mix, toxicity, warc_revisits)
from ._spark import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


@query
def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return learned_partitions.search(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op7_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chains.shared_passages(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.resolve(warc_revisits.capture_log(table(spark, sf_dir, "pages")))


ORACLE["op2_warc_revisits"] = warc_revisits.ORACLE


# links by brute force, components by following them
ORACLE["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(c.low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id"""

ORACLE["op10_minhash_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                                 ELSE w END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(c.low, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document whose id's checksum is even is altered: its text loses the line feeds."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


# every character of the id, then its eight shifts, as one list to reduce
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""


def _field(name: str) -> str:
    v = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if f == "text" else f) for f in merkle_manifest.FIELDS) + ")"


# trees climbed level by level: t holds the documents' sources (s > 0), u the sources themselves
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {CRC32.format('doc_id')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS folded FROM documents),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, folded) - 1 AS i FROM d),
t AS (SELECT s, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM p
      UNION ALL SELECT s, any_value(lvl) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY s, i // 3),
u AS (SELECT 0 AS lvl, s - 1 AS i, h, count(*) OVER () AS n FROM t WHERE n = 1
      UNION ALL SELECT any_value(lvl) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY i // 3),
a AS (SELECT s, lvl, i, h, n FROM t UNION ALL SELECT 0, lvl, i, h, n FROM u),
x AS (SELECT a.s, a.lvl, a.i, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i < a.i), '') AS l,
             coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i > a.i), '') AS r
      FROM a JOIN a o ON o.s = a.s AND o.lvl = a.lvl AND o.i // 3 = a.i // 3 WHERE a.n > 1 GROUP BY a.s, a.lvl, a.i),
f AS (SELECT s AS own, i AS doc, s, 0 AS lvl, i, coalesce(folded, leaf) AS h, '' AS proof FROM p
      UNION ALL
      SELECT own, doc, CASE WHEN x.s IS NULL THEN 0 ELSE f.s END, CASE WHEN x.s IS NULL THEN 0 ELSE f.lvl + 1 END,
             CASE WHEN x.s IS NULL THEN own - 1 ELSE f.i // 3 END,
             CASE WHEN x.s IS NULL THEN f.h ELSE sha256(x.l || f.h || x.r) END, proof || coalesce(x.l || x.r, '')
      FROM f LEFT JOIN x ON x.s = f.s AND x.lvl = f.lvl AND x.i = f.i WHERE f.s > 0 OR x.s IS NOT NULL)
SELECT p.doc_id, p.leaf, q.h AS subroot, z.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = z.h AS verified
FROM p JOIN (SELECT s, h FROM t WHERE n = 1) q ON q.s = p.s JOIN f ON f.own = p.s AND f.doc = p.i
JOIN (SELECT max(lvl) AS top FROM u) m ON f.s = 0 AND f.lvl = m.top CROSS JOIN (SELECT h FROM u WHERE n = 1) z"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuild(table(spark, sf_dir, "conversations")))


# a node is its depth and the text of all its turns; its subtree is found through the paths of owners
ORACLE["op12_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 100 AS base, {CRC32.format('c')} % 6 AS h FROM t),
r AS (SELECT ids.c, pos, role, text FROM ids JOIN t ON t.c = ids.base WHERE pos < h
      UNION ALL SELECT ids.c, pos, role, text FROM ids JOIN t ON t.c = ids.c WHERE pos >= h),
m AS (SELECT c, row_number() OVER w AS depth, count(*) OVER (PARTITION BY c) AS turns, length(text) AS cp,
             string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)
      UNION ALL SELECT c, 0, (SELECT count(*) FROM r WHERE r.c = ids.c), 0, '' FROM ids),
p AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS parent FROM m),
n AS (SELECT depth, k, any_value(parent) AS parent, min(c) AS c, count(*) AS n, any_value(cp) AS cp,
             coalesce(string_agg(CASE WHEN turns = depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM p GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, parent AS k, count(*) AS kids FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (depth, k)),
s AS (SELECT p.depth, p.k, count(*) FILTER (WHERE kids = 0) AS leaves, CAST(sum((x.n - 1) * x.cp) AS BIGINT) AS saved
      FROM x JOIN p ON p.c = x.c AND p.depth <= x.depth GROUP BY p.depth, p.k)
SELECT x.c AS conv_id, x.depth, up.c AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, s.leaves AS n_leaves,
       s.saved AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s ON s.depth = x.depth AND s.k = x.k LEFT JOIN n up ON up.depth = x.depth - 1 AND up.k = x.parent"""


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
