"""The queries of the corpus operators, and SQL with the same rows where SQL can express them."""

from .ann import op4_permutation_index
from .bpe import op7_bpe_transducer
from .decontaminate import op3_benchmark_overlap
from .hmm import op1_hmm_score
from .jaccard import op2_jaccard_join
from .langid import op10_language_id
from .linecrf import op13_line_crf
from .linededup import op5_line_dedup
from .merkle import op12_merkle_manifest
from .runs import op11_periodic_runs
from .sharding import op9_jump_sharding
from .toxicity import op6_toxicity
from .warc import op8_arc_to_warc

QUERIES = {
    "op1_hmm_score": op1_hmm_score,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_benchmark_overlap": op3_benchmark_overlap,
    "op9_jump_sharding": op9_jump_sharding,
    "op4_permutation_index": op4_permutation_index,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_bpe_transducer": op7_bpe_transducer,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_crf": op13_line_crf,
}

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
 u AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b),
 c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.doc_id = s.doc_id"""

WORDS = "regexp_extract_all(" + LOWER + ", '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
OVERLAP_SQL = f"""WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
 i AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
 wi AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0) q),
 sizes AS (SELECT DISTINCT size FROM wi),
 wd AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS x FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size) q),
 hits AS (SELECT wd.doc_id, wd.p, wd.size, item_id FROM wd JOIN wi ON wi.size = wd.size AND wi.x = wd.x),
 n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM hits) q GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '')"
WARC_SQL = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
 q AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS intact FROM q"""

FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
BIT = "xor(y >> 1, (y & 1) * 3988292384)"
CRC32 = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda x, c: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: {BIT}, xor(x, c)), 4294967295), 4294967295)"
UP = "list_transform(range(0, (len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[CAST(3 * j + 1 AS INT):CAST(3 * j + 3 AS INT)], '')))"
MERKLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {LEAF.format(FIELD.format("text"))} AS leaf, {LEAF.format(FIELD.format("replace(text, chr(10), '')"))} AS tampered, {CRC32} AS crc FROM documents),
 p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS no FROM d),
 t(no, level, nodes) AS (SELECT no, 0, list(leaf ORDER BY idx) FROM p GROUP BY no UNION ALL SELECT no, level + 1, {UP} FROM t WHERE len(nodes) > 1),
 subs AS (SELECT no, level AS height, nodes[1] AS subroot FROM t WHERE len(nodes) = 1),
 u(level, nodes) AS (SELECT 0, list(subroot ORDER BY no) FROM subs UNION ALL SELECT level + 1, {UP} FROM u WHERE len(nodes) > 1),
 r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
 runs AS (SELECT p.no, p.idx, t.level AS step, CAST(idx // CAST(pow(3, level) AS BIGINT) AS BIGINT) AS own, nodes FROM p JOIN t ON t.no = p.no WHERE len(nodes) > 1
  UNION ALL SELECT p.no, p.idx, height + u.level, CAST(p.no // CAST(pow(3, u.level) AS BIGINT) AS BIGINT), nodes FROM p JOIN subs ON subs.no = p.no, u WHERE len(nodes) > 1),
 sides AS (SELECT no, idx, step, array_to_string(nodes[CAST(own // 3 * 3 + 1 AS INT):CAST(own AS INT)], '') AS l, array_to_string(nodes[CAST(own + 2 AS INT):CAST(own // 3 * 3 + 3 AS INT)], '') AS r FROM runs),
 proofs AS (SELECT no, idx, list({{'l': l, 'r': r}} ORDER BY step) AS sides FROM sides GROUP BY no, idx),
 f(no, idx, k, node) AS (SELECT no, idx, 0, CASE WHEN crc % 2 = 0 THEN tampered ELSE leaf END FROM p
  UNION ALL SELECT f.no, f.idx, k + 1, sha256(sides[k + 1].l || node || sides[k + 1].r) FROM f JOIN proofs ON proofs.no = f.no AND proofs.idx = f.idx WHERE k < len(sides)),
 folded AS (SELECT no, idx, max_by(node, k) AS folded_root FROM f GROUP BY no, idx)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_transform(sides, lambda s: s.l || s.r), lambda x, y: x || y), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN subs ON subs.no = p.no JOIN folded ON folded.no = p.no AND folded.idx = p.idx LEFT JOIN proofs ON proofs.no = p.no AND proofs.idx = p.idx, r"""

#: Models, tokenizers and orders of hashes are beyond SQL; their queries are tested against plain versions.
ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": JACCARD_SQL, "op3_benchmark_overlap": OVERLAP_SQL, "op8_arc_to_warc": WARC_SQL, "op12_merkle_manifest": MERKLE_SQL}
