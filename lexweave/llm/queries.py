"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .maintext import op7_main_text
from .neardup import op9_near_dedup
from .packing import op3_packing
from .piecebpe import op8_sentencepiece
from .pii import op10_pii
from .quality import op1_quality
from .tokenfiles import op6_token_files
from .topk import OP5_SQL, op5_exact_topk
from .turns import OP4_SQL, op4_snapshot_collapse
from .webp import op2_media

QUERIES = {f.__name__: f for f in (op1_quality, op2_media, op3_packing, op4_snapshot_collapse, op5_exact_topk, op6_token_files, op7_main_text, op8_sentencepiece, op9_near_dedup, op10_pii)} | {"pipeline": corpus_pipeline.run}

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * common >= 75 * (x.n + y.n - common)
), r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = m.doc_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

ORACLE_SQL = {"op4_snapshot_collapse": OP4_SQL, "op5_exact_topk": OP5_SQL, "op9_near_dedup": OP9_SQL}
