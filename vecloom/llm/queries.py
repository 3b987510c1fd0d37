"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from vecloom.llm.decontaminate import op6_decontamination
from vecloom.llm.near_dup import op8_near_dup_join
from vecloom.llm.packing import op5_packing
from vecloom.llm.pii import op10_pii
from vecloom.llm.quality_cnn import op4_quality_classifier
from vecloom.llm.quality_rules import op3_quality_rules
from vecloom.llm.sharding import op7_sharding
from vecloom.llm.token_counts import op2_token_counts
from vecloom.llm.token_output import op9_token_output
from vecloom.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_token_counts, op3_quality_rules, op4_quality_classifier, op5_packing, op6_decontamination, op7_sharding, op8_near_dup_join, op9_token_output, op10_pii)
}
ORACLE_SQL: dict[str, str] = {}

#: All pairs of documents that share a shingle or are equal; classes by a recursive closure.
ORACLE_SQL["op8_near_dup_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
one AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c) UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.t = y.t AND x.doc_id < y.doc_id),
l AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
r AS (SELECT doc_id AS d, doc_id AS o FROM w UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.o)
SELECT d AS doc_id, MIN(o) AS class_id, (SELECT COUNT(*) FROM l WHERE l.a = d) AS n_links, COUNT(*) AS n_class FROM r GROUP BY d"""
