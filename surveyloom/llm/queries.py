"""Queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from surveyloom.llm.decontamination import op9_decontamination
from surveyloom.llm.fingerprints import op2_fingerprints
from surveyloom.llm.language_id import op1_language_id
from surveyloom.llm.lexical_search import op13_lexical_search
from surveyloom.llm.near_dup import op10_near_dup
from surveyloom.llm.packing import op11_packing
from surveyloom.llm.personal_data import op3_personal_data
from surveyloom.llm.pieces import op6_pieces
from surveyloom.llm.sharding import op8_sharding
from surveyloom.llm.substring_dedup import op4_substring_dedup
from surveyloom.llm.suffix_dedup import op5_suffix_dedup
from surveyloom.llm.warc import op7_warc
from surveyloom.llm.whitening import op12_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_fingerprints": op2_fingerprints,
    "op3_personal_data": op3_personal_data,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pieces": op6_pieces,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_near_dup": op10_near_dup,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}

#: The others hash with functions that SQL engines do not share, or iterate; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM win JOIN firsts USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND m <> page_id THEN m END AS refers_to FROM q
""",
    "op13_lexical_search": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
total AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n),
wanted AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT i, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ws)::BIGINT * n) // l))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN df USING (term) JOIN docs USING (r), total GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10
""",
}
