"""The queries of this subpackage, and the SQL of those whose result SQL can state in full (ORACLES). The others are held
against brute force in their tests.

"""

from __future__ import annotations

from .edit_fingerprint import op8_edit_fingerprint
from .jaccard_join import op10_jaccard_join
from .license_scan import op5_license_scan
from .mpeg_audio import op2_mpeg_audio
from .secret_scan import op3_secret_scan
from .sentencepiece_codec import op1_sentencepiece
from .source_mix import op6_source_mix
from .substring_dedup import op9_substring_dedup
from .toxicity_chain import op7_toxicity_chain
from .url_filter import op4_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_mpeg_audio,
        op3_secret_scan,
        op4_url_filter,
        op5_license_scan,
        op6_source_mix,
        op7_toxicity_chain,
        op8_edit_fingerprint,
        op9_substring_dedup,
        op10_jaccard_join,
    )
}

_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + 49), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w)
), firsts AS (
  SELECT h, min(doc_id) AS lo FROM windows GROUP BY h
), covered AS (
  SELECT doc_id, list(s) AS starts FROM windows JOIN firsts USING (h) WHERE lo < doc_id GROUP BY doc_id
), removed AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM covered))
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) e
  ANTI JOIN removed r ON e.doc_id = r.doc_id AND e.p = r.p
  GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS sh
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0))
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.c + q.c - i)
), both_ways AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), reach AS (
  SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT r.d, b.y FROM reach r JOIN both_ways b ON b.x = r.c
)
SELECT w.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(c) AS component_id FROM reach GROUP BY d) m USING (doc_id)
"""

ORACLES: dict[str, str] = {"op9_substring_dedup": _OP9, "op10_jaccard_join": _OP10}
