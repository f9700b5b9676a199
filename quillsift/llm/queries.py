"""The opN_ queries and the SQL that some of them can be checked with."""

from __future__ import annotations

from .html_text import op3_html_text
from .line_dedup import op7_line_dedup
from .media import op8_media
from .mixing import op10_mixing
from .ngram_join import op4_ngram_join
from .packing import op2_packing
from .quality import op9_quality
from .substring_dedup import op5_substring_dedup
from .suffix_tree import op1_suffix_tree
from .syncmers import op6_syncmers

QUERIES = {
    "op5_substring_dedup": op5_substring_dedup,
    "op8_media": op8_media,
    "op3_html_text": op3_html_text,
    "op6_syncmers": op6_syncmers,
    "op7_line_dedup": op7_line_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op1_suffix_tree": op1_suffix_tree,
    "op2_packing": op2_packing,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Links by shared shingles, components by following them; A-Z lower-cased by translate.
OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""

#: Words have no spaces, so windows joined by spaces are equal as word sequences are.
OP5 = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY sha256(array_to_string(w[s:s + 19], ' ')) ORDER BY doc_id, s) AS r FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE r > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN kept k USING (doc_id)"""

#: Queries that SQL can express over whole tables; the others are tested against brute force.
ORACLE: dict[str, str] = {"op4_ngram_join": OP4, "op5_substring_dedup": OP5}
