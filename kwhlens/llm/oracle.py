"""DuckDB SQL of the operators that SQL can express (plain, without the operators' filters and indexes)."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, space: str) -> str:
    return f"[x FOR x IN regexp_split_to_array({_LOWER.format(text)}, '[{space}]+') IF x <> '']"


_PUNCT = r"\x09-\x0D\x20-/:-@\[-`{-~"

SQL = {
    # every window of an item's size that shares a 5-gram with it; weighted Jaccard >= 0.8; best window
    "op1_benchmark_decontamination": f"""
WITH dw AS (SELECT doc_id, {_words('text', _PUNCT)} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {_words('text', _PUNCT)} AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, len(w) AS n, i, array_to_string(w[i:i+4], ' ') AS g
       FROM dw, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5),
ig AS (SELECT item_id, len(w) AS size, i, array_to_string(w[i:i+4], ' ') AS g
       FROM iw, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5),
itf AS (SELECT item_id, g, count(*) AS c FROM ig GROUP BY ALL),
isum AS (SELECT item_id, sum(strlen(g) - 4) AS total FROM ig GROUP BY ALL),
hit AS (SELECT DISTINCT doc_id, n, item_id, size, dg.i FROM dg JOIN ig USING (g)),
win AS (SELECT DISTINCT doc_id, item_id, least(n, size) AS width, s
        FROM hit, unnest(range(greatest(1, i - least(n, size) + 5), least(i, n - least(n, size) + 1) + 1)) t(s)),
wtf AS (SELECT doc_id, item_id, width, s, g, count(*) AS c
        FROM win JOIN dg USING (doc_id) WHERE dg.i BETWEEN s AND s + width - 5 GROUP BY ALL),
sim AS (SELECT doc_id, wtf.item_id, width, s, sum(wtf.c * (strlen(g) - 4)) AS own,
               sum(least(wtf.c, coalesce(itf.c, 0)) * (strlen(g) - 4)) AS common
        FROM wtf LEFT JOIN itf USING (item_id, g) GROUP BY ALL),
found AS (SELECT doc_id, item_id, s - 1 AS word_start, width AS n_words,
                 CAST(common AS DOUBLE) / CAST(own + total - common AS DOUBLE) AS similarity
          FROM sim JOIN isum USING (item_id))
SELECT doc_id, item_id, CAST(word_start AS BIGINT) AS word_start, CAST(n_words AS BIGINT) AS n_words, similarity
FROM found WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, word_start) = 1""",
    "op5_site_line_dedup": """
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, source, trim(x) AS line FROM p, unnest(lines) t(x)
      WHERE source IS NOT NULL AND trim(x) <> ''),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT source, list(line) AS bad FROM (
          SELECT source, line, count(*) AS n FROM l GROUP BY ALL) JOIN total USING (source)
        WHERE n >= 3 AND n > CAST(0.1 AS DOUBLE) * pages GROUP BY source)
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len([x FOR x IN lines IF trim(x) <> '' AND list_contains(bad, trim(x))]), 0) AS BIGINT) AS n_dropped,
  CASE WHEN bad IS NULL THEN text
       ELSE array_to_string([x FOR x IN lines IF trim(x) = '' OR NOT list_contains(bad, trim(x))], chr(10))
  END AS text
FROM p LEFT JOIN bad USING (source)""",
    "op7_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("coalesce(text, '')", r'\x20\x09-\x0D')} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
       FROM w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM sh a JOIN sh b USING (g)
         WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
         WHERE 100 * o >= 80 * (x.n + y.n - o)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT DISTINCT u AS doc_id, u AS other FROM edge
          UNION SELECT r.doc_id, b.v FROM reach r JOIN edge b ON b.u = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
    # sha1 in hex, five digits at a time as four base32 letters
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT)
               >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest
      FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)""",
    "op6_fingerprint": rf"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text,
             coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC),
                      first(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS following
           FROM documents),
e AS (SELECT doc_id, length(text) AS n_chars, text, following,
        substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edited FROM o),
t AS (SELECT doc_id, 'own' AS kind, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e
      UNION ALL SELECT doc_id, 'next', following FROM e),
w AS (SELECT doc_id, kind, {_words('text', r'\x20\x09-\x0D')} AS w FROM t),
h AS (SELECT doc_id, kind, [substr(md5(array_to_string(w[i:i+4], ' ')), 1, 12)
        FOR i IN range(1, greatest(len(w) - 3, least(len(w), 1) + 1))] AS h FROM w),
s AS (SELECT doc_id, kind, CASE WHEN len(h) = 0 THEN [] WHEN list_min(h) < '200000000000'
        THEN list_sort(list_distinct([x FOR x IN h IF x < '200000000000'])) ELSE [list_min(h)] END AS s FROM h),
k AS (SELECT a.doc_id, a.s AS own, b.s AS edited, c.s AS nxt FROM s a JOIN s b USING (doc_id) JOIN s c USING (doc_id)
      WHERE a.kind = 'own' AND b.kind = 'edited' AND c.kind = 'next')
SELECT doc_id, n_chars, sha256(e.edited) AS edited_sha256, array_to_string(own, '') AS fingerprint,
  array_to_string(k.edited, '') AS edited_fingerprint,
  CASE WHEN len(own) + len(k.edited) = 0 THEN 1.0 ELSE CAST(len(list_intersect(own, k.edited)) AS DOUBLE)
    / (len(own) + len(k.edited) - len(list_intersect(own, k.edited))) END AS near_edited,
  CASE WHEN len(own) + len(nxt) = 0 THEN 1.0 ELSE CAST(len(list_intersect(own, nxt)) AS DOUBLE)
    / (len(own) + len(nxt) - len(list_intersect(own, nxt))) END AS near_next
FROM e JOIN k USING (doc_id)""",
    "op2_lm_score": f"""
WITH w AS (SELECT doc_id, {_words('text', _PUNCT)} AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i-1] END AS v FROM w, unnest(range(1, len(w) + 1)) t(i)),
tgt AS (SELECT DISTINCT doc_id, 1 AS t FROM labels WHERE quality = 1),
marked AS (SELECT tok.*, coalesce(t, 0) AS t FROM tok LEFT JOIN tgt USING (doc_id)),
total AS (SELECT count(*) AS n, sum(t) AS nt FROM marked),
voc AS (SELECT w, count(*) AS c, sum(t) AS t FROM marked GROUP BY w
        HAVING count(*) >= CAST(0.000001 AS DOUBLE) * (SELECT n FROM total)),
size AS (SELECT count(*) AS size FROM voc),
ids AS (SELECT doc_id, i, coalesce(a.w, '<unk>') AS w,
          CASE WHEN m.i = 1 THEN '<s>' ELSE coalesce(b.w, '<unk>') END AS v, m.t
        FROM marked m LEFT JOIN voc a ON a.w = m.w LEFT JOIN voc b ON b.w = m.v),
uni AS (SELECT w, CAST(count(*) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS t FROM ids GROUP BY w),
ctx AS (SELECT v, CAST(count(*) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS t FROM ids GROUP BY v),
big AS (SELECT v, w, CAST(count(*) AS DOUBLE) AS c, CAST(sum(t) AS DOUBLE) AS t FROM ids GROUP BY v, w),
low AS (SELECT w, (c + 1) / (n + size + 1) AS b, (t + 1) / (nt + size + 1) AS t FROM uni, total, size),
loss AS (SELECT v, w, ln(CASE WHEN ctx.c > 0 THEN 0.7::DOUBLE * big.c / ctx.c + 0.3::DOUBLE * low.b ELSE low.b END)
                    - ln(CASE WHEN ctx.t > 0 THEN 0.7::DOUBLE * big.t / ctx.t + 0.3::DOUBLE * low.t ELSE low.t END) AS loss
         FROM big JOIN ctx USING (v) JOIN low USING (w)),
score AS (SELECT doc_id, sum(loss) / count(*) AS score FROM ids JOIN loss USING (v, w) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, round(score, 9) AS score
FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN score USING (doc_id)""",
}
