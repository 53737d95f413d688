"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from ledgerloom.llm.license_rules import BASE, GRANT, RULES, SCORES, spaced
from ledgerloom.llm.quality_divergence import CLASS_JUDGED_WORDS, COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, REFERENCE_WORDS, WORD_JUDGED_WORDS
from ledgerloom.llm.source_mixing import QUALITY, SEED, UNLABELLED

#: CRC-32 of a text's UTF-8 bytes: the byte table, then a fold over each text.
CRC32 = r"""
crc_bits(b, c, k) AS (
  SELECT b::UBIGINT, b::UBIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS steps FROM crc_bits WHERE k = 8),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT text, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
    lambda c, b: xor(c // 256, steps[(xor(c, b) % 256 + 1)::BIGINT])))::BIGINT AS crc
  FROM texts, crc_table)"""

OP3 = rf"""
WITH RECURSIVE {CRC32},
rows AS (
  SELECT doc_id, octet_length(encode(coalesce(documents.text, ''))) + 1 AS size, crc AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || crc::VARCHAR), 1, 3))::INT AS virtual_slot
  FROM documents JOIN crcs ON crcs.text = coalesce(documents.text, '')),
stats AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n_rows FROM rows GROUP BY 1),
queue AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k FROM stats),
dealt(k, virtual_slot, shard, loads) AS (
  SELECT 0::BIGINT, NULL::INT, NULL::INT, list_transform(range(16), lambda x: 0::BIGINT)
  UNION ALL
  SELECT q.k, q.virtual_slot, (list_position(d.loads, list_min(d.loads)) - 1)::INT,
    list_transform(d.loads, lambda v, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN v + q.bytes ELSE v END)
  FROM dealt d JOIN queue q ON q.k = d.k + 1)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INT AS grown_shard, virtual_slot
FROM rows JOIN dealt USING (virtual_slot)
"""

OP1 = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT k, i, n, item_id FROM places JOIN windows USING (n, gram)),
hit_words AS (SELECT k, count(DISTINCT i + j) AS n_hit FROM (SELECT k, i, unnest(range(n)) AS j FROM hits) GROUP BY k),
stretches AS (SELECT DISTINCT item_id, list_distinct(w[i:i + 9]) AS terms FROM (SELECT item_id, w, unnest(range(1, len(w) + 1, 10)) AS i FROM items WHERE len(w) > 0)),
seen AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
asked AS (SELECT row_number() OVER () AS s, item_id, unnest(terms) AS word, len(terms) AS n FROM stretches),
-- A stretch is near if the last places of its words up to some place lie within twenty of it.
rare AS (SELECT k, s, any_value(n) AS n FROM seen JOIN asked USING (word) GROUP BY k, s HAVING count(DISTINCT word) = any_value(n)),
steps AS (SELECT r.k, r.s, r.n, seen.i, seen.word FROM rare r JOIN asked a ON a.s = r.s JOIN seen ON seen.k = r.k AND seen.word = a.word),
near AS (SELECT DISTINCT k, s FROM (SELECT k, s, n, i, count(DISTINCT word) OVER (PARTITION BY k, s ORDER BY i RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM steps) WHERE c = n),
close AS (SELECT k, count(DISTINCT item_id) AS n_near FROM near JOIN asked USING (s) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN hit_words USING (k) LEFT JOIN named USING (k) LEFT JOIN close USING (k)
"""

OP2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT payload_digest, max(page_id) AS refers_to FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id < refers_to THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < refers_to THEN refers_to END AS refers_to
FROM p LEFT JOIN kept USING (payload_digest)
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT k, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM f)),
twice AS (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM grams),
covered AS (
  SELECT k, sum(least(8, coalesce(later - i, 8)))::BIGINT AS n FROM (
    SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS later FROM twice WHERE c > 1) GROUP BY k),
c AS (
  SELECT f.*, len(w) AS n_words, coalesce(n, 0) AS n_repeat_words, len(l) - len(list_distinct(l)) AS n_dup_lines,
    length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS c0, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS c1,
    length(regexp_replace(t, '[^\p{{Nd}}]+', '', 'g')) AS c2, length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')) AS c3,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS c4 FROM f LEFT JOIN covered USING (k)),
counted AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM f WHERE lang IS NOT NULL) WHERE regexp_matches(word, '\p{{L}}') GROUP BY 1, 2),
lists AS (
  SELECT lang, list(word ORDER BY nth) AS words, list(n ORDER BY nth) AS counts FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nth FROM counted) WHERE nth <= {COMMON_WORDS} GROUP BY lang),
classes AS (SELECT *, [c0, c1, c2, c3, c4, length(t) - c0 - c1 - c2 - c3 - c4] AS ns FROM c),
totals AS (SELECT lang, [sum(ns[1]), sum(ns[2]), sum(ns[3]), sum(ns[4]), sum(ns[5]), sum(ns[6])] AS ns, sum(n_words) AS n FROM classes GROUP BY lang HAVING sum(n_words) >= {REFERENCE_WORDS}),
refs AS (SELECT lang, words, ns AS ref_classes, list_append(counts, (n - list_sum(counts))::BIGINT) AS ref_words FROM totals JOIN lists USING (lang)),
listed AS (SELECT k, ns, ref_classes, ref_words, n_words, list_transform(words, lambda x: len(list_filter(w, lambda y: y = x))) AS own FROM classes JOIN refs USING (lang)),
bins AS (
  SELECT k, 'class' AS kind, unnest(ns) AS n, unnest(ref_classes) AS r FROM listed
  UNION ALL SELECT k, 'word', unnest(list_append(own, (n_words - list_sum(own))::BIGINT)), unnest(ref_words) FROM listed),
shares AS (SELECT k, kind, n / nullif(sum(n) OVER (PARTITION BY k, kind), 0) AS p, r / sum(r) OVER (PARTITION BY k, kind) AS q FROM bins),
distances AS (
  SELECT k, kind, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM shares GROUP BY k, kind),
closest AS (SELECT k, min(d) FILTER (kind = 'class') AS class_distance, min(d) FILTER (kind = 'word') AS word_distance FROM distances GROUP BY k),
verdict AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c LEFT JOIN closest USING (k))
SELECT doc_id, n_words, length(t) - c3 AS word_chars, c4 AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (n_words >= {CLASS_JUDGED_WORDS} AND coalesce(class_distance > {MAX_CLASS_DISTANCE}, false))
    OR (n_words >= {WORD_JUDGED_WORDS} AND coalesce(word_distance > {MAX_WORD_DISTANCE}, false))) AS kept
FROM verdict
"""

_RULES = ", ".join(f"({k}, ' {r.keyword} ', '{r.pattern}', '{r.label}', {r.priority})" for k, r in enumerate(RULES))
_PHRASES = ", ".join(f"('{spaced(phrase)}', '{label}')" for phrase, label in BASE.items())
OP4 = rf"""
WITH rules AS (SELECT * FROM (VALUES {_RULES}) v(r, keyword, pattern, label, priority)),
phrases AS (SELECT * FROM (VALUES {_PHRASES}) v(phrase, label)),
w AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT k, doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS spaced FROM w),
found AS (SELECT k, r, label, priority, regexp_extract_all(spaced, pattern) AS ms, regexp_split_to_array(spaced, pattern) AS gaps FROM d JOIN rules ON contains(spaced, keyword)),
each AS (SELECT k, r, label, priority, length(m) AS size, length(gap) AS gap, i FROM (
  SELECT k, r, label, priority, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM found)),
hits AS (SELECT k, label, priority, e - size AS s, e FROM (SELECT *, sum(size + gap) OVER (PARTITION BY k, r ORDER BY i) AS e FROM each)),
surviving AS (
  SELECT DISTINCT k, label, priority FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits o WHERE o.k = h.k AND o.e >= h.e AND o.priority <= h.priority
      AND (o.s < h.s OR o.s = h.s AND (o.e > h.e OR o.priority < h.priority OR o.priority = h.priority AND o.label < h.label)))),
base AS (
  SELECT k, phrase, label, spaced, (length(spaced) - length(replace(spaced, phrase, ''))) // length(phrase) AS n,
    instr(spaced, phrase) AS first_at, length(spaced) - instr(reverse(spaced), reverse(phrase)) - length(phrase) + 2 AS last_at
  FROM d JOIN phrases ON contains(spaced, phrase)),
places AS (
  SELECT k, sum(n)::BIGINT AS n_base, min(first_at) AS first_at, max(last_at) AS last_at, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, any_value(spaced) AS spaced
  FROM base GROUP BY k),
named AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM base UNION SELECT k, label FROM surviving) GROUP BY k),
scored AS (SELECT k, min(priority) AS p FROM (SELECT k, priority FROM surviving UNION ALL SELECT k, {GRANT} FROM base) GROUP BY k)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0) AS n_base,
  (length(regexp_replace(substr(p.spaced, 1, first_at - 1), '[^ ]+', '', 'g')) // 2)::BIGINT AS first_word,
  (length(regexp_replace(substr(p.spaced, 1, last_at - 1), '[^ ]+', '', 'g')) // 2)::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce({list(SCORES)}[scored.p + 1], 0)::DOUBLE AS score
FROM d LEFT JOIN places p USING (k) LEFT JOIN named USING (k) LEFT JOIN scored USING (k)
"""

OP11 = """
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS k, *, coalesce('.' || lang, '') AS tree,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS size, coalesce(length((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS size_more,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
leaves AS (SELECT k, doc_id, tree, sha256(head || size || tail) AS leaf, sha256(head || size_more || tail) AS other FROM doc),
-- CRC-32 of the id's digits.
crc_bits(b, c, j) AS (
  SELECT b::UBIGINT, b::UBIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, j + 1 FROM crc_bits WHERE j < 8),
crc_table AS (SELECT list(c ORDER BY b) AS steps FROM crc_bits WHERE j = 8),
touched AS (SELECT k, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)),
    lambda c, b: xor(c // 256, steps[(xor(c, b) % 256 + 1)::BIGINT]))) % 7 = 0 AS yes FROM doc, crc_table WHERE doc_id IS NOT NULL),
placed AS (SELECT l.*, coalesce(yes, false) AS yes, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves l LEFT JOIN touched USING (k)),
nodes(tree, level, place, n, h) AS (
  SELECT tree, 0, place, n, leaf FROM placed
  UNION ALL SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, place, n, h) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 2, n),
-- Siblings of each node on the way up, marked L or R for the side on which they stand; A has none.
up AS (
  SELECT p.k, a.level, CASE WHEN s.h IS NULL THEN 'A' WHEN s.place < a.place THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM placed p JOIN nodes a ON a.tree = p.tree AND a.place = p.place >> a.level AND a.n > 1
  LEFT JOIN nodes s ON s.tree = a.tree AND s.level = a.level AND s.place = xor(a.place, 1)),
over AS (
  SELECT r.tree, 1000 + a.level AS level, CASE WHEN s.h IS NULL THEN 'A' WHEN s.place < a.place THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM subroots r JOIN tops a ON a.place = r.place >> a.level AND a.n > 1
  LEFT JOIN tops s ON s.level = a.level AND s.place = xor(a.place, 1)),
ways AS (
  SELECT k, list(step ORDER BY level) AS steps FROM (SELECT * FROM up UNION ALL SELECT k, level, step FROM placed JOIN over USING (tree)) GROUP BY k),
proven AS (
  SELECT doc_id, leaf, subroot, t.h AS root, sha256(array_to_string(list_transform(coalesce(steps, []), lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN yes THEN other ELSE leaf END, coalesce(steps, [])), lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root
  FROM placed JOIN subroots USING (tree) LEFT JOIN ways USING (k) JOIN tops t ON t.n = 1)
SELECT *, folded_root = root AS verified FROM proven
"""

OP12 = r"""
WITH words AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT k, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS term FROM docs) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, corpus GROUP BY term, big_n),
m AS (SELECT k, doc_id, 50 + (50 * n * big_n) // big_l AS m FROM docs, corpus),
scored AS (
  SELECT item_id, doc_id, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN m USING (k) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP13 = rf"""
WITH RECURSIVE labelled AS (SELECT doc_id, CASE max(quality) {" ".join(f"WHEN {q} THEN {w}" for q, w in QUALITY.items())} ELSE {UNLABELLED} END AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hashed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, '-'), coalesce(source, '-'), md5(coalesce(text, '')))) AS h FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / coalesce(weight, {UNLABELLED})::DOUBLE AS key
  FROM hashed LEFT JOIN labelled USING (doc_id)),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM keyed GROUP BY source),
-- Share what is left among those below their caps, until no more are above.
rounds(rest, sharing, n, before) AS (
  SELECT sum(source_size)::DOUBLE, sum(weight)::DOUBLE, 0, -1 FROM sources
  UNION ALL
  SELECT (SELECT sum(source_size) FROM sources) - held, (SELECT sum(weight) FROM sources) - weight, k, n FROM (
    SELECT n, count(*) FILTER (over_cap) AS k, coalesce(sum(3 * source_size) FILTER (over_cap), 0) AS held, coalesce(sum(weight) FILTER (over_cap), 0) AS weight
    FROM (SELECT r.n, s.*, r.rest * s.weight / r.sharing > 3 * s.source_size AS over_cap FROM rounds r, sources s) GROUP BY n) x WHERE k > n),
final AS (SELECT * FROM rounds ORDER BY n DESC LIMIT 1),
shares AS (
  SELECT source, source_size, CASE WHEN rest * weight / sharing > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE rest * weight / sharing END AS target FROM sources, final),
budgets AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM shares),
drawn AS (
  SELECT k.*, b.* EXCLUDE (source), sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS so_far
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(budget - epochs * source_size - so_far, 0)))::BIGINT AS taken FROM drawn
"""

ORACLES = {"op11_merkle_manifest": OP11, "op12_hybrid_search": OP12, "op13_source_mix": OP13, "op4_license_rules": OP4, "op1_benchmark_postings": OP1, "op2_warc_archives": OP2, "op3_slot_sharding": OP3, "op7_quality_divergence": OP7}
