"""The registered queries of the training-data operators, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import functions as F

from haystrata.llm import conversation_repair, decontaminate, html_extract, merkle_manifest, mixing, pii, quality_classifier, quality_rules, secret_scan, simhash_vptree, token_output, toxicity, warc_fixity
from haystrata.llm.common import table


def op1_secret_scan(spark, sf_dir):
    """The table has one column of ownership: an owner is a source, a repository what a source has in one language."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), "source")


def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_source_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_warc_fixity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = warc_fixity.compare(warc_fixity.archive(pages), warc_fixity.archive(warc_fixity.damaged(pages)))
    return found.selectExpr("file", "cast(seq as long) seq", "id page_id", "begin range_begin", "end range_end", "digest", "other_digest", "status")


def op6_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.grade(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest.verify(table(spark, sf_dir, "documents"), found=merkle_manifest.tampered())


def op12_token_output(spark, sf_dir):
    """The tokenizer drops white space and splits its text there, so words can go to the library one by one."""
    import public_tokenizers

    return token_output.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_words=True)


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_ANY_CASE = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
_VALUE = "[A-Za-z0-9+/_.=-]+"
_KEYED = lambda words, value: rf"""(?:{'|'.join(map(_ANY_CASE, words))})["']?\x20*[:=]\x20*["']?{value}"""
#: (kind, whole pattern, its value as a pattern of the whole match, least characters of the value, whether the span is the value's own) in order of kinds.
_SECRETS = [
    ("assign", _KEYED(["password", "passwd", "secret", "token", "api_?key"], _VALUE), rf"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?({_VALUE})$""", 8, False),
    ("access", "AKIA[A-Z0-9]+", "^(.*)$", 16, False),
    ("hex", "[0-9a-f]{32,}", "^(.*)$", 32, False),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END", r"^-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\s]{32,})-----END$", 32, True),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "^(.*)$", 1, True),
    ("provider", r"\b(?:ghp|gho|ghs|glpat|sk_live|rk_live|xoxb|xoxp|npm)[_-][A-Za-z0-9_-]{16,}", "^(.*)$", 1, True),
    ("url_login", r"://[^\s/:@]{1,64}:[^\s/@:]{8,128}@", r"^://[^\s/:@]{1,64}:([^\s/@:]{8,128})@$", 1, True),
    ("keyed", rf"(?:{'|'.join(map(_ANY_CASE, ['access', 'auth', 'client', 'private', 'signing', 'encryption']))})[_-]?" + _KEYED(["key"], "[A-Za-z0-9+/_=-]{16,}"), """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_=-]{16,})$""", 1, True),
]


def _found(i, kind, pattern, value, least, own):
    """Matches with their places: where the pieces between matches and the matches before it end. A token of jwt begins at no word character, which the table's texts meet."""
    p, v = pattern.replace("'", "''"), value.replace("'", "''")
    head = "strpos(m, v) - 1" if own else "0"
    size = "length(v)" if own else "length(m)"
    return f"""SELECT rid, {i} AS k, '{kind}' AS kind, pos + {head} AS a, pos + {head} + {size} AS b, v FROM (SELECT rid, pos, m, regexp_extract(m, '{v}', 1, 's') AS v FROM
 (SELECT rid, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS pos
  FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d) WHERE len(m) > 0)) WHERE length(v) >= {least}"""


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
f AS ({" UNION ALL ".join(_found(i, *x) for i, x in enumerate(_SECRETS))}),
freq AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM f JOIN d USING (rid) GROUP BY v),
chars AS (SELECT v, unnest(string_split(v, '')) AS c, length(v) AS n FROM freq),
live AS (SELECT v, -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) >= 3.0 AS live FROM (SELECT v, c, n, count(*) AS k FROM chars GROUP BY v, c, n) GROUP BY v),
j AS (SELECT f.*, owners >= 3 OR repos >= 8 AS wide, owners = 1 AND repos < 8 AND live AS own FROM f JOIN freq USING (v) JOIN live USING (v)),
s AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3 OR own) AS spans, count(*) FILTER (own) AS n_live, count(*) FILTER (wide) AS n_copied FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN s USING (rid)
"""

#: Items of under 5 words are one shingle in the operator; the benchmark table has none, and this SQL passes them over.
OP2_SQL = f"""
WITH iw AS (SELECT row_number() OVER () AS rid, item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
ig AS (SELECT DISTINCT rid, item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
n AS (SELECT rid, item_id, count(*) AS n_shingles FROM ig GROUP BY rid, item_id),
dw AS (SELECT row_number() OVER () AS did, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
dg AS (SELECT DISTINCT did, doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT did, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hit AS (SELECT did, doc_id, rid, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY did, doc_id, rid)
SELECT hit.doc_id, n.item_id, n.n_shingles::BIGINT AS n_shingles, hit.n_shared::BIGINT AS n_shared, hit.n_shared::DOUBLE / n.n_shingles::DOUBLE AS containment
FROM hit JOIN n USING (rid) WHERE 10 * hit.n_shared >= 8 * n.n_shingles
"""

_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
_LEAVES = f"""SELECT file, page_id, row_number() OVER w - 1 AS seq, sum(strlen(body)) OVER w AS e, strlen(body) AS n, sha256(body) AS digest
FROM (SELECT page_id, page_id // 1000 AS file, {_RECORD} AS body FROM {{}}) WINDOW w AS (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING)"""
_PLACES = "SELECT *, row_number() OVER (PARTITION BY file, {} ORDER BY seq) AS k FROM {}"
OP5_SQL = f"""
WITH hurt AS (SELECT page_id, url, CASE WHEN page_id % 211 = 7 THEN '?' || substring(html, 2) ELSE html END AS html FROM pages
  WHERE NOT ((page_id // 1000) % 5 = 3 AND page_id % 1000 >= 900) AND NOT ((page_id // 1000) % 3 = 0 AND page_id % 1000 = 120)),
a AS ({_LEAVES.format("pages")}), b AS ({_LEAVES.format("hurt")}),
same AS (SELECT a.file, a.seq FROM a JOIN b ON a.file = b.file AND a.seq = b.seq AND a.e = b.e AND a.n = b.n AND a.digest = b.digest),
x AS ({_PLACES.format("digest", "a WHERE (file, seq) NOT IN (SELECT (file, seq) FROM same)")}), y AS ({_PLACES.format("digest", "b WHERE (file, seq) NOT IN (SELECT (file, seq) FROM same)")}),
moved AS (SELECT x.file, x.seq, y.seq AS seq2 FROM x JOIN y USING (file, digest, k)),
u AS ({_PLACES.format("page_id", "(SELECT file, page_id, seq, e, n, digest FROM x WHERE (file, seq) NOT IN (SELECT (file, seq) FROM moved))")}),
v AS ({_PLACES.format("page_id", "(SELECT file, page_id, seq, e, n, digest FROM y WHERE (file, seq) NOT IN (SELECT (file, seq2) FROM moved))")})
SELECT file::BIGINT AS file, seq::BIGINT AS seq, page_id, (e - n)::BIGINT AS range_begin, e::BIGINT AS range_end, digest, digest AS other_digest, CASE WHEN (file, seq) IN (SELECT (file, seq) FROM same) THEN 'match' ELSE 'moved' END AS status
FROM a WHERE (file, seq) IN (SELECT (file, seq) FROM same UNION ALL SELECT (file, seq) FROM moved)
UNION ALL
SELECT coalesce(u.file, v.file)::BIGINT, coalesce(u.seq, v.seq)::BIGINT, coalesce(u.page_id, v.page_id), coalesce(u.e - u.n, v.e - v.n)::BIGINT, coalesce(u.e, v.e)::BIGINT, u.digest, v.digest, CASE WHEN v.seq IS NULL THEN 'missing' WHEN u.seq IS NULL THEN 'extra' ELSE 'altered' END
FROM u FULL OUTER JOIN v ON u.file = v.file AND u.page_id = v.page_id AND u.k = v.k
"""

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i+1], w[i+2]) AS n FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY rid),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered, len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[a-z]')) AS lower, len(regexp_extract_all(t, '!')) AS exclaims
 FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words OR 10 * lettered < 7 * n_words OR 2 * upper > upper + lower OR 10 * exclaims > 3 * n_words) AS kept
FROM f
"""

#: CRC-32 of an ASCII text by its table of 256 remainders.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"
_CRC = "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


def _tree(name, rows):
    """Every node of the binary trees k over rows (k, pos, n, h), and (k, pos, p): what each row's path is spliced from, the own slot and the sibling of each level."""
    return f"""{name} AS (SELECT k, 0 AS lvl, pos, n, h FROM {rows} UNION ALL SELECT k, any_value(lvl) + 1, pos // 2, any_value(n), sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > (1::BIGINT << lvl) GROUP BY k, pos // 2),
{name}_path AS (SELECT r.k, r.pos, list((r.pos >> l) & 1 || coalesce(s.h, '') ORDER BY l) FILTER (l IS NOT NULL) AS p FROM {rows} r
 LEFT JOIN (SELECT k, lvl AS l FROM {name} x WHERE n > (1::BIGINT << lvl) GROUP BY k, lvl) v ON r.k = v.k LEFT JOIN {name} s ON s.k = r.k AND s.lvl = l AND s.pos = xor(r.pos >> l, 1) GROUP BY r.k, r.pos)"""


_MARKED = lambda parts: "sha256(" + " || ".join(f"coalesce(strlen({p}::VARCHAR) || ':' || {p}::VARCHAR, '-')" for p in parts) + ")"
OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_MARKED(["doc_id", "source", "lang", "n_chars", "text"])} AS h,
 {_MARKED(["doc_id", "source", "lang", f"(n_chars + CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 7 = 0 THEN 1 ELSE 0 END)", "text"])} AS now FROM documents, crc),
r AS (SELECT *, dense_rank() OVER (ORDER BY encode(g)) - 1 AS k, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("low", "r")},
top AS (SELECT 0 AS k, k AS pos, h, count(*) OVER () AS n FROM (SELECT k, h, lvl, max(lvl) OVER (PARTITION BY k) AS last FROM low) WHERE lvl = last),
{_tree("high", "top")},
root AS (SELECT h AS root FROM high WHERE n <= (1::BIGINT << lvl)),
j AS (SELECT r.doc_id, r.h AS leaf, top.h AS subroot, root, coalesce(low_path.p, []) || coalesce(high_path.p, []) AS p, coalesce(now, r.h) AS now
 FROM r JOIN low_path ON low_path.k = r.k AND low_path.pos = r.pos JOIN top ON top.pos = r.k JOIN high_path ON high_path.pos = r.k, root),
f AS (SELECT doc_id, leaf, subroot, root, sha256(list_aggregate([''] || list_transform(p, lambda x: substr(x, 2)), 'string_agg', '')) AS proof_sha256,
 list_reduce(p, lambda a, x: sha256(CASE WHEN x[1] = '1' THEN substr(x, 2) || a ELSE a || substr(x, 2) END), now) AS folded_root FROM j)
SELECT *, folded_root = root AS verified FROM f
"""

#: Rows of the same turn go by role and text here, by role and digest in the operator; the table has none but repeated ones.
OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT coalesce(conv_id, -1) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS m FROM conversations, crc),
d AS (SELECT c, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE m <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, role[1] AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
 i > 1 AND lag(ini) OVER (PARTITION BY c ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS bad FROM o),
ids AS (SELECT c, any_value(conv_id) AS conv_id FROM k GROUP BY c),
s(c, i, s, best) AS (SELECT c, 0, unnest([0, 2, 3]), unnest(['000000000', '000000005I', '000000010II']) FROM ids
 UNION ALL SELECT c, i, t, min(printf('%09d', cost) || audit) FROM (SELECT c, i, unnest([s, CASE WHEN s = 2 THEN 3 ELSE 2 END, CASE WHEN s = 2 THEN 2 ELSE 3 END]) AS t, cost + unnest([0, 5, 10]) AS cost, audit || unnest(['', 'I', 'II']) AS audit
  FROM (SELECT s.c, f.i, s.best[1:9]::BIGINT + unnest([2, 5 * (fault = 'truncated')::INT, 1 + 5 * (fault = 'truncated')::INT]) AS cost, s.best[10:] || unnest(['D', 'K', 'R']) AS audit,
   unnest([s.s, CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN ini = 's' AND s.s = 0 THEN 1 WHEN ini = 'u' AND s.s <> 2 THEN 2 WHEN ini = 'a' AND s.s = 2 THEN 3 END, CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN s.s = 2 THEN 3 ELSE 2 END]) AS s FROM s JOIN f ON f.c = s.c AND f.i = s.i + 1) x
  WHERE s IS NOT NULL) y GROUP BY c, i, t),
n AS (SELECT ids.c, conv_id, count(f.i) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal,
 coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM ids LEFT JOIN f ON ids.c = f.c GROUP BY ids.c, conv_id),
b AS (SELECT n.*, best FROM n JOIN (SELECT s.c, s.i, min(best) AS best FROM s WHERE s.s IN (0, 3) GROUP BY s.c, s.i) z ON z.c = n.c AND z.i = n.n),
a AS (SELECT c, p, best[9 + p] AS op, sum((best[9 + p] <> 'I')::INT) OVER w AS i, sum((best[9 + p] <> 'D')::INT) OVER w AS o FROM (SELECT c, best, unnest(range(1, length(best) - 8)) AS p FROM b) WINDOW w AS (PARTITION BY c ORDER BY p)),
h AS (SELECT a.*, role, text, max((o = 1 AND op = 'K' AND ini = 's')::INT) OVER (PARTITION BY a.c) AS head FROM a LEFT JOIN f ON f.c = a.c AND f.i = a.i AND op <> 'I'),
z AS (SELECT c, string_agg(CASE WHEN op = 'K' THEN role WHEN (o - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS fixed FROM h WHERE op <> 'D' GROUP BY c)
SELECT conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best[1:9]::BIGINT AS cost, best[10:] AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256 FROM b LEFT JOIN z ON z.c = b.c
"""

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_decontamination, op3_source_mixing, op4_toxicity, op5_warc_fixity, op6_html_extraction, op7_quality_rules, op8_pii, op9_quality_classifier, op10_simhash_near_dedup, op11_merkle_manifest, op12_token_output, op13_conversation_repair, pipeline)}
SQL = {"op1_secret_scan": OP1_SQL, "op2_decontamination": OP2_SQL, "op5_warc_fixity": OP5_SQL, "op7_quality_rules": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op13_conversation_repair": OP13_SQL}
