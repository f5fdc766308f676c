"""DuckDB SQL of the document queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from ruleloom.llm import quality_rules as q

BLANK = "[\\x20\\x09-\\x0D]"

EXACT = f"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""

_METRICS = {
    "symbols_per_word": "n_symbols * 1.0E0 / greatest(1, n_words)", "dup_line_share": "n_dup_lines * 1.0E0 / greatest(1, n_lines)", "repeat_share": "n_repeat_words * 1.0E0 / greatest(1, n_words)",
    "chars_per_word": "word_chars * 1.0E0 / greatest(1, n_words)", "thin_words": "1.0E0 / greatest(0.01E0, word_chars * 1.0E0 / greatest(1, n_words))",
}
_GAMMA = repr(q.GAMMA)
_QUANTILE = "CASE metric " + " ".join(f"WHEN '{m}' THEN {share!r}::DOUBLE" for m, share in q.RULES.items()) + " END"

RULES = f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, lang, source, list_filter(string_split_regex(t, '{BLANK}+'), lambda x: x <> '') AS w, length(regexp_replace(t, '{BLANK}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{BLANK}', '', 'g') <> '') AS ln FROM d),
b AS (SELECT doc_id, lang, source, w, len(w) AS n_words, word_chars, n_symbols, len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines FROM m),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, n_words - 3)) AS i FROM b WHERE n_words >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM dup, (SELECT unnest(range(0, 5)) AS j)) GROUP BY 1),
base AS (SELECT b.doc_id, b.lang, b.source, b.n_words, b.word_chars, b.n_symbols, b.n_lines, b.n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM b LEFT JOIN rep ON rep.doc_id = b.doc_id),
vals AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS v FROM base WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)" for k, v in _METRICS.items())}),
bk AS (SELECT lang, source, metric, CASE WHEN v <= 0 THEN {q.ZERO} ELSE ceil(ln(v) / ln({_GAMMA}::DOUBLE))::BIGINT END AS bucket FROM vals),
lv AS (SELECT 2 AS level, lang, source, metric, bucket, count(*) AS c FROM bk GROUP BY ALL UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM bk GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, metric, bucket, count(*) FROM bk GROUP BY ALL),
cu AS (SELECT *, sum(c) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(c) OVER (PARTITION BY level, lang, source, metric) AS n,
  CASE WHEN bucket = {q.ZERO} THEN 0 ELSE pow({_GAMMA}::DOUBLE, bucket) END AS value FROM lv),
qs AS (SELECT level, lang, source, metric, min(n) AS n, min(value) FILTER (upto >= ceil(n * {_QUANTILE})) AS v FROM cu GROUP BY 1, 2, 3, 4),
t0 AS (SELECT metric, v AS t FROM qs WHERE level = 0),
t1 AS (SELECT qs.lang, metric, (qs.n * qs.v + {q.PRIOR_ROWS} * t0.t) / (qs.n + {q.PRIOR_ROWS}) AS t FROM qs JOIN t0 USING (metric) WHERE level = 1),
t2 AS (SELECT qs.lang, qs.source, qs.metric, (qs.n * qs.v + {q.PRIOR_ROWS} * t1.t) / (qs.n + {q.PRIOR_ROWS}) AS t FROM qs JOIN t1 ON qs.metric = t1.metric AND qs.lang IS NOT DISTINCT FROM t1.lang WHERE level = 2),
th AS (SELECT x.lang, x.source, t0.metric, coalesce(t2.t, t1.t, t0.t) AS t FROM (SELECT DISTINCT lang, source FROM base) x CROSS JOIN t0
  LEFT JOIN t1 ON t1.metric = t0.metric AND x.lang IS NOT DISTINCT FROM t1.lang
  LEFT JOIN t2 ON t2.metric = t0.metric AND x.lang IS NOT DISTINCT FROM t2.lang AND x.source IS NOT DISTINCT FROM t2.source),
groups AS (SELECT lang, source, {", ".join(f"max(t) FILTER (metric = '{k}') AS f_{k}" for k in _METRICS)} FROM th GROUP BY 1, 2),
j AS (SELECT base.*, {", ".join(f"coalesce(({v}) > f_{k}, false) AS b_{k}" for k, v in _METRICS.items())}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM base LEFT JOIN groups g ON base.lang IS NOT DISTINCT FROM g.lang AND base.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"b_{k}" for k in _METRICS)}) AS kept,
  concat_ws(',', {", ".join(f"CASE WHEN b_{k} THEN '{k}' END" for k in _METRICS)}) AS beyond FROM j"""

# The checksum goes byte by byte over a table of the 256 remainders.
SHARDING = """WITH remainders AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS r FROM range(256) x(i))),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) END AS crc,
  md5('7:' || coalesce(doc_id::VARCHAR, '')) AS digest, coalesce('s' || source, 'none') AS stratum FROM documents, remainders),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, crc, size) - 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, digest, doc_id, crc, size) - 1 AS position, count(*) OVER () AS total FROM r),
s AS (SELECT *, (8 * (position + 1) - 1) // total AS shard FROM p)
SELECT doc_id, source, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (position - shard * total // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s"""

ORACLES = {"op3_exact_dedup": EXACT, "op8_sharding": SHARDING, "op9_quality_rules": RULES}
