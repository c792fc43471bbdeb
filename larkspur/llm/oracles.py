"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Rules, host rates and verdicts.
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
word AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
win AS (SELECT rid, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY rid ORDER BY pos)),
again AS (SELECT rid, pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win WHERE c IS NOT NULL) WHERE k > 1),
covered AS (SELECT rid, count(DISTINCT pos + i) AS n FROM again, (SELECT unnest([0, 1, 2]) AS i) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.rid = w.rid LEFT JOIN covered ON covered.rid = w.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source AS host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
mean AS (SELECT least(greatest(sum(failed) / sum(n), 1e-6), 1 - 1e-6) AS mean FROM h),
spread AS (SELECT any_value(mean) AS mean, sum((failed / n - mean) * (failed / n - mean)) AS var, sum(1 / n) AS noise, count(*) AS k FROM h, mean),
prior AS (SELECT mean, mean * (1 - mean) AS base, (var - mean * (1 - mean) * noise) / greatest(k, 1) AS btw FROM spread),
strength AS (SELECT mean, CASE WHEN btw > 0 THEN least(greatest(base / btw - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM prior),
r AS (SELECT host, (failed + mean * s) / (n + s) AS rate FROM h, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rate > 0.75, false) AS kept, round(rate, 4) AS host_rate
FROM f LEFT JOIN r ON f.source = r.host"""




def _mixing(sweeps: int = 8, steps: int = 12, rate: float = 0.7) -> str:
    """Raking and calibration, sweep by sweep."""
    ctes = [
        rf"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, source, lang, CASE WHEN contains(t, ' | ') THEN 'table'
  WHEN (length(t) - length(translate(t, '#*$%&<>{{}}', ''))) * 20 > length(t) THEN 'symbols'
  WHEN length(t) < (length(t) - length(replace(t, chr(10), '')) + 1) * 80 THEN 'lines' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(t, '{_WORD}')) AS BIGINT) AS n_tokens FROM d),
cell AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL)"""
    ]
    target = ", ".join(f"sqrt(sum(tokens) OVER (PARTITION BY {m})) AS t_{m}" for m in ("source", "lang", "topic"))
    ctes.append(f"r0 AS (SELECT *, tokens AS w, {target} FROM cell)")
    for m in ("source", "lang", "topic"):
        ctes.append(f"z_{m} AS (SELECT sum(x) AS z FROM (SELECT DISTINCT {m}, t_{m} AS x FROM r0))")
    last = "r0"
    for k in range(sweeps):
        for m in ("source", "lang", "topic"):
            name = f"r{k + 1}_{m}"
            by = f"sum(w) OVER (PARTITION BY {m})"
            ctes.append(f"{name} AS (SELECT * REPLACE (CASE WHEN {by} > 0 THEN w * (t_{m} / z) / {by} ELSE 0 END AS w) FROM (SELECT {last}.*, z FROM {last}, z_{m}))")
            ctes.append(f"{name}x AS (SELECT * EXCLUDE (z) FROM {name})")
            last = f"{name}x"
    ctes.append(f"raked AS MATERIALIZED (SELECT * FROM {last})")
    ctes.append(f"s0 AS (SELECT {rate} * sum(tokens) AS budget, {rate} * sum(tokens) AS scale FROM raked)")
    for k in range(steps):
        ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT budget, scale * budget / (SELECT sum(least(tokens, (SELECT scale FROM s{k}) * w)) FROM raked) AS scale FROM s{k})")
    ctes.append(f"p AS (SELECT source, lang, topic, w, CASE WHEN tokens > 0 THEN least(1.0, scale * w / tokens) ELSE 0 END AS prob FROM raked, s{steps})")
    unit = "CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 13)) AS UBIGINT) / 4503599627370496.0"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS weight, round(prob, 6) AS prob, "
        f"CAST({unit} AS DOUBLE) < prob AND n_tokens > 0 AS kept FROM e JOIN p USING (source, lang, topic)"
    )


def oracle_sql():
    return {"op4_mixing": _mixing(), "op7_quality_rules": QUALITY}
