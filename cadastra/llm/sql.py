"""SQL that checks the operators it can express on whole tables; the others are tested against brute force."""

P1 = r"""
WITH trust AS (SELECT trim(regexp_replace(lower(status), '[^a-z0-9]+', ' ', 'g')) AS k, max(trust) AS trust FROM status_trust GROUP BY 1),
raw AS (
  SELECT queue_id, trim(processed_at) AS p, trim(regexp_replace(lower(status), '[^a-z0-9]+', ' ', 'g')) AS k,
    CASE WHEN regexp_matches(account_number, '^\s*(?i:acct\s*)?#?\s*[A-Za-z]?[- ]*\d{4}[- ]?\d{4}\s*$') THEN regexp_replace(account_number, '\D', '', 'g') END AS digits,
    CAST(coalesce(nullif(regexp_extract(tax_year, '(20\d\d)', 1), ''), '20' || nullif(regexp_extract(tax_year, '''(\d\d)', 1), '')) AS INT) AS year,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(file_name), '%20', ' ', 'g'), '^.*[\\/]', ''), '\.pdf$', ''), '^copy of ', ''), '( ?\(\d+\)|-resend)$', ''), '[\s_]+', '_', 'g') AS stem
  FROM review_queue),
timed AS (
  SELECT *, CASE
    WHEN regexp_matches(p, '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d') THEN epoch_us(TRY_CAST(replace(regexp_extract(p, '^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?)', 1), 'T', ' ') AS TIMESTAMP))
      - CASE WHEN regexp_matches(p, '[+-]\d\d:\d\d$') THEN CASE substr(p, length(p) - 5, 1) WHEN '-' THEN -1 ELSE 1 END * (CAST(substr(p, length(p) - 4, 2) AS BIGINT) * 3600 + CAST(substr(p, length(p) - 1, 2) AS BIGINT) * 60) * 1000000 ELSE 0 END
    WHEN regexp_matches(p, '^\d{8}T\d{6}$') THEN epoch_us(try_strptime(p, '%Y%m%dT%H%M%S'))
    WHEN regexp_matches(p, '[AP]M$') THEN epoch_us(try_strptime(p, '%m/%d/%Y %I:%M:%S %p'))
    WHEN regexp_matches(p, '^[A-Z][a-z]{2} \d\d, ') THEN epoch_us(try_strptime(p, '%b %d, %Y %H:%M:%S')) END AS instant
  FROM raw),
stems AS (SELECT stem, min(digits) AS d, min(year) AS y FROM raw WHERE digits IS NOT NULL AND year IS NOT NULL AND stem IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (digits, year)) = 1),
keyed AS (
  SELECT t.queue_id, coalesce(instant, -4611686018427387904) AS instant, digits, coalesce(digits, d) AS acc, coalesce(t.year, y, year(make_timestamp(t.instant))) AS yr, coalesce(trust.trust, -1) AS trust
  FROM timed t LEFT JOIN stems USING (stem) LEFT JOIN trust ON trust.k = t.k),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY acc, yr ORDER BY trust DESC, instant DESC, queue_id) AS best, row_number() OVER (PARTITION BY acc, yr ORDER BY digits IS NULL, instant DESC, queue_id) AS shown
  FROM keyed WHERE acc IS NOT NULL AND yr IS NOT NULL)
SELECT min(queue_id) AS group_id, max(CASE WHEN best = 1 THEN queue_id END) AS survivor_id, max(CASE WHEN shown = 1 AND digits IS NOT NULL THEN queue_id END) AS account_from
FROM ranked GROUP BY acc, yr HAVING count(*) >= 2
"""
