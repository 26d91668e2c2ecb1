"""The queries p3_, p4_ and p6_ once more, as plain SQL over the same tables."""

_FOLD = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
_FILLED = r"regexp_matches({c}, '\S')"


def _fold(c: str) -> str:
    return _FOLD.format(c=c)


def _orphans(label: str, field: str, ns: str | None, target: str, key: str, target_ns: str | None) -> str:
    match = f"{_fold('t.' + key)} = {_fold('r.' + field)}" + (f" AND {_fold('t.' + target_ns)} = {_fold('r.' + ns)}" if ns else "")
    return f"""
    SELECT '{label}' AS table_name, '{field}' AS field_name, r.load_no, r.row_id, {_fold("r." + field)} AS folded, {_fold("r." + ns) if ns else "''"} AS ns
    FROM {label} r
    WHERE {_FILLED.format(c="r." + field)}
      AND NOT EXISTS (SELECT 1 FROM {target} t WHERE {match} AND t.load_no <= r.load_no AND (t.removed_load_no IS NULL OR t.removed_load_no > r.load_no))"""


_ALL_ORPHANS = "\n    UNION ALL".join([
    _orphans("c2m2_project", "submission", None, "c2m2_dcc", "submission", None),
    _orphans("c2m2_file", "project_local_id", "project_id_namespace", "c2m2_project", "local_id", "id_namespace"),
    _orphans("c2m2_file", "bundle_collection_local_id", "bundle_collection_id_namespace", "c2m2_collection", "local_id", "id_namespace"),
    _orphans("c2m2_dcc", "project_local_id", "project_id_namespace", "c2m2_project", "local_id", "id_namespace"),
])

P3_FOUND = f"SELECT table_name, field_name, load_no, row_id FROM ({_ALL_ORPHANS})"
P3_COUNTS = f"""
SELECT table_name, field_name, load_no, count(*) AS orphan_references, count(DISTINCT (ns, folded)) AS orphan_keys
FROM ({_ALL_ORPHANS}) GROUP BY 1, 2, 3"""

_VALUES = rf"""
values_of AS (
    SELECT 'c2m2_file' AS table_name, 'genome_assembly' AS column_name, load_no, CASE WHEN {_FILLED.format(c="genome_assembly")} THEN genome_assembly END AS v, NULL::BIGINT AS num FROM c2m2_file
    UNION ALL
    SELECT 'c2m2_file', 'data_access_level', load_no, CASE WHEN {_FILLED.format(c="data_access_level")} THEN data_access_level END, NULL FROM c2m2_file
    UNION ALL
    SELECT 'dump_stat', 'value', load_no, CAST(value AS VARCHAR), value FROM dump_stat
),
loads AS (
    SELECT table_name, load_no, lag(load_no) OVER (PARTITION BY table_name ORDER BY load_no) AS prior
    FROM (SELECT DISTINCT table_name, load_no FROM values_of)
),
base AS (
    SELECT v.table_name, v.column_name, v.load_no, count(*) AS n_rows, count(*) - count(v) AS blanks, count(DISTINCT v) AS distinct_values,
        count(*) FILTER (WHERE v IS NOT NULL AND CASE WHEN column_name = 'value' THEN NOT (num BETWEEN 0 AND 1000000000000000)
            ELSE NOT EXISTS (SELECT 1 FROM vocab_term t WHERE t.column_name = v.column_name AND t.term = v.v) END) AS violations,
        min(num) AS low, max(num) AS high, median(num) FILTER (WHERE num BETWEEN 0 AND 1000000000000000) AS med
    FROM values_of v GROUP BY 1, 2, 3
),
counts AS (
    SELECT table_name, column_name, load_no, v, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY table_name, column_name, load_no) AS share
    FROM values_of WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4
),
shifts AS (
    SELECT table_name, column_name, load_no, sum(abs(d)) / 2 AS shift FROM (
        SELECT table_name, column_name, load_no, v, sum(s) AS d FROM (
            SELECT table_name, column_name, load_no, v, share AS s FROM counts
            UNION ALL
            SELECT c.table_name, c.column_name, l.load_no, c.v, -c.share FROM counts c JOIN loads l ON l.table_name = c.table_name AND l.prior = c.load_no
        ) GROUP BY 1, 2, 3, 4
    ) GROUP BY 1, 2, 3
),
entropies AS (
    SELECT table_name, column_name, load_no, -sum(share * log2(share)) AS entropy FROM counts GROUP BY 1, 2, 3
),
metrics AS (
    SELECT b.*, l.prior, e.entropy, CASE WHEN b.n_rows > b.blanks AND p.n_rows > p.blanks THEN s.shift END AS shift, p.blanks / p.n_rows AS prior_rate, p.med AS prior_med
    FROM base b JOIN loads l USING (table_name, load_no) LEFT JOIN entropies e USING (table_name, column_name, load_no) LEFT JOIN shifts s USING (table_name, column_name, load_no)
    LEFT JOIN base p ON p.table_name = b.table_name AND p.column_name = b.column_name AND p.load_no = l.prior
)"""

P4_FOUND = f"""
WITH {_VALUES}
SELECT table_name, column_name, load_no, 'null_rate' AS finding FROM metrics WHERE abs(blanks / n_rows - prior_rate) > 0.20
UNION ALL
SELECT table_name, column_name, load_no, CASE WHEN column_name = 'value' THEN 'range' ELSE 'pattern' END FROM metrics WHERE n_rows > blanks AND violations > 0.05 * (n_rows - blanks)
UNION ALL
SELECT table_name, column_name, load_no, 'distribution' FROM metrics
WHERE CASE WHEN column_name = 'value' THEN greatest(med, prior_med) > 3 * least(med, prior_med) AND med IS NOT NULL AND prior_med IS NOT NULL ELSE shift > 0.25 END"""
P4_PROFILE = f"""
WITH {_VALUES}
SELECT table_name, column_name, load_no, n_rows AS rows, blanks, distinct_values, violations, round(entropy, 6) AS entropy, CAST(low AS VARCHAR) AS low, CAST(high AS VARCHAR) AS high, med AS median, round(shift, 6) AS shift FROM metrics"""

P6_FOUND = r"""
WITH cleaned AS (
    SELECT id_namespace, local_id, load_no, received_at, row_id,
        CASE WHEN regexp_matches(md5, '\S') THEN lower(regexp_replace(md5, '^\s+|\s+$', '', 'g')) END AS md5,
        CASE WHEN regexp_matches(status, '\S') THEN lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) END AS status,
        regexp_replace(size_in_bytes, '^\s+|\s+$', '', 'g') AS size_text
    FROM c2m2_file
),
sized AS (
    SELECT * REPLACE (CASE WHEN regexp_matches(size_text, '^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$') THEN replace(size_text, ',', '') ELSE size_text END AS size_text) FROM cleaned
),
latest AS (
    SELECT id_namespace, local_id, load_no, md5, status, TRY_CAST(size_text AS DECIMAL(38, 6)) AS size_value FROM sized
    QUALIFY row_number() OVER (PARTITION BY id_namespace, local_id, load_no ORDER BY received_at DESC, row_id DESC) = 1
),
loads AS (SELECT load_no, lag(load_no) OVER (ORDER BY load_no) AS prior FROM (SELECT DISTINCT load_no FROM c2m2_file)),
now AS (SELECT t.*, l.prior FROM latest t JOIN loads l USING (load_no) WHERE l.prior IS NOT NULL),
old AS (SELECT t.*, l.load_no AS next FROM latest t JOIN loads l ON l.prior = t.load_no)
SELECT coalesce(n.id_namespace, o.id_namespace) AS id_namespace, coalesce(n.local_id, o.local_id) AS local_id, coalesce(n.load_no, o.next) AS load_no,
    CASE WHEN o.next IS NULL THEN 'added' WHEN n.load_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM now n FULL JOIN old o ON n.id_namespace IS NOT DISTINCT FROM o.id_namespace AND n.local_id IS NOT DISTINCT FROM o.local_id AND n.load_no = o.next
WHERE o.next IS NULL OR n.load_no IS NULL OR n.md5 IS DISTINCT FROM o.md5 OR n.status IS DISTINCT FROM o.status OR n.size_value IS DISTINCT FROM o.size_value"""

ORACLE = {"p3_found": P3_FOUND, "p3_counts": P3_COUNTS, "p4_found": P4_FOUND, "p4_profile": P4_PROFILE, "p6_found": P6_FOUND}
