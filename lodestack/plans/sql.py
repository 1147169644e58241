"""SQL that gives the same rows, for DuckDB over the same tables."""

from __future__ import annotations

from lodestack.plans import catalogue_sql

CHANGES = """
WITH h AS (SELECT id AS scan_id, row_number() OVER (PARTITION BY volume_id ORDER BY started_at, id) AS pos, volume_id,
                  lag(id) OVER (PARTITION BY volume_id ORDER BY started_at, id) AS before
           FROM scan_history WHERE status = 'completed'),
s AS (SELECT scan_id, relative_path, size_bytes, modified_at
      FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, relative_path ORDER BY scanned_at DESC) AS r FROM file_snapshots)
      WHERE r = 1 AND missing <> 1),
new AS (SELECT h.scan_id, h.before, s.relative_path, s.size_bytes, s.modified_at FROM h JOIN s USING (scan_id) WHERE h.before IS NOT NULL),
old AS (SELECT h.scan_id, s.relative_path, s.size_bytes, s.modified_at FROM h JOIN s ON h.before = s.scan_id),
c AS (SELECT coalesce(new.scan_id, old.scan_id) AS scan_id, coalesce(new.relative_path, old.relative_path) AS relative_path,
             CASE WHEN old.scan_id IS NULL THEN 'added' WHEN new.scan_id IS NULL THEN 'removed'
                  WHEN new.size_bytes IS DISTINCT FROM old.size_bytes OR new.modified_at IS DISTINCT FROM old.modified_at THEN 'changed' END AS change_type,
             new.size_bytes AS new_size, old.size_bytes AS old_size
      FROM new FULL JOIN old ON new.scan_id = old.scan_id AND new.relative_path = old.relative_path)
"""

KEYED = """
f AS (SELECT DISTINCT id, volume_id, folder_id, size_bytes FROM files),
k AS (SELECT 'volume_id' AS key_field, volume_id AS key_id, size_bytes FROM f UNION ALL SELECT 'folder_id', folder_id, size_bytes FROM f
      UNION ALL SELECT 'all', NULL, size_bytes FROM f)
"""


def oracle_sql() -> dict[str, str]:
    return catalogue_sql.oracle_sql() | {
        "p4_found": f"{CHANGES} SELECT scan_id, relative_path, change_type FROM c WHERE change_type IS NOT NULL",
        "p4_summary": f"""{CHANGES} SELECT scan_id, count(*) FILTER (change_type = 'added') AS files_added, count(*) FILTER (change_type = 'removed') AS files_removed,
  count(*) FILTER (change_type = 'changed') AS files_changed, sum(coalesce(new_size, 0) - coalesce(old_size, 0))::BIGINT AS bytes_delta
FROM c WHERE change_type IS NOT NULL GROUP BY 1""",
        "p4_increment": f"""{CHANGES} SELECT scan_id, relative_path, change_type FROM c WHERE change_type IS NOT NULL AND scan_id IN (
  SELECT last(scan_id ORDER BY pos) FROM h GROUP BY volume_id)""",
        "p5_found": """
WITH f AS (SELECT DISTINCT id, volume_id, folder_id FROM files)
SELECT 'volume_id' AS key_field, volume_id AS key_id FROM f WHERE volume_id IS NOT NULL GROUP BY 2 HAVING count(*) > 0.04 * (SELECT count(*) FROM f)
UNION ALL SELECT 'folder_id', folder_id FROM f WHERE folder_id IS NOT NULL GROUP BY 2 HAVING count(*) > 0.01 * (SELECT count(*) FROM f)
""",
        "p5_totals": f"""
WITH {KEYED}, w AS (SELECT key_field, key_id, size_bytes, count(*) AS n FROM k GROUP BY 1, 2, 3),
m AS (SELECT key_field, key_id, size_bytes, row_number() OVER (PARTITION BY key_field, key_id ORDER BY n DESC, size_bytes) AS r FROM w WHERE size_bytes >= 0)
SELECT key_field, key_id, t.files, t.total_bytes, t.sized_files, t.distinct_sizes, m.size_bytes AS common_size
FROM (SELECT key_field, key_id, sum(n)::BIGINT AS files, coalesce(sum(CASE WHEN size_bytes >= 0 THEN size_bytes * n END), 0)::BIGINT AS total_bytes,
             coalesce(sum(n) FILTER (size_bytes >= 0), 0)::BIGINT AS sized_files, count(*) FILTER (size_bytes >= 0) AS distinct_sizes FROM w GROUP BY 1, 2) t
LEFT JOIN m ON m.r = 1 AND m.key_field = t.key_field AND m.key_id IS NOT DISTINCT FROM t.key_id
""".replace("key_field, key_id, t.files", "t.key_field, t.key_id, t.files"),
        "p5_medians": f"""
WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY key_field, key_id ORDER BY size_bytes) AS pos, count(*) OVER (PARTITION BY key_field, key_id) AS n
                    FROM k WHERE size_bytes >= 0)
SELECT key_field, key_id, share, size_bytes FROM r, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS share) WHERE pos = greatest(ceil(share * n), 1)
""",
    }
