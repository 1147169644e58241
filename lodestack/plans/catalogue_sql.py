"""SQL for the catalogue's own queries, for DuckDB over the same tables."""

from __future__ import annotations

from lodestack.functions.catalogue import TYPES

REGISTER = """
r AS (SELECT id AS volume_id, format('AID-{:03d}', id) AS drive_id, (id % 5 = 4)::INT AS is_mirror, created_at::DATE AS date_added,
             CASE WHEN id % 5 = 4 THEN id - 1 END AS master_volume_id FROM volumes)
"""
FILES = "f AS (SELECT DISTINCT * FROM files)"
# Files whose size is known count with it, others with nothing.
SIZE = "CASE WHEN size_bytes > 0 THEN size_bytes ELSE 0 END"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ABOUT = "v.id AS volume_id, r.drive_id, v.name AS volume_name"
WHERE_FROM = "v.source_path, v.identity_kind, v.identity_token, v.source_relative_path"


def search(text: str, paths: bool = False, limit: int | None = None) -> str:
    text = text.strip()
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("'", "''")
    holds = lambda c: f"coalesce(contains({LOW.format(c)}, '{low}'), false)"
    any_of = lambda *cs: " OR ".join(map(holds, cs)) if text else "false"
    by_path = ("relative_path",) if paths else ()
    if text.startswith("."):
        of_files, file_rank = f"coalesce(extension, '') = '{text[1:].lower()}'", "0"
    else:
        of_files = any_of("name", "extension", *by_path)
        file_rank = f"CASE WHEN {LOW.format('name')} = '{low}' THEN 0 WHEN {holds('name')} THEN 2 ELSE 4 END"
    folder_rank = f"CASE WHEN {LOW.format('name')} = '{low}' THEN 0 WHEN {holds('name')} THEN 1 ELSE 3 END"
    order = f"ORDER BY match_rank, missing_rank, item_type DESC, {LOW.format('i.name')}, item_id LIMIT {limit}" if limit is not None else ""
    return f"""
WITH {REGISTER}, {FILES},
i AS (SELECT 'file' AS item_type, id AS item_id, name, volume_id, relative_path, size_bytes, modified_at, missing, {file_rank} AS match_rank FROM f WHERE {of_files}
      UNION ALL SELECT 'folder', id, name, volume_id, relative_path, recursive_size_bytes, modified_at, missing, {folder_rank} FROM folders WHERE {any_of('name', *by_path)})
SELECT item_type, item_id, i.name, i.volume_id, r.drive_id, v.name AS volume_name, relative_path, size_bytes, modified_at, missing, {WHERE_FROM},
       CASE WHEN missing = 0 THEN 0 ELSE 1 END AS missing_rank, match_rank
FROM i JOIN volumes v ON v.id = i.volume_id JOIN r ON r.volume_id = v.id {order}
"""


def type_case(column: str, what: int) -> str:
    bare = f"ltrim(lower(coalesce({column}, '')), '.')"
    whens = " ".join(f"WHEN {bare} IN ({', '.join(repr(m) for m in members.split())}) THEN '{label if what == 0 else key}'" for key, (label, members) in TYPES.items())
    return f"CASE WHEN {bare} = '' THEN '{'File' if what == 0 else 'unknown'}' {whens} ELSE {f'upper({bare})' if what == 0 else repr('unknown')} END"


def property_case(column: str) -> str:
    bare, label = f"ltrim(lower(coalesce({column}, '')), '.')", type_case(column, 0)
    return f"CASE WHEN {bare} = '' THEN 'File' WHEN upper({label}) = upper({bare}) THEN upper({bare}) || ' file' ELSE upper({bare}) || ' ' || lower({label}) END"


def size_text(x: str) -> str:
    v = f"coalesce({x}, 0)::DOUBLE"
    return f"""CASE WHEN {v} < 1000 THEN {v}::BIGINT || ' B' WHEN {v} / 1000 < 1000 THEN format('{{:.1f}} KB', {v} / 1000)
 WHEN {v} / 1000 / 1000 < 1000 THEN format('{{:.1f}} MB', {v} / 1000 / 1000) WHEN {v} / 1000 / 1000 / 1000 < 1000 THEN format('{{:.1f}} GB', {v} / 1000 / 1000 / 1000)
 ELSE format('{{:.1f}} TB', {v} / 1000 / 1000 / 1000 / 1000) END"""


CLOSURE = """
WITH RECURSIVE p AS (SELECT DISTINCT id, parent_id FROM folders WHERE missing = 0),
c AS (SELECT id AS descendant, id AS ancestor, 0 AS steps FROM p
      UNION ALL SELECT c.descendant, p.parent_id, c.steps + 1 FROM c JOIN p ON p.id = c.ancestor JOIN p AS q ON q.id = p.parent_id)
"""
PRESENT = f"SELECT DISTINCT id, volume_id, folder_id, {SIZE} AS size, identity_device AS dev, identity_inode AS ino FROM files WHERE missing = 0"
DIRECT = f"""
x AS ({PRESENT}),
d AS (SELECT p.id AS folder_id, coalesce(n, 0) AS direct_file_count, coalesce(s, 0)::BIGINT AS direct_size, coalesce(k, 0) AS direct_subfolder_count
      FROM (SELECT DISTINCT id FROM folders WHERE missing = 0) p
      LEFT JOIN (SELECT folder_id, count(*) AS n, sum(size) AS s FROM x GROUP BY 1) a ON a.folder_id = p.id
      LEFT JOIN (SELECT parent_id, count(*) AS k FROM folders WHERE missing = 0 GROUP BY 1) b ON b.parent_id = p.id)
"""
RECURSIVE = f"""{CLOSURE}, {DIRECT},
t AS (SELECT ancestor, sum(direct_size) AS size, sum(direct_file_count)::BIGINT AS files, sum(direct_subfolder_count)::BIGINT AS subfolders FROM c JOIN d ON d.folder_id = c.descendant GROUP BY 1),
l AS (SELECT volume_id, dev, ino, max(size) AS largest FROM x WHERE folder_id IS NOT NULL AND dev IS NOT NULL AND ino IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1),
e AS (SELECT ancestor, sum((n - 1) * largest) AS excess FROM (
        SELECT c.ancestor, volume_id, dev, ino, count(*) AS n, max(largest) AS largest FROM x JOIN l USING (volume_id, dev, ino) JOIN c ON c.descendant = x.folder_id GROUP BY 1, 2, 3, 4) GROUP BY 1),
s AS (SELECT d.folder_id, (t.size - coalesce(e.excess, 0))::BIGINT AS recursive_size_bytes, t.files AS recursive_file_count, t.subfolders AS recursive_subfolder_count,
  d.direct_file_count, d.direct_subfolder_count, d.direct_size FROM d JOIN t ON t.ancestor = d.folder_id LEFT JOIN e ON e.ancestor = d.folder_id)
{{select}}"""
INFO = f"""WITH x AS (SELECT DISTINCT id, missing, {SIZE} AS size FROM files)
SELECT (SELECT count(*) FROM volumes) AS volume_count, (SELECT coalesce(sum(capacity_bytes), 0)::BIGINT FROM volumes) AS capacity_bytes, (SELECT coalesce(sum(used_bytes), 0)::BIGINT FROM volumes) AS used_bytes,
  (SELECT coalesce(sum(free_bytes), 0)::BIGINT FROM volumes) AS free_bytes, (SELECT max(last_scan_at) FROM volumes) AS latest_scan_at, (SELECT count(*) FROM x WHERE missing = 0) AS file_count,
  (SELECT coalesce(sum(size), 0)::BIGINT FROM x WHERE missing = 0) AS indexed_size_bytes, (SELECT count(*) FROM x WHERE missing <> 0) AS missing_file_count,
  (SELECT count(DISTINCT id) FROM folders WHERE missing = 0) AS folder_count, (SELECT count(DISTINCT id) FROM folders WHERE missing <> 0) AS missing_folder_count, (SELECT count(*) FROM scan_history) AS scan_count"""
DATES = """SELECT volume_id, min(modified_at)::DATE::VARCHAR AS earliest, max(modified_at)::DATE::VARCHAR AS latest
FROM (SELECT volume_id, modified_at FROM files WHERE missing = 0 UNION ALL SELECT volume_id, modified_at FROM folders WHERE missing = 0) WHERE modified_at IS NOT NULL GROUP BY 1"""
LAST = """
h AS (SELECT id AS scan_id, volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY started_at DESC, id DESC) AS back FROM scan_history WHERE status = 'completed'),
s AS (SELECT back, volume_id, relative_path, size_bytes, modified_at FROM (
        SELECT h.back, t.*, row_number() OVER (PARTITION BY t.scan_id, t.relative_path ORDER BY t.scanned_at DESC) AS r
        FROM file_snapshots t JOIN h USING (scan_id) WHERE h.back <= 2) WHERE r = 1 AND missing <> 1)
"""

CONNECTED = """
WITH k AS (SELECT identity_kind, lower(identity_token) AS token, '/mnt/' || min(id) AS mount_root FROM volumes WHERE id % 3 = 0 AND identity_token <> '' AND identity_kind <> '' GROUP BY 1, 2)
SELECT v.id, mount_root, CASE WHEN mount_root IS NULL THEN NULL WHEN trim(v.source_relative_path, '/') IN ('', '.') THEN mount_root ELSE mount_root || '/' || trim(v.source_relative_path, '/') END AS found_path,
  mount_root IS NOT NULL AS connected FROM volumes v LEFT JOIN k ON k.identity_kind = v.identity_kind AND k.token = lower(v.identity_token)"""


def oracle_sql() -> dict[str, str]:
    master = "LEFT JOIN volumes m ON m.id = r.master_volume_id LEFT JOIN r AS mr ON mr.volume_id = m.id"
    seen = "CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-05-01' ELSE scanned_at END"
    count = lambda name, column: f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name} WHERE {column} <> 29"
    file_columns = "f.id AS item_id, f.volume_id, v.name AS volume_name, f.folder_id AS parent_id, f.name, f.relative_path, f.extension, f.size_bytes"
    return {
        "search_name": search("Harbour"),
        "search_paths": search("camera roll", paths=True),
        "search_extension": search(".jpg"),
        "search_no_extension": search("."),
        "search_short": search("v1"),
        "search_wildcards": search("100%_"),
        "search_blank": search("  "),
        "search_top": search("report", limit=100),
        "list_volumes": f"""WITH {REGISTER} SELECT v.id, v.name, r.drive_id, r.is_mirror, 'Active' AS register_status, r.date_added::VARCHAR AS date_added, r.master_volume_id, m.name AS master_name,
  mr.drive_id AS master_drive_id, CASE WHEN v.capacity_bytes = 0 THEN 0 ELSE least(100, greatest(0, round_even(v.used_bytes / v.capacity_bytes * 100, 0)))::INT END AS percent_full
FROM volumes v JOIN r ON r.volume_id = v.id {master}""",
        "master_options": f"WITH {REGISTER} SELECT v.id, r.drive_id, v.name FROM volumes v JOIN r ON r.volume_id = v.id WHERE is_mirror = 0 AND v.id <> 1",
        "mirror_dependents": f"WITH {REGISTER} SELECT v.id, r.drive_id, v.name, r.master_volume_id FROM volumes v JOIN r ON r.volume_id = v.id WHERE is_mirror = 1",
        "mirror_violations": f"""WITH {REGISTER}, b AS (SELECT volume_id, CASE volume_id % 25 WHEN 4 THEN volume_id WHEN 9 THEN 999 WHEN 14 THEN volume_id - 5 WHEN 19 THEN NULL ELSE master_volume_id END AS m FROM r WHERE is_mirror = 1)
SELECT * FROM (SELECT b.volume_id, CASE WHEN m IS NULL THEN 'no master' WHEN m = b.volume_id THEN 'own master' WHEN r.volume_id IS NULL THEN 'unknown master' WHEN r.is_mirror = 1 THEN 'master is a mirror' END AS violation
FROM b LEFT JOIN r ON r.volume_id = b.m) WHERE violation IS NOT NULL""",
        "next_drive_id": "SELECT format('AID-{:03d}', max(id) + 1) AS drive_id FROM volumes",
        "drive_natural_order": """SELECT id, drive_id, row_number() OVER (ORDER BY n IS NULL, n, lower(drive_id))::INT AS place
FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'Shelf ' || id ELSE format('AID-{:03d}', id) END AS drive_id, CASE WHEN id % 7 <> 0 THEN id END AS n FROM volumes)""",
        "volume_filter": f"""WITH {REGISTER} SELECT v.id, v.name, r.drive_id FROM volumes v JOIN r ON r.volume_id = v.id LEFT JOIN volumes m ON m.id = r.master_volume_id
WHERE is_mirror = 1 AND contains(lower(concat_ws(' ', r.drive_id, v.name, v.source_path, m.name)), 'vault')""",
        "scan_log": f"""
SELECT volume_id, 'scan' AS section, id, (u.i - 1)::INT AS line_number, lines[u.i] AS line FROM (SELECT volume_id, id, list_filter([
  coalesce(strftime(started_at, '%Y-%m-%d %H:%M'), '-') || ' - ' || status || ' - ' || files_seen || ' files, ' || folders_seen || ' folders, ' || errors_count || ' errors',
  CASE WHEN files_added IS NOT NULL THEN '  Changes: +' || files_added || ' files, -' || files_removed || ' files, ' || files_changed || ' changed; +0 folders, -0 folders' END,
  CASE WHEN files_added IS NOT NULL THEN '  Indexed size: ' || {size_text('bytes_before')} || ' -> ' || {size_text('bytes_after')} || ' (' ||
    CASE WHEN bytes_after > bytes_before THEN '+' WHEN bytes_after < bytes_before THEN '-' ELSE '' END || {size_text('abs(bytes_after - bytes_before)')} || ')' END,
  CASE WHEN message <> '' THEN '  ' || message END], lambda x: x IS NOT NULL) AS lines FROM scan_history) h, (SELECT unnest([1, 2, 3, 4]) AS i) u WHERE u.i <= len(lines)
UNION ALL SELECT volume_id, 'error', id, 0, strftime(created_at, '%Y-%m-%d %H:%M') || ' - ' || path || ': ' || coalesce(message, '') FROM (SELECT DISTINCT * FROM scan_errors)""",
        "search_connected": f"WITH s AS ({search('minutes')}), c AS ({CONNECTED}) SELECT s.item_type, s.item_id, s.volume_id, coalesce(c.connected, false) AS connected, c.found_path FROM s LEFT JOIN c ON c.id = s.volume_id",
        "connected_volumes": CONNECTED,
        "unique_names": f"SELECT {LOW.format('name')} AS folded, count(*) AS n, min(id) AS first_id FROM folders WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "catalogue_info": INFO,
        "info_shown": f"""SELECT format('{{:,}}', volume_count) AS volume, format('{{:,}}', file_count) AS file, format('{{:,}}', folder_count) AS folder, format('{{:,}}', missing_file_count) AS missing_file,
  format('{{:,}}', missing_folder_count) AS missing_folder, format('{{:,}}', scan_count) AS scan, {size_text('used_bytes')} AS used, {size_text('capacity_bytes')} AS capacity, {size_text('free_bytes')} AS free,
  {size_text('indexed_size_bytes')} AS indexed_size, coalesce(strftime(latest_scan_at, '%Y-%m-%d %H:%M'), '-') AS latest_scan FROM ({INFO})""",
        "content_dates": DATES,
        "filled_dates": f"""WITH d AS ({DATES}) SELECT v.id AS volume_id, CASE WHEN v.id % 3 = 0 THEN '2001-01-01' ELSE earliest END AS earliest_content_date, latest AS latest_content_date FROM volumes v LEFT JOIN d ON d.volume_id = v.id""",
        "volume_counts": """SELECT v.id, (SELECT count(DISTINCT f.id) FROM files f WHERE f.volume_id = v.id AND f.missing = 0) AS indexed_file_count,
  (SELECT count(DISTINCT o.id) FROM folders o WHERE o.volume_id = v.id AND o.missing = 0) AS indexed_folder_count FROM volumes v""",
        "duplicate_identities": f"""WITH x AS ({PRESENT}) SELECT volume_id, dev AS identity_device, ino AS identity_inode, count(*) AS links, max(size) AS size_bytes
FROM x WHERE folder_id IS NOT NULL AND dev IS NOT NULL AND ino IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1""",
        "file_type_counts": f"SELECT {type_case('extension', 0)} AS type_label, {type_case('extension', 1)} AS category, count(*) AS file_count, sum({SIZE})::BIGINT AS total_bytes FROM (SELECT DISTINCT id, extension, size_bytes FROM files) GROUP BY 1, 2",
        "ancestor_closure": f"{CLOSURE} SELECT descendant, ancestor, steps FROM c",
        "direct_folder_stats": f"WITH {DIRECT} SELECT * FROM d",
        "recursive_folder_stats": RECURSIVE.format(select="SELECT * FROM s"),
        "stats_rewrite": RECURSIVE.format(
            select="SELECT DISTINCT f.id, f.missing, s.recursive_size_bytes, s.recursive_file_count, s.recursive_subfolder_count, s.direct_file_count, s.direct_subfolder_count, CASE WHEN s.folder_id IS NOT NULL THEN TIMESTAMP '2024-05-01' END AS stats_updated_at FROM folders f LEFT JOIN s ON s.folder_id = f.id"
        ),
        "prune_history": "SELECT id, volume_id, status FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY id DESC) AS n FROM scan_history) WHERE n <= 3",
        "prune_errors": """SELECT id, scan_id, volume_id, path FROM scan_errors WHERE scan_id IS NULL OR scan_id NOT IN (
  SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY volume_id ORDER BY id DESC) AS n FROM scan_history) WHERE n > 3)""",
        "recent_history": "SELECT id, volume_id, started_at, status FROM scan_history ORDER BY id DESC LIMIT 50",
        "recent_errors": "SELECT e.id, e.scan_id, e.volume_id, e.path, h.started_at FROM (SELECT DISTINCT * FROM scan_errors ORDER BY id DESC LIMIT 200) e LEFT JOIN scan_history h ON h.id = e.scan_id",
        "error_counts": "SELECT volume_id, count(*) AS errors, max(created_at) AS latest FROM (SELECT DISTINCT * FROM scan_errors) GROUP BY 1",
        "diff_summary": f"""WITH {LAST}, p AS (SELECT volume_id, relative_path, modified_at, {SIZE} AS size FROM s WHERE back = 2), n AS (SELECT volume_id, relative_path, modified_at, {SIZE} AS size FROM s WHERE back = 1),
b AS (SELECT coalesce(n.volume_id, p.volume_id) AS volume_id, p.volume_id IS NOT NULL AS was, n.volume_id IS NOT NULL AS now, p.size AS psize, n.size AS nsize,
             (p.volume_id IS NOT NULL AND n.volume_id IS NOT NULL AND (p.size <> n.size OR p.modified_at IS DISTINCT FROM n.modified_at)) AS changed
      FROM p FULL JOIN n ON n.volume_id = p.volume_id AND n.relative_path = p.relative_path)
SELECT *, files_before > 0 AS has_previous, files_added + files_removed + files_changed > 0 AS has_changes FROM (SELECT volume_id, count(*) FILTER (was) AS files_before, count(*) FILTER (now) AS files_after,
  count(*) FILTER (now AND NOT was) AS files_added, count(*) FILTER (was AND NOT now) AS files_removed, count(*) FILTER (changed) AS files_changed,
  coalesce(sum(psize) FILTER (was), 0)::BIGINT AS bytes_before, coalesce(sum(nsize) FILTER (now), 0)::BIGINT AS bytes_after, coalesce(sum(nsize) FILTER (now AND NOT was), 0)::BIGINT AS bytes_added,
  coalesce(sum(psize) FILTER (was AND NOT now), 0)::BIGINT AS bytes_removed, coalesce(sum(psize) FILTER (changed), 0)::BIGINT AS changed_bytes_before, coalesce(sum(nsize) FILTER (changed), 0)::BIGINT AS changed_bytes_after
FROM b GROUP BY 1)""",
        "folder_diff": """WITH x AS (SELECT volume_id, relative_path, max((id % 11 <> 0)::INT) AS p, max((id % 10 <> 0)::INT) AS n FROM folders GROUP BY 1, 2)
SELECT sum(p)::BIGINT AS folders_before, sum(n)::BIGINT AS folders_after, count(*) FILTER (n = 1 AND p = 0) AS folders_added, count(*) FILTER (p = 1 AND n = 0) AS folders_removed FROM x""",
        "upsert_files": f"""WITH {LAST}, {FILES}, n AS (SELECT * FROM s WHERE back = 1),
u AS (SELECT n.volume_id, n.relative_path, n.size_bytes, n.modified_at FROM n ANTI JOIN f ON f.volume_id = n.volume_id AND f.relative_path = n.relative_path)
SELECT f.id, f.volume_id, f.relative_path, CASE WHEN n.volume_id IS NULL THEN f.size_bytes ELSE n.size_bytes END AS size_bytes, CASE WHEN n.volume_id IS NULL THEN f.modified_at ELSE n.modified_at END AS modified_at
FROM f LEFT JOIN n ON f.volume_id = n.volume_id AND f.relative_path = n.relative_path
UNION ALL SELECT (SELECT max(id) FROM f) + row_number() OVER (ORDER BY volume_id, relative_path), volume_id, relative_path, size_bytes, modified_at FROM u""",
        "finalize_files": f"SELECT DISTINCT id, volume_id, relative_path FROM files WHERE volume_id <> 29 OR ({seen}) IS NOT DISTINCT FROM TIMESTAMP '2024-05-01'",
        "delete_volume": " UNION ALL ".join(count(n, "id" if n == "volumes" else "volume_id") for n in ("volumes", "folders", "files", "scan_history", "scan_errors")),
        "update_volume": "SELECT id, CASE WHEN id = 7 THEN 'Seven' ELSE name END AS name, CASE WHEN id = 7 THEN 5 ELSE used_bytes END AS used_bytes, last_scan_at FROM volumes",
        "list_children": "SELECT id, name, relative_path, missing FROM folders WHERE parent_id = (SELECT id FROM folders WHERE volume_id = 29 AND relative_path = '')",
        "list_files": "SELECT DISTINCT id, name, relative_path FROM files WHERE folder_id = 449 AND volume_id = 29",
        "directory_listing": f"""
SELECT 0 AS position, 'folder' AS item_type, p.id AS item_id, '..' AS name, p.relative_path, 'Folder' AS type_label, '' AS extension, NULL::BIGINT AS size_bytes, p.modified_at, p.missing FROM folders c JOIN folders p ON p.id = c.parent_id WHERE c.id = 449
UNION ALL SELECT 1, 'folder', id, name, relative_path, 'Folder', '', recursive_size_bytes, modified_at, missing FROM folders WHERE parent_id = 449
UNION ALL SELECT DISTINCT 2, 'file', id, name, relative_path, {type_case('extension', 0)}, coalesce(extension, ''), size_bytes, modified_at, missing FROM files WHERE folder_id = 449""",
        "navigate_path": """WITH t AS (SELECT relative_path AS p FROM folders WHERE volume_id = 29 ORDER BY length(relative_path) DESC, id LIMIT 1)
SELECT id, name, relative_path, CASE WHEN relative_path = '' THEN 0 ELSE len(string_split(relative_path, '/')) END::INT AS level FROM folders, t
WHERE volume_id = 29 AND (relative_path = '' OR relative_path = p OR starts_with(p, relative_path || '/'))""",
        "file_properties": f"WITH {FILES} SELECT {file_columns}, o.id AS parent_folder_id, o.name AS parent_folder_name, o.relative_path AS parent_relative_path, {property_case('f.extension')} AS type FROM f JOIN volumes v ON v.id = f.volume_id LEFT JOIN folders o ON o.id = f.folder_id",
        "folder_properties": "SELECT f.id AS item_id, f.volume_id, v.name AS volume_name, f.parent_id, f.name, f.relative_path, f.recursive_size_bytes AS size_bytes, f.recursive_file_count, f.direct_file_count, o.name AS parent_folder_name, 'Folder' AS type FROM folders f JOIN volumes v ON v.id = f.volume_id LEFT JOIN folders o ON o.id = f.parent_id",
        "sizes_shown": f"SELECT DISTINCT id, {size_text('size_bytes')} AS size_text, CASE WHEN size_bytes IS NULL THEN 'Unknown' ELSE {size_text('size_bytes')} END AS shown FROM files",
        "volume_shown": f"""WITH {REGISTER} SELECT v.id, CASE WHEN capacity_bytes = 0 THEN 0 ELSE least(100, greatest(0, round_even(used_bytes / capacity_bytes * 100, 0)))::INT END AS percent_full,
  r.drive_id || coalesce(' - ' || nullif(v.name, ''), '') AS reference, format('{{:,}}', indexed_file_count) AS files, source_path || CASE WHEN trim(source_relative_path, '/') IN ('', '.') THEN '' ELSE '/' || trim(source_relative_path, '/') END AS place,
  coalesce(strftime(last_scan_at, '%Y-%m-%d %H:%M'), '-') AS last_scan,
  CASE WHEN used_bytes > free_bytes THEN '+' WHEN used_bytes < free_bytes THEN '-' ELSE '' END || {size_text('abs(used_bytes - free_bytes)')} AS delta FROM volumes v JOIN r ON r.volume_id = v.id""",
        "extension_extract": f"SELECT DISTINCT id, lower(regexp_extract(name, '(?s)^.+\\.([^.]+)$', 1)) AS ext, {property_case('extension')} AS type FROM files",
        "path_parts": """SELECT DISTINCT id, CASE WHEN relative_path = '' THEN '/' ELSE relative_path END AS shown, CASE WHEN relative_path = '' THEN NULL WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END AS parent,
  string_split(relative_path, '/')[-1] AS segment, CASE WHEN relative_path = '' THEN 0 ELSE len(string_split(relative_path, '/')) END::INT AS depth FROM folders""",
        "uint64_wrap": """WITH x AS (SELECT id, identity_inode::HUGEINT * 2 AS v FROM files)
SELECT DISTINCT id, CASE WHEN v <= 0 OR v >= 18446744073709551616 THEN NULL WHEN v < 9223372036854775808 THEN v ELSE v - 18446744073709551616 END::VARCHAR AS wrapped FROM x""",
        "timestamp_text": "SELECT DISTINCT id, strftime(modified_at, '%Y-%m-%dT%H:%M:%S.%f') || '+0000' AS stored, modified_at::DATE::VARCHAR AS day FROM files",
        "connected_checked": """
WITH k AS (SELECT identity_kind, lower(identity_token) AS token, '/mnt/' || min(id) AS mount_root FROM volumes WHERE id % 3 = 0 AND identity_token <> '' AND identity_kind <> '' GROUP BY 1, 2),
m AS (SELECT v.*, mount_root, mount_root || coalesce('/' || nullif(nullif(trim(v.source_relative_path, '/'), ''), '.'), '') AS path FROM volumes v LEFT JOIN k ON k.identity_kind = v.identity_kind AND k.token = lower(v.identity_token)),
p AS (SELECT *, CASE WHEN path IN (SELECT path FROM m WHERE id % 2 = 0) THEN path WHEN mount_root IS NULL AND id % 4 = 0 AND identity_kind <> '' AND identity_token <> '' THEN source_path END AS found FROM m)
SELECT id, CASE WHEN found IS NOT NULL THEN mount_root END AS mount_root, found AS found_path, found IS NOT NULL AS connected FROM p""",
        "item_paths": f"WITH c AS ({CONNECTED}) SELECT DISTINCT f.id, c.found_path || '/' || f.relative_path AS physical_path, coalesce(c.connected, false) AS available FROM files f LEFT JOIN c ON c.id = f.volume_id",
        "volume_table": f"""WITH {REGISTER}, c AS ({CONNECTED})
SELECT v.id, r.drive_id, coalesce(nullif(v.name, ''), '-') AS name, coalesce(nullif(v.source_path, ''), '-') AS source_path, 'Active' AS status, 'Good' AS condition, '-' AS description, 'USB' AS connector,
  CASE WHEN c.connected THEN 'Connected' ELSE 'Offline' END AS connection, CASE WHEN r.is_mirror = 1 THEN 'Yes' ELSE 'No' END AS mirror,
  CASE WHEN r.is_mirror = 1 THEN mr.drive_id || coalesce(' - ' || nullif(m.name, ''), '') ELSE '-' END AS master_drive, r.date_added::VARCHAR AS date_added, '-' AS earliest_content, '-' AS latest_content,
  '-' AS retired_date, '-' AS mirror_date, {size_text('v.capacity_bytes')} AS capacity, {size_text('v.used_bytes')} AS used, {size_text('v.free_bytes')} AS free,
  CASE WHEN v.capacity_bytes = 0 THEN 0 ELSE least(100, greatest(0, round_even(v.used_bytes / v.capacity_bytes * 100, 0)))::INT END || '%' AS full,
  format('{{:,}}', v.indexed_file_count) AS files, format('{{:,}}', v.indexed_folder_count) AS folders, coalesce(strftime(v.last_scan_at, '%Y-%m-%d %H:%M'), '-') AS last_scan
FROM volumes v JOIN r ON r.volume_id = v.id JOIN c ON c.id = v.id {master}""",
        "mount_signature": """SELECT string_agg(k || ':' || t || ':/mnt/' || id, ';' ORDER BY k, t, '/mnt/' || id) AS signature
FROM (SELECT id, lower(trim(identity_kind)) AS k, lower(trim(identity_token)) AS t FROM volumes WHERE id % 3 = 0) WHERE k <> '' AND t <> ''""",
        "backfill_register": f"""WITH {REGISTER}, h AS (SELECT max(volume_id) AS top FROM r WHERE volume_id % 3 <> 0)
SELECT volume_id, drive_id, 'Active' AS status, is_mirror FROM r WHERE volume_id % 3 <> 0
UNION ALL SELECT volume_id, format('AID-{{:03d}}', top + row_number() OVER (ORDER BY volume_id)), 'Active', 0 FROM r, h WHERE volume_id % 3 = 0""",
        "create_volumes": f"""WITH {REGISTER}, n AS (SELECT max(id) AS top FROM volumes)
SELECT id, name, source_path, identity_kind, identity_token, capacity_bytes, created_at AS made, drive_id, is_mirror, date_added::VARCHAR AS date_added FROM volumes JOIN r ON volume_id = id
UNION ALL SELECT top + k, name, path, kind, token, 0, TIMESTAMP '2024-05-01', coalesce(drive, format('AID-{{:03d}}', top + d)), 0, '2024-05-01' FROM n,
  (VALUES (1, 1, NULL, '/a', '', '', NULL), (2, NULL, 'Beta', '/b', '', '', 'SHELF-1'), (3, 2, 'Zed', '/z', 'k', 't', NULL)) AS x(k, d, name, path, kind, token, drive)""",
        "upsert_register": f"""WITH {REGISTER}, e AS (SELECT volume_id, volume_id % 8 = 0 AS given, sum((volume_id % 8 <> 0)::INT) OVER (ORDER BY volume_id) AS k FROM r WHERE volume_id % 4 = 0)
SELECT volume_id, drive_id, is_mirror, master_volume_id, 'Good' AS condition, date_added::VARCHAR AS date_added, (SELECT updated_at FROM volumes WHERE id = volume_id) AS updated_at FROM r WHERE volume_id % 4 <> 0
UNION ALL SELECT volume_id, CASE WHEN given THEN format('AID-{{:03d}}', volume_id) ELSE format('AID-{{:03d}}', (SELECT max(volume_id) FROM r)::BIGINT + k::BIGINT) END, given::INT, CASE WHEN given THEN 1 END, 'Unknown', '2020-02-02', TIMESTAMP '2024-05-01' FROM e""",
        "register_violations": f"""WITH {REGISTER}, b AS (SELECT volume_id, is_mirror, date_added, CASE WHEN volume_id = 9 THEN 9 ELSE master_volume_id END AS m,
  CASE WHEN volume_id % 10 = 1 THEN 'aid-050' WHEN volume_id % 10 = 2 THEN ' ' ELSE drive_id END AS drive FROM r WHERE volume_id <> 3),
n AS (SELECT id, CASE WHEN id < 4 THEN 'Same' ELSE name END AS name FROM volumes)
SELECT volume_id, 'content dates reversed' AS violation FROM b WHERE volume_id % 11 = 0
UNION ALL SELECT volume_id, 'retired before it was added' FROM b WHERE volume_id % 7 = 0 AND date_added > DATE '2001-01-01'
UNION ALL SELECT volume_id, 'mirrored before it was added' FROM b WHERE volume_id % 9 = 0 AND date_added > DATE '2001-01-01'
UNION ALL SELECT volume_id, 'no drive id' FROM b WHERE trim(drive) = ''
UNION ALL SELECT volume_id, 'drive id taken' FROM b WHERE lower(drive) IN (SELECT lower(drive) FROM b GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT id, 'name taken' FROM n WHERE lower(name) IN (SELECT lower(name) FROM n WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 3, 'no entry'
UNION ALL SELECT * FROM (SELECT b.volume_id, CASE WHEN b.m = b.volume_id THEN 'own master' WHEN o.volume_id IS NULL THEN 'unknown master' WHEN o.is_mirror = 1 THEN 'master is a mirror' END AS v FROM b LEFT JOIN b AS o ON o.volume_id = b.m WHERE b.is_mirror = 1) WHERE v IS NOT NULL""",
        "update_location": """SELECT id, CASE id WHEN 5 THEN '/new/place' WHEN 6 THEN '' ELSE source_path END AS source_path, CASE id WHEN 5 THEN '' WHEN 6 THEN 'uuid' ELSE identity_kind END AS identity_kind,
  CASE id WHEN 5 THEN '' WHEN 6 THEN 'q' ELSE identity_token END AS identity_token, CASE id WHEN 5 THEN 'sub' WHEN 6 THEN '' ELSE source_relative_path END AS source_relative_path,
  CASE id WHEN 7 THEN 10 ELSE capacity_bytes END AS capacity_bytes, last_scan_at, CASE WHEN id IN (5, 6, 7) THEN TIMESTAMP '2024-05-01' ELSE updated_at END AS updated_at FROM volumes""",
        "item_lookup": """SELECT DISTINCT 'file' AS found_by, id, volume_id, name, relative_path FROM files WHERE id = 1000 UNION ALL SELECT 'folder', id, volume_id, name, relative_path FROM folders WHERE id = 449
UNION ALL SELECT 'path', id, volume_id, name, relative_path FROM folders WHERE volume_id = 29 AND relative_path = (SELECT relative_path FROM folders WHERE id = 449)
UNION ALL SELECT 'root', id, volume_id, name, relative_path FROM folders WHERE volume_id = 29 AND relative_path = ''""",
        "prune_history_limit": """SELECT id, volume_id FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY id DESC) AS place FROM (SELECT id * 50 + n AS id, volume_id FROM scan_history, range(50) AS t(n))) WHERE place <= 100""",
        "suggested_ids": """SELECT id, CASE WHEN id % 3 = 0 THEN format('AID-{:03d}', id) WHEN id % 3 = 1 AND id >= 100 THEN 'AID-' || id WHEN id % 3 = 2 AND regexp_matches(trim(name), '^(?i:AID)-[0-9]{3,}$') THEN upper(trim(name)) END AS suggested FROM volumes""",
        "iso_dates": """SELECT DISTINCT id, CASE WHEN id % 6 < 2 OR (id % 6 = 2 AND month(modified_at) > 9 AND day(modified_at) > 9) THEN strftime(modified_at, '%Y-%m-%d')
  WHEN id % 6 = 3 AND month(modified_at) IN (1, 3, 5, 7, 8, 10, 12) THEN strftime(modified_at, '%Y-%m') || '-31' END AS day FROM files""",
        "parsed_times": "SELECT DISTINCT id, CASE WHEN id % 5 <> 0 THEN modified_at END AS parsed FROM files",
        "largest_items": "SELECT id, name, size_bytes FROM (SELECT DISTINCT id, name, size_bytes FROM files) ORDER BY coalesce(size_bytes, -1) DESC, id LIMIT 500",
        "volumes_in_order": f"SELECT row_number() OVER (ORDER BY {LOW.format('name')} NULLS FIRST, id)::INT AS place, id FROM volumes",
        "masters_in_order": f"WITH {REGISTER} SELECT row_number() OVER (ORDER BY lower(drive_id), {LOW.format('name')} NULLS FIRST)::INT AS place, id FROM volumes JOIN r ON volume_id = id WHERE is_mirror = 0",
        "children_in_order": f"SELECT row_number() OVER (ORDER BY {LOW.format('name')} NULLS FIRST, id)::INT AS place, id FROM folders WHERE parent_id = (SELECT id FROM folders WHERE volume_id = 29 AND relative_path = '')",
        "listing_in_order": """WITH l AS (SELECT 0 AS position, 'folder' AS item_type, p.id, '..' AS name, NULL::BIGINT AS size FROM folders c JOIN folders p ON p.id = c.parent_id WHERE c.id = 449
  UNION ALL SELECT 1, 'folder', id, name, recursive_size_bytes FROM folders WHERE parent_id = 449 UNION ALL SELECT DISTINCT 2, 'file', id, name, size_bytes FROM files WHERE folder_id = 449)
SELECT 'size_bytes' AS sorted_by, row_number() OVER (ORDER BY position, coalesce(size, -1) DESC, id)::INT AS place, item_type, id AS item_id FROM l
UNION ALL SELECT 'name', row_number() OVER (ORDER BY position, lower(coalesce(name, '')), id)::INT, item_type, id FROM l""",
        "hits_in_order": f"""SELECT row_number() OVER (ORDER BY match_rank, missing_rank, item_type DESC, {LOW.format('name')} NULLS FIRST, item_id)::INT AS place, item_type, item_id FROM ({search('Harbour')})""",
        "smallest_items": "SELECT id, name, size_bytes FROM (SELECT DISTINCT id, name, size_bytes FROM files) ORDER BY coalesce(size_bytes, -1), id LIMIT 700",
        "message_counts": r"SELECT regexp_replace(lower(regexp_replace(message, '^\s+|\s+$', '', 'g')), '\s*\(code \d+\)$', '') AS message, count(*) AS n FROM (SELECT DISTINCT * FROM scan_errors) GROUP BY 1",
    }
