"""SQL counterparts of the registered queries, over the same tables.

Shared inputs are common table expressions named like the adapters that build them.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"

RAW = """raw AS (
  SELECT CAST(user_id AS VARCHAR) AS dataset_id, event_id, ts AS time,
    CASE WHEN event_id % 11 <> 0 THEN value END AS temperature,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS depth,
    30.0::DOUBLE + (event_id % 700) / 100.0::DOUBLE AS salinity,
    CASE WHEN event_id % 13 <> 0
      THEN (user_id * 37 % 1000) / 10.0::DOUBLE - 50.0::DOUBLE + (event_id % 97) / 100.0::DOUBLE END AS lat,
    CASE WHEN event_id % 17 <> 0
      THEN (user_id * 53 % 3000) / 10.0::DOUBLE - 150.0::DOUBLE + (event_id % 89) / 100.0::DOUBLE END AS lon,
    CAST(event_id % 4 AS DOUBLE) AS temperature_qc
  FROM events)"""

OBS = RAW + """,
obs AS (SELECT dataset_id, event_id AS row_idx, time, temperature, depth, salinity, lat, lon, temperature_qc FROM raw)"""

RANGES = """ranges AS (
  SELECT dataset_id, min(time) AS time_min, max(time) AS time_max, min(lat) AS lat_min, max(lat) AS lat_max,
    min(lon) AS lon_min, max(lon) AS lon_max
  FROM obs GROUP BY dataset_id)"""

_ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"
COVERAGE = OBS + f""",
{RANGES},
coverage AS (
  SELECT dataset_id, coalesce(strftime(time_min, {_ISO}), '') AS time_start,
    coalesce(strftime(time_max, {_ISO}), '') AS time_end,
    coalesce(lat_min, -90.0::DOUBLE) AS lat_min, coalesce(lat_max, 90.0::DOUBLE) AS lat_max,
    coalesce(lon_min, -180.0::DOUBLE) AS lon_min, coalesce(lon_max, 180.0::DOUBLE) AS lon_max
  FROM ranges)"""


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _number(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"{value}::DOUBLE"


def _bounds(min_time=None, max_time=None, min_lat=None, max_lat=None, min_lon=None, max_lon=None) -> str:
    """Request columns of one fixed set of bounds."""
    return ", ".join([
        f"{_text(min_time)} AS min_time", f"{_text(max_time)} AS max_time",
        f"{_number(min_lat)} AS min_lat", f"{_number(max_lat)} AS max_lat",
        f"{_number(min_lon)} AS min_lon", f"{_number(max_lon)} AS max_lon",
    ])


def _padded(column: str, clock: str) -> str:
    return (
        f"CASE WHEN regexp_matches({column}, '^[0-9]') AND NOT contains({column}, 'T') "
        f"THEN {column} || '{clock}' ELSE {column} END"
    )


def _instant(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '^[0-9]') THEN try_cast({column} AS TIMESTAMP) END"


def _resolved(source: str, name: str = "resolved") -> str:
    """The table-server rules over rows that hold coverage and request columns."""
    return f"""filled_{name} AS (
  SELECT *, coalesce(nullif(min_time, ''), time_start) AS low, coalesce(nullif(max_time, ''), time_end) AS high,
    coalesce(min_lat, lat_min) AS lat_a, coalesce(max_lat, lat_max) AS lat_b,
    coalesce(min_lon, lon_min) AS lon_a, coalesce(max_lon, lon_max) AS lon_b
  FROM {source}),
padded_{name} AS (
  SELECT *, {_padded('low', 'T00:00:00Z')} AS first, {_padded('high', 'T23:59:59Z')} AS last FROM filled_{name}),
flagged_{name} AS (
  SELECT *, coalesce({_instant('first')} > {_instant('last')}, false) AS time_reset FROM padded_{name}),
{name} AS (
  SELECT * EXCLUDE (low, high, first, last, lat_a, lat_b, lon_a, lon_b),
    CASE WHEN time_reset THEN time_start ELSE first END AS from_time,
    CASE WHEN time_reset THEN time_end ELSE last END AS to_time,
    CASE WHEN lat_a > lat_b THEN lat_b ELSE lat_a END AS from_lat,
    CASE WHEN lat_a > lat_b THEN lat_a ELSE lat_b END AS to_lat,
    CASE WHEN lon_a > lon_b THEN lon_b ELSE lon_a END AS from_lon,
    CASE WHEN lon_a > lon_b THEN lon_a ELSE lon_b END AS to_lon
  FROM flagged_{name})"""


def _inside(obs: str, resolved: str) -> str:
    return f"""inside AS (
  SELECT o.* FROM {obs} o JOIN {resolved} r USING (dataset_id)
  WHERE (r.from_time = '' OR o.time >= CAST(r.from_time AS TIMESTAMP))
    AND (r.to_time = '' OR o.time <= CAST(r.to_time AS TIMESTAMP))
    AND o.lat BETWEEN r.from_lat AND r.to_lat AND o.lon BETWEEN r.from_lon AND r.to_lon)"""


WINDOW = _bounds("2024-01-03", "2024-01-27", 40.0, -45.0, None, 120.0)
INSIDE = f"""{COVERAGE},
asked AS (SELECT coverage.*, {WINDOW} FROM coverage),
{_resolved('asked')},
{_inside('obs', 'resolved')}"""


def _thinned(source: str, step: int, key: str = "dataset_id", order: str = "row_idx") -> str:
    return (
        f"(SELECT * EXCLUDE (pos) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS pos "
        f"FROM {source}) WHERE pos % {step} = 0)"
    )


def _oracle(name: str, body: str, *parts: str) -> None:
    ORACLE[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


# --- sources, row numbers, export -------------------------------------------------------

_oracle("row_index_dense", """SELECT dataset_id, time, event_id, temperature,
  row_number() OVER (PARTITION BY dataset_id ORDER BY time, event_id) - 1 AS row_idx FROM raw""", RAW)
_oracle("position_in_blocks", """SELECT dataset_id, row_idx,
  row_number() OVER (PARTITION BY dataset_id ORDER BY row_idx) - 1 AS position FROM obs""", OBS)
_NULL_KEYS = """holed AS (SELECT CASE WHEN row_idx % 7 <> 0 THEN dataset_id END AS dataset_id,
    CASE WHEN row_idx % 11 <> 0 THEN row_idx END AS row_idx, row_idx AS event_id FROM obs)"""
_oracle("thin_null_keys", f"SELECT * FROM {_thinned('(SELECT * FROM holed WHERE row_idx IS NOT NULL)', 3)}", OBS, _NULL_KEYS)
_oracle("position_null_order", """SELECT dataset_id, row_idx,
  row_number() OVER (PARTITION BY dataset_id ORDER BY row_idx NULLS FIRST) - 1 AS position FROM holed""", OBS, _NULL_KEYS)
_oracle("read_back", """SELECT format, dataset_id, row_idx, time, lat, temperature FROM obs,
  unnest(['csv', 'csv0', 'csvp', 'tsv', 'tsv0', 'tsvp', 'json', 'jsonlKVP', 'parquet', 'orc']) f(format)""", OBS)
_oracle("subset_export", "SELECT dataset_id, time, lat, lon, temperature FROM inside", INSIDE)
_oracle("subset_distinct", "SELECT DISTINCT dataset_id, depth, temperature_qc FROM inside", INSIDE)
_oracle("subset_unconstrained", """SELECT o.* FROM obs o JOIN ranges r USING (dataset_id)
  WHERE o.lat BETWEEN r.lat_min AND r.lat_max AND o.lon BETWEEN r.lon_min AND r.lon_max""", OBS, RANGES)

_oracle("thin_stored", f"SELECT dataset_id, row_idx, temperature FROM {_thinned('(SELECT * FROM obs WHERE temperature IS NOT NULL AND lat IS NOT NULL)', 5)}", OBS)
_oracle("thin_all_stored", f"SELECT dataset_id, row_idx FROM {_thinned('obs', 4)}", OBS)
_oracle("stored_datasets", """SELECT dataset_id, row_idx, temperature FROM obs
  WHERE dataset_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0)""", OBS)
_NAMED = "named AS (SELECT *, CAST(dataset_id AS INTEGER) % 5 AS kind FROM obs)"
_oracle("mixed_timeseries", f"""SELECT dataset_id, row_idx, time AS x, temperature AS y
  FROM {_thinned('(SELECT * FROM named WHERE kind < 3 AND temperature IS NOT NULL AND time IS NOT NULL)', 3)}""", OBS, _NAMED)
_oracle("mixed_unresolved", """SELECT DISTINCT dataset_id, wanted, CASE
    WHEN kind = 3 OR wanted = 'salt' THEN 'no column matches ' || wanted ELSE 'several columns are named temperature' END AS reason
  FROM named, (VALUES ('temp'), ('salt')) w(wanted)
  WHERE kind >= 3 OR (wanted = 'salt' AND kind = 2)""", OBS, _NAMED)

# --- catalog trees (used above by the address queries too) ------------------------------

_URL = "'https://files.example.org/'"
TREE = f"""segments AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer),
catalogs AS (
  SELECT {_URL} || 'catalog.xml' AS catalog_url, 'root' AS catalog_name
  UNION ALL SELECT {_URL} || 'r/' || r_regionkey || '/catalog.xml', r_name FROM region
  UNION ALL SELECT {_URL} || 'n/' || n_nationkey || '/catalog.xml', n_name FROM nation
  UNION ALL SELECT {_URL} || 'n/' || c_nationkey || '/' || c_mktsegment || '/catalog.xml', c_mktsegment FROM segments
  UNION ALL SELECT {_URL} || 'c/' || c_custkey || '/catalog.xml', c_name FROM customer),
edges AS (
  SELECT {_URL} || 'catalog.xml' AS parent_url, r_name AS ref_name,
    {_URL} || 'r/' || r_regionkey || '/catalog.xml' AS child_url, CAST(r_regionkey AS INTEGER) AS pos FROM region
  UNION ALL SELECT {_URL} || 'r/' || n_regionkey || '/catalog.xml', n_name,
    {_URL} || 'n/' || n_nationkey || '/catalog.xml', CAST(n_nationkey AS INTEGER) FROM nation
  UNION ALL SELECT {_URL} || 'n/' || n_nationkey || '/catalog.xml', 'archive',
    {_URL} || 'gone/' || n_nationkey || '/catalog.xml', 0 FROM nation WHERE n_nationkey % 4 = 0
  UNION ALL SELECT {_URL} || 'n/' || c_nationkey || '/catalog.xml', c_mktsegment,
    {_URL} || 'n/' || c_nationkey || '/' || c_mktsegment || '/catalog.xml', 1 FROM segments
  UNION ALL SELECT {_URL} || 'n/' || c_nationkey || '/' || c_mktsegment || '/catalog.xml', c_name,
    {_URL} || 'c/' || c_custkey || '/catalog.xml', CAST(c_custkey AS INTEGER) FROM customer),
leaves AS (
  SELECT {_URL} || 'n/' || s_nationkey || '/catalog.xml' AS catalog_url, s_name AS name,
    CAST(NULL AS VARCHAR) AS http, s_name AS dap, CAST(NULL AS VARCHAR) AS wms, CAST(s_suppkey AS INTEGER) AS pos FROM supplier
  UNION ALL SELECT {_URL} || 'c/' || o_custkey || '/catalog.xml', 'Order-' || o_orderkey || '.nc',
    CASE WHEN o_orderkey % 5 IN (2, 3, 4) THEN {_URL} || 'fileServer/' || o_orderkey END,
    CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN {_URL} || 'dodsC/' || o_orderkey END,
    CASE WHEN o_orderkey % 5 = 0 THEN {_URL} || 'fileServer/' || o_orderkey END,
    CAST(o_orderkey AS INTEGER) FROM orders)"""


def _walk(depth: int) -> str:
    return f"""walk AS (
  SELECT catalog_url, CAST([] AS VARCHAR[]) AS path, 0 AS depth, true AS reachable
  FROM catalogs WHERE catalog_url = {_URL} || 'catalog.xml'
  UNION ALL
  SELECT e.child_url, list_append(w.path, e.ref_name), w.depth + 1,
    e.child_url IN (SELECT catalog_url FROM catalogs)
  FROM walk w JOIN edges e ON e.parent_url = w.catalog_url WHERE w.reachable AND w.depth < {depth}),
tree_index AS (
  SELECT l.name, l.catalog_url, w.path, w.depth, l.pos,
    CASE WHEN len(w.path) = 0 THEN '(root)' ELSE array_to_string(w.path, ' > ') END AS path_text
  FROM walk w JOIN leaves l USING (catalog_url) WHERE w.reachable)"""


_INDEXED = "SELECT name, catalog_url, path_text AS path, depth FROM tree_index"
_oracle("catalog_index", _INDEXED, TREE, _walk(8))
_oracle("catalog_index_shallow", _INDEXED, TREE, _walk(2))
_oracle("catalog_broken_references", "SELECT count(*) AS skipped FROM walk WHERE NOT reachable", TREE, _walk(8))
_oracle("catalog_doubled", "SELECT catalog_url, array_to_string(path, ' > ') AS path, depth, reachable FROM walk", TREE, _walk(8))
_oracle("catalog_find", """SELECT name, catalog_url, path_text, count(*) OVER () AS total,
  greatest(count(*) OVER () - 30, 0) AS more FROM tree_index WHERE contains(lower(name), 'order-11')
  ORDER BY depth, path_text, pos, name LIMIT 30""", TREE, _walk(8))
_oracle("catalog_browse", f"""SELECT 'sub_catalog' AS kind, pos, ref_name AS name, child_url AS target_url FROM edges
  WHERE parent_url = {_URL} || 'n/3/catalog.xml'
  UNION ALL SELECT 'dataset', pos, name, catalog_url FROM leaves WHERE catalog_url = {_URL} || 'n/3/catalog.xml'""", TREE)


def _decided(names: str, key: str, column: str, asked: str) -> str:
    return f"""decided AS (
  SELECT {key}, count(*) AS n_matches, bool_or({column} = '{asked}') AS exact, min({column}) AS only,
    count(DISTINCT {column}) AS n_names
  FROM {names} WHERE contains(lower({column}), lower('{asked}')) GROUP BY {key})"""


_CHOICE = """CASE WHEN d.n_names IS NULL THEN '{none}' WHEN d.exact OR d.n_names = 1 THEN 'ok' ELSE 'ambiguous' END AS status,
  CASE WHEN d.exact THEN '{asked}' WHEN d.n_names = 1 THEN d.only END AS chosen, coalesce(d.n_matches, 0) AS n_matches"""
_oracle("catalog_descend", f"""SELECT c.catalog_url AS parent_url, {_CHOICE.format(none='not_found', asked='NATION_1')}
  FROM catalogs c LEFT JOIN decided d ON d.parent_url = c.catalog_url""", TREE,
        _decided("edges", "parent_url", "ref_name", "NATION_1"))
_oracle("catalog_leaf_named", f"""SELECT c.catalog_url,
  CASE WHEN c.catalog_url NOT IN (SELECT catalog_url FROM leaves) THEN 'no_datasets'
    WHEN d.n_names IS NULL THEN 'not_found' WHEN d.exact OR d.n_names = 1 THEN 'ok' ELSE 'ambiguous' END AS status,
  CASE WHEN d.exact THEN 'order-7' WHEN d.n_names = 1 THEN d.only END AS chosen, coalesce(d.n_matches, 0) AS n_matches
  FROM catalogs c LEFT JOIN decided d USING (catalog_url)""", TREE, _decided("leaves", "catalog_url", "name", "order-7"))
_oracle("catalog_leaf_single", """SELECT c.catalog_url,
  CASE WHEN count(l.name) = 0 THEN 'no_datasets' WHEN count(DISTINCT l.name) = 1 THEN 'ok' ELSE 'ambiguous' END AS status,
  CASE WHEN count(DISTINCT l.name) = 1 THEN min(l.name) END AS chosen, count(l.name) AS n_matches
  FROM catalogs c LEFT JOIN leaves l USING (catalog_url) GROUP BY c.catalog_url""", TREE)
_CHOICES = """SELECT c.catalog_url, c.status, 'dataset' AS kind, l.name FROM decided c JOIN meant l USING (catalog_url)
    WHERE c.status = 'ambiguous'
  UNION ALL SELECT c.catalog_url, c.status, 'sub_catalog', e.ref_name FROM decided c JOIN edges e ON e.parent_url = c.catalog_url
    WHERE c.status = 'no_datasets'"""
_oracle("catalog_choices", _CHOICES, TREE, "meant AS (SELECT * FROM leaves)", """decided AS (
  SELECT c.catalog_url, CASE WHEN count(l.name) = 0 THEN 'no_datasets' WHEN count(DISTINCT l.name) > 1 THEN 'ambiguous' END AS status
  FROM catalogs c LEFT JOIN leaves l USING (catalog_url) GROUP BY c.catalog_url)""")
_oracle("catalog_choices_named", _CHOICES, TREE, "meant AS (SELECT * FROM leaves WHERE contains(lower(name), 'order-7'))", """decided AS (
  SELECT c.catalog_url, CASE WHEN count(l.name) = 0 THEN 'no_datasets'
    WHEN count(DISTINCT m.name) > 1 AND count(*) FILTER (l.name = 'order-7') = 0 THEN 'ambiguous' END AS status
  FROM catalogs c LEFT JOIN leaves l USING (catalog_url) LEFT JOIN meant m ON m.catalog_url = l.catalog_url AND m.name = l.name
  GROUP BY c.catalog_url)""")
_SERVICES = """services AS (
  SELECT DISTINCT catalog_url, unnest(['HTTPServer', 'OpenDAP', 'WMS']) AS service, unnest([http, dap, wms]) AS url FROM leaves)"""
_oracle("catalog_services", "SELECT DISTINCT catalog_url, service FROM services WHERE url IS NOT NULL", TREE, _SERVICES)
_oracle("catalog_levels", """SELECT c.catalog_url, c.catalog_name,
  (SELECT count(*) FROM edges e WHERE e.parent_url = c.catalog_url) AS n_sub_catalogs,
  (SELECT count(*) FROM leaves l WHERE l.catalog_url = c.catalog_url) AS n_datasets,
  (SELECT count(DISTINCT service) FROM services s WHERE s.catalog_url = c.catalog_url AND url IS NOT NULL) AS n_services
  FROM catalogs c""", TREE, _SERVICES)
_oracle("download_address", """SELECT catalog_url, name,
  CASE WHEN http IS NOT NULL THEN 'HTTPServer' WHEN dap IS NOT NULL THEN 'OpenDAP' END AS service,
  coalesce(http, dap) AS url,
  CASE WHEN coalesce(http, dap) IS NULL THEN 'no file service; available: WMS' END AS error FROM leaves""", TREE)
_oracle("service_address", """SELECT catalog_url, name, dap AS url,
  CASE WHEN dap IS NULL THEN 'OpenDAP is not offered; available: ' ||
    CASE WHEN http IS NOT NULL THEN 'HTTPServer' ELSE 'WMS' END END AS error FROM leaves""", TREE)

# --- projection, schema, flattening -----------------------------------------------------

_oracle("cleaned_headers", "SELECT dataset_id, row_idx, time, lat, lon, temperature FROM obs", OBS)

NESTED = """profiles AS (
  SELECT CAST(label AS VARCHAR) AS dataset_id, 't' || vec_id AS trajectory, CAST(p.p AS INTEGER) AS profile,
    TIMESTAMP '2024-01-01' + to_hours(CAST(p.p AS INTEGER)) + to_minutes(CAST(vec_id AS INTEGER)) AS time,
    -40.0::DOUBLE + vec_id % 80 + p.p * 0.25::DOUBLE AS lat,
    CASE WHEN vec_id % 9 <> 0 THEN -100.0::DOUBLE + vec_id % 50 - p.p * 0.5::DOUBLE END AS lon, embedding
  FROM embeddings, range(8) p(p)),
measured AS (
  SELECT p.* EXCLUDE (embedding), CAST(i.i AS INTEGER) AS obs_no, i.i * 10.0::DOUBLE AS depth,
    CAST(embedding[p.profile * 8 + 1 + i.i] AS DOUBLE) AS temperature, 30.0::DOUBLE + i.i / 10.0::DOUBLE AS salinity
  FROM profiles p, range(8) i(i))"""
_oracle("flatten_observations", """SELECT dataset_id, trajectory, profile, obs_no, time, lat, lon, depth, temperature
  FROM measured""", NESTED)
_oracle("flatten_profiles", "SELECT trajectory, profile, time, lat, lon FROM profiles", NESTED)
_oracle("flatten_in_bounds", """SELECT trajectory, profile, obs_no, time, depth, salinity FROM measured
  WHERE time BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 12:00:00'
    AND lat BETWEEN -20 AND 30 AND lon <= -60""", NESTED)
_oracle("flatten_stored", ORACLE["flatten_in_bounds"])
_oracle("flatten_bare_end_date", """SELECT * FROM (SELECT trajectory, profile,
    time + to_days(CAST((length(trajectory) + ascii(right(trajectory, 1))) % 5 AS INTEGER)) AS time, lat FROM profiles)
  WHERE time <= TIMESTAMP '2024-01-03 00:00:00'""", NESTED)
_oracle("flatten_nan_bounds", """SELECT trajectory, profile, obs_no, lat, CASE WHEN obs_no % 4 <> 2 THEN temperature END AS temperature
  FROM measured WHERE lat >= 0 AND profile % 3 <> 1""", NESTED)
_oracle("mixed_trajectories", """SELECT CAST(label AS VARCHAR) AS dataset_id FROM embeddings
  GROUP BY label HAVING count(*) > 1""")
_oracle("nested_timeseries", f"""SELECT trajectory AS dataset_id, profile * 2147483648 + obs_no AS row_idx, time AS x, temperature AS y
  FROM {_thinned("(SELECT * FROM measured WHERE lat >= -20)", 7, "trajectory", "profile, obs_no")}""", NESTED)

_oracle("nested_profile", f"""SELECT trajectory AS dataset_id, profile * 2147483648 + obs_no AS row_idx, temperature AS x, depth AS y,
  salinity AS color FROM {_thinned("(SELECT * FROM measured WHERE lon <= -70)", 3, "trajectory", "profile, obs_no")}""", NESTED)
_oracle("nested_custom", f"""SELECT trajectory AS dataset_id, profile * 2147483648 + obs_no AS row_idx, salinity AS x, temperature AS y
  FROM {_thinned("measured", 5, "trajectory", "profile, obs_no")}""", NESTED)
_oracle("nested_map", f"""SELECT trajectory AS dataset_id, CAST(profile AS BIGINT) AS row_idx, lat, lon,
  '(' || CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR) || ')' AS hover
  FROM {_thinned("(SELECT * FROM profiles WHERE time >= TIMESTAMP '2024-01-01 02:00:00')", 3, "trajectory", "profile")}
  WHERE lat IS NOT NULL AND lon IS NOT NULL""", NESTED)

ATTRIBUTES = """cells AS (
  SELECT CAST(p_partkey AS VARCHAR) AS dataset_id, 'attribute' AS row_type, unnest([
    {'v': 'NC_GLOBAL', 'a': 'time_coverage_start', 'x': CASE WHEN p_partkey % 4 = 0 THEN '2024-01-0' || (p_partkey % 9 + 1)
      WHEN p_partkey % 4 <> 3 THEN '2024-01-0' || (p_partkey % 9 + 1) || 'T06:00:00Z' END},
    {'v': 'NC_GLOBAL', 'a': 'time_coverage_end', 'x': CASE WHEN p_partkey % 9 <> 0 THEN '2024-01-2' || (p_partkey % 9) END},
    {'v': 'NC_GLOBAL', 'a': 'geospatial_lat_min', 'x': CASE WHEN p_partkey % 7 = 0 THEN 'unknown'
      WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 90 - 45 AS VARCHAR) END},
    {'v': 'NC_GLOBAL', 'a': 'geospatial_lat_max', 'x': CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 90 - 40) || '.5' END},
    {'v': 'NC_GLOBAL', 'a': 'geospatial_lon_min', 'x': CAST(p_partkey % 300 - 150 AS VARCHAR)},
    {'v': 'NC_GLOBAL', 'a': 'geospatial_lon_max', 'x': CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 300 - 130 AS VARCHAR) END},
    {'v': 'NC_GLOBAL', 'a': 'contributor_name', 'x': CASE WHEN p_partkey % 6 <> 0 THEN p_name END},
    {'v': 'NC_GLOBAL', 'a': 'creator_name', 'x': CASE WHEN p_partkey % 12 <> 0 THEN p_brand END},
    {'v': 'NC_GLOBAL', 'a': 'institution', 'x': 'Institute of ' || p_type || ' and ' || p_brand || ' studies, building ' || p_partkey},
    {'v': 'NC_GLOBAL', 'a': 'platform', 'x': CASE WHEN p_partkey % 2 = 0 THEN 'glider' END},
    {'v': 'NC_GLOBAL', 'a': 'license', 'x': CASE WHEN p_partkey % 3 <> 0 THEN 'CC-BY' END},
    {'v': 'NC_GLOBAL', 'a': 'cdm_data_type', 'x': CASE WHEN p_partkey % 10 = 0 THEN 'Grid' WHEN p_partkey % 10 = 1 THEN 'grid'
      WHEN p_partkey % 10 < 8 THEN 'TrajectoryProfile' END},
    {'v': 'temperature', 'a': 'standard_name', 'x': 'sea_water_temperature'},
    {'v': 'temperature', 'a': 'long_name', 'x': p_name},
    {'v': 'temperature', 'a': 'units', 'x': CASE WHEN p_partkey % 8 = 0 THEN '' WHEN p_partkey % 9 <> 0 THEN 'Celsius' END},
    {'v': 'temperature', 'a': 'ioos_category', 'x': 'Temperature'},
    {'v': 'temperature', 'a': 'valid_min', 'x': '-2'},
    {'v': 'salinity', 'a': 'standard_name', 'x': 'sea_water_practical_salinity'},
    {'v': 'salinity', 'a': 'units', 'x': '1'},
    {'v': 'temperature_qc', 'a': 'long_name', 'x': 'quality of ' || p_name},
    {'v': 'extra_' || (p_partkey % 13) || '_Flag', 'a': 'units', 'x': '1'},
    {'v': 'depth', 'a': 'units', 'x': 'm'}]) AS c
  FROM part),
attrs AS (SELECT dataset_id, row_type, c.v AS variable_name, c.a AS attribute_name, c.x AS value FROM cells WHERE c.x IS NOT NULL)"""


def _global(name: str) -> str:
    return f"max(value) FILTER (variable_name = 'NC_GLOBAL' AND attribute_name = '{name}')"


def _variables(*fields: str) -> str:
    picked = ", ".join(f"max(value) FILTER (attribute_name = '{f}') AS {f}" for f in fields)
    return f"""variables AS (SELECT dataset_id, variable_name, {picked} FROM attrs
  WHERE variable_name <> 'NC_GLOBAL' GROUP BY dataset_id, variable_name)"""


_FIELDS = ("standard_name", "long_name", "units", "ioos_category")
_oracle("variable_dictionary", "SELECT * FROM variables", ATTRIBUTES, _variables(*_FIELDS))
_oracle("variables_matching", """SELECT * FROM variables
  WHERE NOT (contains(lower(variable_name), 'qc') OR contains(lower(variable_name), 'qartod') OR lower(variable_name) LIKE '%flag')
    AND contains(lower(concat_ws(' ', variable_name, standard_name, long_name, units, ioos_category)), 'temperature red')""",
        ATTRIBUTES, _variables(*_FIELDS))
_oracle("variable_lines", """SELECT dataset_id, variable_name, '- `' || variable_name || '`' ||
  CASE WHEN detail = '' THEN '' ELSE ' (' || detail || ')' END AS line
  FROM (SELECT *, concat_ws(', ', 'standard_name: ' || standard_name, 'long_name: ' || long_name, 'units: ' || units) AS detail FROM variables)""",
        ATTRIBUTES, _variables(*_FIELDS[:3]))
_oracle("unknown_variables", """SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS dataset_id,
  'extra_' || (l_linenumber * 2) || '_Flag' AS variable_name FROM lineitem
  EXCEPT SELECT dataset_id, variable_name FROM variables""", ATTRIBUTES, _variables(*_FIELDS))

# --- constraints ------------------------------------------------------------------------

REQUESTS = """requests AS (
  SELECT o_orderkey AS request_id, CAST(o_custkey % 150 AS VARCHAR) AS dataset_id,
    CASE o_orderkey % 6 WHEN 1 THEN '' WHEN 2 THEN '2024-01-1' || (o_orderkey % 10)
      WHEN 3 THEN '2024-01-2' || (o_orderkey % 10) || 'T01:02:03Z' WHEN 4 THEN 'now-' || (o_orderkey % 20 + 1) || 'days'
      WHEN 5 THEN '2024-02-0' || (o_orderkey % 9 + 1) END AS min_time,
    CASE o_orderkey % 7 WHEN 1 THEN '2024-01-2' || (o_orderkey % 10) WHEN 2 THEN '2024-01-0' || (o_orderkey % 9 + 1) || 'T00:00:00Z'
      WHEN 3 THEN 'now' WHEN 4 THEN 'soon' END AS max_time,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 180 - 90 AS DOUBLE) END AS min_lat,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 7 % 180 - 90 AS DOUBLE) END AS max_lat,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 360 - 180 AS DOUBLE) END AS min_lon,
    CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey * 11 % 360 - 180 AS DOUBLE) END AS max_lon
  FROM orders)"""
_RESOLVED = "from_time, to_time, from_lat, to_lat, from_lon, to_lon, time_reset"
_oracle("resolved_requests", f"SELECT request_id, dataset_id, {_RESOLVED} FROM resolved", COVERAGE, REQUESTS,
        "asked AS (SELECT * FROM requests JOIN coverage USING (dataset_id))", _resolved("asked"))


def _declared(axis: str, default: float) -> str:
    return f"coalesce(try_cast({_global('geospatial_' + axis)} AS DOUBLE), {default}::DOUBLE) AS {axis}"


_WARN = ", ".join(
    f"CASE WHEN {_global(a)} IS NOT NULL AND try_cast({_global(a)} AS DOUBLE) IS NULL THEN '{a}' END"
    for a in ("geospatial_lat_min", "geospatial_lat_max", "geospatial_lon_min", "geospatial_lon_max")
)
DECLARED = f"""declared AS (
  SELECT dataset_id, coalesce({_global('time_coverage_start')}, '') AS time_start,
    coalesce({_global('time_coverage_end')}, '') AS time_end, {_declared('lat_min', -90.0)}, {_declared('lat_max', 90.0)},
    {_declared('lon_min', -180.0)}, {_declared('lon_max', 180.0)}, concat_ws(', ', {_WARN}) AS warnings
  FROM attrs GROUP BY dataset_id)"""
_oracle("described_bounds", """SELECT *, CASE WHEN time_start <> '' THEN time_start || ' to ' || time_end
  ELSE 'not specified in metadata' END AS time_range FROM declared""", ATTRIBUTES, DECLARED)
_oracle("resolved_declared", f"SELECT dataset_id, {_RESOLVED}, warnings FROM resolved", ATTRIBUTES, DECLARED,
        f"asked AS (SELECT declared.*, {_bounds('2024-01-15', None, 20.0, None, None, -10.0)} FROM declared)", _resolved("asked"))


def _moment(column: str) -> str:
    return f"""CASE WHEN {column} = 'now' THEN {AS_OF}
    WHEN starts_with({column}, 'now-') THEN {AS_OF} - to_days(CAST(regexp_extract({column}, '[0-9]+') AS INTEGER))
    ELSE try_cast({column} AS TIMESTAMP) END"""


_oracle("bounds_as_times", f"""SELECT request_id, {_moment('low')} AS from_time, {_moment('high')} AS to_time FROM (
  SELECT request_id, {_padded('min_time', 'T00:00:00Z')} AS low, {_padded('max_time', 'T23:59:59Z')} AS high FROM requests)""", REQUESTS)
TYPED = f"""typed AS (
  SELECT *, CASE WHEN from_time <> '' THEN {_moment('from_time')} END AS f, CASE WHEN to_time <> '' THEN {_moment('to_time')} END AS t
  FROM resolved)"""
_oracle("rows_for_requests", """SELECT request_id, o.dataset_id, o.row_idx, o.time, o.temperature
  FROM obs o JOIN typed r USING (dataset_id)
  WHERE (r.from_time = '' OR o.time >= f) AND (r.to_time = '' OR o.time <= t)
    AND o.lat BETWEEN r.from_lat AND r.to_lat AND o.lon BETWEEN r.from_lon AND r.to_lon""", COVERAGE, REQUESTS,
        "asked AS (SELECT * FROM requests JOIN coverage USING (dataset_id))", _resolved("asked"), TYPED)
_oracle("coverage_view", "SELECT * FROM coverage", COVERAGE.replace(
    "temperature_qc FROM raw)", "temperature_qc FROM raw WHERE CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN event_id % 3 = 0 "
    "WHEN 3 THEN lat > 0 OR lat IS NULL ELSE true END)"))
_oracle("requests_without_coverage", f"""SELECT request_id, dataset_id, CASE WHEN known THEN 'ok' ELSE 'no_coverage' END AS status,
    {', '.join(f'CASE WHEN known THEN {c} END AS {c}' for c in ('from_time', 'to_time', 'from_lat', 'to_lat', 'from_lon', 'to_lon'))}
  FROM resolved""", COVERAGE, REQUESTS, """
asked AS (SELECT * FROM requests LEFT JOIN (
    SELECT *, true AS known FROM coverage WHERE CAST(dataset_id AS INTEGER) % 3 <> 1) USING (dataset_id))""", _resolved("asked"))
_oracle("bounds_null_keys", """SELECT o.dataset_id, o.row_idx, o.time, o.lat, o.lon
  FROM holed o JOIN resolved r ON o.dataset_id IS NOT DISTINCT FROM r.dataset_id
  WHERE (r.from_time = '' OR o.time >= CAST(r.from_time AS TIMESTAMP)) AND (r.to_time = '' OR o.time <= CAST(r.to_time AS TIMESTAMP))
    AND o.lat BETWEEN r.from_lat AND r.to_lat AND o.lon BETWEEN r.from_lon AND r.to_lon""", f"""{RAW},
holed AS (SELECT CASE WHEN event_id % 3 <> 0 THEN dataset_id END AS dataset_id, event_id AS row_idx, time, lat, lon FROM raw),
{RANGES.replace('FROM obs', 'FROM holed')},
{COVERAGE[COVERAGE.index('coverage AS ('):]},
asked AS (SELECT coverage.*, {WINDOW} FROM coverage)""", _resolved("asked"))
_RELATIVE_DAYS = "to_days(CAST(regexp_extract({0}, '[0-9]+') AS INTEGER))"


def _whole(column: str, clock: str) -> str:
    """A bound with its clock; a relative one as the instant it means."""
    return f"""CASE WHEN {column} = 'now' THEN strftime({AS_OF}, {_ISO})
    WHEN starts_with({column}, 'now-') THEN strftime({AS_OF} - {_RELATIVE_DAYS.format(column)}, {_ISO})
    WHEN contains({column}, 'T') OR NOT regexp_matches({column}, '^[0-9]') THEN {column} ELSE {column} || '{clock}' END"""


_oracle("clamped_requests", """SELECT request_id, dataset_id,
  CASE WHEN inv OR coalesce(f < CAST(time_start AS TIMESTAMP), false) THEN time_start ELSE first END AS from_time,
  CASE WHEN inv OR coalesce(l > CAST(time_end AS TIMESTAMP), false) THEN time_end ELSE last END AS to_time,
  greatest(least(la, lb), lat_min) AS from_lat, least(greatest(la, lb), lat_max) AS to_lat,
  greatest(least(oa, ob), lon_min) AS from_lon, least(greatest(oa, ob), lon_max) AS to_lon, inv AS time_reset
  FROM (SELECT *, coalesce(f > l, false) AS inv FROM (
    SELECT *, try_cast(first AS TIMESTAMP) AS f, try_cast(last AS TIMESTAMP) AS l FROM full_bounds))""",
        COVERAGE, REQUESTS, f"""
merged AS (SELECT *, coalesce(nullif(min_time, ''), time_start) AS low, coalesce(nullif(max_time, ''), time_end) AS high,
    coalesce(min_lat, lat_min) AS la, coalesce(max_lat, lat_max) AS lb, coalesce(min_lon, lon_min) AS oa, coalesce(max_lon, lon_max) AS ob
  FROM requests JOIN coverage USING (dataset_id)),
full_bounds AS (SELECT *, {_whole('low', 'T00:00:00Z')} AS first, {_whole('high', 'T23:59:59Z')} AS last FROM merged)""")
_oracle("skipped_requests", """SELECT dataset_id, concat_ws('; ', CASE WHEN max_time = 'soon' THEN 'to_time soon cannot be read' END,
    CASE WHEN known IS NULL THEN 'the dataset has no coverage' END) AS reason
  FROM requests LEFT JOIN (SELECT dataset_id, true AS known FROM coverage) USING (dataset_id)
  WHERE max_time = 'soon' OR known IS NULL""", COVERAGE, REQUESTS)
_oracle("incomplete_boxes", """SELECT request_id, concat_ws(', ', CASE WHEN min_lat IS NULL THEN 'min_lat' END,
  CASE WHEN max_lat IS NULL THEN 'max_lat' END, CASE WHEN min_lon IS NULL THEN 'min_lon' END,
  CASE WHEN max_lon IS NULL THEN 'max_lon' END) AS missing FROM requests
  WHERE min_lat IS NULL OR max_lat IS NULL OR min_lon IS NULL OR max_lon IS NULL""", REQUESTS)
_oracle("drop_missing_any", """SELECT dataset_id, row_idx, temperature, lat, lon FROM obs
  WHERE temperature IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL""", OBS)
_oracle("drop_missing_all", """SELECT dataset_id, row_idx, temperature, lat, lon FROM obs
  WHERE temperature IS NOT NULL OR lat IS NOT NULL OR lon IS NOT NULL""", OBS)

# --- discovery --------------------------------------------------------------------------

INDEX = OBS + f""",
{RANGES},
documents_indexed AS (
  SELECT CASE WHEN doc_id % 500 = 499 THEN 'allDatasets' ELSE CAST(doc_id AS VARCHAR) END AS dataset_id,
    source || ' ' || lang || ' record ' || doc_id AS title, doc_id % 997 * 10000000000 + doc_id AS rank, text AS summary,
    CASE WHEN doc_id % 17 <> 0 THEN '_' || source || '_' || lang || '_lab ' ELSE ' ' END AS institution,
    lang AS ioos_category,
    CASE WHEN doc_id % 5 = 0 THEN 'Grid' WHEN doc_id % 5 < 3 THEN 'TrajectoryProfile' WHEN doc_id % 5 = 3 THEN 'TimeSeries' END AS cdm_data_type,
    list_filter(['depth', CASE WHEN doc_id % 2 = 0 THEN 'sea_water_temperature' END,
      CASE WHEN doc_id % 3 = 0 THEN 'sea_water_practical_salinity' END, CASE WHEN doc_id % 5 = 0 THEN 'temperature_status_flag' END,
      CASE WHEN doc_id % 7 = 0 THEN 'salinity_QARTOD_check' END], lambda x: x IS NOT NULL) AS standard_names,
    list_filter(['time', CASE WHEN doc_id % 2 = 0 THEN 'temperature' END, CASE WHEN doc_id % 3 = 0 THEN 'salinity' END,
      CASE WHEN doc_id % 4 = 0 THEN 'temperature_qc' END], lambda x: x IS NOT NULL) AS variable_names,
    list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS keywords,
    CASE WHEN doc_id % 4 = 0 THEN 'x' END AS griddap, CASE WHEN doc_id % 3 = 0 THEN 'x' END AS tabledap,
    CASE WHEN doc_id % 101 = 7 THEN '' END AS wms
  FROM documents),
idx AS (
  SELECT d.*, r.* EXCLUDE (dataset_id),
    lower(concat_ws(' ', dataset_id, title, summary, institution, ioos_category, cdm_data_type)) AS words,
    concat_ws(' ', array_to_string(keywords, ' '), array_to_string(standard_names, ' '), array_to_string(variable_names, ' ')) AS listed
  FROM documents_indexed d LEFT JOIN ranges r USING (dataset_id))"""


def _has(term: str) -> str:
    """A term without spaces cannot span two searched fields, so either text may hold it."""
    return f"(contains(words, '{term}') OR contains(lower(listed), '{term}'))"


_oracle("search_keywords", f"""SELECT dataset_id, title, rank FROM idx
  WHERE {_has('the')} AND contains(words, 'src1 en') AND NOT {_has('ound')}""", INDEX)
_oracle("search_facets", """SELECT dataset_id, title, rank FROM idx WHERE list_contains(variable_names, 'temperature')
  AND ioos_category = 'en' AND list_contains(standard_names, 'sea_water_practical_salinity')
  AND cdm_data_type = 'TrajectoryProfile'""", INDEX)
_oracle("search_two_variables", f"SELECT dataset_id, title FROM idx WHERE {_has('temperature_qc')} AND {_has('salinity')}", INDEX)
_REGION_TEST = """time_max >= TIMESTAMP '2024-01-05' AND time_min <= TIMESTAMP '2024-01-25'
  AND lat_max >= -30 AND lat_min <= 35 AND lon_max >= -120 AND lon_min <= 100"""
_oracle("search_regions", f"""SELECT request_id AS region_id, idx.dataset_id, rank FROM idx, requests
  WHERE (coalesce(min_time, '') = '' OR time_max >= {_moment('min_time')})
    AND (coalesce(max_time, '') = '' OR time_min <= {_moment('max_time')})
    AND (min_lat IS NULL OR lat_max >= min_lat) AND (max_lat IS NULL OR lat_min <= max_lat)
    AND (min_lon IS NULL OR lon_max >= min_lon) AND (max_lon IS NULL OR lon_min <= max_lon)""", INDEX, REQUESTS)
_oracle("search_region", f"SELECT dataset_id, rank FROM idx WHERE {_REGION_TEST}", INDEX)
_oracle("search_many", """SELECT query_id, idx.dataset_id, rank FROM (
    SELECT query_id, CASE k WHEN 0 THEN [w1 || ' ' || w2] WHEN 1 THEN [w1, w2] WHEN 2 THEN [w1] WHEN 3 THEN [w1[1:2]]
        WHEN 4 THEN [w1[1:1], w2] WHEN 5 THEN [] ELSE ['record', CAST(query_id AS VARCHAR)] END AS wanted,
      CASE k WHEN 2 THEN w3 WHEN 5 THEN w1 END AS unwanted
    FROM (SELECT doc_id AS query_id, doc_id % 7 AS k, coalesce(ws[1], 'of') AS w1, coalesce(ws[2], 'of') AS w2, coalesce(ws[3], 'of') AS w3
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS ws FROM documents))) q,
    (SELECT dataset_id, rank, words || ' ' || lower(concat_ws(' ', array_to_string(standard_names, ' '), array_to_string(variable_names, ' '))) AS searched FROM idx) idx
  WHERE len(list_filter(wanted, lambda w: NOT contains(searched, w))) = 0 AND (unwanted IS NULL OR NOT contains(searched, unwanted))""", INDEX)
_oracle("leaves_many", """SELECT c_custkey AS query_id, name, catalog_url FROM leaves, customer
  WHERE contains(lower(name), lower(CASE WHEN c_custkey % 3 = 0 THEN 'ORDER-1' ELSE '' END || c_custkey))""", TREE)
_oracle("search_unique", f"""SELECT institution, ioos_category, min(rank) AS rank FROM idx WHERE {_has('record')}
  GROUP BY institution, ioos_category""", INDEX)
_oracle("search_preview", f"""SELECT dataset_id, title, rank, count(*) OVER () AS total, greatest(count(*) OVER () - 30, 0) AS more
  FROM (SELECT dataset_id, title, min(rank) AS rank FROM idx WHERE {_has('the')} GROUP BY dataset_id, title)
  ORDER BY rank, dataset_id, title LIMIT 30""", INDEX)
_oracle("search_page", f"SELECT dataset_id, rank FROM idx WHERE {_has('of')} ORDER BY rank LIMIT 1000000", INDEX)
_oracle("search_any", f"""SELECT dataset_id, query_no, rank, title FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY query_no, rank, title) AS n FROM (
    SELECT *, CASE WHEN {_has('src3')} THEN 0 WHEN {_has('src4')} AND NOT {_has('ist')} THEN 1 WHEN {_has('und')} THEN 2 END AS query_no FROM idx)
  WHERE query_no IS NOT NULL AND list_contains(standard_names, 'sea_water_temperature')
    AND regexp_matches(title, '(?i)SRC[34] (en|de)')) WHERE n = 1""", INDEX)
_oracle("facet_institutions", """SELECT DISTINCT institution AS value FROM idx
  WHERE institution IS NOT NULL AND contains(lower(institution), 'src1')""", INDEX)
_oracle("facet_standard_names", """SELECT DISTINCT value FROM (SELECT unnest(standard_names) AS value FROM idx)
  WHERE NOT (contains(lower(value), 'qc') OR contains(lower(value), 'qartod') OR lower(value) LIKE '%flag')""", INDEX)
_oracle("facet_keywords", "SELECT DISTINCT unnest(keywords) AS value FROM idx", INDEX)
_oracle("facet_listed", """SELECT value, row_number() OVER (ORDER BY value) - 1 AS place
  FROM (SELECT DISTINCT unnest(keywords) AS value FROM idx)""", INDEX)
_oracle("facet_checks", """SELECT a.facet, a.value, k.value IS NOT NULL AS valid FROM (
    SELECT 'institution' AS facet, '_' || source || '_' || lang || '_lab ' AS value FROM documents
    UNION SELECT 'ioos_category', upper(lang) FROM documents
    UNION SELECT 'keywords', unnest(regexp_split_to_array(text, '\\s+')) FROM documents) a
  LEFT JOIN (SELECT 'institution' AS facet, institution AS value FROM idx UNION SELECT 'ioos_category', ioos_category FROM idx
    UNION SELECT 'keywords', unnest(keywords) FROM idx) k ON k.facet = a.facet AND k.value = a.value""", INDEX)


def _title(column: str) -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower(replace(trim({column}, '_ '), '_', ' ')), "
        f"'[{cased}]+|[^{cased}]+'), lambda w: (CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END) || w[2:]), '')"
    )


_oracle("server_summary", f"""SELECT 'dataset_count' AS section, CAST(count(DISTINCT dataset_id) AS VARCHAR) AS value FROM live
  UNION ALL SELECT DISTINCT 'protocol', p FROM (SELECT unnest([CASE WHEN griddap IS NOT NULL THEN 'griddap' END,
    CASE WHEN tabledap IS NOT NULL THEN 'tabledap' END, CASE WHEN wms IS NOT NULL THEN 'wms' END]) AS p FROM live) WHERE p IS NOT NULL
  UNION ALL SELECT DISTINCT 'institution', {_title('institution')} FROM live WHERE trim(institution) <> ''
  UNION ALL SELECT DISTINCT 'keyword', {_title('k')} FROM (SELECT unnest(keywords) AS k FROM live)
    WHERE trim(k) <> '' AND NOT (contains(lower(k), 'qc') OR contains(lower(k), 'qartod'))""",
        INDEX, "live AS (SELECT * FROM idx WHERE dataset_id <> 'allDatasets')")
_oracle("protocol_flags", """SELECT bool_or(griddap IS NOT NULL) AS griddap, bool_or(tabledap IS NOT NULL) AS tabledap,
  bool_or(wms IS NOT NULL) AS wms FROM idx WHERE dataset_id <> 'allDatasets'""", INDEX)


def _labels(author: str) -> str:
    others = ", ".join(f"coalesce({_global(n)}, 'N/A') AS {n}" for n in ("institution", "platform", "license", "project"))
    return f"labels AS (SELECT dataset_id, coalesce({author}, 'N/A') AS author, {others} FROM attrs GROUP BY dataset_id)"


_TABLE_LABELS = _labels(_global("contributor_name"))
_BOX = """boxes AS (SELECT dataset_id, substring(author, 1, 35) AS author, substring(institution, 1, 35) AS institution,
  platform, license FROM labels)"""
_oracle("label_records", "SELECT * FROM labels", ATTRIBUTES, _TABLE_LABELS)
_oracle("label_records_file", "SELECT * FROM labels", ATTRIBUTES,
        _labels(f"{_global('contributor_name')}, {_global('creator_name')}"))
_oracle("info_boxes", "SELECT * FROM boxes", ATTRIBUTES, _TABLE_LABELS, _BOX)
_oracle("units_joined", """SELECT l.*, u.units, CASE WHEN u.units <> '' THEN l.variable_name || ' (' || u.units || ')'
    ELSE l.variable_name END AS label FROM (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS dataset_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'temperature' ELSE 'depth' END AS variable_name FROM lineitem) l
  LEFT JOIN variables u USING (dataset_id, variable_name)""", ATTRIBUTES, _variables("units"))
_oracle("grids_rejected", f"""SELECT *, coalesce(cdm_data_type, '') <> 'Grid' AS supported,
  CASE WHEN cdm_data_type = 'Grid' THEN 'gridded data cannot be read as trajectories' END AS error
  FROM (SELECT dataset_id, {_global('cdm_data_type')} AS cdm_data_type FROM attrs GROUP BY dataset_id)""", ATTRIBUTES)
_oracle("attribute_numbers", """SELECT dataset_id, variable_name, attribute_name, value, try_cast(value AS DOUBLE) AS number,
  contains(lower(variable_name), 'qc') OR contains(lower(variable_name), 'qartod') OR lower(variable_name) LIKE '%flag' AS qc_variable,
  contains(lower(value), 'qc') OR contains(lower(value), 'qartod') AS qc_keyword FROM attrs""", ATTRIBUTES)

def _digest(source: str, key: str, table: str, *content: str) -> str:
    texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in content)
    return f"SELECT '{source}' AS source, CAST({key} AS VARCHAR) AS key, md5(concat_ws('|', {texts})) AS digest FROM {table}"


_LISTED = [f"array_to_string(list_sort({n}), ',')" for n in ("standard_names", "variable_names", "keywords")]
_MILLIONTHS = [f"CAST(round({n} * 1000000) AS BIGINT)" for n in ("lat_min", "lat_max", "lon_min", "lon_max")]
_oracle("read_tables", " UNION ALL ".join([
    _digest("attributes", "dataset_id", "attrs", "row_type", "variable_name", "attribute_name", "value"),
    _digest("index", "dataset_id", "idx", "title", "rank", "summary", "institution", "ioos_category", "cdm_data_type", *_LISTED,
            *[f"{n} IS NULL" for n in ("griddap", "tabledap", "wms")], "epoch_us(time_min)", "epoch_us(time_max)", *_MILLIONTHS),
    _digest("catalogs", "catalog_url", "catalogs", "catalog_name"),
    _digest("edges", "child_url", "edges", "parent_url", "ref_name", "pos"),
    _digest("leaves", "name", "leaves", "catalog_url", "http", "dap", "wms", "pos"),
]), INDEX, ATTRIBUTES, TREE)
_oracle("read_nested", ORACLE["flatten_profiles"])
_oracle("declared_subset", "SELECT dataset_id, row_idx, time, lat, lon, temperature FROM inside", OBS, ATTRIBUTES, DECLARED,
        f"asked AS (SELECT declared.*, {_bounds(None, '2024-01-15', -50.0)} FROM declared)", _resolved("asked"), _inside("obs", "resolved"))
_oracle("declared_dataset", "SELECT dataset_id, row_idx, lat FROM inside WHERE dataset_id = '4'", OBS, ATTRIBUTES, DECLARED,
        f"asked AS (SELECT declared.*, {_bounds(None, None, -90.0, 90.0, -180.0, 180.0)} FROM declared)", _resolved("asked"),
        _inside("obs", "resolved"))

# --- coverage, thinning, views ----------------------------------------------------------

_oracle("observed_coverage", "SELECT * FROM coverage", COVERAGE)
_oracle("coverage_with_nan", f"""SELECT dataset_id, coalesce(strftime(min(time), {_ISO}), '') AS time_start,
    coalesce(strftime(max(time), {_ISO}), '') AS time_end,
    coalesce(min(lat) FILTER (row_idx % 5 <> 0), -90.0::DOUBLE) AS lat_min, coalesce(max(lat) FILTER (row_idx % 5 <> 0), 90.0::DOUBLE) AS lat_max,
    coalesce(min(lon) FILTER (row_idx % 6 <> 1), -180.0::DOUBLE) AS lon_min, coalesce(max(lon) FILTER (row_idx % 6 <> 1), 180.0::DOUBLE) AS lon_max
  FROM obs GROUP BY dataset_id""", OBS)
_oracle("dataset_profiles", """SELECT dataset_id, count(*) AS total_rows, count(*) FILTER (ok) AS valid_rows,
  min(time) FILTER (ok) AS time_min, max(time) FILTER (ok) AS time_max, min(lat) FILTER (ok) AS lat_min, max(lat) FILTER (ok) AS lat_max,
  min(lon) FILTER (ok) AS lon_min, max(lon) FILTER (ok) AS lon_max
  FROM (SELECT *, temperature IS NOT NULL OR salinity IS NOT NULL OR temperature_qc IS NOT NULL AS ok FROM obs) GROUP BY dataset_id""", OBS)
_oracle("thin_every_fifth", f"SELECT dataset_id, row_idx, temperature FROM {_thinned('obs', 5)}", OBS)
_oracle("thin_then_drop", f"""SELECT dataset_id, row_idx, lat, lon FROM {_thinned('obs', 25)}
  WHERE lat IS NOT NULL AND lon IS NOT NULL""", OBS)
_oracle("drop_then_thin", f"""SELECT dataset_id, row_idx, lat AS x, lon AS y
  FROM {_thinned('(SELECT * FROM obs WHERE lat IS NOT NULL AND lon IS NOT NULL)', 25)}""", OBS)

# --- plot jobs --------------------------------------------------------------------------


def _scatter(x: str, y: str, step: int, color: str | None = None) -> str:
    shade = f", {color} AS color" if color else ""
    complete = f"(SELECT dataset_id, row_idx, {x} AS x, {y} AS y{shade} FROM inside WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"SELECT * FROM {_thinned(complete, step)}"


_EXTENT = "SELECT dataset_id, min(x) AS x_min, max(x) AS x_max, count(*) AS n_points FROM ({points}) GROUP BY dataset_id"
_oracle("timeseries_points", _scatter("time", "temperature", 5, "salinity"), INSIDE)
_oracle("timeseries_summary", f"""SELECT e.*, 'temperature vs time' AS title, b.* EXCLUDE (dataset_id), false AS invert_y
  FROM ({_EXTENT.format(points=_scatter('time', 'temperature', 5))}) e LEFT JOIN boxes b USING (dataset_id)""",
        INSIDE, ATTRIBUTES, _TABLE_LABELS, _BOX)
_oracle("profile_points", _scatter("temperature", "depth", 3, "salinity"), INSIDE)
_oracle("profile_summary", f"""SELECT *, 'temperature profile' AS title, true AS invert_y
  FROM ({_EXTENT.format(points=_scatter('temperature', 'depth', 1))})""", INSIDE)
_oracle("custom_points", _scatter("salinity", "temperature", 1, "depth"), INSIDE)
_TRACK = f"""track AS (SELECT dataset_id, row_idx, lat, lon, temperature AS color FROM {_thinned('inside', 4)}
  WHERE lat IS NOT NULL AND lon IS NOT NULL)"""
_oracle("trajectory_points", """SELECT dataset_id, row_idx, lat, lon, color, label AS color_label,
  '(' || CAST(round_even(lat * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS VARCHAR) || ', ' || CAST(round_even(lon * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS VARCHAR)
    || ')<br>' || label || ': ' || coalesce(CAST(round_even(color * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS VARCHAR), 'nan') AS hover
  FROM (SELECT t.*, CASE WHEN v.units <> '' THEN 'temperature (' || v.units || ')' ELSE 'temperature' END AS label
    FROM track t LEFT JOIN (SELECT * FROM variables WHERE variable_name = 'temperature') v USING (dataset_id))""",
        INSIDE, _TRACK, ATTRIBUTES, _variables("units"))
_oracle("trajectory_summary", """SELECT dataset_id, round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon,
  count(*) AS n_points, 5 AS zoom, 'Flight path: ' || dataset_id AS title FROM track GROUP BY dataset_id""", INSIDE, _TRACK)


def _region(cap: int, step: int, test: str = _REGION_TEST, times=("2024-01-05", "2024-01-25")) -> tuple[str, ...]:
    bounds = _bounds(*times, -30.0, 35.0, -120.0, 100.0)
    return (INDEX, COVERAGE.split(RANGES + ",")[1].strip(), f"""found AS (
  SELECT dataset_id, min(rank) AS rank FROM idx WHERE {test} GROUP BY dataset_id),
capped AS (SELECT *, row_number() OVER (ORDER BY rank) - 1 AS slot_order FROM found ORDER BY rank LIMIT {cap}),
asked AS (SELECT coverage.*, {bounds} FROM coverage JOIN capped USING (dataset_id)),
{_resolved('asked')},
{_inside('obs', 'resolved')},
loaded AS (SELECT dataset_id, count(*) AS n_rows FROM inside GROUP BY dataset_id),
tracks AS (
  SELECT c.*, l.n_rows, CASE WHEN n_rows IS NOT NULL THEN
    CAST((count(n_rows) OVER (ORDER BY slot_order) - 1) % 10 AS INTEGER) END AS slot
  FROM capped c LEFT JOIN loaded l USING (dataset_id)),
region_pts AS (SELECT i.dataset_id, i.row_idx, i.lat, i.lon, t.slot FROM {_thinned('inside', step)} i JOIN tracks t USING (dataset_id)
  WHERE i.lat IS NOT NULL AND i.lon IS NOT NULL)""")


def _view(points: str) -> str:
    return f"""SELECT center_lat, center_lon, n_points, n_drawn, round(span, 6) AS span,
  round(least(greatest(log2(360.0::DOUBLE / span) - 1, 1.0::DOUBLE), 12.0::DOUBLE), 6) AS zoom FROM (
  SELECT round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon, count(*) AS n_points, count(DISTINCT dataset_id) AS n_drawn,
    greatest(max(lat) - min(lat), (max(lon) - min(lon)) * 0.7::DOUBLE, 0.01::DOUBLE) AS span FROM {points})"""


for _name, _cap, _step in (("region", 10, 25), ("region_all", 1_000_000, 2)):
    _oracle(f"{_name}_points", "SELECT * FROM region_pts", *_region(_cap, _step))
    _oracle(f"{_name}_summary", f"""SELECT v.*, (SELECT count(*) FROM found) AS total_found, (SELECT count(slot) FROM tracks) AS plotted,
  (SELECT count(*) - count(slot) FROM tracks) AS skipped, (SELECT count(*) FROM found) > {_cap} AS capped,
  CASE WHEN (SELECT count(slot) FROM tracks) = 0 THEN 'none of the datasets could be plotted'
    WHEN n_points = 0 THEN 'no dataset has a position to plot' END AS error FROM ({_view('region_pts')}) v""", *_region(_cap, _step))
_oracle("region_searched", "SELECT * FROM region_pts", *_region(
    50, 3, f"""time_max >= TIMESTAMP '2024-01-05 12:00:00' AND time_min <= TIMESTAMP '2024-01-19 12:00:00'
  AND lat_max >= -30 AND lat_min <= 35 AND lon_max >= -120 AND lon_min <= 100 AND {_has('record')} AND {_has('src1')}""",
    ("2024-01-05T12:00:00Z", "2024-01-19T12:00:00Z")))
_oracle("region_tracks", "SELECT dataset_id, rank, slot_order, n_rows, slot FROM tracks", *_region(10, 25))
_oracle("pooled_view", _view(f"(SELECT * FROM {_thinned('obs', 25)} WHERE lat IS NOT NULL AND lon IS NOT NULL)"), OBS)
_oracle("colored_depth", f"""SELECT dataset_id, row_idx, time AS x, depth AS y, temperature AS color
  FROM {_thinned('(SELECT * FROM obs WHERE temperature IS NOT NULL)', 2)}""", OBS)
_COLORED = """SELECT dataset_id, row_idx, time, lat, lon, temperature, depth,
  'Time: ' || strftime(time, '%-H:%M<br>%-d-%b') || '<br>Temp:' || CAST(round_even(temperature * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS VARCHAR)
    || '°C       Depth:' || CAST(round_even(depth * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS VARCHAR) || '(m)' AS hover
  FROM """
_oracle("colored_track", _COLORED + _thinned("(SELECT * FROM obs WHERE temperature IS NOT NULL)", 3), OBS)

_oracle("clamped_track", _COLORED + _thinned("(SELECT * FROM clamped WHERE temperature IS NOT NULL)", 2),
        COVERAGE, """clamped AS (SELECT o.* FROM obs o JOIN coverage c USING (dataset_id)
  WHERE o.time BETWEEN greatest(TIMESTAMP '2024-01-03', CAST(time_start AS TIMESTAMP)) AND least(TIMESTAMP '2024-01-27 23:59:59', CAST(time_end AS TIMESTAMP))
    AND o.lat BETWEEN greatest(-45, lat_min) AND least(40, lat_max)
    AND o.lon BETWEEN greatest(least(lon_min, 120), lon_min) AND least(greatest(lon_min, 120), lon_max))""")

# --- scalar functions -------------------------------------------------------------------

ADDRESSES = r"""addresses AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '/(en|fr|de|es)/', '/ERDDAP/tabledap/')
    WHEN 1 THEN regexp_extract(url, '^[^?#]*') || '/index.html/' WHEN 2 THEN regexp_extract(url, '^[^?#]*') || '/catalog.html?x=1'
    ELSE url END AS url FROM pages),
plain AS (SELECT page_id, url, split_part(split_part(url, '?', 1), '#', 1) AS p FROM addresses)"""
_oracle("table_server_addresses", r"""SELECT page_id, url, CASE WHEN regexp_matches(p, '(?i)https?://[^/]+/erddap')
    THEN regexp_extract(p, '(?i)(https?://[^/]+/erddap)', 1)
    ELSE regexp_replace(rtrim(p, '/'), '/index\.html$', '') END AS base FROM plain""", ADDRESSES)
_oracle("catalog_addresses", r"""SELECT page_id, url, CASE WHEN t LIKE '%catalog.html' THEN regexp_replace(t, 'html$', 'xml')
    WHEN t LIKE '%.xml' OR t LIKE '%.html' THEN t ELSE t || '/catalog.xml' END AS catalog
  FROM (SELECT page_id, url, rtrim(p, '/') AS t FROM plain)""", ADDRESSES)
_oracle("clean_titles", f"""SELECT doc_id, {_title("('_ ' || source || '_' || text || '_3d o''NEIL u.s. ')")} AS title FROM documents""")
_oracle("listed_counts", r"""SELECT page_id, try_cast(replace(regexp_extract(h, 'View a List of All ([\d,]+) Datasets', 1), ',', '') AS BIGINT) AS n_datasets
  FROM (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN html || 'View a List of All ' || format('{:,}', page_id * 37) || ' Datasets' ELSE html END AS h FROM pages)""")
_oracle("hover_texts", """SELECT row_idx, '(' || coalesce(CAST(round_even(lat / 7.0::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS VARCHAR), 'nan') || ', ' ||
  coalesce(CAST(round_even(lon / 70000.0::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS VARCHAR), 'nan') || ')<br>' ||
  strftime(time, '%Y-%m-%d %H:%M:%S') || CASE WHEN strftime(time, '%f') = '000000' THEN '' ELSE '.' || strftime(time, '%f') END || '+00:00<br>t (C): ' ||
  coalesce(CAST(round_even(temperature * 3333333.3::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS VARCHAR), 'nan') AS hover FROM obs""", OBS)

# --- chat logs --------------------------------------------------------------------------


def _spoken(words: str) -> str:
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"regexp_matches(lower(text), '(^|{edge})({words})($|{edge})')"


TURNS = f"""marked AS (
  SELECT conv_id, turn, {_spoken('the|und|que')} AS t, {_spoken('of|ist|des')} AS f FROM conversations WHERE role = 'user'),
named AS (
  SELECT conv_id, turn, concat_ws(',', CASE WHEN f THEN 'file' END, CASE WHEN t THEN 'table' END) AS mentioned,
    CASE WHEN t AND NOT f THEN 'table' WHEN f AND NOT t THEN 'file' END AS single FROM marked)"""
_oracle("platform_mentions", "SELECT conv_id, turn, mentioned FROM named", TURNS)
_oracle("routed_turns", """SELECT conv_id, turn, mentioned, active_before,
  CASE WHEN active_before IS NOT NULL AND mentioned IN ('', active_before) THEN 'stay'
    WHEN single IS NOT NULL THEN 'switch' ELSE 'model' END AS decision, coalesce(single, active_before) AS active_after
  FROM (SELECT *, last_value(single IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active_before FROM named)""", TURNS)
_oracle("last_user_texts", """SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS text
  FROM conversations GROUP BY conv_id""")
_oracle("registry_latest", """SELECT conv_id, role, turn, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1""")
_oracle("registry_kept", ORACLE["registry_latest"])
_oracle("registry_null_sequence", """SELECT conv_id, role, turn, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC NULLS LAST) AS n FROM (
    SELECT conv_id, role, CASE WHEN turn > 1 AND conv_id % 2 = 0 THEN turn END AS turn, min(text) AS text
    FROM conversations GROUP BY ALL)) WHERE n = 1""")
_oracle("artifacts_appended", """SELECT conv_id, turn, text FROM conversations
  UNION ALL SELECT doc_id, length(text), text FROM documents""")
