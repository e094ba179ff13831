"""Common table expressions of the equivalent SQL: the tables as they stand."""

HASH = "replace(regexp_replace(lower({}), '\\s+', '', 'g'), 'blake3:', '')"
_US = "coalesce(-epoch_us(TRY_CAST({} AS TIMESTAMPTZ)), 4611686018427387904)"
_WS = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"

FILES = f"""f AS (SELECT * REPLACE ({HASH.format('hash')} AS hash) FROM files WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_US.format('last_seen')}, hash NULLS FIRST, scan_status NULLS FIRST) = 1)"""
RECORDS = f"""c AS (SELECT * REPLACE ({HASH.format('source_hash')} AS source_hash) FROM concepts WHERE source_hash IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {HASH.format('source_hash')} ORDER BY {_US.format('written_at')}, {_US.format('generated_at')}, concept_id NULLS FIRST, title NULLS FIRST, description NULLS FIRST, tags NULLS FIRST, entities NULLS FIRST) = 1)"""
LIVE = f"{RECORDS}, l AS (SELECT * FROM c WHERE concept_id IS NOT NULL AND coalesce(status, 'stable') <> 'deprecated')"
TAGS = f"""t AS (SELECT concept_id, tag FROM (SELECT concept_id, lower({_WS.format('x')}) AS tag FROM
  (SELECT concept_id, unnest(CAST(json_extract_string(tags, '$[*]') AS VARCHAR[])) AS x FROM l WHERE tags IS NOT NULL)) WHERE tag <> '')"""
MENTIONS = f"""m AS (SELECT *, kind || ':' || replace(lower(name), 'ß', 'ss') AS key FROM (SELECT concept_id, {_WS.format("e ->> 'name'")} AS name, lower(e ->> 'kind') AS kind FROM
  (SELECT concept_id, unnest(CAST(json_extract(entities, '$[*]') AS JSON[])) AS e FROM l WHERE entities IS NOT NULL)) WHERE name <> '' AND kind IS NOT NULL)"""
TERMS = "w AS (SELECT DISTINCT concept_id, 'tag:' || tag AS term, 1.0 AS weight FROM t UNION SELECT DISTINCT concept_id, 'entity:' || key, 1.5 FROM m)"
CHUNKS = """k AS (SELECT chunk_id, concept_id, source_hash, source, concept_type, sensitivity, title, heading_path, chunk_index, text, tokens, model FROM chunks
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY concept_id, source_hash, source NULLS FIRST, concept_type, sensitivity, title, heading_path NULLS FIRST, chunk_index, text, tokens, model) = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
