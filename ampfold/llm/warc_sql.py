"""DuckDB twin of the WARC query."""

from html.entities import html5

from ampfold.llm.warc import BASE32, BLANKS, BREAKS, HIDDEN, LINE_ENDS, LINK, NUMERIC, TAGS, TITLE

CRLF = "chr(13) || chr(10)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digest(data: str) -> str:
    word = f"('0x' || substr(sha1({data}), 5 * (i // 4) + 1, 5))::BIGINT"
    pick = f"substr('{BASE32}', 1 + (({word} >> (15 - 5 * (i % 4))) & 31)::INT, 1)"
    return f"'sha1:' || array_to_string(list_transform(range(32), lambda i: {pick}), '')"


def _uuid(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"'<urn:uuid:' || regexp_replace(md5({joined}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"


def _unescaped(text: str) -> str:
    name = "split_part(p, ';', 1)"
    number = f"CASE WHEN lower({name}[2]) = 'x' THEN TRY_CAST('0x' || {name}[3:] AS BIGINT) ELSE TRY_CAST({name}[2:] AS BIGINT) END"
    valid = f"({number}) BETWEEN 1 AND 1114111 AND ({number}) NOT BETWEEN 55296 AND 57343"
    numeric = f"CASE WHEN {valid} THEN chr(CAST({number} AS INT)) ELSE chr(65533) END"
    value = f"CASE WHEN regexp_matches({name}, {_quoted(NUMERIC)}) THEN {numeric} ELSE named[{name}] END"
    resolved = (f"CASE WHEN i = 1 THEN p WHEN contains(p, ';') AND ({value}) IS NOT NULL THEN ({value}) || substr(p, length({name}) + 2) "
                f"ELSE '&' || p END")
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: {resolved}), '')"


def _tidy(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, {_quoted(BLANKS)}, ' ', 'g'), {_quoted(LINE_ENDS)}, chr(10), 'g'), ' ' || chr(10))"


def _line(name: str, value: str) -> str:
    return f"'{name}: ' || {value} || {CRLF}"


REFERENCES = ", ".join(f"{_quoted(name[:-1])}: {_quoted(value)}" for name, value in html5.items() if name.endswith(";"))

DERIVATIVES = f"""
WITH refs AS (SELECT MAP {{{REFERENCES}}} AS named),
p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, strlen(html) AS size, {_uuid("'response'", "coalesce(page_id::VARCHAR, '')", "coalesce(url, '')")} AS source,
  'HTTP/1.1 200 OK' || {CRLF} || 'Content-Type: text/html; charset=utf-8' || {CRLF} || 'Content-Length: ' || strlen(html) || {CRLF} || {CRLF} || html AS response
  FROM p),
v AS (SELECT *, regexp_replace(html, {_quoted(HIDDEN)}, '', 'g') AS shown FROM r),
s AS (SELECT *, regexp_replace(regexp_replace(shown, {_quoted(BREAKS)}, chr(10), 'g'), {_quoted(TAGS)}, '', 'g') AS stripped,
  regexp_extract(shown, {_quoted(TITLE)}, 1) AS raw_title,
  list_transform(regexp_extract_all(shown, {_quoted(LINK)}, 1), lambda h: regexp_replace(h, '^["'']|["'']$', '', 'g')) AS hrefs FROM v, refs),
t AS (SELECT *, {_tidy(_unescaped("stripped"))} AS body, replace({_tidy(_unescaped("raw_title"))}, chr(10), ' ') AS title,
  list_transform(hrefs, lambda h: trim(translate({_unescaped("h")}, chr(9) || chr(10) || chr(13), ''))) AS links,
  {_digest("response")} AS source_block_digest, {_digest("html")} AS source_payload_digest,
  ['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || size] AS source_headers,
  {_uuid("'conversion'", "source")} AS conversion_id, {_uuid("'metadata'", "source")} AS metadata_id FROM s),
m AS (SELECT page_id, url, source, source_headers, source_block_digest, source_payload_digest,
  'metadata' AS warc_type, metadata_id AS record_id, 'application/warc-fields' AS content_type,
  {_line("http-status", "'200'")}
  || array_to_string(list_transform(source_headers, lambda h: {_line("source-header", "h")}), '')
  || {_line("source-content-length", "strlen(response)")} || {_line("source-block-digest", "source_block_digest")}
  || {_line("source-payload-digest", "source_payload_digest")} || {_line("conversion", "conversion_id")}
  || CASE WHEN title = '' THEN '' ELSE {_line("title", "title")} END
  || array_to_string(list_transform(links, lambda h: {_line("outlink", "h")}), '') AS block FROM t
  UNION ALL
  SELECT page_id, url, source, source_headers, source_block_digest, source_payload_digest,
  'conversion', conversion_id, 'text/plain; charset=UTF-8', body FROM t)
SELECT page_id, warc_type, record_id, source AS refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS "date", content_type,
  strlen(block) AS content_length, {_digest("block")} AS block_digest, array_to_string(source_headers, '|') AS source_headers,
  source_block_digest, source_payload_digest, block
FROM m"""
