"""Parameters and input expressions of the registered queries.

The `*_SQL` texts are input adapters over the given tables and read the same
in Spark SQL and in DuckDB.
"""

from __future__ import annotations

# Parameters of the queries.
SKIP_PATTERNS = ("*.md", "*/.cache/*", "*doc_1?.c")
NAME_PATTERNS = ("doc_*1*.c", "*[!0-9].gz")
TYPES = " c, .md,,txt"
SIZE_LIMIT = 2048
ADMIT_MAX = 4096
ADMIT_NAME = "*doc_*[0-68].*"
CAP_PER_BUNDLE = 20
CAP_TOTAL = 300
SMALL_BUDGET = 32 * 1024
HMAC_KEY = b"bindery example key"

# Limit of each row: its own size, or one byte less for every other row.
BOUNDARY_BYTES = "size - seq % 2"

# Hidden names and folders, six extension shapes.
PATH_SQL = """concat(source, '/', lang,
  case when doc_id % 29 = 0 then '/.cache' else '' end, '/',
  case when doc_id % 13 = 0 then '.' else '' end, 'doc_', doc_id,
  case doc_id % 6 when 0 then '.c' when 1 then '.h' when 2 then '.txt'
    when 3 then '.md' when 4 then '.tar.gz' else '' end)"""

# Blank runs, CRLF, control bytes, fence lines, and both kinds of last line.
RAW_SQL = """case doc_id % 7
  when 0 then replace(text, '. ', concat('.', repeat(chr(10), 3), ' ', repeat(chr(10), 2)))
  when 1 then replace(text, chr(10), concat(chr(13), chr(10)))
  when 2 then concat(repeat(chr(1), 600), text)
  when 3 then concat(repeat(chr(1), 100), text)
  when 4 then concat(text, chr(10), repeat(chr(39), 3), chr(10), 'tail')
  when 5 then text
  else concat(text, chr(10)) end"""

TYPES_TEXT_SQL = """concat(' ', lang, ', .', source, ',,', lang,
  case when doc_id % 2 = 0 then ',txt , .txt' else ',' end)"""

# A text that ends in a letter of two bytes.
LETTER_ENDED_SQL = "concat(coalesce(text, ''), chr(233))"

# One glob a label; those of good documents match no file.
LABEL_GLOB_SQL = """concat('*d', case when quality = 0 or toxic = 1 then 'o' else 'a' end,
  'c_', doc_id, '.*')"""

# Globs that begin alike, that have no literal text, and that match nothing.
MIXED_GLOB_SQL = """case when doc_id % 97 = 0 then concat(repeat('?', 9 + cast(doc_id % 7 as int)), '[0-3].?')
  when quality = 0 or toxic = 1 then concat('*/doc_', doc_id, '.*')
  when doc_id % 3 = 0 then concat('*doc_', doc_id, '[a-c]?')
  else concat('*/.cache/*', doc_id, '[!a]md') end"""

# Unique order values, far apart.
SPARSE_SQL = "seq * 48271 % 2147483647 * 5000"

NO_PATH_SQL = "doc_id % 5 = 1"
NO_CONTENT_SQL = "doc_id % 7 = 3"

ODD_PATH_SQL = """case doc_id % 8
  when 0 then concat(source, chr(10), doc_id)
  when 1 then concat(' ', source, '/', doc_id)
  when 2 then concat(source, ' --- [SIGNATURE:', doc_id, ']')
  when 3 then concat(source, ' --- ', doc_id)
  when 4 then concat(source, '/', doc_id, chr(9))
  when 5 then concat('PUBLIC_KEY --- [KEY:', doc_id)
  when 6 then null
  else concat(source, '/', doc_id) end"""

HEADER_TEXT_SQL = """case doc_id % 6
  when 0 then concat(source, '/', doc_id, ' ---')
  when 1 then concat(source, '/', doc_id, ' --- [SIGNATURE:', lang, '==]')
  when 2 then concat(source, ' --- ', lang, ' --- [SIGNATURE:a] --- [SIGNATURE:b]')
  when 3 then concat(source, '/', doc_id, ' --- [SIGNATURE:', lang)
  when 4 then concat(' ', source, ' --- ', doc_id, ' --- ', chr(13))
  else concat(source, '/', doc_id) end"""

KEY_TEXT_SQL = """case seq % 3
  when 0 then concat(repeat('QUJD', 10), 'QUI=')
  when 1 then concat(repeat('QUJD', 10), 'QUJD')
  else concat('not base64 ', bundle, '!') end"""

REPO_TEXT_SQL = """case page_id % 6
  when 0 then url
  when 1 then concat(url, '.git.git')
  when 2 then concat('git@host.example:owner/', page_id, '/repo', page_id, '.git')
  when 3 then concat('ssh://git@host.example/owner/repo', page_id, '.git')
  when 4 then concat('git://host.example/repo', page_id, '/')
  else concat('/srv/git/repo', page_id) end"""

HEADER_PATH_SQL = """case doc_id % 8
  when 0 then concat('/', source, '/', doc_id)
  when 1 then concat(source, '/../', doc_id)
  when 2 then concat('../', source)
  when 3 then concat(source, '/..')
  when 4 then repeat(' ', cast(doc_id % 3 as int))
  when 5 then concat(source, '/..', doc_id)
  else concat(source, '/', lang, '/', doc_id, '.txt') end"""

# Odd ways to write a path, by the identifier.
EXTRACT_PATH_SQL = (
    "case doc_id % 8 when 0 then concat('d', doc_id) when 1 then concat('d', doc_id - 1, '/x') "
    "when 2 then concat('../', doc_id) when 3 then concat('e', doc_id, '/') "
    "when 4 then concat('f//', doc_id) when 5 then concat('f/./', doc_id - 1) "
    "when 6 then '.' else concat('g', doc_id) end"
)
