"""The registered queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import hashlib

from bindery.config import ROW_SHARD_BYTES
from bindery.functions import globs
from bindery.functions.frames import FRAME_OVERHEAD
from bindery.functions.integrity import HMAC_BLOCK, INNER_PAD, OUTER_PAD
from bindery.functions.text import BLANK_CLASS, HEAD_BYTES
from bindery.plans.corpus import (
    ADMIT_MAX, ADMIT_NAME, BOUNDARY_BYTES, CAP_PER_BUNDLE, CAP_TOTAL, LETTER_ENDED_SQL, MIXED_GLOB_SQL,
    NO_CONTENT_SQL, NO_PATH_SQL, ODD_PATH_SQL, SPARSE_SQL, HEADER_PATH_SQL, HEADER_TEXT_SQL, HMAC_KEY, KEY_TEXT_SQL, NAME_PATTERNS, PATH_SQL, RAW_SQL,
    REPO_TEXT_SQL, SIZE_LIMIT, SKIP_PATTERNS, SMALL_BUDGET, TYPES_TEXT_SQL,
)

LF = "chr(10)"
QUOTES = "repeat(chr(39), 3)"
FENCE_LINE = f"{LF} || {QUOTES} || {LF}"
PREFIX = f"{QUOTES} || '--- '"
MARKER = "'[Binary file - contents omitted]'"

FILES = f"""files as (
  select *, string_split(path, '/')[-1] as base_name,
    regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\\.[^.]*)$', 1) as ext,
    strlen(raw)::bigint as size
  from (select doc_id as seq, source as bundle, {PATH_SQL} as path, {RAW_SQL} as raw
        from documents))"""


def _emptied(text: str) -> str:
    lines = f"replace({text}, chr(13) || {LF}, {LF})"
    return f"regexp_replace({lines}, '(?m)^{BLANK_CLASS}+$', '', 'g')"


def _squeezed(text: str) -> str:
    return f"regexp_replace({_emptied(text)}, '(^|\\n)\\n{{3,}}', '\\1' || {LF} || {LF}, 'g')"


def _ended(text: str) -> str:
    return f"case when ends_with({text}, {LF}) then {text} else {text} || {LF} end"


def _restored(body: str) -> str:
    return (
        f"case when ends_with({body}, {LF} || {LF}) then left({body}, length({body}) - 1) "
        f"else {body} end"
    )


def _glob_any(column: str, patterns) -> str:
    tests = [f"regexp_full_match({column}, '(?s){globs.glob_body(p)}')" for p in patterns]
    return "(" + " or ".join(tests) + ")"


# Control bytes among the first bytes, from their hexadecimal form.
_CONTROL = f"""(length(regexp_replace(hex(encode(raw)[1:{HEAD_BYTES}]),
  '(0[0-8BCEF]|1[0-9A-F])|[0-9A-F]{{2}}', '\\1', 'g')) // 2)"""

BODIES = f"""marked as (
  select *, {_CONTROL}::bigint as ctl, least(size, {HEAD_BYTES})::bigint as head_len from files),
bodies as (
  select *, head_len > 0 and (ctl * 100) // greatest(head_len, 1) > 10 as is_binary,
    {_squeezed(f"raw || {LF}")} as body
  from marked)"""


def _hmac(text: str) -> str:
    key = hashlib.sha256(HMAC_KEY).digest() if len(HMAC_KEY) > HMAC_BLOCK else HMAC_KEY
    padded = key.ljust(HMAC_BLOCK, b"\0")
    inner, outer = (bytes(b ^ p for b in padded).hex() for p in (INNER_PAD, OUTER_PAD))
    return (
        f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"
    )


def _frame(signature: str = "''") -> str:
    return f"""case when is_binary then {PREFIX} || path || ' ---' || {LF} || {MARKER} || {LF}
      else {PREFIX} || path || ' ---' || {signature} || {LF} || body || {QUOTES} || {LF} || {LF}
      end"""


_SIGNATURE = f"' [SIGNATURE:' || to_base64(unhex({_hmac('body')})) || ']'"
FRAMES = f"{BODIES}, frames as (select *, {_frame()} as frame from bodies)"
SIGNED = f"{BODIES}, frames as (select *, {_frame(_SIGNATURE)} as frame from bodies)"


def _with_shards(budget: int) -> str:
    weight = f"size + strlen(path) + {FRAME_OVERHEAD}"
    return f"""planned as (
  select *, (((sum({weight}) over (partition by bundle order by seq
      rows unbounded preceding)) - ({weight})) // {budget})::bigint as shard
  from files)"""


def _packed(budget: int) -> str:
    return f"""with {FILES}, {FRAMES}, {_with_shards(budget)}
select bundle, shard, count(*) as n_files, sum(strlen(frame))::bigint as n_bytes,
  sha256(string_agg(frame, '' order by seq)) as sha
from frames join planned using (bundle, seq) group by bundle, shard"""


# Bundles joined to one text, cut at the frame breaks and parsed.
UNPACKED = f"""texts as (
  select bundle, {LF} || regexp_replace(string_agg(frame, '' order by seq), '\\n$', '') as t
  from frames group by bundle),
records as (
  select bundle, unnest(string_split(t, {LF} || {PREFIX})[2:]) as record from texts),
lines as (
  select bundle, string_split(record, {LF})[1] as header,
    substr(record, length(string_split(record, {LF})[1]) + 2) as rest
  from records),
unpacked as (
  select bundle,
    regexp_replace(header, ' ---( \\[SIGNATURE:[^\\]]*\\])?$', '') as path,
    nullif(regexp_extract(header, ' --- \\[SIGNATURE:([^\\]]*)\\]$', 1), '') as signature,
    case when string_split(rest, {LF})[1] = {MARKER} then 'binary' else 'text' end as kind,
    case when string_split(rest, {LF})[1] = {MARKER} then null
      else substr(string_split({LF} || rest || {LF}, {FENCE_LINE})[1], 2) || {LF} end as body
  from lines)"""

# Frames after every eleventh text was changed and every nineteenth lost.
TAMPERED = f"""numbered as (
  select *, regexp_extract(path, 'doc_(\\d+)', 1)::bigint as n from unpacked where kind = 'text'),
tampered as (
  select bundle, path, signature,
    case when n % 11 = 0 then body || 'changed' || {LF} else body end as body
  from numbered where n % 19 <> 0)"""

_ADMIT = f"""case when starts_with(base_name, '.') then 'DOT'
  when {_glob_any('base_name', SKIP_PATTERNS)} or {_glob_any('path', SKIP_PATTERNS)} then 'SKIP'
  when size > {ADMIT_MAX} then 'SIZE'
  when not {_glob_any('base_name', [ADMIT_NAME])} then 'NAME'
  when ext not in ('.c', '.md', '.txt') then 'TYPE' else 'OK' end"""

_SIGNATURE_STATUS = f"""case when signature is null then 'UNSIGNED'
  when signature = to_base64(unhex({_hmac('body')})) then 'OK' else 'MISMATCH' end"""

_VERIFIED = f"""with {FILES}, {FRAMES}, {UNPACKED}, {TAMPERED},
expected as (select bundle, path, sha256(body) as e from bodies
             where not is_binary and seq % 17 <> 0),
found as (select bundle, path, sha256(body) as f from tampered),
verified as (
  select bundle, path, case when f is null then 'MISSING' when e is null then 'UNSIGNED'
    when f = e then 'OK' else 'MISMATCH' end as status
  from found full outer join expected using (bundle, path))"""

_UNSAFE = "(^/|(^|/)\\.\\.(/|$)|^\\s*$)"

_EXT = "regexp_extract(base_name, '(?s)^.+(\\.[^.]*)$', 1)"

ORACLES: dict[str, str] = {
    "table_files": f"""select bundle, seq, path, base_name, {_EXT} as ext, size, sha from (
  select *, string_split(path, '/')[-1] as base_name from (
    select 'pages' as bundle, page_id as seq, concat('pages/', page_id, '.html') as path,
      strlen(html)::bigint as size, sha256(html) as sha from pages
    union all
    select 'chat', conv_id * 1000 + turn, concat('chat/', conv_id, '/', turn, '.', role),
      strlen(text)::bigint, sha256(text) from conversations
    union all
    select 'items', item_id, concat('items/', item_id), strlen(text)::bigint, sha256(text)
    from benchmark))""",
    "manifest_join": f"""with {FILES}
select seq, path from files join labels on doc_id = seq""",
    "manifest_join_repeats": f"""with {FILES}, tracked as (
  select doc_id - doc_id % 3 * toxic as seq from labels
  union all select case when quality = 1 then 0 else doc_id end from labels)
select seq, path from files join tracked using (seq)""",
    "manifest_unmatched": f"""with {FILES}
select doc_id as seq, count(*) as copies from labels
where doc_id not in (select seq from files where not starts_with(base_name, '.'))
group by doc_id""",
    "walk_files": f"""with {FILES}
select bundle || '/' || path as path, base_name, ext, size, false as hidden_tree,
  false as failed, sha256(raw) as sha
from files where not contains(path, '/.')""",
    "walk_hidden": f"""with {FILES}
select bundle || '/' || path as path, size, contains(path, '/.') as hidden_tree from files""",
    "named_files": f"""with {FILES}
select bundle || '/' || path as path, not starts_with(base_name, '.') as "exists",
  not starts_with(base_name, '.') as is_file,
  case when not starts_with(base_name, '.') then size end as size from files""",
    "binary_file_source": f"""with {FILES}
select bundle || '/' || path as path, base_name, ext, size, sha256(raw) as sha
from files where not contains(path, '/.') and size > 0""",
    "path_parts": f"""with {FILES}
select seq, path, base_name, ext, array_to_string(string_split(path, '/')[:-2], '/') as parent
from files""",
    "dot_filter": f"""with {FILES}
select seq, path from files where not base_name glob '.*'""",
    "hidden_tree_filter": f"""with {FILES}
select seq, path from files
where len(list_filter(string_split(path, '/')[2:], lambda p: starts_with(p, '.'))) = 0""",
    "skip_filter": f"""with {FILES}
select seq, path from files where not ({_glob_any('base_name', SKIP_PATTERNS)}
  or {_glob_any('path', SKIP_PATTERNS)})""",
    "skip_by_table": f"""with {FILES}
select seq, path from files where not (base_name glob '*.md' or path glob '*.md'
  or base_name glob '*/.cache/*' or path glob '*/.cache/*'
  or base_name glob '*doc_1?.c' or path glob '*doc_1?.c')""",
    "skip_by_long_table": f"""with {FILES}
select seq, path from files where ext = '' or seq not in (
  select doc_id from labels where quality = 0 or toxic = 1)""",
    "skip_by_mixed_table": f"""with {FILES}, patterns as (
  select distinct {MIXED_GLOB_SQL} as pattern from labels)
select seq, path from files where not exists (
  select 1 from patterns where path glob pattern or base_name glob pattern)""",
    "size_filter": f"""with {FILES}
select seq, size from files where size <= {SIZE_LIMIT}""",
    "size_boundary": f"""with {FILES}
select seq, size from files where size <= {BOUNDARY_BYTES}""",
    "name_filter": f"""with {FILES}
select seq, base_name from files where {_glob_any('base_name', NAME_PATTERNS)}""",
    "type_filter": f"""with {FILES}
select seq, ext from files where ext in ('.c', '.md', '.txt')""",
    "type_lists": f"""with parts as (
  select doc_id as seq, unnest(string_split({TYPES_TEXT_SQL}, ',')) as part from documents),
dotted as (
  select distinct seq, case when starts_with(trim(part), '.') then trim(part)
    else '.' || trim(part) end as ext from parts where trim(part) <> '')
select seq, string_agg(ext, '|' order by ext) as types from dotted group by seq""",
    "admission_reason": f"""with {FILES}
select seq, {_ADMIT} as reason from files""",
    "admission_counts": f"""with {FILES}
select {_ADMIT} as reason, count(*) as files, sum(size)::bigint as bytes
from files group by 1""",
    "capped_reason": f"""with {FILES}, reasoned as (
  select seq, case when starts_with(base_name, '.') then 'DOT'
    else 'OK' end as r from files)
select seq, case when r = 'OK' and row_number() over (partition by r order by seq) > {CAP_TOTAL}
  then 'CAP' else r end as reason from reasoned""",
    "file_cap": f"""with {FILES}
select bundle, seq from files
qualify row_number() over (partition by bundle order by seq) <= {CAP_PER_BUNDLE}""",
    "file_cap_sparse": f"""with {FILES}
select bundle, {SPARSE_SQL} as seq from files
qualify row_number() over (partition by bundle order by {SPARSE_SQL}) <= {CAP_PER_BUNDLE}""",
    "admission_nulls": f"""with {FILES}, reasoned as (
  select seq, case when {NO_PATH_SQL} or {NO_CONTENT_SQL} then 'UNREADABLE' else {_ADMIT} end
    as reason from (select *, seq as doc_id from files))
select seq, reason, reason = 'OK' as admitted from reasoned""",
    "admission_stored_sizes": f"""with {FILES}
select seq, case when {NO_CONTENT_SQL} then 'UNREADABLE' else {_ADMIT} end as reason
from (select *, seq as doc_id from files)""",
    "pack_nulls": f"""with {FILES}, {FRAMES}, held as (
  select bundle, strlen(frame) as n from (select *, seq as doc_id from frames)
  where not ({NO_PATH_SQL}) and not ({NO_CONTENT_SQL}))
select bundle, count(*) as n_files, sum(n)::bigint as n_bytes, sum(n)::bigint as text_bytes
from held group by bundle""",
    "union_inputs": f"""with {FILES}
select 0::integer as arg, seq, path from files where seq % 3 < 2
union all select 1::integer, seq, path from files where seq % 3 > 0""",
    "input_order": f"""with {FILES}, inputs as (
  select 0::integer as arg, path from files where seq % 3 < 2
  union all select 1::integer, path from files where seq % 3 > 0)
select arg, path, row_number() over (order by arg, path)::bigint as position from inputs""",
    "binary_flag": f"""with {FILES}, {BODIES}
select seq, ctl, head_len, is_binary from bodies""",
    "utf8_text": f"""with ended as (select doc_id, {LETTER_ENDED_SQL} as t from documents),
cut as (
  select doc_id as seq, try(decode(encode(t)[1:strlen(t) - doc_id % 3])) as t from ended)
select seq, t is not null as utf8, sha256(coalesce(t, 'Non-UTF8 content')) as sha from cut""",
    "ascii_mask": f"""with {FILES}
select seq, sha256(array_to_string(list_transform(string_split(raw, ''), lambda c:
  case when c between ' ' and '~' or c in (chr(9), chr(10), chr(13)) then c
  else repeat('?', strlen(c)) end), '')) as sha
from files""",
    "squeeze_blank": f"""with {FILES}, s as (
  select seq, {_squeezed(_ended('raw'))} as t from files)
select seq, sha256(t) as sha, strlen(t)::bigint as n_bytes from s""",
    "blank_run_audit": f"""with {FILES}, texts as (
  select seq, string_split({_emptied(_ended('raw'))}, {LF})[:-2] as l from files),
lines as (select seq, unnest(l) as line, generate_subscripts(l, 1) as i from texts),
islands as (
  select seq, i - row_number() over (partition by seq order by i) as island
  from lines where line = ''),
runs as (select seq, island, count(*) as n from islands group by all)
select f.seq, count(r.n) as runs, coalesce(max(r.n), 0)::bigint as longest_run
from files f left join runs r using (seq) group by f.seq""",
    "roundtrip_text": f"""with {FILES}, {BODIES}
select seq, sha256({_restored('body')}) as sha from bodies""",
    "preview": f"""with {FILES}, n as (select seq, raw, length(raw) as n from files)
select seq, substr(raw, 1, 50) as head,
  substr(raw, least(100, greatest(n - 50, 0)) + 1,
    least(150, n) - least(100, greatest(n - 50, 0))) as mid,
  right(raw, 50) as tail from n""",
    "prefix_digest": f"""with {FILES}
select seq, sha256(encode(raw)[1:1000]) as sha from files""",
    "frame_render": f"""with {FILES}, {FRAMES}
select seq, sha256(frame) as sha from frames""",
    "signed_frames": f"""with {FILES}, {SIGNED}
select seq, sha256(frame) as sha from frames""",
    "pack_bundles": _packed(ROW_SHARD_BYTES),
    "pack_shards": _packed(SMALL_BUDGET),
    "shard_plan": f"""with {FILES}, {_with_shards(SMALL_BUDGET)}
select bundle, seq, shard from planned""",
    "shard_plan_sparse": f"""with {FILES}, {_with_shards(SMALL_BUDGET)}
select bundle, seq * 5000 as seq, shard from planned""",
    "bundle_names": """select source as bundle,
  source || '_main_' || max(doc_id) || '.txt' as file_name from documents group by source""",
    "unpack_frames": f"""with {FILES}, {FRAMES}, {UNPACKED}
select bundle, path, kind, sha256(coalesce(body, '')) as sha from unpacked""",
    "restore_text": f"""with {FILES}, {FRAMES}, {UNPACKED}
select bundle, path, sha256({_restored('body')}) as sha from unpacked where kind = 'text'""",
    "bundle_files": f"""with {FILES}, {FRAMES}, {UNPACKED}
select bundle, path, sha256({_restored('body')}) as sha from unpacked where kind = 'text'""",
    "unpack_some": f"""with {FILES}, {FRAMES}, {UNPACKED}
select bundle, path, kind, sha256(coalesce(body, '')) as sha from unpacked
where regexp_extract(path, 'doc_(\\d+)', 1)::bigint in (
  select doc_id from labels where quality = 0 or toxic = 1)""",
    "frame_table": f"""with {FILES}, {FRAMES}
select bundle, seq, path, is_binary, sha256(frame) as sha from frames""",
    "extract_counts": f"""with {FILES}, {FRAMES}, {UNPACKED}
select bundle, count(*) filter (kind = 'text') as extracted,
  count(*) filter (kind = 'binary') as binary, 0::bigint as bad_header
from unpacked group by bundle""",
    "last_wins": f"""with {FILES}
select bundle, 'doc_' || (seq % 50) as path, seq, sha256(raw) as sha from files
qualify row_number() over (partition by bundle, seq % 50 order by seq desc) = 1""",
    "header_parse": f"""with h as (
  select doc_id as seq, regexp_replace({HEADER_TEXT_SQL}, '\\s+$', '') as h from documents),
m as (
  select seq, h, contains(h, ' --- [SIGNATURE:') as marked from h)
select seq,
  case when marked and ends_with(h, ']') then
      trim(regexp_extract(h, '^(.*) --- \\[SIGNATURE:(.*)\\]$', 1))
    when not marked and ends_with(h, ' ---') then trim(regexp_extract(h, '^(.*) ---$', 1))
  end as path,
  case when marked and ends_with(h, ']') then
      regexp_extract(h, '^(.*) --- \\[SIGNATURE:(.*)\\]$', 2) end as signature
from m""",
    "key_blocks": f"""with b as (
  select source as bundle, min(doc_id) as seq from documents group by source),
k as (select bundle, {KEY_TEXT_SQL} as key from b)
select bundle, key, coalesce(octet_length(try(from_base64(key))) = 32, false) as valid from k""",
    "collision_audit": f"""with {FILES}, {BODIES}
select seq, contains({LF} || body, {FENCE_LINE}) or contains({LF} || body, {LF} || {PREFIX})
    or starts_with(body, {MARKER} || {LF}) as collides,
  false as not_utf8, {_restored('body')} <> raw as lossy from bodies""",
    "path_audit": f"""select doc_id as seq, {ODD_PATH_SQL} as path,
  doc_id % 8 in (0, 1, 2, 4, 5, 6) as bad_path from documents""",
    "integrity_manifest": f"""with {FILES}, {BODIES}
select bundle, path, size, sha256(body) as sha256, sha256(raw) as raw_sha256
from bodies where not is_binary""",
    "keyed_digest": f"""with {FILES}, {BODIES}
select bundle, path, {_hmac('body')} as sha from bodies where not is_binary""",
    "manifest_table": f"""with {FILES}, {BODIES}
select bundle, seq, path, size, sha256(body) as sha256 from bodies where not is_binary""",
    "verify_status": f"""{_VERIFIED} select * from verified""",
    "verify_counts": f"""{_VERIFIED} select status, count(*) as n from verified group by status""",
    "signature_status": f"""with {FILES}, {SIGNED}, {UNPACKED}, {TAMPERED}
select bundle, path, {_SIGNATURE_STATUS} as status from tampered""",
    "quarantined_frames": f"""with {FILES}, {SIGNED}, {UNPACKED}, {TAMPERED}
select * from (select bundle, path, {_SIGNATURE_STATUS} as status from tampered)
where status = 'MISMATCH'""",
    "repo_name": f"""with u as (select page_id, {REPO_TEXT_SQL} as url from pages)
select page_id, url,
  url like 'http://%' or url like 'https://%' or url like 'git://%' or url like 'ssh://%'
    or url like 'git@%' as is_repo_url,
  regexp_replace(case when url like 'git@%:%'
    then string_split(string_split(url, ':')[2], '/')[-1]
    else string_split(url, '/')[-1] end, '(\\.git)+$', '') as repo
from u""",
    "extract_two_bundles": """select
  case when doc_id % 2 = 0 then 'even' else 'odd' end || '/p' || (doc_id // 2) as path,
  sha256(coalesce(text, '')) as sha from documents""",
    "last_then_verify": f"""with {FILES}, {SIGNED}, {UNPACKED}, {TAMPERED},
placed as (select *, regexp_extract(path, 'doc_(\\d+)', 1)::bigint as n from tampered)
select bundle, 'p' || (n % 50) as path, {_SIGNATURE_STATUS} as status from placed
qualify row_number() over (partition by bundle, n % 50 order by n desc) = 1""",
    "extract_odd_paths": """with d as (select doc_id, doc_id % 8 as k from documents)
select concat('d', doc_id) as path,
  case when doc_id + 1 in (select doc_id from d) then 'CONFLICT' else 'WRITTEN' end as status
from d where k = 0
union all select concat('d', doc_id - 1, '/x'), 'WRITTEN' from d where k = 1
union all select concat('../', doc_id), 'UNSAFE' from d where k = 2
union all select concat('e', doc_id, '/'), 'UNSAFE' from d where k = 3
union all select distinct concat('f/', doc_id - k + 4), 'WRITTEN' from d where k in (4, 5)
union all select '.', 'UNSAFE' from d where k = 6
union all select concat('g', doc_id), 'WRITTEN' from d where k = 7""",
    "extract_commit": """with d as (
  select doc_id, doc_id % 8 as k, sha256(coalesce(text, '')) as sha from documents),
beside as (select doc_id, doc_id + 1 in (select doc_id from d) as clash from d)
select concat('d', doc_id) as path, case when clash then 'CONFLICT' else 'WRITTEN' end as status,
  case when not clash then sha end as sha from d join beside using (doc_id) where k = 0
union all select concat('d', doc_id - 1, '/x'), 'WRITTEN', sha from d where k = 1
union all select concat('../', doc_id), 'UNSAFE', null from d where k = 2
union all select concat('e', doc_id, '/'), 'UNSAFE', null from d where k = 3
union all select concat('f/', doc_id - k + 4), 'WRITTEN', arg_max(sha, doc_id) from d where k in (4, 5)
  group by doc_id - k
union all select '.', 'UNSAFE', null from d where k = 6
union all select concat('g', doc_id), 'WRITTEN', sha from d where k = 7""",
    "verify_plain_files": f"""with {FILES}, {BODIES},
plain as (
  select bundle, path, case when seq % 11 = 0 then raw || 'changed' || {LF} else raw end as raw
  from files where seq % 19 <> 0),
expected as (select bundle, path, sha256(body) as e from bodies where not is_binary and seq % 17 <> 0),
plain_marked as (
  select *, {_CONTROL}::bigint as ctl, least(strlen(raw), {HEAD_BYTES})::bigint as head_len from plain),
found as (
  select bundle, path, sha256({_squeezed(f"raw || {LF}")}) as f
  from plain_marked where not (head_len > 0 and (ctl * 100) // greatest(head_len, 1) > 10))
select bundle, path, case when f is null then 'MISSING' when e is null then 'UNSIGNED'
    when f = e then 'OK' else 'MISMATCH' end as status
from found full outer join expected using (bundle, path)""",
    "squeeze_chunked": f"""with {FILES}, {BODIES}
select bundle, path, sha256(body) as sha from bodies""",
    "hash_tree": f"""with {FILES}, {BODIES},
entries as (
  select sha256(length(bundle)::varchar || ':' || bundle || path) as k, sha256(body) as sha
  from bodies where not is_binary),
leaves as (select substr(k, 1, 2) as node, sha256(k || ':' || sha) as leaf from entries),
second as (
  select node, sha256(string_agg(leaf, '' order by leaf)) as digest, count(*) as files
  from leaves group by node),
first as (
  select substr(node, 1, 1) as node, sha256(string_agg(node || ':' || digest, '' order by node)) as digest,
    sum(files)::bigint as files
  from second group by substr(node, 1, 1))
select 2 as level, node, digest, files from second union all select 1, node, digest, files from first
union all select 0, '', sha256(string_agg(node || ':' || digest, '' order by node)), sum(files)::bigint from first""",
    "verify_root": f"""with {FILES}, {FRAMES}, {UNPACKED},
numbered as (
  select *, regexp_extract(path, 'doc_(\\d+)', 1)::bigint as n from unpacked where kind = 'text'),
digests as (
  select bundle, path, n, sha256(case when n % 101 = 7 then body || 'changed' || {LF} else body end) as f
  from numbered where n % 97 <> 5),
found as (
  select bundle, path, f from digests
  union all select bundle, path || '.forged', f from digests where n % 89 = 3),
expected as (select bundle, path, sha256(body) as e from bodies where not is_binary)
select * from (
  select bundle, path, case when f is null then 'MISSING' when e is null then 'UNSIGNED'
    when f = e then 'OK' else 'MISMATCH' end as status
  from found full outer join expected using (bundle, path)) where status <> 'OK'""",
    "safe_path": f"""with h as (select doc_id as seq, {HEADER_PATH_SQL} as path from documents)
select seq, path, not regexp_matches(path, '{_UNSAFE}') as safe from h""",
    "relative_path": f"""with h as (select doc_id as seq, {HEADER_PATH_SQL} as path from documents)
select seq, case when starts_with(path, 'src1/') then substr(path, 6) else path end as rel
from h""",
    "path_quarantine": f"""with h as (
  select doc_id as seq, {HEADER_PATH_SQL} as path from documents)
select seq, path from h where regexp_matches(path, '{_UNSAFE}')""",
    "digest_text": f"""with {FILES}
select seq, to_base64(unhex(sha256(raw))) as encoded, true as valid from files""",
    "run_summary": f"""with {FILES}, {BODIES}, reasoned as (
  select *, {_ADMIT} = 'OK' as admitted from bodies)
select bundle, count(*) filter (admitted) as processed, 0::bigint as failed,
  count(*) filter (not admitted) as skipped, count(*) filter (admitted and is_binary) as binary,
  coalesce(sum(size) filter (admitted), 0)::bigint as bytes
from reasoned group by bundle""",
    "run_summary_reads": f"""with {FILES}, {BODIES}, tested as (
  select *, size <= {ADMIT_MAX} as admitted, starts_with(base_name, '.') as gone from bodies)
select bundle, count(*) filter (admitted and not gone) as processed,
  count(*) filter (admitted and gone) as failed, count(*) filter (not admitted) as skipped,
  count(*) filter (admitted and not gone and is_binary) as binary,
  coalesce(sum(size) filter (admitted and not gone), 0)::bigint as bytes
from tested group by bundle""",
}
