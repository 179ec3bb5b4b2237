"""The SQL that the oracle queries share, for DuckDB."""

from notelake.functions.notes import WIKILINK
from notelake.functions.text import WHITE_SPACE

WS = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)
TITLE = r"regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\.md$', '')"

NOTES = rf"""n as (select vault, "key", {TITLE.format('"key"')} title, coalesce(reference, false) reference, mtime_ns, hash, coalesce(body, '') body from notes where removed_at is null)"""
LINKS = rf"""{NOTES},
l as (select vault, "key" from_key, unnest(range(len(x))) pos, unnest(x) target0, unnest(y) alias0 from (
  select vault, "key", regexp_extract_all(body, '{WIKILINK}', 1) x, regexp_extract_all(body, '{WIKILINK}', 2) y from n)),
e as (select distinct vault, from_key, trim(target0, {WS}) target from l)"""
SPLIT = "strpos({0}, '/') > 1 and length({0}) > strpos({0}, '/')"
HEAD, REST = "substr({0}, 1, strpos({0}, '/') - 1)", "substr({0}, strpos({0}, '/') + 1)"
GRAPH = rf"""{LINKS},
r as (select e.vault, e.from_key, e.target, n."key" k, v.name vn from e left join n on n.vault = e.vault and n.title = e.target
  left join (select distinct name from vaults) v on {SPLIT.format('e.target')} and v.name = {HEAD.format('e.target')}),
ends as (select vault||'/'||from_key from_id, case when k is not null then vault||'/'||k when vn is not null then target else vault||'/'||target end to_id,
  case when k is null then {TITLE.format('target')} end label from r),
ge as (select distinct from_id, to_id from ends),
gn as (select vault||'/'||"key" id, title label, false missing, reference from n
  union all select to_id, min(label), true, false from ends where label is not null and to_id not in (select vault||'/'||"key" from n) group by 1)"""
