"""Registered queries of the link graph and of the functions on notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import notes as N
from notelake.functions.text import title_of
from notelake.operators import graph as G
from notelake.plans.prelude import GRAPH, HEAD, LINKS, NOTES, REST, SPLIT, TITLE, WS
from notelake.sources.tables import table

# What the point queries ask about.
VAULT, TITLE_ASKED, TARGET, NEW_TITLE = "atlas-handbook", "README", "Inventory glossary", "Inventory $lossary"


def _n(spark: SparkSession, folder: str) -> DataFrame:
    return G.snapshot(table(spark, folder, "notes"))


def _ne(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    n = _n(spark, folder)
    return n, G.edges(n)


def _v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vaults")


def _g(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return G.graph(*_ne(spark, folder), _v(spark, folder))


def list_notes(spark, folder):
    return _n(spark, folder).select("vault", "key", "title", "reference")


def title_from_key(spark, folder):
    return table(spark, folder, "notes").select("vault", "key", title_of("key").alias("title"))


def find_notes(spark, folder):
    return G.find_notes(_n(spark, folder), VAULT, TITLE_ASKED)


def parse_wikilinks(spark, folder):
    return G.links(_n(spark, folder))


def rewrite_wikilinks(spark, folder):
    made = _n(spark, folder).select("vault", "key", N.rewrite_wikilinks("body", TARGET, NEW_TITLE).alias("r")).where("r.n > 0")
    return made.select("vault", "key", F.md5("r.body").alias("body_md5"), F.col("r.n").alias("n"))


def split_cross_vault(spark, folder):
    t = table(spark, folder, "wiki_links").select("target").where("target is not null").distinct()
    return t.select("target", N.split_cross_vault("target").alias("s")).select("target", F.col("s.vault").alias("head"), F.col("s.title").alias("rest"))


def validate_key(spark, folder):
    keys = table(spark, folder, "note_updates").select("key").union(table(spark, folder, "wiki_links").select("target")).distinct()
    return keys.select("key", N.validate_key("key").alias("problem"))


def forward_links(spark, folder):
    return _ne(spark, folder)[1]


def backlinks(spark, folder):
    return G.backlinks(_ne(spark, folder)[1], VAULT, TARGET)


def links_for_title(spark, folder):
    return G.links_for_title(*_ne(spark, folder))


def duplicate_titles(spark, folder):
    return G.duplicate_titles(_n(spark, folder))


def namesakes(spark, folder):
    return G.namesakes(_n(spark, folder))


def degrees(spark, folder):
    return G.degrees(*_ne(spark, folder))


def graph_lines(spark, folder):
    return G.graph_lines(_ne(spark, folder)[1])


def graph_all_vaults(spark, folder):
    return G.graph_all_vaults(_ne(spark, folder)[1], _v(spark, folder))


def orphans(spark, folder):
    return G.orphans(*_ne(spark, folder))


def broken_links(spark, folder):
    return G.broken_links(*_ne(spark, folder), _v(spark, folder))


def note_links(spark, folder):
    return G.note_links(*_ne(spark, folder))


def note_backlinks(spark, folder):
    return G.note_backlinks(*_ne(spark, folder))


def dangling_backlinks(spark, folder):
    return G.dangling_backlinks(*_ne(spark, folder))


def cross_vault_backlinks(spark, folder):
    return G.cross_vault_backlinks(_ne(spark, folder)[1])


def graph_nodes(spark, folder):
    return _g(spark, folder)[0]


def graph_edges(spark, folder):
    return _g(spark, folder)[1]


def resolved_degrees(spark, folder):
    return G.resolved_degrees(_g(spark, folder)[1])


def one_hop_view(spark, folder):
    return G.one_hop_view(*_g(spark, folder))


def neighbours(spark, folder):
    return G.neighbours(_g(spark, folder)[1], f"{VAULT}/{TARGET}")


def group_top10(spark, folder):
    return G.largest_groups(_g(spark, folder)[0])


def folder_rollup(spark, folder):
    return G.folder_rollup(_n(spark, folder))


def compressed_folders(spark, folder):
    return G.compressed_folders(G.folder_rollup(_n(spark, folder)))


def autocomplete(spark, folder):
    return G.autocomplete(_n(spark, folder), VAULT, "rea")


def follow_link(spark, folder):
    return G.follow_link(_n(spark, folder), _v(spark, folder), VAULT, TITLE_ASKED)


def rename_report(spark, folder):
    return G.rename(*_ne(spark, folder), VAULT, TARGET, NEW_TITLE)[1]


def attribution(spark, folder):
    hit = G.attribution(_n(spark, folder), table(spark, folder, "sources"))
    return hit.select("vault", "key", N.source_label("source", "license").alias("label"), "prefix")


def is_reference(spark, folder):
    return G.is_reference(_n(spark, folder), table(spark, folder, "sources"))


def outline(spark, folder):
    heads = _n(spark, folder).select("vault", "key", F.explode(N.outline("body")).alias("h"))
    return heads.select("vault", "key", F.col("h.line").cast("long").alias("line"), F.col("h.level").cast("long").alias("level"), F.col("h.heading").alias("heading"))


def key_parts(spark, folder):
    return table(spark, folder, "notes").select("vault", "key", N.top_level("key").alias("top"), N.in_dependency_dir("key").alias("dependency"))


def summarize_keys(spark, folder):
    return G.key_summary(_n(spark, folder))


def degree_boost(spark, folder):
    return degrees(spark, folder).select("vault", "key", F.round(N.degree_boost("degree"), 6).alias("boost"))


def keys_to_titles(spark, folder):
    return G.backlink_titles(_ne(spark, folder)[1])


_T, _FK = TITLE.format('"key"'), TITLE.format("from_key")
_OLD = r"\[\[[ \t]*Inventory glossary[ \t]*(\|[^\]\r\n]+)?\]\]"
_BACK = f"{LINKS}, b as (select n.vault, n.\"key\", e.from_key from e join n on n.vault = e.vault and n.title = e.target where e.from_key <> n.\"key\")"
SQL = {
    "list_notes": f'with {NOTES} select vault, "key", title, reference from n',
    "title_from_key": f'select vault, "key", {_T} title from notes',
    "find_notes": f"with {NOTES} select vault, \"key\", title, reference from n where vault = '{VAULT}' and title = '{TITLE_ASKED}'",
    "parse_wikilinks": f"with {LINKS} select vault, from_key, pos, trim(target0, {WS}) target, nullif(trim(coalesce(alias0, ''), {WS}), '') alias from l",
    "rewrite_wikilinks": rf"""with {NOTES} select vault, "key", md5(regexp_replace(body, '{_OLD}', '[[{NEW_TITLE}\1]]', 'g')) body_md5, len(regexp_extract_all(body, '{_OLD}')) n
from n where regexp_matches(body, '{_OLD}')""",
    "split_cross_vault": f"""select distinct target, case when {SPLIT.format('target')} then {HEAD.format('target')} end head, case when {SPLIT.format('target')} then {REST.format('target')} end rest
from wiki_links where target is not null""",
    "validate_key": r"""select "key", case when coalesce("key", '') = '' then 'empty' when contains("key", '\') then 'backslash' when contains("key", chr(0)) then 'nul'
when starts_with("key", '/') or substr("key", 2, 1) = ':' then 'absolute' when not ends_with("key", '.md') then 'not a note'
when list_has_any(string_split("key", '/'), ['', '.', '..']) then 'segment' end problem from (select "key" from note_updates union select target from wiki_links)""",
    "forward_links": f"with {LINKS} select vault, from_key, target from e",
    "backlinks": f"with {LINKS} select from_key \"key\" from e where vault = '{VAULT}' and target = '{TARGET}'",
    "links_for_title": f"with {LINKS} select distinct vault, {_FK} title, target from e",
    "duplicate_titles": f"with {NOTES} select vault, title, count(*) n, bool_or(not reference) project from n group by 1, 2 having count(*) > 1",
    "namesakes": f'with {NOTES} select vault, title, "key" from n where (vault, title) in (select (vault, title) from n group by vault, title having count(*) > 1)',
    "degrees": f"""with {LINKS}, d as (select vault, from_key "key" from e union all select n.vault, n."key" from e join n on n.vault = e.vault and n.title = e.target)
select vault, "key", count(*) degree from d group by 1, 2""",
    "graph_lines": f"with {LINKS} select distinct vault, {_FK} from_title, target from e",
    "graph_all_vaults": f"""with {LINKS} select distinct e.vault||'/'||{_FK} from_node, case when v.name is not null then target else e.vault||'/'||target end to_node
from e left join (select distinct name from vaults) v on {SPLIT.format('target')} and v.name = {HEAD.format('target')}""",
    "orphans": f'with {LINKS} select vault, title, "key" from n where not exists (select 1 from e where e.vault = n.vault and e.target = n.title)',
    "broken_links": f"""with {LINKS} select vault, from_key, target from e where not exists (select 1 from n where n.vault = e.vault and n.title = e.target)
and not exists (select 1 from n where n.vault in (select name from vaults) and {SPLIT.format('e.target')} and n.vault = {HEAD.format('e.target')} and n.title = {REST.format('e.target')})""",
    "note_links": f'with {LINKS} select e.vault, e.from_key, e.target, n."key" from e left join n on n.vault = e.vault and n.title = e.target',
    "note_backlinks": f'with {_BACK} select vault, "key", from_key from b',
    "dangling_backlinks": f'with {_BACK} select distinct vault, "key", {_FK} title from b',
    "cross_vault_backlinks": f"""with {LINKS} select distinct {HEAD.format('target')} vault, {REST.format('target')} title, vault||'/'||{_FK} from_node from e
where {SPLIT.format('target')} and {HEAD.format('target')} <> vault""",
    "graph_nodes": f"with {GRAPH} select id, label, missing, reference from gn",
    "graph_edges": f"with {GRAPH} select from_id, to_id from ge",
    "resolved_degrees": f"with {GRAPH} select id, count(*) degree from (select from_id id from ge union all select to_id from ge) group by 1",
    "one_hop_view": f"""with {GRAPH}, own as (select id from gn where not reference),
kept as (select id from own union select to_id from ge where from_id in (select id from own) union select from_id from ge where to_id in (select id from own))
select id, id in (select id from kept) kept from gn""",
    "neighbours": f"""with {GRAPH} select distinct id from (select to_id id from ge where from_id = '{VAULT}/{TARGET}' union all select from_id from ge where to_id = '{VAULT}/{TARGET}')
where id <> '{VAULT}/{TARGET}'""",
    "group_top10": f"with {GRAPH} select regexp_replace(id, '/[^/]*$', '') folder, count(*) n from gn where not missing group by 1 order by n desc, folder limit 10",
    "folder_rollup": f"""with {NOTES} select vault, folder, count(*) n from (select vault, unnest(list_transform(range(len(string_split("key", '/'))),
lambda i: array_to_string(list_slice(string_split("key", '/'), 1, i), '/'))) folder from n) group by 1, 2""",
    "compressed_folders": f"""with {NOTES}, r as (select vault, folder, count(*) n from (select vault, unnest(list_transform(range(len(string_split("key", '/'))),
lambda i: array_to_string(list_slice(string_split("key", '/'), 1, i), '/'))) folder from n) group by 1, 2),
c as (select vault, regexp_replace(folder, '/?[^/]*$', '') folder, count(*) c, max(n) m from r where folder <> '' group by 1, 2)
select r.vault, r.folder, r.n, r.n > 25 collapsed from r left join c on c.vault = r.vault and c.folder = r.folder where r.folder = '' or c.c is null or not (c.c = 1 and c.m = r.n)""",
    "autocomplete": f"""with {NOTES} select distinct place, suggestion from (select case when vault = '{VAULT}' then 0 else 1 end place, case when vault = '{VAULT}' then title else vault||'/'||title end suggestion
from n where contains(lower(title), 'rea')) order by place, suggestion limit 12""",
    "follow_link": f"with {NOTES} select vault, \"key\", title from n where vault = '{VAULT}' and (title = '{TITLE_ASKED}' or \"key\" = '{TITLE_ASKED}')",
    "rename_report": rf"""with {LINKS}, s as (select n.*, len(regexp_extract_all(body, '{_OLD}')) c from n where exists (select 1 from e where e.vault = n.vault and e.from_key = n."key" and e.target = '{TARGET}') and vault = '{VAULT}')
select count(*) filter (not reference and c > 0) notes, cast(coalesce(sum(c) filter (not reference), 0) as bigint) links, count(*) filter (reference) skipped from s""",
    "attribution": f"""with {NOTES}, h as (select n.vault, n."key", s.name, s.license, s.prefix, row_number() over (partition by n.vault, n."key" order by length(s.prefix) desc, s.name) r
from n join sources s on s.vault = n.vault and (n."key" = s.prefix or starts_with(n."key", s.prefix||'/')))
select vault, "key", name||' · '||coalesce(nullif(trim(license, {WS}), ''), 'licence not stated') label, prefix from h where r = 1""",
    "is_reference": f"""with {NOTES} select vault, "key", exists (select 1 from sources s where s.vault = n.vault and (n."key" = s.prefix or starts_with(n."key", s.prefix||'/'))) reference from n""",
    "outline": rf"""with {NOTES}, x as (select vault, "key", string_split(replace(body, chr(13)||chr(10), chr(10)), chr(10)) ls from n), y as (select vault, "key", unnest(range(len(ls))) line, unnest(ls) s from x)
select vault, "key", line, length(regexp_extract(s, '^(#{{1,6}})\s+(.+?)\s*$', 1)) "level", regexp_extract(s, '^(#{{1,6}})\s+(.+?)\s*$', 2) heading from y where regexp_matches(s, '^(#{{1,6}})\s+(.+?)\s*$')""",
    "key_parts": """select vault, "key", string_split("key", '/')[1] top, list_has_any(list_slice(string_split("key", '/'), 1, len(string_split("key", '/')) - 1),
['node_modules', 'bower_components', 'vendor', 'site-packages', '__pycache__', 'Pods']) dependency from notes""",
    "summarize_keys": f"""with {NOTES}, k as (select vault, title, list_sort(list("key")) k from n group by 1, 2 having count(*) > 1)
select vault, title, array_to_string(list_slice(k, 1, 4), ', ')||case when len(k) > 4 then ', ... (+'||(len(k) - 4)||' more)' else '' end summary from k""",
    "degree_boost": f"""with {LINKS}, d as (select vault, from_key "key" from e union all select n.vault, n."key" from e join n on n.vault = e.vault and n.title = e.target)
select vault, "key", round(1 + 0.25 * least(1.0, ln(1 + count(*)) / ln(13)), 6) boost from d group by 1, 2""",
    "keys_to_titles": f"with {LINKS} select distinct vault, target, {_FK} title from e",
}
QUERIES = {name: globals()[name] for name in SQL}
