"""Registered queries of refresh and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelake.functions.notes import WIKILINK
from notelake.operators import graph as G
from notelake.operators import health as H
from notelake.operators import refresh as R
from notelake.plans.prelude import LINKS, NOTES, WS
from notelake.plans.search_queries import _USABLE
from notelake.sources.tables import table


def _n(spark, folder):
    return G.snapshot(table(spark, folder, "notes"))


def _feed(spark, folder):
    """The feed's last updates as a listing, and the stored state."""
    listing = R.latest(table(spark, folder, "note_updates"))
    return listing, table(spark, folder, "notes").select("vault", "key", "mtime_ns", "hash")


def latest_updates(spark, folder):
    return R.latest(table(spark, folder, "note_updates")).select("vault", "key", "title", "mtime_ns", "hash", F.size("targets").cast("long").alias("targets"))


def incremental_diff(spark, folder):
    return R.diff(*_feed(spark, folder))


def needs_hash(spark, folder):
    return R.needs_hash(*_feed(spark, folder))


def refresh_report(spark, folder):
    return R.report(R.diff(*_feed(spark, folder)))


def apply_upsert(spark, folder):
    listing, state = _feed(spark, folder)
    edges = G.edges(table(spark, folder, "notes").select("vault", "key", F.coalesce("body", F.lit("")).alias("body")))
    changes = R.diff(listing, state).where("change <> 'removed'")
    fresh = listing.join(changes.where(F.col("change").isin("changed", "added")).select("vault", "key"), ["vault", "key"], "left_semi")
    fresh = fresh.select("vault", F.col("key").alias("from_key"), F.explode("targets").alias("target")).where("target is not null").distinct()
    return R.apply_edges(edges, changes, fresh)


def apply_state(spark, folder):
    listing, state = _feed(spark, folder)
    return R.apply_state(state, listing)


def embed_plan(spark, folder):
    return R.embed_plan(_n(spark, folder), table(spark, folder, "vectors"))


def removed_keys(spark, folder):
    return R.removed_keys(_n(spark, folder), table(spark, folder, "vectors"))


def embedding_coverage(spark, folder):
    return R.coverage(_n(spark, folder), table(spark, folder, "vectors"))


def audit_counts(spark, folder):
    return H.audit(table(spark, folder, "notes"), _n(spark, folder))


def skipped_by_dir(spark, folder):
    return H.skipped_by_dir(table(spark, folder, "notes"), _n(spark, folder))


def doctor_counts(spark, folder):
    n = _n(spark, folder)
    # one vault's store is taken away, so that a vault without vectors is among the rows
    vectors = table(spark, folder, "vectors").where("vault <> 'atlas-handbook'")
    return H.doctor(table(spark, folder, "notes"), n, G.edges(n), table(spark, folder, "vaults"), vectors)


def pack_report(spark, folder):
    return H.pack_report(_n(spark, folder))


def debounce_batches(spark, folder):
    made = R.debounce(table(spark, folder, "note_updates"), "vault", "received_at", 6 * 3_600_000, "update_id")
    return made.select("update_id", "vault", F.unix_micros("batch_start").alias("start_us"))


_LATEST = """lu as (select vault, "key", title, targets, mtime_ns, hash from note_updates where "key" is not null
qualify row_number() over (partition by vault, "key" order by received_at desc nulls last, update_id desc) = 1)"""
_DIFF = f"""{_LATEST}, df as (select coalesce(a.vault, b.vault) vault, coalesce(a."key", b."key") "key", case when a."key" is null then 'removed' when b."key" is null then 'added'
when coalesce(a.mtime_ns = b.mtime_ns, false) then 'unchanged' when coalesce(a.hash = b.hash, false) then 'touched' else 'changed' end change
from lu a full join notes b on a.vault = b.vault and a."key" = b."key")"""
_AUDIT = f"""{NOTES}, au as (select x.vault, count(n."key") included, count(*) filter (n.reference) reference, count(*) filter (n."key" is null) skipped,
count(*) filter (n."key" is null and list_has_any(list_slice(string_split(x."key", '/'), 1, len(string_split(x."key", '/')) - 1),
['node_modules', 'bower_components', 'vendor', 'site-packages', '__pycache__', 'Pods'])) skipped_dependency
from notes x left join n on n.vault = x.vault and n."key" = x."key" where ends_with(x."key", '.md') group by 1)"""
_COVER = f"""hv as (select distinct vault, "key" from vectors where {_USABLE}), cv as (select n.vault, count(hv."key") embedded, count(*) filter (hv."key" is null and not n.reference) missing_project,
count(*) filter (hv."key" is null and n.reference) missing_reference from n left join hv on hv.vault = n.vault and hv."key" = n."key" group by 1)"""
_COVER_SOME = _COVER.replace("from vectors where", "from vectors where vault <> 'atlas-handbook' and")
_L = LINKS.split("\n", 1)[1]

SQL = {
    "latest_updates": f'with {_LATEST} select vault, "key", title, mtime_ns, hash, len(targets) targets from lu',
    "incremental_diff": f'with {_DIFF} select vault, "key", change from df',
    "needs_hash": f"""with {_DIFF} select vault, "key" from df where change in ('added', 'touched', 'changed')""",
    "refresh_report": f"""with {_DIFF} select vault, count(*) filter (change in ('added', 'changed')) indexed, count(*) filter (change = 'touched') touched,
count(*) filter (change = 'removed') removed, count(*) filter (change = 'unchanged') unchanged from df group by 1""",
    "apply_upsert": rf"""with {_DIFF}, b as (select distinct vault, "key" from_key, trim(unnest(regexp_extract_all(coalesce(body, ''), '{WIKILINK}', 1)), {WS}) target from notes),
up as (select vault, "key" from df where change in ('added', 'changed'))
select vault, from_key, target from b where (vault, from_key) not in (select (vault, "key") from up)
union all select distinct vault, "key", t from (select lu.vault, lu."key", unnest(targets) t from lu where (lu.vault, lu."key") in (select (vault, "key") from up)) where t is not null""",
    "apply_state": f'with {_LATEST} select lu.vault, lu."key", lu.mtime_ns, coalesce(lu.hash, o.hash) hash from lu left join notes o on o.vault = lu.vault and o."key" = lu."key"',
    "embed_plan": f"""with {NOTES}, h as (select vault, "key", max(hash) hash from vectors group by 1, 2)
select coalesce(n.vault, h.vault) vault, coalesce(n."key", h."key") "key", case when n."key" is null then 'remove' when coalesce(n.hash = h.hash, false) then 'current'
when n.reference then 'skip' else 'embed' end plan from n full join h on n.vault = h.vault and n."key" = h."key" """,
    "removed_keys": f"""with {NOTES} select distinct vault, "key" from vectors where (vault, "key") not in (select (vault, "key") from n)""",
    "embedding_coverage": f"with {NOTES}, {_COVER} select * from cv",
    "audit_counts": f"with {_AUDIT} select * from au",
    "skipped_by_dir": f"""with {NOTES} select vault, string_split("key", '/')[1] dir, count(*) n from notes x where ends_with("key", '.md') and not exists (select 1 from n where n.vault = x.vault and n."key" = x."key") group by 1, 2""",
    "doctor_counts": f"""with {_AUDIT}, {_L}, {_COVER_SOME}, dd as (select vault, bool_or(not reference) p from n group by vault, title having count(*) > 1),
du as (select vault, count(*) filter (p) ambiguous, count(*) filter (not p) ambiguous_reference from dd group by 1),
orp as (select vault, count(*) orphans from n where not exists (select 1 from e where e.vault = n.vault and e.target = n.title) group by 1),
br as (select vault, count(*) broken from e where not exists (select 1 from n where n.vault = e.vault and n.title = e.target)
  and not exists (select 1 from n where n.vault in (select name from vaults) and strpos(e.target, '/') > 1 and length(e.target) > strpos(e.target, '/')
  and n.vault = substr(e.target, 1, strpos(e.target, '/') - 1) and n.title = substr(e.target, strpos(e.target, '/') + 1)) group by 1)
select au.vault, included, reference, skipped, skipped_dependency, coalesce(ambiguous, 0) ambiguous, coalesce(ambiguous_reference, 0) ambiguous_reference, coalesce(orphans, 0) orphans,
coalesce(broken, 0) broken, case when st.vault is not null then coalesce(embedded, 0) end embedded, coalesce(missing_project, 0) missing_project,
case when st.vault is not null then coalesce(missing_reference, 0) else 0 end missing_reference
from au left join du using (vault) left join orp using (vault) left join br using (vault) left join cv using (vault) left join (select distinct vault from vectors where vault <> 'atlas-handbook') st using (vault)""",
    "pack_report": f"with {NOTES} select vault, count(*) filter (not reference) packed, count(*) filter (reference) skipped_reference from n group by 1",
    "debounce_batches": """with recursive o as (select update_id, vault, epoch_us(received_at) t, row_number() over (partition by vault order by received_at, update_id) r from note_updates where received_at is not null),
b as (select update_id, vault, t, r, t s from o where r = 1 union all
  select o.update_id, o.vault, o.t, o.r, case when o.t - b.s >= 21600000000 then o.t else b.s end from b join o on o.vault = b.vault and o.r = b.r + 1)
select update_id, vault, s start_us from b union all select update_id, vault, null from note_updates where received_at is null""",
}
QUERIES = {name: globals()[name] for name in SQL}
