"""Registered queries over vaults on disk, with their SQL.

The notes that are alive are written as files, a folder for each vault, with rules of scope of each kind: the table's
sources are include roots with configurations of their own, ``.gitignore`` leaves out every ``Index.md``, the vault's own
ignore file every folder ``archive``, and the configuration every ``CHANGELOG.md``. What the engine then lists, reads,
indexes and watches must be what SQL finds in the tables. A session writes the files of a data folder once."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.engine import Engine
from notelake.functions.notes import is_newer, name_from_url, trust
from notelake.operators import graph as G
from notelake.operators import health as H
from notelake.plans.prelude import LINKS, NOTES, WS
from notelake.plans.search_queries import _CHUNKS, _RANKED, LIMIT, TEXT
from notelake.session import shared_folder
from notelake.sources import vault as V
from notelake.sources.registry import Registry, sources_table
from notelake.sources.scope import Scope, scope_summary
from notelake.sources.tables import table


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _place(spark: SparkSession, folder: str) -> str:
    name = hashlib.sha256(f"{spark.sparkContext.applicationId} {folder}".encode()).hexdigest()[:16]
    return f"{_local(shared_folder(spark))}/vaults-{name}"


def _write(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def _vaults(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and folders of the vaults, written if they are not there. The shared folder must be a mounted one."""
    top = _place(spark, folder)
    names = sorted(r["name"] for r in table(spark, folder, "vaults").collect())
    roots = {n: f"{top}/vaults/{n}" for n in names}
    if os.path.exists(f"{top}/done"):
        return roots

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vault, key, body in zip(*(c.to_pylist() for c in batch.columns)):
                _write(f"{top}/vaults/{vault}/{key}", body)
            yield batch.select([1])

    G.snapshot(table(spark, folder, "notes")).select("vault", "key", "body").mapInArrow(put, "key string").write.format("noop").mode("overwrite").save()
    sources = table(spark, folder, "sources").collect()
    for name, root in roots.items():
        mine = [r for r in sources if r["vault"] == name]
        include = ", ".join(json.dumps(r["prefix"], ensure_ascii=False) for r in mine)
        _write(f"{root}/vault.toml", f'[vault]\nlicense = "CC0"\n[scope]\nexclude = ["CHANGELOG.md"]\ninclude = [{include}]\n')
        _write(f"{root}/.gitignore", "Index.md\n")
        _write(f"{root}/.vaultignore", "archive/\n")
        for r in mine:
            if os.path.isdir(f"{root}/{r['prefix']}"):
                stated = [f"{k} = {json.dumps(r[k], ensure_ascii=False)}" for k in ("name", "license", "version") if r[k] is not None]
                _write(f"{root}/{r['prefix']}/vault.toml", "\n".join(["[vault]", *stated]) + "\n")
    _write(f"{top}/done", "")
    return roots


def _engine(spark: SparkSession, folder: str) -> Engine:
    """The engine over the written vaults, refreshed once; Thai runs stay whole, as SQL has no dictionary."""
    roots, top = _vaults(spark, folder), _place(spark, folder)
    engine = Engine(spark, f"{top}/registry.json", f"file:{top}/store", segment=None)
    if not engine.registry.list():
        for name, root in roots.items():
            os.makedirs(root, exist_ok=True)
            engine.registry.add(name, root)
    if engine.store.current() is None:
        engine.refresh()
    return engine


def vault_listing(spark, folder):
    return V.read_vaults(spark, _vaults(spark, folder), bodies=False).select("vault", "key", "title", "reference")


def vault_bodies(spark, folder):
    return V.read_vaults(spark, _vaults(spark, folder)).select("vault", "key", "hash", F.length("body").cast("long").alias("chars"))


def registry_vaults(spark, folder):
    _engine(spark, folder)
    return Registry(f"{_place(spark, folder)}/registry.json").table(spark).select("name")


def installed_sources(spark, folder):
    return sources_table(spark, _vaults(spark, folder)).select("vault", "prefix", "name", "license", "version")


def scope_audit(spark, folder):
    rows = [(name, (a := Scope(root).audit()).included, a.reference, a.skipped, a.skipped_dependency, scope_summary(a).split(":")[0]) for name, root in _vaults(spark, folder).items()]
    return spark.createDataFrame(rows, "vault string, included bigint, reference bigint, skipped bigint, skipped_dependency bigint, summary string")


def may_include(spark, folder):
    """Keys that could be notes by name and place alone, of all notes of the table."""
    roots = _vaults(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes = {name: Scope(root) for name, root in roots.items()}
        for batch in batches:
            told = [v in scopes and scopes[v].may_include(k) for v, k in zip(*(c.to_pylist() for c in batch.columns))]
            yield batch.filter(pa.array(told))

    return G.snapshot(table(spark, folder, "notes")).select("vault", "key").mapInArrow(run, "vault string, key string")


def store_notes(spark, folder):
    return _engine(spark, folder).notes().select("vault", "key", "title", "reference", "hash")


def store_edges(spark, folder):
    return _engine(spark, folder).edges().select("vault", "from_key", "target")


def store_search(spark, folder):
    return _engine(spark, folder).search(TEXT, limit=LIMIT).select("vault", "key", F.col("rank").cast("long").alias("rank"))


def store_vectors(spark, folder):
    """What embedding writes, with an embedder that tells a passage's length; reference notes are not embedded."""
    engine = _engine(spark, folder)
    engine.embed(lambda texts: [[float(len(t)), 1.0] for t in texts], "lengths", 2)
    return engine.store.read("vectors").select("vault", "key", "chunk_ix", F.element_at("embedding", 1).cast("long").alias("chars"))


def watch_changes(spark, folder):
    """The first batch of the stream of changes: every note in scope is new."""
    top = _place(spark, folder)
    out = f"file:{top}/changes"
    if not os.path.exists(f"{top}/changes"):
        stream = V.stream_changes(spark, _vaults(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file:{top}/changes-checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("vault", "key", "op")


def note_access(spark, folder):
    """Creating, writing, reading and deleting single notes, and what is refused."""
    root = f"{_place(spark, folder)}/scratch"
    _write(f"{root}/vault.toml", '[scope]\ninclude = ["vendor/h"]\n')
    _write(f"{root}/vendor/h/Ref.md", "ref")
    rows = []

    def told(step: str, call) -> None:
        try:
            rows.append((step, str(call())))
        except V.NoteError:
            rows.append((step, "refused"))

    if os.path.exists(f"{root}/New.md"):
        os.remove(f"{root}/New.md")
    told("create", lambda: V.create_note(root, "New"))
    told("create again", lambda: V.create_note(root, "New"))
    told("put", lambda: V.put_note(root, "a/b.md", "text"))
    told("put out of scope", lambda: V.put_note(root, "node_modules/b.md", "text"))
    told("put reference", lambda: V.put_note(root, "vendor/h/Ref.md", "x"))
    told("put outside", lambda: V.put_note(root, "../b.md", "x"))
    told("get", lambda: V.get_note(root, "a/b.md")[0])
    told("get reference", lambda: V.get_note(root, "vendor/h/Ref.md")[2])
    told("get nothing", lambda: V.get_note(root, "none.md"))
    told("delete", lambda: V.delete_note(root, "a/b.md"))
    told("delete again", lambda: V.delete_note(root, "a/b.md"))
    return spark.createDataFrame(rows, "step string, result string")


def links_of_title(spark, folder):
    """For every title: what its notes link to, the titles that link to it, and links from other vaults."""
    n = G.snapshot(table(spark, folder, "notes"))
    e = G.edges(n)
    forward = G.links_for_title(n, e).select("vault", "title", F.lit("forward").alias("kind"), F.col("target").alias("other"))
    back = G.backlink_titles(e).select("vault", F.col("target").alias("title"), F.lit("back").alias("kind"), F.col("title").alias("other"))
    away = G.cross_vault_backlinks(e).select("vault", "title", F.lit("away").alias("kind"), F.col("from_node").alias("other"))
    return forward.unionByName(back).unionByName(away)


def _signatures(spark, folder):
    code = F.substring(F.lit("GUXYRBENZ"), F.pmod(F.length("name") + F.length("prefix"), F.lit(9)) + 1, 1)
    key = F.substring("name", 1, 1)
    pinned = F.when(F.pmod(F.length("prefix"), F.lit(3)) == 0, key).when(F.pmod(F.length("prefix"), F.lit(3)) == 1, F.lit("?"))
    changes = F.when(F.pmod(F.length("name"), F.lit(5)) == 0, F.array(F.lit("README.md"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "sources").select(F.concat_ws("/", "vault", "prefix").alias("name"), code.alias("trust_code"), key.alias("key"), pinned.alias("pinned"), changes.alias("changes"))


def verify_sources(spark, folder):
    return H.verify(_signatures(spark, folder)).select("name", "wrong", "proven")


def trust_meanings(spark, folder):
    return _signatures(spark, folder).select("name", (trust("trust_code") == trust(F.lit("N"))).alias("unsigned"))


def name_of_url(spark, folder):
    s = table(spark, folder, "sources")
    return s.select("vault", "prefix", name_from_url(F.concat(F.lit("https://example.org/"), "prefix", F.when(F.length("prefix") % 2 == 0, ".git").otherwise("/"))).alias("name"))


def newer_version(spark, folder):
    return table(spark, folder, "sources").select("vault", "prefix", is_newer("version", F.lit("v2.3.4")).alias("older"))


_DIRS = "list_slice(string_split({0}, '/'), 1, len(string_split({0}, '/')) - 1)"
_DEPS = "['node_modules', 'bower_components', 'vendor', 'site-packages', '__pycache__', 'Pods']"
_SEEN = f"""{NOTES.replace("n as (", "n0 as (", 1)}, al as (select n.*, exists (select 1 from sources s where s.vault = n.vault and starts_with(n."key", s.prefix||'/') and not regexp_matches(substr(n."key", length(s.prefix) + 2), '(^|/)\\.')) inc,
  exists (select 1 from sources s where s.vault = n.vault and (n."key" = s.prefix or starts_with(n."key", s.prefix||'/'))) ref,
  regexp_matches(n."key", '(^|/)\\.') hidden, list_has_any({_DIRS.format('n."key"')}, {_DEPS}) dep, list_contains({_DIRS.format('n."key"')}, 'archive') arch,
  regexp_extract(n."key", '[^/]*$') last from n0 n where n.vault in (select name from vaults)),
insc as (select *, ends_with("key", '.md') and (inc or (not hidden and not dep and not arch and last not in ('Index.md', 'CHANGELOG.md'))) ins from al)"""
_SCOPED = _SEEN + """, sn as (select vault, "key", title, ref reference, body from insc where ins)"""


def _over_scope(sql: str) -> str:
    """A query over the notes in scope in place of the table's."""
    return sql.replace(NOTES, _SCOPED + """, n as (select vault, "key", title, reference, null mtime_ns, sha256(body) hash, body from sn)""")


_CODE = "substr('GUXYRBENZ', (length(name) + length(prefix)) % 9 + 1, 1)"
SQL = {
    "vault_listing": f'with {_SCOPED} select vault, "key", title, reference from sn',
    "vault_bodies": f'with {_SCOPED} select vault, "key", sha256(body) hash, length(body) chars from sn',
    "registry_vaults": "select name from vaults",
    "installed_sources": f"""with {_SEEN} select distinct s.vault, prefix, s.name, license, version from sources s join n0 n on n.vault = s.vault and starts_with(n."key", s.prefix||'/')""",
    "scope_audit": f"""with {_SEEN}, c as (select v.name vault, count(*) filter (ins) included, count(*) filter (ins and ref) reference, count(*) filter (not ins and not hidden and ends_with("key", '.md')) skipped,
count(*) filter (not ins and not hidden and dep and ends_with("key", '.md')) skipped_dependency from vaults v left join insc sc on sc.vault = v.name group by 1)
select *, included||' notes ('||reference||' reference), '||skipped||' other Markdown files'||case when skipped > 0 then ' ('||skipped_dependency||' in dependency folders)' else '' end summary from c""",
    "may_include": f"""with {_SEEN} select vault, "key" from insc sc where ends_with("key", '.md') and (exists (select 1 from sources s where s.vault = sc.vault and starts_with(sc."key", s.prefix||'/'))
or (not hidden and not dep and last <> 'CHANGELOG.md'))""",
    "store_notes": f'with {_SCOPED} select vault, "key", title, reference, sha256(body) hash from sn',
    "store_edges": _over_scope(f"with {LINKS} select vault, from_key, target from e"),
    "store_search": _over_scope(f'with {_RANKED} select vault, "key", rank from rk'),
    "store_vectors": _over_scope(f"""with recursive {_CHUNKS}, ps as (select vault, "key", cast(chunk_ix as int) chunk_ix, length('passage: '||case when chunk_ix = 0 then title||chr(10)||chr(10)||chunk else chunk end) chars from pc
union all select vault, "key", 0, length('passage: '||title) from n where length(trim(body, {WS})) = 0) select ps.* from ps where (vault, "key") in (select (vault, "key") from sn where not reference)"""),
    "watch_changes": f"""with {_SCOPED} select vault, "key", 'added' op from sn""",
    "note_access": """select * from (values ('create', 'New.md'), ('create again', 'refused'), ('put', 'True'), ('put out of scope', 'False'), ('put reference', 'refused'), ('put outside', 'refused'),
('get', 'text'), ('get reference', 'True'), ('get nothing', 'refused'), ('delete', 'None'), ('delete again', 'refused')) t(step, result)""",
    "links_of_title": f"""with {LINKS}, x as (select vault, regexp_replace(regexp_extract(from_key, '([^/]*)$', 1), '\\.md$', '') ft, target from e)
select distinct vault, ft title, 'forward' kind, target other from x union all select distinct vault, target, 'back', ft from x
union all select distinct substr(target, 1, strpos(target, '/') - 1), substr(target, strpos(target, '/') + 1), 'away', vault||'/'||ft from x
where strpos(target, '/') > 1 and length(target) > strpos(target, '/') and substr(target, 1, strpos(target, '/') - 1) <> vault""",
    "verify_sources": f"""with s as (select vault||'/'||prefix name, {_CODE} c, case when length(prefix) % 3 = 0 then true when length(prefix) % 3 = 1 then false end same, length(name) % 5 = 0 changed from sources),
w as (select name, c, c = 'B' or changed or (same is not null and not (same and c in ('G', 'U'))) wrong from s) select name, wrong, c in ('G', 'U') and not wrong proven from w""",
    "trust_meanings": f"select vault||'/'||prefix name, {_CODE} in ('N', 'Z') unsigned from sources",
    "name_of_url": r"select vault, prefix, case when starts_with(b, '.') or b = '' then null else b end name from (select vault, prefix, regexp_replace(regexp_extract(prefix, '([^/:]+)$', 1), '\.git$', '') b from sources)",
    "newer_version": r"""with p as (select vault, prefix, regexp_extract(version, '^v?(\d+\.\d+\.\d+)', 1) v from sources)
select vault, prefix, coalesce(case when v <> '' then list_transform(string_split(v, '.'), lambda x: cast(x as int)) < [2, 3, 4] end, false) older from p""",
}
QUERIES = {name: globals()[name] for name in SQL}
