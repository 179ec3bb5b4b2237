"""The engine: vaults on disk or tables of notes, refreshed into snapshots and asked by one API."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import title_of
from notelake.functions.tokens import thai_words
from notelake.operators import graph as G
from notelake.operators import health as H
from notelake.operators import refresh as R
from notelake.operators import search as S
from notelake.session import cut, ship
from notelake.sources import vault as V
from notelake.sources.registry import Registry, sources_table
from notelake.sources.scope import CONFIG_FILE, Scope
from notelake.sources.store import Store

KEY = ["vault", "key"]


class Engine:
    """Vaults of a registry, with their derived tables in a store."""

    def __init__(self, spark: SparkSession, registry: str, store: str, segment: object | None = thai_words) -> None:
        """``segment`` cuts Thai runs into words, in the index as in queries; without one they stay whole."""
        self.segment = segment
        self.spark = ship(spark)
        self.registry = Registry(registry)
        self.store = Store(spark, store)

    # -- refresh --

    def refresh(self, full: bool = False, vaults: list[str] | None = None) -> DataFrame:
        """Brings the derived tables up to date (of ``vaults`` only, the others kept); the report per vault that changed. Only
        files whose time changed are read, and only vaults with a change are written."""
        known = self.registry.list()
        meta = self.store.current()
        upgraded = meta is not None and R.needs_rebuild(meta.get("index_version"))
        full = full or meta is None or upgraded
        asked = known if vaults is None or full else {n: r for n, r in known.items() if n in vaults}
        if not asked:
            return R.report(self.spark.createDataFrame([], "vault string, key string, change string"))
        if full:
            # read once, whatever is derived from it
            self._publish(cut(V.read_vaults(self.spark, asked)), sorted(asked))
            return R.report(self.store.read("notes").select(*KEY, F.lit("added").alias("change")))
        state = self.store.read("state", list(asked))
        listing = V.read_vaults(self.spark, asked, bodies=False)
        due = R.needs_hash(listing, state)
        # a change of a file between two reads must not split the tables, so what was read is kept
        bodies = cut(V.read_vaults(self.spark, asked).join(due, KEY, "left_semi"))
        hashed = listing.join(bodies.select(*KEY, "hash"), KEY, "left")
        changes = cut(R.diff(hashed, state).where("change <> 'unchanged'"))
        report = R.report(changes)
        touched = sorted(r["vault"] for r in changes.select("vault").distinct().collect())
        if touched:
            old = self.store.read("notes", touched)
            fresh = bodies.join(changes.where(F.col("change").isin("added", "changed")).select(*KEY), KEY, "left_semi")
            notes = R.apply_rows(old, changes, fresh)
            moved = bodies.join(changes.where("change = 'touched'").select(*KEY), KEY, "left_semi").select(*KEY, F.col("mtime_ns").alias("_m"))
            notes = notes.join(moved, KEY, "left").withColumn("mtime_ns", F.coalesce("_m", "mtime_ns")).drop("_m")
            self._publish(notes, touched, changes, fresh)
        return report

    def _publish(self, notes: DataFrame, vaults: list[str], changes: DataFrame | None = None, fresh: DataFrame | None = None) -> None:
        def table(name: str, make) -> DataFrame:
            if changes is None:
                return make(notes)
            apply = R.apply_edges if name == "edges" else R.apply_rows
            return apply(self.store.read(name, vaults), changes, make(fresh))

        tables = {"notes": notes, "edges": table("edges", G.edges), "postings": table("postings", lambda n: S.postings(n, self.segment)), "lengths": table("lengths", lambda n: S.lengths(n, self.segment))}
        tables["degrees"] = G.degrees(notes, tables["edges"])
        tables["state"] = notes.select(*KEY, "mtime_ns", "hash")
        self.store.publish(tables, vaults, keep=list(self.registry.list()), index_version=R.INDEX_VERSION)

    # -- tables --

    def notes(self, vault: str | None = None) -> DataFrame:
        return self._of("notes", vault)

    def edges(self, vault: str | None = None) -> DataFrame:
        return self._of("edges", vault)

    def vaults(self) -> DataFrame:
        return self.registry.table(self.spark)

    def sources(self) -> DataFrame:
        return sources_table(self.spark, self.registry.list())

    def _of(self, name: str, vault: str | list[str] | None = None) -> DataFrame:
        df = self.store.read(name, [vault] if isinstance(vault, str) else vault)
        if df is None:
            raise LookupError("nothing is indexed yet: refresh first")
        return df

    def views(self) -> None:
        """The tables as temporary views, for SQL."""
        for name in ("notes", "edges", "postings"):
            self._of(name).createOrReplaceTempView(name)
        self.vaults().createOrReplaceTempView("vaults")
        self.sources().createOrReplaceTempView("sources")

    # -- queries --

    def list(self, vault: str | None = None) -> DataFrame:
        return self.notes(vault).select("vault", "key", "title", "reference").orderBy("vault", "title", "key")

    def search(
        self, text: str, vaults: list[str] | None = None, limit: int = S.DEFAULT_LIMIT, total: bool = False, chars: int = 150, query_vector: list[float] | None = None, refresh: bool = False
    ) -> DataFrame:
        """``vault, key, title, score, rank, snippet, source, license``: up to ``limit`` hits per vault, or of all together. Nothing
        indexed gives no hits; with ``refresh`` what is searched is brought up to date first."""
        if refresh:
            self.refresh(vaults=vaults)
        if self.store.current() is None:
            return S.empty_hits(self.spark)
        notes = self._of("notes", vaults)
        pick = lambda t: self._of(t, vaults)
        vectors = self.store.read("vectors", vaults)
        q = None if query_vector is None or vectors is None else self.spark.createDataFrame([(query_vector,)], "q array<double>")
        hits = S.search(notes, pick("degrees"), text, limit, vectors, q, (pick("postings"), pick("lengths")), self.segment)
        if total:
            hits = S.total(hits, S.clamp(limit))
        shown = S.with_snippets(hits, notes, text, chars, self.segment)
        named = G.attribution(shown, self.sources()).select(*KEY, "source", "license")
        return shown.join(named, KEY, "left").orderBy(F.desc("score"), "vault", "rank") if total else shown.join(named, KEY, "left").orderBy("vault", "rank")

    def links(self, vault: str, title: str) -> tuple[DataFrame, DataFrame]:
        """Targets and backlink titles of all notes of a title, the note itself kept among them."""
        e = self.edges(vault)
        forward = G.links_for_title(self.notes(vault), e).where(F.col("title") == title).select("target").orderBy("target")
        back = e.where(F.col("target") == title).select(title_of("from_key").alias("title")).distinct().orderBy("title")
        away = G.cross_vault_backlinks(self.edges()).where((F.col("vault") == vault) & (F.col("title") == title)).select(F.col("from_node").alias("title"))
        return forward, back.unionByName(away)

    def note(self, vault: str, key: str) -> dict:
        """Body, title, whether it is a reference, and its source."""
        body, title, reference = V.get_note(self._root(vault), key)
        one = self.spark.createDataFrame([(vault, key)], "vault string, key string")
        source = G.attribution(one, self.sources()).select("source", "license").collect()
        return {"body": body, "title": title, "reference": reference, "source": source[0].asDict() if source else None}

    def note_links(self, vault: str, key: str) -> tuple[DataFrame, DataFrame]:
        """Targets with the keys they reach, and the other notes that link here."""
        n, e = self.notes(vault), self.edges(vault)
        return G.note_links(n, e.where(F.col("from_key") == key)), G.note_backlinks(n.where(F.col("key") == key), e)

    def orphans(self, vault: str | None = None) -> DataFrame:
        return G.orphans(self.notes(vault), self.edges(vault)).orderBy("vault", "title", "key")

    def broken(self, vault: str | None = None) -> DataFrame:
        out = G.broken_links(self.notes(), self.edges(), self.vaults())
        return (out if vault is None else out.where(F.col("vault") == vault)).orderBy("vault", "from_key", "target")

    def graph(self, vault: str | None = None) -> tuple[DataFrame, DataFrame]:
        return G.graph(self.notes(vault), self.edges(vault), self.vaults())

    def doctor(self) -> DataFrame:
        model = (self.store.current() or {}).get("model")
        return H.doctor(self.notes().select(*KEY), self.notes(), self.edges(), self.vaults(), self.store.read("vectors"), model[1] if model else None)

    # -- changes --

    def _root(self, vault: str) -> str:
        root = self.registry.get(vault)
        if root is None:
            raise LookupError(f"there is no vault {vault!r}")
        return root

    def create(self, vault: str, title: str) -> str:
        return V.create_note(self._root(vault), title)

    def save(self, vault: str, key: str, body: str) -> bool:
        in_scope = V.put_note(self._root(vault), key, body)
        self.refresh(vaults=[vault])
        return in_scope

    def delete(self, vault: str, key: str) -> list[str]:
        """Deletes a note; the titles of the notes whose links dangle now."""
        back = G.dangling_backlinks(self.notes(vault), self.edges(vault)).where(F.col("key") == key)
        titles = sorted(r["title"] for r in back.select("title").collect())
        V.delete_note(self._root(vault), key)
        self.refresh(vaults=[vault])
        return titles

    def rename(self, vault: str, old: str, new: str) -> dict:
        """Renames the first note of a title and the links to it; ``notes``, ``links`` and ``skipped`` (read-only ones)."""
        root, n = self._root(vault), self.notes(vault)
        found = [r for r in G.find_notes(n, vault, old).limit(1).collect()]
        if not found:
            raise LookupError(f"there is no note {old!r}")
        if found[0]["reference"]:
            raise V.NoteError(f"{old!r} is a reference note, which is read-only")
        if G.find_notes(n, vault, new).limit(1).count():
            raise V.NoteError(f"there is a note {new!r} already")
        written, report = G.rename(n, self.edges(vault), vault, old, new)
        counts = report.collect()[0].asDict()
        # files are changed where they lie, one at a time
        for row in written.toLocalIterator():
            V.put_note(root, row["key"], row["body"])
        key = found[0]["key"]
        target = os.path.join(os.path.dirname(key), f"{new}.md")
        os.replace(V.resolve_key(root, key), V.resolve_key(root, target))
        self.refresh(vaults=[vault])
        return counts

    def embed(self, embedder, model: str, dim: int, include_reference: bool = False) -> DataFrame:
        """Embeds the notes that need it and drops vectors of notes that are gone; counts by what was done, per vault."""
        from notelake.functions.chunks import passages

        meta = self.store.current() or {}
        R.claim(meta.get("model"), model, dim)
        notes = self.notes()
        stored = self.store.read("vectors")
        stored = stored if stored is not None else self.spark.createDataFrame([], "vault string, key string, hash string, chunk_ix int, embedding array<float>")
        plan = R.embed_plan(notes, stored, include_reference)
        made = R.embed(passages(notes), plan, embedder)
        gone = plan.where(F.col("plan").isin("embed", "remove")).select(*KEY)
        vectors = stored.join(gone, KEY, "left_anti").unionByName(made.select(*stored.columns))
        counts = self.spark.createDataFrame([r for r in plan.groupBy("vault", "plan").agg(F.count("*").alias("n")).collect()], "vault string, plan string, n bigint")
        touched = sorted(r["vault"] for r in gone.select("vault").distinct().collect())
        if touched:
            # other tables and the rows of other vaults stay where they are
            self.store.publish({"vectors": vectors.where(F.col("vault").isin(*touched))}, touched, model=[model, dim])
        return counts

    def pack(self, vault: str, target: str, include_reference: bool = False) -> dict:
        """Copies the notes of a vault and its configuration to an empty folder; needs a stated licence."""
        root = self._root(vault)
        scope = Scope(root)
        if not scope.config.license:
            raise V.NoteError("a pack needs [vault] license in the configuration")
        if os.path.realpath(target) == os.path.realpath(root):
            raise V.NoteError("a vault cannot be packed into itself")
        if os.path.isdir(target) and os.listdir(target):
            raise V.NoteError("the target folder is not empty")
        packed = skipped = 0
        for note in scope.notes():
            if note.reference and not include_reference:
                skipped += 1
                continue
            to = os.path.join(target, note.key)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            shutil.copyfile(note.path, to)
            packed += 1
        os.makedirs(target, exist_ok=True)
        if os.path.exists(os.path.join(root, CONFIG_FILE)):
            shutil.copyfile(os.path.join(root, CONFIG_FILE), os.path.join(target, CONFIG_FILE))
        return {"packed": packed, "skipped_reference": skipped}


