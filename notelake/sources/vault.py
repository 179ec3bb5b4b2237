"""Vaults as Spark tables: a Python data source ``vault`` for batch and stream, and the writes that one note needs.

The built-in file sources are no use here: they drop names with a leading underscore, know no ignore rules, and as a
stream never report an edited or a deleted file. A read lists the folders in the task of each first-level folder, so
that a large vault is listed and read in parallel; bodies are read only if the schema that is asked for has them."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from notelake.functions.notes import DEPENDENCY_DIRS
from notelake.sources.scope import Config, Note, Scope, is_note_name

LISTING = "vault string, key string, title string, reference boolean, mtime_ns bigint"
NOTES = f"{LISTING}, hash string, body string"
CHANGES = "vault string, key string, op string, mtime_ns bigint"


def _vaults(options: dict) -> dict[str, str]:
    """``name=path`` pairs of the option ``vaults`` (JSON) or of ``path`` and ``name``."""
    if options.get("vaults"):
        return dict(json.loads(options["vaults"]))
    if not options.get("path"):
        raise ValueError("the source needs the option path, or vaults")
    return {options.get("name") or os.path.basename(os.path.normpath(options["path"])): options["path"]}


def content_hash(body: str) -> str:
    return hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()


class _Part(InputPartition):
    def __init__(self, vault: str, root: str, keys: list[str] | None, start: str) -> None:
        self.vault, self.root, self.keys, self.start = vault, root, keys, start


class VaultReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.fields = [f.name for f in schema.fields]
        self.vaults = _vaults(options)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name, root in self.vaults.items():
            scope = Scope(root)
            # what lies at the top, and each first-level folder of its own
            tops = [p for p, is_dir in _top(scope) if is_dir]
            out += [_Part(name, root, None, t) for t in tops]
            at = f"{scope.notes_dir}/" if scope.notes_dir else ""
            out.append(_Part(name, root, [at + p for p, is_dir in _top(scope) if not is_dir and is_note_name(p)], ""))
            out += [_Part(name, root, None, "\0" + r.prefix) for r in scope.includes if r.present]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        scope = Scope(partition.root)
        at = f"{scope.notes_dir}/" if scope.notes_dir else ""
        if partition.keys is not None:
            keys = partition.keys
        elif partition.start.startswith("\0"):
            # an include root within the main scan gives only what that scan leaves out
            keys = list(scope._include_walk(partition.start[1:]))
            first = {r.prefix for r in scope.includes[: [r.prefix for r in scope.includes].index(partition.start[1:])]}
            keys = [k for k in keys if not any(k.startswith(p + "/") for p in first) and not _in_main(scope, k)]
        else:
            top_rules = scope._read_rules(os.path.join(scope.root, scope.notes_dir), "")
            keys = [at + p for p, is_dir in scope.walk(partition.start, top_rules) if not is_dir and is_note_name(p.rsplit("/", 1)[-1])]
        for key in keys:
            row = _row(scope, partition.vault, key, self.fields)
            if row is not None:
                yield row


def _top(scope: Scope) -> list[tuple[str, bool]]:
    shallow = Scope(scope.root, Config(**{**scope.config.__dict__, "max_depth": 1}))
    return list(shallow.walk()) if os.path.isdir(os.path.join(scope.root, scope.notes_dir)) else []


def _in_main(scope: Scope, key: str) -> bool:
    at = f"{scope.notes_dir}/" if scope.notes_dir else ""
    if not key.startswith(at):
        return False
    rel = key[len(at) :]
    parts = rel.split("/")
    own, git = [], []
    for k in range(len(parts)):
        path, is_dir = "/".join(parts[: k + 1]), k < len(parts) - 1
        more = scope._read_rules(os.path.join(scope.root, scope.notes_dir, *parts[:k]), "/".join(parts[:k]))
        own, git = own + more[0], git + more[1]
        if parts[k].startswith(".") or (is_dir and parts[k] in DEPENDENCY_DIRS) or scope._ignored(own, git, path, is_dir):
            return False
    return not (scope.config.max_depth and len(parts) > scope.config.max_depth)


def in_scope(scope: Scope, key: str) -> bool:
    """Whether a key is one of the scope's notes, by the rules on its own path; no folder is listed."""
    if not is_note_name(key.rsplit("/", 1)[-1]):
        return False
    below = next((key[len(r.prefix) + 1 :] for r in scope.includes if r.present and key.startswith(r.prefix + "/")), None)
    if below is not None and not any(p.startswith(".") for p in below.split("/")):
        return True
    return _in_main(scope, key)


def _row(scope: Scope, vault: str, key: str, fields: list[str]) -> tuple | None:
    path = os.path.join(scope.root, key)
    try:
        note = Note(key, path, scope.is_reference(key))
        values = {"vault": vault, "key": key, "title": note.title, "reference": note.reference, "mtime_ns": os.stat(path).st_mtime_ns}
        if "body" in fields or "hash" in fields:
            body = Path(path).read_bytes().decode("utf-8")
            values |= {"body": body, "hash": content_hash(body)}
        key.encode("utf-8")
    except FileNotFoundError:
        return None
    except UnicodeEncodeError:
        return None
    except UnicodeDecodeError as e:
        raise NoteError(f"{path!r} is not UTF-8: {e.reason} at byte {e.start}") from e
    return tuple(values[f] for f in fields)


class ChangeReader(SimpleDataSourceStreamReader):
    """Polls the vaults; an offset is the listing it saw, so that a restarted query reports what changed meanwhile."""

    def __init__(self, options: dict) -> None:
        self.vaults = _vaults(options)

    def _listing(self) -> dict[str, int]:
        out = {}
        for name, root in self.vaults.items():
            scope = Scope(root)
            for key in scope.keys():
                try:
                    out[f"{name}\n{key}"] = os.stat(os.path.join(root, key)).st_mtime_ns
                except FileNotFoundError:
                    continue
        return out

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._listing()
        return iter(self._between(json.loads(start["seen"]), now)), {"seen": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(json.loads(start["seen"]), json.loads(end["seen"])))

    @staticmethod
    def _between(before: dict, after: dict) -> list[tuple]:
        out = []
        for at in sorted(before.keys() | after.keys()):
            vault, key = at.split("\n", 1)
            if at not in after:
                out.append((vault, key, "removed", None))
            elif at not in before or before[at] != after[at]:
                out.append((vault, key, "added" if at not in before else "changed", after[at]))
        return out


class VaultSource(DataSource):
    """``spark.read.format("vault").option("path", folder)``; as a stream, the changes."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return CHANGES if self.options.get("changes") == "true" else LISTING if self.options.get("listing") == "true" else NOTES

    def reader(self, schema: StructType) -> DataSourceReader:
        return VaultReader(schema, dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return ChangeReader(dict(self.options))


def read_vaults(spark: SparkSession, vaults: dict[str, str], bodies: bool = True) -> DataFrame:
    """The notes of the vaults (name to folder); without ``bodies`` only names and times, for which no file is opened."""
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").option("vaults", json.dumps(vaults)).option("listing", str(not bodies).lower()).load()


def stream_changes(spark: SparkSession, vaults: dict[str, str]) -> DataFrame:
    """A stream of ``vault, key, op, mtime_ns``; ``op`` is added, changed or removed."""
    spark.dataSource.register(VaultSource)
    return spark.readStream.format("vault").option("vaults", json.dumps(vaults)).option("changes", "true").load()


# ---- one note ----


class NoteError(ValueError):
    """A note cannot be read or written."""


def check_key(key: str) -> None:
    """The rules of ``functions.notes.validate_key``, for one key."""
    problem = (
        "empty"
        if not key
        else "backslash"
        if "\\" in key
        else "nul"
        if "\0" in key
        else "absolute"
        if key.startswith("/") or key[1:2] == ":"
        else "not a note"
        if not key.endswith(".md")
        else "segment"
        if any(p in ("", ".", "..") for p in key.split("/"))
        else None
    )
    if problem:
        raise NoteError(f"{key!r} is no note's key: {problem}")


def resolve_key(root: str, key: str) -> str:
    """The file of a valid key; refused if links lead its folder out of the vault."""
    check_key(key)
    path = os.path.join(root, key)
    there = path
    while not os.path.exists(there):
        there = os.path.dirname(there)
    real, top = os.path.realpath(there), os.path.realpath(root)
    if real != top and not real.startswith(top + os.sep):
        raise NoteError(f"{key!r} leads out of the vault")
    return path


def _own(scope: Scope, key: str) -> None:
    if scope.is_reference(key):
        raise NoteError(f"{key!r} is a reference note, which is read-only")


def create_note(root: str, title: str) -> str:
    """A new note at the root with its heading; the key."""
    scope = Scope(root)
    key = (f"{scope.notes_dir}/" if scope.notes_dir else "") + f"{title}.md"
    path = resolve_key(root, key)
    _own(scope, key)
    if os.path.exists(path):
        raise NoteError(f"{key!r} exists")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "x", encoding="utf-8", newline="") as f:
        f.write(f"# {title}\n\n")
    return key


def put_note(root: str, key: str, body: str) -> bool:
    """Writes a note; whether it is in scope."""
    scope = Scope(root)
    path = resolve_key(root, key)
    _own(scope, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(body)
    return in_scope(Scope(root), key)


def get_note(root: str, key: str) -> tuple[str, str, bool]:
    """``body, title, reference`` of a note."""
    path = resolve_key(root, key)
    if not os.path.isfile(path):
        raise NoteError(f"there is no note {key!r}")
    return Path(path).read_bytes().decode("utf-8"), Note(key, path, False).title, Scope(root).is_reference(key)


def delete_note(root: str, key: str) -> None:
    scope = Scope(root)
    path = resolve_key(root, key)
    _own(scope, key)
    if not os.path.isfile(path):
        raise NoteError(f"there is no note {key!r}")
    os.remove(path)


def same_key(a: str, b: str) -> bool:
    """Whether two keys differ in nothing but the composition of their accents."""
    return unicodedata.normalize("NFC", a) == unicodedata.normalize("NFC", b)


