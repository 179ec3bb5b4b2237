"""What is a note of a vault: its configuration, the rules of scope, and the walk over its folders.

A vault is a folder. The rules say which Markdown files in it are notes: the main scan follows ``.gitignore`` (unless
turned off), the vault's own ignore file and the configured exclusions, leaves out hidden names and folders of
third-party code; each include root is scanned besides, for reference notes, under no rule but hidden names. Folders
that the rules leave out are never listed.
"""

from __future__ import annotations

import os
import tomllib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from notelake.functions.notes import DEPENDENCY_DIRS
from notelake.sources import ignore

CONFIG_FILE = "vault.toml"
IGNORE_FILE = ".vaultignore"
INDEX_DIR = ".notelake"
#: Entries an audit looks at before it stops; its counts are lower bounds then.
AUDIT_LIMIT = 200_000

_VAULT_KEYS = {"name": str, "description": str, "version": str, "license": str, "source": str}
_SCOPE_KEYS = {"notes_dir": str, "exclude": list, "include": list, "follow_gitignore": bool, "max_depth": int}


class ConfigError(ValueError):
    """The configuration of a vault cannot be used."""


@dataclass(frozen=True)
class Config:
    name: str | None = None
    description: str | None = None
    version: str | None = None
    license: str | None = None
    source: str | None = None
    notes_dir: str = "."
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    follow_gitignore: bool = True
    max_depth: int = 0

    @staticmethod
    def parse(text: str) -> Config:
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"the configuration is not TOML: {e}") from e
        values: dict[str, object] = {}
        for part, keys in (("vault", _VAULT_KEYS), ("scope", _SCOPE_KEYS)):
            section = raw.pop(part, {})
            if not isinstance(section, dict):
                raise ConfigError(f"[{part}] must be a table")
            for key, value in section.items():
                if key not in keys:
                    raise ConfigError(f"unknown key {part}.{key}")
                kind = keys[key]
                if not isinstance(value, kind) or (kind is int and (isinstance(value, bool) or value < 0)) or (kind is list and not all(isinstance(v, str) for v in value)):
                    raise ConfigError(f"{part}.{key} has the wrong type")
                values[key] = tuple(value) if kind is list else value
        if raw:
            raise ConfigError(f"unknown key {next(iter(raw))}")
        return Config(**values)

    @staticmethod
    def load(vault: str | Path, file: str = CONFIG_FILE) -> Config:
        path = Path(vault, file)
        return Config.parse(path.read_text(encoding="utf-8")) if path.exists() else Config()


def inside(raw: str, what: str) -> str:
    """A configured path as a clean relative one; refused if it leaves the vault."""
    path = raw.strip()
    while path.startswith("./"):
        path = path[2:]
    parts = [p for p in path.replace("\\", "/").split("/")]
    while parts and parts[-1] == "":
        parts.pop()
    if not parts or path.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0][1:2] == ":":
        raise ConfigError(f"{what} {raw!r} must be a relative path inside the vault")
    return "/".join(parts)


@dataclass(frozen=True)
class IncludeRoot:
    declared: str
    prefix: str
    present: bool


@dataclass(frozen=True)
class Note:
    key: str
    path: str
    reference: bool

    @property
    def title(self) -> str:
        return self.key.rsplit("/", 1)[-1].removesuffix(".md")


@dataclass
class Audit:
    included: int = 0
    reference: int = 0
    skipped: int = 0
    skipped_dependency: int = 0
    skipped_by_dir: list[tuple[str, int]] = field(default_factory=list)
    truncated: bool = False


def is_note_name(name: str) -> bool:
    """Whether a file name is one of a note: exactly ``.md``, with something before it."""
    return name.endswith(".md") and len(name) > 3


class Scope:
    """The rules of one vault."""

    def __init__(self, root: str | Path, config: Config | None = None, ignore_file: str = IGNORE_FILE, config_file: str = CONFIG_FILE) -> None:
        self.root = str(Path(root))
        self.config = config if config is not None else Config.load(root, config_file)
        self.ignore_file = ignore_file
        dir_ = self.config.notes_dir.strip()
        while dir_.startswith("./"):
            dir_ = dir_[2:]
        self.notes_dir = "" if dir_ in ("", ".") else inside(self.config.notes_dir, "scope.notes_dir")
        for pattern in self.config.exclude:
            if pattern.startswith("!"):
                raise ConfigError(f"scope.exclude {pattern!r} must not start with '!': every pattern there excludes; negations go into {ignore_file}")
        self.exclude = [r for p in self.config.exclude if (r := ignore.parse_line(p))]
        roots = [(d, inside(d, "scope.include")) for d in self.config.include]
        self.includes = [IncludeRoot(d, p, os.path.isdir(os.path.join(self.root, p))) for d, p in roots]

    # -- the walk --

    def _read_rules(self, dir_: str, rel: str) -> tuple[list[ignore.Rule], list[ignore.Rule]]:
        """Rules of the vault's ignore file and of ``.gitignore`` in a folder, based on the folder scanned."""
        out = []
        for file, used in ((self.ignore_file, True), (".gitignore", self.config.follow_gitignore)):
            path = os.path.join(dir_, file)
            text = Path(path).read_text(encoding="utf-8", errors="replace") if used and os.path.isfile(path) else ""
            out.append(ignore.parse(text, rel))
        return out[0], out[1]

    def _ignored(self, own: list[ignore.Rule], git: list[ignore.Rule], rel: str, is_dir: bool) -> bool:
        if ignore.verdict(self.exclude, rel, is_dir):
            return True
        # the vault's own file overrules .gitignore, also to bring something back
        said = ignore.verdict(own, rel, is_dir)
        return bool(ignore.verdict(git, rel, is_dir)) if said is None else said

    def walk(self, start: str = "", rules: tuple[list, list] | None = None) -> Iterator[tuple[str, bool]]:
        """``(path below the notes folder, is_dir)`` of what the main scan keeps, below ``start``."""
        top = os.path.join(self.root, self.notes_dir)
        own, git = rules or ([], [])

        def below(rel: str, own: list, git: list, depth: int) -> Iterator[tuple[str, bool]]:
            dir_ = os.path.join(top, rel)
            more_own, more_git = self._read_rules(dir_, rel)
            own, git = own + more_own, git + more_git
            with os.scandir(dir_) as entries:
                listed = sorted(entries, key=lambda e: e.name)
            for e in listed:
                if e.name.startswith(".") or e.is_symlink():
                    continue
                path = f"{rel}/{e.name}" if rel else e.name
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir and (e.name in DEPENDENCY_DIRS or e.name == INDEX_DIR):
                    continue
                if self._ignored(own, git, path, is_dir):
                    continue
                yield path, is_dir
                if is_dir and not (self.config.max_depth and depth + 1 >= self.config.max_depth):
                    yield from below(path, own, git, depth + 1)

        yield from below(start, own, git, start.count("/") + 1 if start else 0)

    def _include_walk(self, prefix: str) -> Iterator[str]:
        stack = [prefix]
        while stack:
            rel = stack.pop()
            with os.scandir(os.path.join(self.root, rel)) as entries:
                for e in entries:
                    if e.name.startswith(".") or e.is_symlink():
                        continue
                    path = f"{rel}/{e.name}"
                    if e.is_dir(follow_symlinks=False):
                        if e.name != INDEX_DIR:
                            stack.append(path)
                    elif is_note_name(e.name):
                        yield path

    def is_reference(self, key: str) -> bool:
        return any(key == r.prefix or key.startswith(r.prefix + "/") for r in self.includes)

    def keys(self) -> list[str]:
        """Keys of all notes, sorted, each once."""
        at = f"{self.notes_dir}/" if self.notes_dir else ""
        found = {at + p for p, is_dir in self.walk() if not is_dir and is_note_name(p.rsplit("/", 1)[-1])}
        for r in self.includes:
            if r.present:
                found.update(self._include_walk(r.prefix))
        return sorted(found, key=lambda k: k.encode("utf-8", "surrogateescape"))

    def notes(self) -> list[Note]:
        """All notes by title, then key."""
        made = [Note(k, os.path.join(self.root, k), self.is_reference(k)) for k in self.keys() if _is_text(k)]
        return sorted(made, key=lambda n: (n.title.encode(), n.key.encode()))

    def missing_includes(self) -> list[str]:
        return [r.declared for r in self.includes if not r.present]

    def watch_targets(self) -> list[str]:
        """Folders worth watching: the notes folder, those in it that the scan keeps, and the include roots that exist."""
        top = os.path.join(self.root, self.notes_dir) if self.notes_dir else self.root
        found = {top} | {os.path.join(top, p) for p, is_dir in self.walk() if is_dir and "/" not in p}
        return sorted(found | {os.path.join(self.root, r.prefix) for r in self.includes if r.present})

    def may_include(self, path: str) -> bool:
        """Whether a path could be a note, by its name and place alone."""
        rel = os.path.relpath(path, self.root).replace(os.sep, "/") if os.path.isabs(path) else path
        if not is_note_name(rel.rsplit("/", 1)[-1]):
            return False
        if any(r.present and rel.startswith(r.prefix + "/") for r in self.includes):
            return True
        if self.notes_dir:
            if not rel.startswith(self.notes_dir + "/"):
                return False
            rel = rel[len(self.notes_dir) + 1 :]
        parts = rel.split("/")
        if any(p.startswith(".") or p in ("", "..") or p in DEPENDENCY_DIRS for p in parts):
            return False
        if self.config.max_depth and len(parts) > self.config.max_depth:
            return False
        return not ignore.verdict(self.exclude, rel, False)

    def audit(self, limit: int = AUDIT_LIMIT) -> Audit:
        """What the scan takes and leaves, against a walk under no rule but hidden names."""
        taken = set(self.keys())
        out = Audit(included=len(taken), reference=sum(map(self.is_reference, taken)))
        by_dir: Counter[str] = Counter()
        # the walk looks at its root too
        seen, stack = 1, [""]
        while stack and not out.truncated:
            rel = stack.pop()
            with os.scandir(os.path.join(self.root, rel)) as entries:
                for e in entries:
                    if e.name.startswith(".") or e.is_symlink() or e.name == INDEX_DIR:
                        continue
                    seen += 1
                    if seen > limit:
                        out.truncated = True
                        break
                    path = f"{rel}/{e.name}" if rel else e.name
                    if e.is_dir(follow_symlinks=False):
                        stack.append(path)
                    elif is_note_name(e.name) and path not in taken:
                        out.skipped += 1
                        out.skipped_dependency += any(p in DEPENDENCY_DIRS for p in path.split("/"))
                        by_dir[path.split("/")[0]] += 1
        out.skipped_by_dir = sorted(by_dir.items(), key=lambda x: (-x[1], x[0]))
        return out


def _is_text(key: str) -> bool:
    try:
        key.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def scope_summary(audit: Audit) -> str:
    """One line for people: counts, and the three folders that lose the most."""
    least = "at least " if audit.truncated else ""
    text = f"{audit.included} notes ({audit.reference} reference), {least}{audit.skipped} other Markdown files"
    if audit.skipped:
        text += f" ({least}{audit.skipped_dependency} in dependency folders): " + ", ".join(f"{d} {n}" for d, n in audit.skipped_by_dir[:3])
    return text
