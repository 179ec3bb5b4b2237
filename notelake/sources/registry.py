"""The catalog of vaults: names and folders, kept in one JSON file that is replaced as a whole."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from notelake.sources.scope import Config, ConfigError, Scope


class Registry:
    def __init__(self, file: str | Path) -> None:
        self.file = Path(file)

    def list(self) -> dict[str, str]:
        """Names and folders, by name."""
        found = json.loads(self.file.read_text(encoding="utf-8")) if self.file.exists() else {}
        return dict(sorted(found.items()))

    def _write(self, vaults: dict[str, str]) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        fd, temporary = tempfile.mkstemp(dir=self.file.parent)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(vaults, f, ensure_ascii=False, indent=1)
        os.replace(temporary, self.file)

    def add(self, name: str, root: str | Path) -> None:
        if not name or "/" in name or "\\" in name:
            raise ConfigError(f"{name!r} cannot name a vault")
        vaults = self.list()
        if name in vaults:
            raise ConfigError(f"there is a vault {name!r} already")
        if not os.path.isdir(root):
            raise ConfigError(f"{str(root)!r} is no folder")
        self._write(vaults | {name: os.path.realpath(root)})

    def remove(self, name: str) -> bool:
        vaults = self.list()
        if vaults.pop(name, None) is None:
            return False
        self._write(vaults)
        return True

    def get(self, name: str) -> str | None:
        return self.list().get(name)

    def name_of(self, root: str | Path) -> str | None:
        real = os.path.realpath(root)
        return next((n for n, r in self.list().items() if r == real), None)

    def table(self, spark: SparkSession) -> DataFrame:
        """``name, root``."""
        return spark.createDataFrame(list(self.list().items()), "name string, root string")


def manifest(root: str) -> Config:
    return Config.load(root)


def sources_of(vault: str, scope: Scope) -> list[tuple[str, str, str, str, str | None, str | None]]:
    """``vault, prefix, root, name, license, version`` of the include roots that exist; a source whose configuration cannot be
    read has its folder's name."""
    out = []
    for r in scope.includes:
        if r.present:
            path = os.path.join(scope.root, r.prefix)
            try:
                c = Config.load(path)
            except (ConfigError, OSError, UnicodeDecodeError):
                c = Config()
            out.append((vault, r.prefix, path, c.name or r.prefix.rsplit("/", 1)[-1], c.license, c.version))
    return out


def sources_table(spark: SparkSession, vaults: dict[str, str]) -> DataFrame:
    rows = [row for name, root in vaults.items() for row in sources_of(name, Scope(root))]
    return spark.createDataFrame(rows, "vault string, prefix string, root string, name string, license string, version string")


def installed(scope: Scope) -> list[str]:
    """Prefixes of the include roots that are checked-out repositories of their own."""
    return [r.prefix for r in scope.includes if r.present and os.path.exists(os.path.join(scope.root, r.prefix, ".git"))]
