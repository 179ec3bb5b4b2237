"""Ignore rules in the gitignore pattern language, matched in plain Python on the driver or in a reader's task."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@lru_cache(maxsize=4096)
def glob_regex(glob: str) -> re.Pattern:
    """A pattern for a slash-separated path: ``*`` and ``?`` stay within a segment, ``**`` spans segments."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i) and i + 2 == len(glob) and (i == 0 or glob[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^") else i + 1)) > 0:
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\[\]^])", r"\\\1", body[1:] if negated else body) + "]")
            i = end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return re.compile("".join(out) + r"\Z", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file in directory ``base`` (relative to the root, ``""`` for the root itself)."""

    base: str
    glob: str
    negated: bool
    only_dirs: bool
    anchored: bool

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.only_dirs and not is_dir:
            return False
        if self.base:
            if not path.startswith(self.base + "/"):
                return False
            path = path[len(self.base) + 1 :]
        return bool(glob_regex(self.glob if self.anchored else "**/" + self.glob).match(path))


def parse_line(line: str, base: str = "") -> Rule | None:
    """The rule of a line, none for a blank line or a comment."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    anchored = "/" in line
    line = line.removeprefix("/")
    return Rule(base, line, negated, only_dirs, anchored) if line else None


def parse(text: str, base: str = "") -> list[Rule]:
    return [r for line in text.splitlines() if (r := parse_line(line, base))]


def verdict(rules: list[Rule], path: str, is_dir: bool) -> bool | None:
    """Whether the rules ignore a path (the last that matches decides), or none of them says."""
    for rule in reversed(rules):
        if rule.matches(path, is_dir):
            return not rule.negated
    return None
