"""Column functions on note texts, keys and links. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake.functions.text import trimmed

# Fixed value: a wikilink on one line, with its target and, after a bar, its alias.
WIKILINK = r"\[\[([^\]\|\r\n]+)(?:\|([^\]\r\n]+))?\]\]"
# Directories of third-party code, which hold no notes.
DEPENDENCY_DIRS = ("node_modules", "bower_components", "vendor", "site-packages", "__pycache__", "Pods")
# Growth of the boost for links, and the number of links at which it is full.
BOOST, FULL_AT = 0.25, 12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wikilinks(body: Column | str) -> Column:
    """``array<struct<target, alias>>`` of the links of a text in order, repeats kept, both parts trimmed; no alias is null."""
    b = _col(body)
    zipped = F.arrays_zip(F.regexp_extract_all(b, F.lit(WIKILINK), F.lit(1)).alias("t"), F.regexp_extract_all(b, F.lit(WIKILINK), F.lit(2)).alias("a"))
    return F.transform(zipped, lambda z: F.struct(trimmed(z["t"]).alias("target"), F.nullif(trimmed(z["a"]), F.lit("")).alias("alias")))


def link_targets(body: Column | str) -> Column:
    """The trimmed targets of the links of a text in order, repeats kept."""
    return F.transform(F.regexp_extract_all(_col(body), F.lit(WIKILINK), F.lit(1)), trimmed)


def rewrite_wikilinks(body: Column | str, old: str, new: str) -> Column:
    """``struct<body, n>``: links to exactly the title ``old`` renamed to ``new`` (aliases kept), and how many."""
    b = _col(body)
    pattern = r"\[\[[ \t]*" + re.sub(r"([^\w\s])", r"\\\1", old) + r"[ \t]*(\|[^\]\r\n]+)?\]\]"
    safe = new.replace("\\", "\\\\").replace("$", "\\$")
    return F.struct(F.regexp_replace(b, pattern, f"[[{safe}$1]]").alias("body"), F.regexp_count(b, F.lit(pattern)).cast("long").alias("n"))


def split_cross_vault(target: Column | str) -> Column:
    """``struct<vault, title>`` of a target with both parts around its first ``/``, else null."""
    t = _col(target)
    at = F.instr(t, "/")
    return F.when((at > 1) & (F.length(t) > at), F.struct(F.substring_index(t, "/", 1).alias("vault"), F.substring(t, at + 1, F.length(t)).alias("title")))


def validate_key(key: Column | str) -> Column:
    """The first rule that a key breaks, null for a valid one."""
    k = _col(key)
    parts = F.split(k, "/")
    return (
        F.when(F.coalesce(F.length(k), F.lit(0)) == 0, "empty")
        .when(F.instr(k, "\\") > 0, "backslash")
        .when(F.instr(k, "\x00") > 0, "nul")
        .when(F.startswith(k, F.lit("/")) | (F.substring(k, 2, 1) == ":"), "absolute")
        .when(~F.endswith(k, F.lit(".md")), "not a note")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "segment")
    )


def degree_boost(degree: Column | str) -> Column:
    """1 without links, growing with the logarithm to 1 + BOOST at FULL_AT links."""
    d = F.coalesce(_col(degree), F.lit(0)).cast("double")
    return F.when(d <= 0, F.lit(1.0)).otherwise(1 + BOOST * F.least(F.lit(1.0), F.log(1 + d) / F.log(F.lit(1.0 + FULL_AT))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two numeric arrays; 0 where the lengths differ, an array is null or empty, or a norm is zero."""
    x, y = _col(a), _col(b)
    num = lambda v: v.cast("double")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: num(p) * num(q)), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + num(p) * num(p)))
    usable = (F.size(x) == F.size(y)) & (F.size(x) > 0)
    return F.coalesce(F.when(usable & (norm(x) > 0) & (norm(y) > 0), dot / (norm(x) * norm(y))), F.lit(0.0))


def usable_vector(c: Column | str, dim: int | Column | None = 64) -> Column:
    """Whether an embedding has ``dim`` finite entries (any number if None), not all zero."""
    e = _col(c)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.lit(True) if dim is None else F.size(e) == dim) & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def source_label(name: Column | str, license_: Column | str) -> Column:
    """``name · licence``, or that the licence is not stated (null or blank)."""
    given = F.nullif(trimmed(license_), F.lit(""))
    return F.concat(_col(name), F.lit(" · "), F.coalesce(given, F.lit("licence not stated")))


def top_level(key: Column | str) -> Column:
    """First segment of a key; a file at the root gives its own name."""
    return F.substring_index(_col(key), "/", 1)


def in_dependency_dir(key: Column | str) -> Column:
    """Whether a directory on the key's way is one of third-party code."""
    dirs = F.split(F.regexp_replace(_col(key), r"/?[^/]*$", ""), "/")
    return F.arrays_overlap(dirs, F.array(*map(F.lit, DEPENDENCY_DIRS)))


def summarize_keys(keys: Column | str, n: Column | None = None, shown: int = 4) -> Column:
    """The first keys, and how many more there are of ``n`` (by default the array's size)."""
    k = _col(keys)
    more = (F.size(k) if n is None else n) - shown
    return F.concat(F.concat_ws(", ", F.slice(k, 1, shown)), F.when(more > 0, F.concat(F.lit(", ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def outline(body: Column | str) -> Column:
    """``array<struct<line, level, heading>>`` of the Markdown headings, lines counted from 0."""
    lines = F.split(F.regexp_replace(_col(body), "\r\n", "\n"), "\n")
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+(.+?)\s*$", 1)).alias("level"), F.regexp_extract(x, r"^(#{1,6})\s+(.+?)\s*$", 2).alias("heading")))
    return F.filter(placed, lambda h: h["level"] > 0)


def under_prefix(key: Column, prefix: Column) -> Column:
    """Whether a key is a prefix or lies below it."""
    return (key == prefix) | F.startswith(key, F.concat(prefix, F.lit("/")))


def name_from_url(url: Column | str) -> Column:
    """Last segment of a repository's address without ``.git``; null for an empty or a hidden name."""
    name = F.regexp_replace(F.regexp_extract(F.regexp_replace(_col(url), "/+$", ""), r"([^/:]+)$", 1), r"\.git$", "")
    return F.when((name != "") & ~F.startswith(name, F.lit(".")), name)


def is_newer(current: Column | str, latest: Column | str) -> Column:
    """Whether ``latest`` is a higher ``major.minor.patch`` than ``current`` (a leading v is ignored); false if either is none."""
    parts = lambda v: F.transform(F.split(F.regexp_extract(_col(v), r"^v?(\d+\.\d+\.\d+)", 1), r"\."), lambda p: p.try_cast("int"))
    return F.coalesce(F.when((F.size(parts(current)) == 3) & (F.size(parts(latest)) == 3), parts(latest) > parts(current)), F.lit(False))


# The status letters of a signature check and their meaning.
TRUST = {
    "G": "good signature",
    "U": "good signature from an uncertified key",
    "X": "good signature from an expired key",
    "Y": "good signature, key expired at signing time",
    "R": "good signature from a revoked key",
    "B": "BAD signature — the content does not match it",
    "E": "signed, but you do not have the key to check it",
    "N": "not signed",
}


def trust(code: Column | str) -> Column:
    """Meaning of a signature's status letter; anything else counts as no signature."""
    c = _col(code)
    out = F.lit(TRUST["N"])
    for letter, meaning in TRUST.items():
        out = F.when(c == letter, meaning).otherwise(out)
    return out


def is_sound(code: Column | str) -> Column:
    """Whether the status is a good signature, trusted or not yet."""
    return F.coalesce(_col(code).isin("G", "U"), F.lit(False))


def markdown_snippet(snippet: Column | str) -> Column:
    """A snippet with its marks as Markdown, on one line."""
    s = _col(snippet)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "<b>", "**"), "</b>", "**"), r"[\r\n]+", " ")


