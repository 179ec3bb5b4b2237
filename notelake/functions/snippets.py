"""Snippets of found notes."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Length of a snippet by default and at least.
DEFAULT_CHARS, LEAST_CHARS = 150, 20
_WORD = re.compile(r"[฀-๿]+|[^\W_฀-๿]+")


def opening(body: Column | str, chars: int = DEFAULT_CHARS) -> Column:
    """The first characters of a body, as they are."""
    return F.substring(F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit("")), 1, max(LEAST_CHARS, chars))


def excerpt(body: str, terms: set[str], chars: int) -> str:
    """The part of at most ``chars`` characters with the most different terms, then the most hits, then the earliest; the
    rest of it HTML-escaped, the hits in bold. Without a hit the opening, as it is."""
    chars = max(LEAST_CHARS, chars)
    hits = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(body) if m[0].lower() in terms or any("฀" <= t[:1] <= "๿" and t in m[0] for t in terms)]
    hits = [h for h in hits if h[1] - h[0] <= chars]
    if not hits:
        return body[:chars]
    best, at, first = (0, 0), 0, 0
    for last in range(len(hits)):
        while hits[last][1] - hits[first][0] > chars:
            first += 1
        window = hits[first : last + 1]
        score = (len({t for *_, t in window}), len(window))
        if score > best:
            best, at = score, hits[first][0]
    room = chars - (min(at + chars, len(body)) - at)
    start = max(0, at - max(room, (chars - (hits[-1][1] - at)) // 2 if hits[-1][1] - at < chars else 0))
    while 0 < start < at and not body[start - 1].isspace():
        start += 1
    stop = min(len(body), start + chars)
    out, pos = [], start
    for a, b, _ in hits:
        if a >= start and b <= stop:
            out += [html.escape(body[pos:a], quote=False), "<b>", html.escape(body[a:b], quote=False), "</b>"]
            pos = b
    return "".join([*out, html.escape(body[pos:stop], quote=False)]).strip()


def snippet(terms: list[str], chars: int = DEFAULT_CHARS):
    """A function of a body column that gives its excerpt for ``terms``."""
    wanted = {t.lower() for t in terms}

    @F.pandas_udf(T.StringType())
    def made(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: excerpt(b or "", wanted, chars))

    return made
