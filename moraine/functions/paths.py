"""One spelling for an object's path, as Spark columns and for single strings."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """The object a path names, in one spelling; stays in generated code, no Python.

    ``s3``, ``s3a`` and ``s3n`` are one store, percent escapes are decoded (a ``+`` is itself),
    empty and ``.`` segments vanish. Null gives null, an empty string an empty string. A malformed
    escape leaves the text undecoded.
    """
    plus_kept = F.replace(path, F.lit("+"), F.lit("%2B"))
    decoded = F.when(F.contains(path, F.lit("%")), F.coalesce(F.try_url_decode(plus_kept), path)).otherwise(path)
    one_store = F.regexp_replace(decoded, r"^(?i:s3[an]?):/*", "s3://")
    marked = F.regexp_replace(one_store, r"(?<!:)/(?:\.?/)+(?!/)", "/")
    tidy = F.regexp_replace(marked, r"^(\w+://)(?:\.?/)+", "$1")
    thorough = F.regexp_replace(tidy, r"/\.?$", "")
    # Most paths are in the one spelling already, and plain comparisons are far cheaper than patterns.
    return F.when(F.startswith(path, F.lit("s3://")) & _tidy_from(path, 5), path).otherwise(thorough)


def _tidy_from(path: Column, start: int) -> Column:
    """No escape, and no empty or ``.`` segment from the ``start``-th character on."""
    rest = F.substring(path, start, 1 << 30)
    odd = [F.contains(path, F.lit("%")), F.contains(rest, F.lit("//")), F.contains(rest, F.lit("/./")), F.endswith(path, F.lit("/")), F.endswith(path, F.lit("/."))]
    return ~reduce(lambda a, b: a | b, odd)


def object_key_column(path: Column) -> Column:
    """How paths are compared: one spelling, local files without a scheme."""
    local = F.startswith(path, F.lit("file:///")) & _tidy_from(path, 8)
    return F.when(local, F.substring(path, 8, 1 << 30)).otherwise(F.regexp_replace(canonical_path(path), "^file:/+", "/"))


def object_key(path: str) -> str:
    """``object_key_column`` for one string."""
    text = canonical_path_text(path)
    return "/" + text[5:].lstrip("/") if text.startswith("file:") else text


_STORE = re.compile(r"^s3[an]?:/*", re.IGNORECASE)


def canonical_path_text(path: str | None) -> str | None:
    """``canonical_path`` for one string, for driver-side use and as the test oracle."""
    if path is None:
        return None
    text = _STORE.sub("s3://", unquote(path))
    scheme, mark, rest = text.partition("://")
    if not mark:
        scheme, rest = "", text
    absolute = "/" if not mark and rest.startswith("/") else ""
    return scheme + mark + absolute + "/".join(s for s in rest.split("/") if s not in ("", "."))
