"""Path and URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_host(url) -> Column:
    """Authority part of a URL (``user@host:port`` kept as written)."""
    return F.regexp_extract(_c(url), _SCHEME + r"([^/?#]*)", 1)


def url_path(url) -> Column:
    """Path part of a URL, without query string or fragment."""
    return F.regexp_extract(_c(url), _SCHEME + r"[^/?#]*([^?#]*)", 1)


def parent_dir(path) -> Column:
    """The directory of a path: ``.`` of a bare name, ``/`` of a file in the root."""
    p = _c(path)
    return F.when(F.instr(p, "/") == 0, ".").when(p.rlike("^/[^/]*$"), "/") \
            .otherwise(F.regexp_extract(p, r"^(.*)/[^/]*$", 1))


def basename(path) -> Column:
    """Everything after the last ``/``."""
    return F.substring_index(_c(path), "/", -1)


def join_path(*parts) -> Column:
    """Parts joined by ``/``; null if any is."""
    out = _c(parts[0])
    for p in parts[1:]:
        out = F.concat(out, F.lit("/"), _c(p))
    return out
