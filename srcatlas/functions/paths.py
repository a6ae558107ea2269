"""Path and identifier expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path) -> Column:
    """Last path component (``Path(p).name``)."""
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def suffix(path) -> Column:
    """``Path(p).suffix``: last dot-part of the name, '' for dotfiles and no dot."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def ext(path) -> Column:
    """Lower-case suffix without the dot ('' when there is none)."""
    return F.lower(F.substring(suffix(path), 2, 1 << 30))


def doc_type(path) -> Column:
    """Suffix without the dot, as written, or ``unknown``."""
    s = suffix(path)
    return F.when(s == "", F.lit("unknown")).otherwise(F.substring(s, 2, 1 << 30))


def path_parts(path) -> Column:
    return F.split(_c(path), "/")


def repo_id(source) -> Column:
    """``'repo_' || md5(source)[:12]``: stable id of a declared source."""
    return F.concat(F.lit("repo_"), F.substring(F.md5(_c(source)), 1, 12))


def url_path(source) -> Column:
    """Path part of a URL as a lenient URL splitter sees it; a plain path is its own path."""
    s = _c(source)
    no_scheme = F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    no_netloc = F.regexp_replace(no_scheme, r"^//[^/?#]*", "")
    return F.regexp_replace(no_netloc, r"(?s)[?#].*$", "")


def repo_name(source) -> Column:
    """Repository name from a URL or path: last path segment with ``.git`` removed."""
    path = F.regexp_replace(url_path(source), r";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.regexp_replace(last, r"\.git$", "")


# A URL is valid when it has a web scheme, a host (dotted name with a
# top-level label, localhost or an IPv4 address), an optional port and no
# white space. Written once and used by both engines.
VALID_URL_RE = (
    r"^(?:https?|ftps?)://(?:[^\s/?#@:]+(?::[^\s/?#@]*)?@)?"
    r"(?:(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
    r"|localhost|[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
    r"(?::[0-9]{1,5})?(?:[/?#]\S*)?$"
)


def valid_url(source) -> Column:
    return F.coalesce(_c(source).rlike(VALID_URL_RE), F.lit(False))


def point_id(repo, chunk_id) -> Column:
    """Id of a vector-store point: md5 of repository and chunk, wide enough
    that no two of any number of chunks share one."""
    return F.md5(F.concat(_c(repo), F.lit("/"), _c(chunk_id)))
