"""Column expressions on file paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, empty when there is none.

    A leading dot (``.hidden``) starts a name, not an extension, and a bare
    trailing dot is no extension.
    """
    return F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"^(.+?)\.[^.]+$", "$1")


def container_codec(path: Column) -> Column:
    """Lower-cased extension without the dot, NULL when there is none."""
    return F.nullif(F.lower(F.ltrim(suffix(path), F.lit("."))), F.lit(""))


def relative_to(path: Column, root: str | Column) -> Column:
    """``path`` below ``root``; both as plain ``/``-separated strings."""
    base = F.lit(root) if isinstance(root, str) else root
    base = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(path, base), F.substr(path, F.length(base) + 1)
    ).otherwise(path)


def plain_path(path: Column) -> Column:
    """A ``file:/a/b`` or ``file:///a/b`` URI as ``/a/b``; other schemes stay."""
    return F.regexp_replace(path, r"^file:/+", "/")


def utt_id_from_path(relative: Column) -> Column:
    """Relative path without the last extension, with ``/`` written as ``__``."""
    return F.replace(
        F.regexp_replace(relative, r"\.[^.]*$", ""), F.lit("/"), F.lit("__")
    )


def path_part(relative: Column, index: int) -> Column:
    """Zero-based directory part of a relative path, NULL past its end."""
    return F.get(F.split(relative, "/"), F.lit(index))


def namespaced_utt(dataset: Column, utt: Column) -> Column:
    return F.concat(dataset, F.lit("__"), utt)


def namespaced_path(dataset: Column, utt: Column, path: Column) -> Column:
    return F.concat(dataset, F.lit("/"), utt, suffix(path))
