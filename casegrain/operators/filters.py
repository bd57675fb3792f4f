"""Filters of entries, activity, bookmarks, notes, groups and sheets: predicates as Columns, lists as DataFrames.

A criterion that is None, or an empty list or text, doesn't filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.functions import scalars as S


def every(parts: list[Column | None]) -> Column:
    """AND of the criteria that are given; true without any."""
    return reduce(Column.__and__, [p for p in parts if p is not None], F.lit(True))


def _holds(c: Column, low: str) -> Column:
    """Case-insensitive substring; false on null."""
    return F.coalesce(F.lower(c).contains(low), F.lit(False))


def search_filter(kinds: list[str] = (), extensions: list[str] = (), categories: list[str] = (), container: str | None = None, least: int | None = None, most: int | None = None, directories: bool = False) -> Column:
    """The predicate of index entries (container_type, extension, category, container, size, is_dir): lists are ORs of lower-case terms.

    Directories are left out unless asked for; with nothing given but that, everything matches.
    """
    among = lambda c, terms: F.lower(F.col(c)).isin(*[x.lower() for x in terms]) if terms else None
    return every([
        among("container_type", kinds), among("extension", extensions), among("category", categories),
        None if container is None else F.col("container") == container,
        None if least is None else F.col("size") >= least, None if most is None else F.col("size") <= most,
        None if directories else ~F.col("is_dir"),
    ])


def entry_matches(entries: DataFrame, pattern: str | None = None, extension: str | None = None, directories_only: bool = False, files_only: bool = False, least: int | None = None, most: int | None = None, hash_given: bool = False) -> DataFrame:
    """Entries (name, path, size, is_dir) that match a name pattern, on name or path, or an extension; with match_type.

    match_type is Name, Extension, or Multiple where both match.  Without pattern, extension and hash all match, as Name.
    """
    kept = entries.where(every([F.col("is_dir") if directories_only else None, ~F.col("is_dir") if files_only else None, None if least is None else F.col("size") >= least, None if most is None else F.col("size") <= most]))
    if pattern is None and extension is None and not hash_given:
        return kept.withColumn("match_type", F.lit("Name"))
    by_name = F.lit(False) if pattern is None else S.glob_match(F.col("name"), pattern) | S.glob_match(F.col("path"), pattern)
    by_end = F.lit(False) if extension is None else F.lower("name").endswith(f".{extension.lower()}")
    return kept.where(by_name | by_end).withColumn("match_type", F.when(by_name & by_end, "Multiple").when(by_end, "Extension").otherwise("Name"))


def has_extension(entries: DataFrame, extension: str) -> DataFrame:
    """Files whose name's last dot-separated part is the extension; a name without a dot counts whole."""
    return entries.where(~F.col("is_dir") & (F.lower(F.element_at(F.split("name", r"\."), -1)) == extension.lower()))


def container_search(containers: DataFrame, pattern: str | None = None, wanted: str | None = None, most: int | None = None) -> DataFrame:
    """Containers (path, name, size, md5, sha1) as single entries: a row by name, another by stored hash; at most `most`."""
    row = ["path", F.lit("/").alias("entry_path"), "name", "size"]
    found = [containers.where(F.lit(False)).select(*row, F.lit("Name").alias("match_type"))]
    if pattern is not None:
        found.append(containers.where(S.glob_match(F.col("name"), pattern)).select(*row, F.lit("Name").alias("match_type")))
    if wanted is not None:
        same = F.coalesce(F.lower("md5") == wanted.lower(), F.lit(False)) | F.coalesce(F.lower("sha1") == wanted.lower(), F.lit(False))
        found.append(containers.where(same).select(*row, F.lit("Hash").alias("match_type")))
    out = reduce(DataFrame.unionByName, found)
    return out if most is None else out.orderBy("path", F.desc("match_type")).limit(most)


def activity_panel(log: DataFrame, category: str | None = None, text: str = "", since: str | None = None, until: str | None = None, newest: bool = True) -> DataFrame:
    """Activity (id, category, description, action, user, file_path, ts): text in any of four columns, whole days, both included."""
    low = text.strip().lower()
    found = reduce(Column.__or__, [_holds(F.col(c), low) for c in ("description", "action", "user", "file_path")]) if low else None
    rows = log.where(every([
        None if category in (None, "all") else F.col("category") == category, found,
        None if since is None else F.col("ts") >= F.to_date(F.lit(since)).cast("timestamp_ntz"),
        None if until is None else F.col("ts") < F.date_add(F.to_date(F.lit(until)), 1).cast("timestamp_ntz"),
    ]))
    return rows.orderBy(F.desc("ts") if newest else F.asc("ts"), "id")


def bookmark_panel(bookmarks: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """Bookmarks (name, path, notes, tags, kind): text in name, path, notes or any tag."""
    low = text.strip().lower()
    found = reduce(Column.__or__, [_holds(F.col(c), low) for c in ("name", "path", "notes")]) | any_tag(F.col("tags"), low) if low else None
    return bookmarks.where(every([found, None if kind is None else F.col("kind") == kind]))


def any_tag(tags: Column, low: str) -> Column:
    return F.coalesce(F.exists(tags, lambda tag: _holds(tag, low)), F.lit(False))


def note_panel(notes: DataFrame, kind: str | None = None, newest: bool = True) -> DataFrame:
    """Notes (id, kind, modified) of one kind, by time."""
    return notes.where(every([None if kind is None else F.col("kind") == kind])).orderBy(F.desc("modified") if newest else F.asc("modified"), "id")


def group_panel(groups: DataFrame, match_type: str | None = None, cross_container: bool = False, order: str = "waste") -> DataFrame:
    """Duplicate groups (match_type, cross_container, waste, n, size, name): filtered, and sorted by waste, count, size or name."""
    kept = groups.where(every([None if match_type is None else F.col("match_type") == match_type, F.col("cross_container") if cross_container else None]))
    orders = {"waste": [F.desc("waste")], "count": [F.desc("n")], "size": [F.desc("size")], "name": [F.asc("name")]}
    return kept.orderBy(*orders[order], "size", "name")


def sheet_rows(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with the text in any rendered cell, whatever the case; all rows for a blank text."""
    if not text.strip():
        return rows
    low = text.lower()
    return rows.where(reduce(Column.__or__, [_holds(F.col(c).cast("string"), low) for c in columns]))


def discovered(files: DataFrame, container_type: str | None = None) -> DataFrame:
    return files.where(every([None if not container_type else F.col("container_type") == container_type]))


def tree(entries: DataFrame, text: str = "", most: int = 500, tie: str = "path") -> DataFrame:
    """The first `most` entries by path (then `tie`) whose path holds the text."""
    low = text.strip().lower()
    return (entries.where(_holds(F.col("path"), low)) if low else entries).orderBy("path", tie).limit(most)


def key_values(rows: DataFrame, text: str) -> DataFrame:
    """Flattened values (key_path, preview) with the text in either."""
    return rows.where(_holds(F.col("key_path"), text.lower()) | _holds(F.col("preview"), text.lower()))


def by_name(rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns renamed by parts of their names: each wanted name gets the first column that holds one of its parts; null without one."""
    def pick(parts: list[str]) -> Column:
        for part in parts:
            for c in rows.columns:
                if part.lower() in c.lower():
                    return F.col(f"`{c}`").cast("string")
        return F.lit(None).cast("string")

    return rows.select(*[pick(parts).alias(name) for name, parts in wanted.items()])
