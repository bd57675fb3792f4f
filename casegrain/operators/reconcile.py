"""Project comparison, merging with explicit conflict rules, and record linkage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.operators.shared import written


def _last(rows: DataFrame, keys: list[str], order: str | None, value: Column) -> DataFrame:
    """keys and the value of the last row of each: the greatest by `order`, or by the value where no order is given."""
    pick = F.max_by(value, F.col(order)) if order else F.max(value)
    return rows.groupBy(*keys).agg(pick.alias("value"))


def _sides(key: str) -> tuple[str, str]:
    """Names for the two rows of a key that are not the key's own."""
    return f"{key}_row_a", f"{key}_row_b"


def diff(a: DataFrame, b: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """key, both rows as structs, bucket (only_a, only_b, common, modified) and the changed fields; null-safe comparison.

    Of B's rows with one key the last by `order` counts, and each of A's rows meets it.  Null keys meet each other.
    """
    left, right = _sides(key)
    x = a.select(F.col(key).alias("key_a"), F.struct(*fields).alias(left))
    y = _last(b, [key], order, F.struct(*fields)).select(F.col(key).alias("key_b"), F.col("value").alias(right))
    both = x.join(y, x["key_a"].eqNullSafe(y["key_b"]), "full_outer")
    both = both.select(F.when(F.col(left).isNull(), F.col("key_b")).otherwise(F.col("key_a")).alias(key), left, right)
    changed = F.filter(F.array(*[F.when(~F.col(left)[f].eqNullSafe(F.col(right)[f]), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    both = both.withColumn("bucket", F.when(F.col(right).isNull(), "only_a").when(F.col(left).isNull(), "only_b").when(F.size(changed) > 0, "modified").otherwise("common"))
    return both.withColumn("changed", F.when(F.col("bucket") == "modified", F.array_join(changed, ",")).otherwise(""))


def similarity(differences: DataFrame) -> DataFrame:
    """2 * common / (rows of A + rows of B) in percent; 100 where both are empty."""
    count = lambda *k: F.count(F.when(F.col("bucket").isin(*k), 1))
    out = differences.agg(count("common").alias("common"), count("only_a", "common", "modified").alias("a"), count("only_b", "common", "modified").alias("b"))
    return out.withColumn("similarity", F.when(F.col("a") + F.col("b") == 0, 100.0).otherwise(F.round(200.0 * F.col("common") / (F.col("a") + F.col("b")), 6)))


def merge(a: DataFrame, b: DataFrame, key: str, fields: list[str], strategy: str, order: str | None = None) -> DataFrame:
    """One table of two; strategy for keys with differing fields: PreferA, PreferB, KeepBoth, Skip (as PreferA) or Manual (left out)."""
    left, right = _sides(key)
    d = diff(a, b, key, fields, order)
    first = F.when((F.col("bucket") == "only_b") | ((F.col("bucket") == "modified") & F.lit(strategy == "PreferB")), F.col(right)).otherwise(F.col(left))
    out = d.where(F.col("bucket") != "modified") if strategy == "Manual" else d
    out = out.select(key, first.alias(left))
    if strategy == "KeepBoth":
        second = d.where("bucket = 'modified'").select(F.concat(key, F.lit(" (from B)")).alias(key), F.col(right).alias(left))
        out = out.unionByName(second.distinct())
    return out.select(key, f"{left}.*")


def first_wins(sources: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """N-way keyed union: of equal keys the row of the earliest source stays (then by `order`)."""
    tagged = [s.withColumn("source_ordinal", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    w = Window.partitionBy(*keys).orderBy("source_ordinal", order)
    return every.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def newest_wins(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Of equal keys the newest row; ties keep the earlier source."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), "source_ordinal")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def merge_users(rows: DataFrame) -> DataFrame:
    """Earliest first access, latest last access, first known names."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_ordinal")))
    return rows.groupBy("username").agg(F.min("first_access").alias("first_access"), F.max("last_access").alias("last_access"), known("display_name").alias("display_name"), known("hostname").alias("hostname"))


def insert_or_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """target and the new rows whose key isn't there yet; of new rows with one key the first by `order` (the least row without one).

    Keys with a null are never equal, as in a unique index: such rows all come in.
    """
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    first = new.where(known).groupBy(*keys).agg((F.min_by(F.struct(*new.columns), order) if order else F.min(F.struct(*new.columns))).alias("row")).select("row.*")
    added = first.join(target.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new.where(~known))
    return target.unionByName(added, allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """New non-null values replace old ones; rows that are only on one side stay.

    Of new rows with one key the last by `order` counts.  Null keys meet each other.
    """
    n = _last(new, [key], order, F.struct(*columns)).select(F.col(key).alias("new_key"), F.col("value").alias("new_row"), F.lit(True).alias("is_new"))
    both = target.join(n, target[key].eqNullSafe(n["new_key"]), "full_outer")
    return both.select(F.coalesce(F.col(key), F.col("new_key")).alias(key), *[F.coalesce(F.col("new_row")[c], F.col(c)).alias(c) for c in columns])


def sync_by_name(target: DataFrame, source: DataFrame, name: str, order: str, overwrite: bool) -> DataFrame:
    """target with source's rows: the last of each name replaces all of that name, or the first of each missing name is added."""
    pick = F.max_by if overwrite else F.min_by
    rows = source.groupBy(name).agg(pick(F.struct(*source.columns), order).alias("row")).select("row.*").select(*source.columns)
    if overwrite:
        names = rows.select(F.col(name).alias("other_name"))
        return target.join(names, target[name].eqNullSafe(names["other_name"]), "left_anti").unionByName(rows)
    names = target.select(F.col(name).alias("other_name")).distinct()
    return target.unionByName(rows.join(names, rows[name].eqNullSafe(names["other_name"]), "left_anti"))


def union_distinct(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All sources' rows, one a key: the earliest source's (of one source the least row)."""
    tagged = [s.select(F.lit(i).alias("source_ordinal"), F.struct(*s.columns).alias("row"), *keys) for i, s in enumerate(sources)]
    first = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.min(F.struct("source_ordinal", "row")).alias("m"))
    return first.select("m.row.*")


def all_paths(sources: list[DataFrame], column: str) -> DataFrame:
    """The distinct values of a column over all sources."""
    return reduce(DataFrame.unionByName, [s.select(column) for s in sources]).distinct()


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """The tables without the rows that `gone` (one column of ids of the first link's parent) takes along.

    links are (parent, its key, child, its foreign key), parents before their children; a child's deleted rows are the
    parents of its own links.  The first link's parent loses the given ids themselves.
    """
    root, key = links[0][0], links[0][1]
    ids = gone.select(F.col(gone.columns[0]).alias("gone_id")).distinct()
    lost = {root: tables[root].join(ids, F.col(key) == F.col("gone_id"), "left_semi")}
    for parent, own, child, foreign in links:
        dead = lost[parent].select(F.col(own).alias("gone_id")).distinct()
        rows = tables[child].join(dead, F.col(foreign) == F.col("gone_id"), "left_semi")
        lost[child] = lost[child].unionByName(rows) if child in lost else rows
    out = {}
    for name, table in tables.items():
        out[name] = table
        if name == root:
            out[name] = table.join(ids, F.col(key) == F.col("gone_id"), "left_anti")
        for parent, own, child, foreign in links:
            if child == name:
                dead = lost[parent].select(F.col(own).alias("gone_id")).distinct()
                out[name] = out[name].join(dead, F.col(foreign) == F.col("gone_id"), "left_anti")
    return out


def remap_children(parents: DataFrame, children: DataFrame, natural: str, key: str, foreign: str) -> DataFrame:
    """Children of parents that a natural key merges get the surviving parent's id (the earliest source's)."""
    w = Window.partitionBy(natural).orderBy("source_ordinal", key)
    ids = parents.select(F.col(key).alias(foreign), F.first(key).over(w).alias("kept"))
    return children.join(ids.distinct(), foreign, "left").withColumn(foreign, F.coalesce("kept", foreign)).drop("kept")


def link_by_rank(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Greedy one-to-one pairs of equal keys in input order: the i-th of a key with the i-th."""
    w = Window.partitionBy(key).orderBy(order)
    a, b = left.withColumn("rn", F.row_number().over(w)), right.withColumn("rn", F.row_number().over(w))
    return a.join(b.withColumnRenamed(order, f"{order}_right"), [key, "rn"]).drop("rn")


def transitions(events: DataFrame, key: str, allowed: set[tuple[str, str]]) -> DataFrame:
    """Each status event with its predecessor and whether the step is allowed (the first always is)."""
    w = Window.partitionBy(key).orderBy("seq")
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(allowed)])
    out = events.withColumn("before", F.lag("status").over(w))
    return out.withColumn("valid", F.col("before").isNull() | F.array_contains(steps, F.concat_ws(">", "before", "status")))


def collection_conflicts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """current, incoming (ids) and the first reason by which two collections look the same: case number, date and officer, date and location.

    Both have id, case_number, date (text, of which ten characters count), officer and location; nulls and empty texts match
    nothing, and equal ids are no conflict.

    Each pass leaves out what earlier ones match, so the pairs (many times the rows) don't move; only those of ids that
    several rows have are grouped.
    """
    known = lambda c: F.when(F.col(c) != "", F.lower(c))
    date = F.when(F.col("date") != "", F.substring("date", 1, 10))
    keys = lambda d, side: d.where("id IS NOT NULL").select(F.col("id").alias(side), *[c.alias(f"{side}_{name}") for name, c in (("case_number", known("case_number")), ("date", date), ("officer", known("officer")), ("location", known("location")))])
    same = lambda *names: reduce(Column.__and__, [F.col(f"current_{c}") == F.col(f"incoming_{c}") for c in names])
    passes = (("case number", same("case_number")), ("date and officer", same("date", "officer")), ("date and location", same("date", "location")))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        found = []
        for k, (reason, on) in enumerate(passes):
            earlier = [~F.coalesce(x, F.lit(False)) for _, x in passes[:k]]
            met = a.join(b, reduce(Column.__and__, [on, F.col("current") != F.col("incoming"), *earlier]))
            found.append(met.select("current", "incoming", F.struct(F.lit(k).alias("k"), F.lit(reason).alias("reason")).alias("why")))
        return reduce(DataFrame.unionByName, found)

    a, b = keys(current, "current"), keys(incoming, "incoming")
    again_a, again_b = (d.groupBy(side).count().where("count > 1").select(side) for d, side in ((a, "current"), (b, "incoming")))
    if again_a.isEmpty() and again_b.isEmpty():
        return pairs(a, b).select("current", "incoming", "why.reason")
    once_a, once_b = a.join(again_a, "current", "left_anti"), b.join(again_b, "incoming", "left_anti")
    several = pairs(a.join(again_a, "current", "left_semi"), b).unionByName(pairs(once_a, b.join(again_b, "incoming", "left_semi")))
    several = several.groupBy("current", "incoming").agg(F.min("why").alias("why"))
    return pairs(once_a, once_b).unionByName(several).select("current", "incoming", "why.reason")


#: Letters of a text that must stand in another for the two to be compared.
GRAM = 8


def _inside(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Pairs of rows where the needle stands in the text."""
    at = F.explode(F.sequence(F.lit(1), F.length(text)))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(text) - F.col("at") + 1)))
    grams = texts.select("*", at.alias("at")).select("*", sizes.alias("size"))
    grams = grams.select(*texts.columns, F.substring(F.col(text), F.col("at"), F.col("size")).alias("gram")).distinct()
    heads = needles.withColumn("gram", F.substring(F.col(needle), F.lit(1), F.lit(GRAM)))
    return heads.join(grams, "gram").where(F.contains(text, needle))


def link_evidence(items: DataFrame, files: DataFrame) -> DataFrame:
    """i, j, method and confidence of the files that four ordered passes link to items, each over what earlier ones left.

    Items have i (their order), file_id, item_number, serial and description; files have j, path, evidence_number, serial and
    filename.  The first pass takes the first file of that path, and a file may then serve several items; the others are
    one-to-one in input order.  The last is by containment of one normalized text in the other: pairs meet on the first
    letters (GRAM at most) of the shorter one, wherever the longer one has them, and are then compared whole.  Texts without
    letters match nothing.
    """
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    say = lambda d, method, confidence: d.select("i", "j", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
    first = files.groupBy(F.col("path").alias("file_id")).agg(F.min("j").alias("j"))
    found = [say(items.where("file_id <> ''").join(first, "file_id"), "evidence_file_id", "high")]
    rest = lambda: (items.join(reduce(DataFrame.unionByName, found), "i", "left_anti"), files.join(reduce(DataFrame.unionByName, found), "j", "left_anti"))
    for method, confidence, mine, theirs in (("item_number", "medium", "item_number", "evidence_number"), ("serial_number", "high", "serial", "serial")):
        left, right = rest()
        left = left.where(F.col(mine) != "").select(normal(mine).alias("key"), F.col("i").alias("o"))
        right = right.where(F.col(theirs) != "").select(normal(theirs).alias("key"), F.col("j").alias("o"))
        pairs = link_by_rank(left, right, "key", "o").select(F.col("o").alias("i"), F.col("o_right").alias("j"))
        found.append(written(say(pairs, method, confidence)))
    left, right = rest()
    left, right = left.select("i", normal("description").alias("d")).where("d <> ''"), right.select("j", normal("filename").alias("f")).where("f <> ''")
    free = written(_inside(left, "d", right, "f").unionByName(_inside(right, "f", left, "d")).select("i", "j").distinct())
    while not free.isEmpty():  # a pair that is the first of its item and of its file is what the greedy order takes
        of_item, of_file = free.groupBy("i").agg(F.min("j").alias("j")), free.groupBy("j").agg(F.min("i").alias("i"))
        taken = written(of_item.join(of_file, ["i", "j"]))
        found.append(say(taken, "filename", "low"))
        free = written(free.join(taken.select("i"), "i", "left_anti").join(taken.select("j"), "j", "left_anti"))
    return reduce(DataFrame.unionByName, found)


def linked_data(collections: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """collection, item, file and state of every item: linked, or unlinked where its collection isn't there.

    collections have collection; items have item and collection_id; files have item_id and file.
    """
    joined = items.join(collections, items["collection_id"] == collections["collection"], "left").join(files, items["item"] == files["item_id"], "left")
    return joined.select("collection", "item", "file", F.when(F.col("collection").isNull(), "unlinked").otherwise("linked").alias("state"))
