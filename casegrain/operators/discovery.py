"""Finding containers and case databases in listings of files (path, size): by name, by first bytes, by what stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.functions import scalars as S

#: Parts of a set after the first: only the first stands for the set.
LATER_PART = r"(?i)\.(?:e(?:0[2-9]|[1-9]\d)|ex(?:0[2-9]|[1-9]\d)|l(?:0[2-9]|[1-9]\d)|ad(?:[2-9]|\d{2,})|0(?:0[2-9]|[1-9]\d)|[1-9]\d\d)$"
# Case databases by names below a case's folder.
CASE_DATABASES = (
    ("AXIOM", r"(?i)\.mfdb$"),
    ("Cellebrite", r"(?i)\.(?:ufdr|ufdx|pas)$"),
    ("X-Ways", r"(?i)\.xfc$"),
    ("Autopsy", r"(?i)\.(?:aut|db)$"),
    ("EnCase", r"(?i)\.case$"),
    ("FTK", r"(?i)\.ftk$"),
)


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def with_sibling(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows (folder, stem) with another's stem in their folder that starts with theirs, whatever the case.

    Stems meet by equality: each of the others' stems is cut to the lengths that rows of its folder have.
    """
    lengths = rows.select("folder", F.length("stem").alias("length")).distinct()
    heads = others.join(lengths, "folder").where(F.length("stem") >= F.col("length"))
    heads = heads.select("folder", F.lower(F.substring(F.col("stem"), F.lit(1), F.col("length"))).alias("head")).distinct()
    return rows.join(heads, (rows["folder"] == heads["folder"]) & (F.lower(rows["stem"]) == heads["head"]), "left_semi")


def containers(files: DataFrame) -> DataFrame:
    """path, name, container_type and size of the containers among files.

    Left out: hidden twins (._*), parts of sets after the first, files that only point at others.  A ZIP beside a UFD whose
    name starts with its own is a UFED extraction.  A path that is listed twice counts once.
    """
    name = S.file_name(F.col("path"))
    rows = files.groupBy("path").agg(F.max("size").alias("size")).select("path", "size", name.alias("name"), S.parent_path(F.col("path")).alias("folder"), S.container_type(name).alias("container_type"))
    rows = rows.where(~F.startswith("name", F.lit("._")) & ~F.col("name").rlike(LATER_PART) & F.col("container_type").isNotNull()).withColumn("stem", stem(F.col("name")))
    zips, other = rows.where("container_type = 'ZIP'"), rows.where("container_type <> 'ZIP'")
    ufd = rows.where("container_type = 'UFED (UFD)'").select("folder", "stem")
    beside = with_sibling(zips, ufd).select(F.col("path").alias("p"), F.lit(True).alias("ufed"))
    zips = zips.join(beside, zips["path"] == beside["p"], "left").withColumn("container_type", F.when(F.col("ufed"), "UFED").otherwise("ZIP")).drop("p", "ufed")
    return zips.unionByName(other).select("path", "name", "container_type", "size")


def container_kind(name: Column, head: Column) -> Column:
    """ad1, l01, archive, ewf or raw by first bytes, and by name for raw images; null for other files.  Tried in this order."""
    first = F.hex(F.substring(head, 1, 16))
    archive = first.rlike("^(504B0304|504B0506|377ABCAF271C|526172211A07|1F8B|425A68|FD377A585A00)")
    return F.when(first.startswith("41445345474D454E54454446494C45"), "ad1").when(first.startswith("4C5646090D0A"), "l01").when(archive, "archive").when(first.startswith("455646090D0A"), "ewf").when(F.lower(name).rlike(r"\.(dd|raw|img|001|bin)$"), "raw")


def case_databases(files: DataFrame) -> DataFrame:
    """path, tool and folder of third-party case databases by file name."""
    out = F.lit(None).cast("string")
    for tool, pattern in reversed(CASE_DATABASES):
        out = F.when(F.col("path").rlike(pattern), tool).otherwise(out)
    return files.select("path", out.alias("tool"), S.parent_path(F.col("path")).alias("folder")).where("tool is not null")


def case_documents(files: DataFrame) -> DataFrame:
    """path, document_type, case_number, evidence_id by name, then (where content has some text) by what it says."""
    name = S.file_name(F.col("path"))
    by_name = S.document_type(name)
    says = F.lower(F.coalesce(F.col("content"), F.lit("")))
    by_text = F.when(says.contains("chain of custody"), "chain_of_custody").when(says.contains("evidence intake"), "evidence_intake").when(says.rlike("(case|examiner) notes"), "case_notes").when(says.contains("receipt"), "evidence_receipt").otherwise("other")
    return files.select("path", F.when(by_name != "other", by_name).otherwise(by_text).alias("document_type"), S.case_number(name).alias("case_number"), S.evidence_id(name).alias("evidence_id"))
