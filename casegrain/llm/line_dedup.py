"""Line dedup by distinct-site spread, with DataFrame functions only.

Each line's sites are counted by a HyperLogLog sketch, built and merged by aggregation.  Lines whose estimate is well over
the threshold are boilerplate, lines well under it are not; for those near it the exact distinct count decides, so the
result is that of exact counts.  A boilerplate line stays in the document with the least id that has it, and goes from
all others.

Only line hashes move, and the texts once, to put the kept lines back together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.llm import frames

#: Distinct sites from which a line counts as cross-site boilerplate.
MIN_SITES = 10
#: Sketches of 2**12 registers err by 1.6 % (one standard error); within this share of the threshold counts are exact.
NEAR, REGISTERS = 0.2, 12


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with boilerplate lines removed from `text`, and two more columns, lines_before and lines_removed.

    Lines are cut at \\n and compared without white space at their ends; blank lines are kept and never counted.  A null text
    stays null with 0 lines.  A null site counts as one site; a null doc_id sorts after all others.  Rows with the doc_id
    that keeps a line all keep it.  An empty table gives none.  Columns of docs named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lines_before", "lines_removed")]
    gone_at, gone_id, gone_key = (frames.fresh_name(docs.columns, c) for c in ("gone", "gone_id", "gone_key"))
    whole = F.split(F.col(text).cast("string"), "\n")
    line = F.trim(F.regexp_replace(F.col("line"), r"^\s+|\s+$", ""))
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(order.alias("id"), F.xxhash64(F.col(text).cast("string")).alias("tkey"), F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"), F.posexplode(whole).alias("at", "line"))
    rows = rows.withColumn("line", line).where("line <> ''").select("id", "tkey", "site", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"))
    rows = frames.checkpointed(rows)  # texts are cut into lines once; from here on only hashes move
    spread = rows.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"), F.min("id").alias("first"))
    spread = spread.select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR))
    spread = frames.checkpointed(spread)
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR))
    exact = rows.join(near.select("h", "g"), ["h", "g"]).groupBy("h", "g").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    common = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("h", "g", "first")
    common = common.unionByName(near.join(exact.select("h", "g"), ["h", "g"]).select("h", "g", "first"))
    gone = rows.join(common, ["h", "g"]).where("id <> first").groupBy("id", "tkey").agg(F.collect_set("at").alias(gone_at))
    gone = gone.select(F.col("id").alias(gone_id), F.col("tkey").alias(gone_key), gone_at)
    out = docs.join(gone, (order == F.col(gone_id)) & (F.xxhash64(docs[text].cast("string")) == F.col(gone_key)), "left")
    lines = F.transform(whole, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    left = F.transform(F.filter(lines, lambda s: ~F.array_contains(gone_at, s["i"])), lambda s: s["x"])
    new = F.when(F.col(gone_at).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return out.select(*[(new.alias(c) if c == text else F.col(f"`{c}`")) for c in kept], F.coalesce(F.size(whole), F.lit(0)).cast("long").alias("lines_before"), F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("lines_removed")).withColumn("lines_before", F.when(F.col("lines_before") < 0, 0).otherwise(F.col("lines_before"))).withColumn("lines_removed", F.greatest("lines_removed", F.lit(0).cast("long")))
