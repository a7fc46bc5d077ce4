"""Lines that many sites share, removed from all documents but the first.

How many distinct sites hold a line is estimated with HyperLogLog sketches, one per line hash, that
merge where partial aggregates meet. Only lines whose estimate lies near the threshold are counted
exactly, so the decision is exact while most lines never need a list of their sites.
"""

from __future__ import annotations

from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import text_of
from panelweave.session import materialize

MIN_SITES = 10
#: Registers of a sketch, as a power of two; the relative error is about 1.04 / sqrt(2 ** LG_REGISTERS).
LG_REGISTERS = 10
#: Width of the zone that is counted exactly, in standard errors.
SIGMAS = 5


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """Each line that is not blank: its key, site (null is a site of its own), document and text hash."""
    body = text_of(text)
    each = docs.select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(body).alias("body"),
        F.coalesce(F.xxhash64(F.col(site)), F.lit(0)).alias("site"),
        F.explode(F.split(body, "\n")).alias("line"),
    )
    line = F.trim("line")
    return each.filter(line != "").select("doc", "body", "site", _key(line).alias("key"))


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Keys of the lines on at least ``min_sites`` distinct sites, with the first document that has each."""
    lines = _lines(docs, doc_id, text, site)
    spread = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS)))
    zone = max(1, ceil(SIGMAS * 1.04 / sqrt(2**LG_REGISTERS) * min_sites))
    low, high = max(0, floor(min_sites - zone)), min_sites + zone
    sketched = materialize(
        lines.groupBy("key").agg(spread.alias("sites"), F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).filter((F.col("n") >= min_sites) & (F.col("sites") >= low)),
        "sketched",
    )
    near = sketched.filter(F.col("sites") <= high).select("key", "first")
    exact = lines.join(near, "key").groupBy("key", "first", "site").agg(F.lit(1).alias("one")).groupBy("key", "first").agg(F.count("one").alias("sites"))
    return sketched.filter(F.col("sites") > high).select("key", "first").unionByName(exact.filter(F.col("sites") >= min_sites).select("key", "first"))


def drop_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source", removed: str | None = None) -> DataFrame:
    """``docs`` without the lines that at least ``min_sites`` distinct sites share.

    Lines are compared without spaces at their ends; blank lines stay. The document with the smallest
    id keeps its copies of a line, so no line is lost from the corpus; every other document loses it.
    All rows stay, with all columns, a null text as null; n_chars follows the new text where there is
    such a column. A null site counts as one site. Repeated rows are treated alike; rows with a null id
    lose every shared line that a row with an id has. ``removed`` names a column for the number of lines
    removed. An empty table gives an empty result.
    """
    shared = materialize(shared_lines(docs, min_sites, doc_id, text, site), "shared_lines")
    hits = (
        _lines(docs, doc_id, text, site)
        .join(shared, "key")
        .filter(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy("doc", "body")
        .agg(F.collect_set("key").alias("drop"))
        .select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("drop").alias("__drop"))
    )
    column = F.col(f"`{text}`")
    joined = docs.join(hits, column.isNotNull() & F.col(f"`{doc_id}`").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_of(text)) == F.col("__body")), "left")
    lines = F.split(column, "\n")
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("__drop"), _key(F.trim(line))))
    cleaned = F.when(F.col("__drop").isNull(), column).otherwise(F.array_join(kept, "\n"))
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out[text] = cleaned
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("__drop").isNull(), out["n_chars"]).otherwise(F.char_length(cleaned).cast(docs.schema["n_chars"].dataType))
    if removed:
        out[removed] = F.when(F.col("__drop").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return joined.select(*[v.alias(k) for k, v in out.items()])
