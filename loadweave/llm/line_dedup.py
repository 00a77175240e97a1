"""Cross-site boilerplate lines: site spread by HyperLogLog, in DataFrame functions only.

A line is a \\n-separated piece of a text that has a character other than ASCII white
space; lines are compared whole, by XXH64. Its spread is the number of distinct sites
(null is no site) whose documents have it. Lines with a spread of ``min_sites`` or more are boilerplate:
of each, the first occurrence (smallest document id, then position; null ids last)
stays, all others go. So copies of a document over many sites leave one whole.

Spread is estimated by one sketch per line, merged by the aggregation. Sketches are
exact for small numbers and off by 1.6 % (one standard deviation) for large ones; every line whose estimate
lies within ``_BAND`` (more than six deviations) or two sites of the threshold is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import SPACED_WORD, let
from loadweave.session import pin

MIN_SITES = 5
_SKETCH_BITS = 12
_BAND = 0.1


def _line_rows(docs: DataFrame, site: str) -> DataFrame:
    """id, key, pos, h, site: one narrow row per line, no texts."""
    rows = docs.select(
        F.col("doc_id").alias("id"),
        _row_key().alias("key"),
        F.col(site).cast("string").alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    return rows.filter(F.col("line").rlike(SPACED_WORD)).select(
        "id", "key", "pos", F.xxhash64("line").alias("h"), "site"
    )


def _row_key() -> Column:
    # rows with equal id and text have the same lines to lose
    return F.xxhash64("doc_id", "text")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, first_id, first_pos of the lines of ``_line_rows`` that reach the spread."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "pos")
    spread = pin(
        lines.groupBy("h")
        .agg(
            F.hll_sketch_agg("site", _SKETCH_BITS).alias("sketch"),
            F.count("*").alias("n"),
            F.min(place).alias("first"),
        )
        .filter(F.col("n") >= min_sites)  # no line has more sites than occurrences
        .select("h", F.hll_sketch_estimate("sketch").alias("sites"), "first")
    )
    margin = max(2, round(min_sites * _BAND))
    sure = spread.filter(F.col("sites") > min_sites + margin)
    near = spread.filter(F.abs(F.col("sites") - min_sites) <= margin)
    # grouped by a hash of the line: the shuffle that this asks for lets a hot line
    # be split over tasks in the join before it
    exact = (
        lines.join(near.select("h"), "h", "left_semi")
        .groupBy(F.xxhash64("h").alias("g"), "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("g")
        .agg(F.count("site").alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    counted = near.withColumn("g", F.xxhash64("h")).join(exact, "g", "left_semi").drop("g")
    return pin(
        sure.unionByName(counted).select(
            "h", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos")
        )
    )


def _removals(lines: DataFrame, found: DataFrame) -> DataFrame:
    """key, n_removed, masks: for each 64 lines of a document, from its first on, the bits of those that go."""
    gone = lines.join(found, "h").filter(
        ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos")))
    )
    chunk = F.shiftright("pos", 6)
    bit = F.expr("shiftleft(1L, pos % 64)")
    masks = gone.groupBy("key", chunk.alias("chunk")).agg(F.bit_or(bit).alias("mask"))
    gathered = masks.groupBy("key").agg(
        F.sum(F.bit_count("mask")).cast("long").alias("n_removed"),
        F.sort_array(F.collect_list(F.struct("chunk", "mask"))).alias("found"),
    )

    def filled(found):
        """Masks by chunk, zero where nothing goes: a line finds its own at once."""

        def one(x, i):
            before = F.coalesce(F.get(found, i - 1)["chunk"], F.lit(-1))
            return F.concat(F.array_repeat(F.lit(0).cast("long"), x["chunk"] - before - 1), F.array(x["mask"]))

        return F.flatten(F.transform(found, one))

    return gathered.select("key", "n_removed", let(F.col("found"), filled).alias("masks"))


def _remaining(text: Column, masks: Column) -> Column:
    def stays(_, i):
        mask = F.get(masks, F.shiftright(i, 6))
        return F.coalesce(F.getbit(mask, F.pmod(i, F.lit(64))), F.lit(0)) == 0

    kept = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    return F.when(masks.isNull(), text).otherwise(kept)


def _with_removals(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """row (all columns of docs as a struct), text (what remains), n_removed."""
    lines = pin(_line_rows(docs, site))
    removals = _removals(lines, boilerplate(lines, min_sites))
    rows = docs.select(F.struct("*").alias("row"), _row_key().alias("key"))
    # removals grow with the documents: one plan for all sizes, never a broadcast; a hash of the key
    # asks for a shuffle below the join, so that rows that share an id and text can be split over tasks
    check = {"check": F.xxhash64("key")}
    joined = rows.withColumns(check).join(removals.withColumns(check).hint("merge"), ["key", "check"], "left")
    return joined.select(
        "row",
        _remaining(F.col("row.text"), F.col("masks")).alias("text"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
    )


def line_report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of what remains (a null text as empty).

    One row per row of ``docs``; rows that share an id and text lose the same lines.
    """
    found = _with_removals(docs.select("doc_id", "text", site), site, min_sites)
    lines = F.filter(F.split("row.text", "\n"), lambda x: x.rlike(SPACED_WORD))
    return found.select(
        "row.doc_id",
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def without_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """The documents, ``text`` without boilerplate; all rows and other columns stay."""
    found = _with_removals(docs, site, min_sites)
    return found.select(
        *[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )
