"""Lines that many sites share, found by HyperLogLog sketches per line and removed.

Each line gets a sketch of the sites it occurs on; sketches merge by aggregation, in each task
before the shuffle. A sketch of up to 2**4 sites (its list of coupons) is as good as exact; above,
an estimate far from the threshold decides, and lines near it get an exact distinct count. Lines
travel as two 64-bit hashes. Texts stay where they are: the removed lines go to them, up to
:data:`FEW` of them; more meet the lines by a shuffle, and then the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.arrow import map_rows, schema_with
from groundwork.llm.registry import query, table
from groundwork.llm.storage import stored

#: 2**12 registers: a relative standard error of 1.6 %.
LOG_K = 12
#: Estimates within this share of the threshold are counted exactly: ten standard errors.
NEAR = 0.16
#: Up to this many removed lines are sent to the texts, 16 bytes each.
FEW = 500_000


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line):
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _blank(line):
    return F.length(F.trim(line)) == 0


def _hashes(text):
    """Two independent hashes of each different line that is not of spaces alone."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: ~_blank(x)), _hash))


def site_spread(docs: DataFrame, min_sites: int, text_column: str = "text", site_column: str = "source") -> DataFrame:
    """(h1, h2, sites): hashes of the lines on at least ``min_sites`` distinct sites.

    ``sites`` is exact near the threshold, an estimate elsewhere. Rows without a site count for none.
    """
    seen = docs.where(F.col(site_column).isNotNull()).select(
        F.col(site_column).cast("string").alias("site"), F.explode(_hashes(F.col(text_column))).alias("x")
    )
    seen = seen.select("x.h1", "x.h2", "site")
    sketched = stored(
        seen.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch")).select(
            "h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")
        ).where(F.col("sites") >= min_sites * (1 - NEAR)),
        "spread",
    )
    near = F.col("sites") <= min_sites * (1 + NEAR)
    exact = seen.join(sketched.where(near).select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sketched.where(~near).unionByName(exact)


def line_dedup(
    docs: DataFrame, min_sites: int = 5, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source", few: int = FEW
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text (the lines that stay).

    A line is what stands between line feeds, compared byte for byte; lines of spaces alone
    are never removed. A line found on ``min_sites`` distinct sites or more is removed everywhere,
    also from documents without a site. A null text has no lines and stays null; an empty text has
    one empty line. Repeated rows and missing identifiers are kept, each row with its own result. Other
    columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    wide = site_spread(docs, min_sites, text_column, site_column).select("h1", "h2")
    removed = wide.limit(few + 1).toArrow()
    return _filtered_in_place(own, removed) if removed.num_rows <= few else _filtered_by_join(own, wide)


def _filtered_in_place(own: DataFrame, removed: pa.Table) -> DataFrame:
    """The removed lines, of bounded number, are looked up where the texts are."""
    removed = removed.sort_by([("h1", "ascending"), ("h2", "ascending")])
    first, second = (removed[c].to_numpy() for c in ("h1", "h2"))

    def among(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at, end = np.searchsorted(first, h1), np.searchsorted(first, h1, "right")
        found = np.zeros(len(h1), bool)
        while (open_ := np.flatnonzero(at < end)).size:
            found[open_] |= second[at[open_]] == h2[open_]
            at[open_] += 1
        return found

    def work(tables):
        for part in tables:
            lines = part["lines"].combine_chunks()
            ends = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))
            flat = lines.flatten()
            blank = pc.is_null(flat.field("h1")).to_numpy(zero_copy_only=False)
            gone = among(*(pc.fill_null(flat.field(c), 0).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))) & ~blank
            starts = np.r_[0, ends[:-1]].astype(int)
            known = pc.is_valid(part["text"]).to_numpy()
            n_removed = np.diff(np.r_[0, np.cumsum(gone)][np.r_[starts, ends[-1:]].astype(int)])
            hit = np.flatnonzero(n_removed)
            rest = []
            for i, text in zip(hit, part["text"].take(hit).to_pylist(), strict=True):
                rest.append("\n".join(x for x, g in zip(text.split("\n"), gone[starts[i] : ends[i]], strict=True) if not g))
            text = part["text"].combine_chunks()
            yield {
                "doc_id": part["doc_id"],
                "n_lines": np.where(known, ends - starts, 0),
                "n_removed": n_removed,
                "text": pc.replace_with_mask(text, pa.array(n_removed > 0), pa.array(rest, text.type)) if rest else text,
            }

    hashes = F.transform(_lines(F.col("text")), lambda x: F.when(_blank(x), F.struct(F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"))).otherwise(_hash(x)))
    schema = schema_with(own, {"doc_id": "doc_id"}, "n_lines long, n_removed long, text string")
    return map_rows(own.withColumn("lines", hashes), schema, work)


def _filtered_by_join(own: DataFrame, wide: DataFrame) -> DataFrame:
    """The removed lines meet the lines, and what they hit the texts, by shuffles.

    What a text loses depends on the text alone, so texts go by their digest: copies of one text,
    however many, add up to one row of the lines it loses.
    """
    keyed = own.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    held = keyed.where("sha IS NOT NULL").select("sha", F.explode(_hashes(F.col("text"))).alias("x")).select("sha", "x.h1", "x.h2")
    # Both hashes must be a removed line's; one row per text leaves this join.
    bad = stored(held.join(wide, ["h1", "h2"]).groupBy("sha").agg(F.collect_set(F.struct("h1", "h2")).alias("bad")), "bad-lines")
    joined = keyed.join(bad, "sha", "left").withColumn("lines", _lines(F.col("text")))
    rest = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), _hash(x))))
    some = joined.withColumn("rest", rest)
    return some.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("rest")).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.array_join("rest", "\n")).alias("text"),
    )


MIN_SITES = 5

OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
wide AS (
  SELECT line FROM (SELECT source, unnest(lines) AS line FROM d)
  WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
bad AS (SELECT list(line) AS lines FROM wide),
k AS (SELECT doc_id, d.lines, list_filter(d.lines, lambda x: NOT list_contains(bad.lines, x)) AS rest, text FROM d, bad)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(rest) END AS n_removed,
       sha256(coalesce(array_to_string(rest, chr(10)), '')) AS kept_sha256
FROM k
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of ``documents`` on five sources or more are removed."""
    out = line_dedup(table(spark, directory, "documents"), MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
