"""Packing documents into batches of a token budget, in length buckets that waste the least padding.

One pass gives the histogram of lengths (words). Lengths up to FINE are cells of their own, longer ones fall into cells that
grow by 1/256, so the histogram has a few thousand cells for any corpus. Dynamic programming over the cells finds the
`buckets` bucket bounds that minimise total padding, every document being padded to the bound of its bucket.
Inside a bucket documents are dealt, in a given order or else that of a hash of doc_id, to batches of floor(budget / bound)
documents (at least one: a document beyond the budget is a batch of its own).

Numbers inside a bucket come from counts of groups (ranges of the order, or of the hash) and a window inside a group. Null and empty texts have length
0 and share the first bucket. Rows that repeat a doc_id are packed one by one, as tied rows. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.mixing import n_words
from tenure.llm.scratch import Scratch

FINE = 1024
BUDGET = 65_536
BUCKETS = 16
GROUP_ROWS = 5_000


def cell(length: Column) -> Column:
    """Number of the histogram cell of a length."""
    octave = F.floor(F.log2(length / FINE))
    step = F.pow(F.lit(2.0), octave) * (FINE / 256)
    return F.when(length <= FINE, length).otherwise(FINE + 1 + octave * 256 + F.floor((length - FINE * F.pow(F.lit(2.0), octave)) / step)).cast("long")


def best_bounds(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, of at most `buckets` runs of cells, that minimise the padding to them.

    top: the greatest length of each cell, ascending; count and total: its documents and their summed lengths.
    """
    n = len(top)
    if not n:
        return []
    counts, sums = np.concatenate([[0.0], np.cumsum(count)]), np.concatenate([[0.0], np.cumsum(total)])
    best = top * counts[1:] - sums[1:]
    cut = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        before = np.concatenate([[0.0], best[:-1]])
        after, at = np.empty(n), np.empty(n, np.int64)
        for a in range(0, n, 256):
            last = np.arange(a, min(n, a + 256))
            first = np.arange(last[-1] + 1)
            cost = before[first] + top[last, None] * (counts[last + 1, None] - counts[first]) - (sums[last + 1, None] - sums[first])
            cost[first[None, :] > last[:, None]] = np.inf
            at[last] = cost.argmin(1)
            after[last] = cost[np.arange(len(last)), at[last]]
        cut.append(at)
        best = after
    bounds, end = [], n - 1
    for at in reversed(cut):
        bounds.append(int(top[end]))
        end = int(at[end]) - 1
        if end < 0:
            break
    return bounds[::-1]


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs with `_range` and `_place`: where a row stands in docs as it was sorted.

    In a table of files that is the number of the file and the row in it, as tasks may read files in any order;
    otherwise it is the partition and the row in it. Other columns are left out, whatever their names.
    """
    if docs.inputFiles():
        meta = docs.metadataColumn("_metadata")
        file = F.struct(F.regexp_extract(meta["file_name"], r"part-(\d+)", 1).try_cast("long").alias("number"), meta["file_path"].alias("path"))
        try:
            return docs.select("doc_id", "text", file.alias("_range"), meta["row_index"].alias("_place"))
        except AnalysisException:  # made from files, but not by a scan alone
            pass
    at = F.monotonically_increasing_id()
    return docs.select("doc_id", "text", F.shiftright(at, 33).alias("_range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, ordered: bool = False) -> DataFrame:
    """doc_id, n_tokens, bucket, pad_to, batch, slot (its place in the batch): one row per document.

    ordered: docs has the columns of numbered(), and batches of a bucket follow them.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"), *(("_range", "_place") if ordered else ())))
    cells = (
        rows.groupBy(cell(F.col("n_tokens")).alias("cell"))
        .agg(F.max("n_tokens").alias("top"), F.count("*").alias("count"), F.sum("n_tokens").alias("total"))
        .orderBy("cell").toPandas()
    )
    bounds = best_bounds(*(cells[c].to_numpy(float) for c in ("top", "count", "total")), buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", *(F.lit(0).cast(t).alias(n) for n, t in _ADDED.items()))
    where = F.lit(0)
    for b in bounds[:-1]:
        where = where + (F.col("n_tokens") > b).cast("int")
    largest = int(cells["count"].sum())
    digits = max(0, math.ceil(math.log(max(1, largest / GROUP_ROWS), 16)))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    if ordered:
        order, group = F.col("_place"), F.struct("_range", F.floor(F.col("_place") / GROUP_ROWS).alias("part"))
    else:
        group = F.substring("_order", 1, digits) if digits else F.lit("")
    rows = rows.withColumn("bucket", where).withColumn("_order", order).withColumn("_group", group)
    groups = rows.groupBy("bucket", "_group").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("bucket").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("bucket", "_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("bucket", "_group").orderBy("_order", "n_tokens")
    rows = rows.withColumn("_inside", F.row_number().over(inside) - 1).join(groups, ["bucket", "_group"])
    pad = F.array(*map(F.lit, bounds))[F.col("bucket")].cast("long")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), pad)))
    number = F.col("_base") + F.col("_inside")
    return rows.select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), pad.alias("pad_to"),
        F.floor(number / fits).cast("long").alias("batch"), F.pmod(number, fits).cast("long").alias("slot"),
    )


_ADDED = {"bucket": "int", "pad_to": "long", "batch": "long", "slot": "long"}
