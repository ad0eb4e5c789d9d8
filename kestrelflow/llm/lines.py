"""Site-relative line removal: lines that stand on more than a share of a host's pages are boilerplate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelflow.llm.common import WordHasher, arrow_rows, packed, released, settled, steps, stored, utf8
from kestrelflow.llm.neardup import WIDE, near_duplicates


def _not_line() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x0A] = True
    return table


def line_hashes(column: pa.Array):
    """For each text, the hashes of its lines that aren't empty."""
    hasher = WordHasher(_not_line(), fold=False)
    data, offsets = utf8(column)
    for i, j in steps(offsets):
        lines, _, first = hasher.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield from (lines[first[k] : first[k + 1]] for k in range(j - i))


#: So many boilerplate lines of all hosts together are broadcast as arrays by host; more travel with the rows.
MOST_LISTED = 1 << 20


def with_lists(rows: DataFrame, host: Column, drop: DataFrame):
    """The rows for a task, and a function that gives the sorted line hashes (or None) for each row of a batch."""
    spark = rows.sparkSession
    many = drop.agg(F.coalesce(F.sum(F.size("drop") + 1), F.lit(0))).first()[0]
    if many <= MOST_LISTED:
        held = spark.sparkContext.broadcast({r["host"]: np.array(r["drop"], np.int64) for r in drop.collect()})

        def broadcast_lists(batch: pa.RecordBatch) -> list:
            hosts = batch.column("_host").dictionary_encode()
            lists = [held.value.get(h) for h in hosts.dictionary.to_pylist()]
            none = held.value.get(None)
            return [none if i is None else lists[i] for i in hosts.indices.to_pylist()]

        return rows.withColumn("_host", host), broadcast_lists

    def own_lists(batch: pa.RecordBatch) -> list:
        drops = batch.column("_drop")
        at, every = drops.offsets.to_numpy(), drops.values.to_numpy()
        return [every[at[r] : at[r + 1]] if valid else None for r, valid in enumerate(drops.is_valid().to_pylist())]

    listed = drop.select(F.col("host").alias("_of"), F.col("drop").alias("_drop"))
    return rows.withColumn("_host", host).join(listed, F.col("_host").eqNullSafe(F.col("_of")), "left").drop("_of"), own_lists


def listed_among(lines: np.ndarray, listed: np.ndarray | None) -> np.ndarray:
    """Which of a page's lines are in a sorted list."""
    if listed is None or not len(listed):
        return np.zeros(len(lines), bool)
    lines = lines.view(np.int64)
    return listed[np.minimum(np.searchsorted(listed, lines), len(listed) - 1)] == lines


def _frequent(on: DataFrame, totals: DataFrame, percent: int, least: int) -> DataFrame:
    """(host, drop) of (host, line, n) and (of, total)."""
    found = on.where(F.col("n") >= least).join(totals, F.col("host").eqNullSafe(F.col("of")))
    found = found.where(100 * F.col("n") > percent * F.col("total"))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def boilerplate_lines(pages: DataFrame, percent: int, least_pages: int) -> DataFrame:
    """(host, drop): for each host that has some, the hashes of its boilerplate lines.

    A host's list is bounded: with L lines on an average page, at most 100 * L / percent lines can
    stand on more than that share of its pages. Counts are of pages, over all pages, and are summed
    before they are shuffled.
    """

    def work(batch: pa.RecordBatch):
        found = [np.unique(x) for x in line_hashes(batch.column("text"))]
        sizes = np.array([len(x) for x in found], np.int64)
        at = pa.array(np.repeat(np.arange(len(found)), sizes))
        lines = np.concatenate([*found, np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column("host").take(at), pa.array(lines.view(np.int64))], ["host", "line"])

    on_pages = arrow_rows(pages.select("host", "text"), work, "host string, line long").groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("total"))
    return _frequent(on_pages, totals, percent, least_pages)


def boilerplate_of_groups(pages: DataFrame, percent: int, least: int, near: tuple[int, int]) -> DataFrame:
    """(host, drop) as boilerplate_lines(), where copies of a text are one page, and near copies too.

    A line has to be on more than the share of a host's different texts, and on more than the share
    of its groups of near-duplicates. Only pages that hold a line of the first kind are grouped.
    """
    pages = pages.withColumn("page", F.xxhash64("text"))

    def work(batch: pa.RecordBatch):
        found = [np.unique(x) for x in line_hashes(batch.column("text"))]
        at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        lines = np.concatenate([*found, np.zeros(0, np.uint64)])
        kept = [batch.column("host").take(at), batch.column("page").take(at), pa.array(lines.view(np.int64))]
        yield pa.RecordBatch.from_arrays(kept, ["host", "page", "line"])

    each = arrow_rows(pages.select("host", "page", "text"), work, "host string, page long, line long").distinct()
    totals = settled(pages.select("host", "page").distinct().groupBy(F.col("host").alias("of")).agg(F.count("*").alias("total")))
    first = settled(_frequent(each.groupBy("host", "line").agg(F.count("*").alias("n")), totals, percent, least))

    held, lists = with_lists(pages.select("host", "page", "text"), F.col("host"), first)

    def holding(batch: pa.RecordBatch):
        hits = [np.unique(x[listed_among(x, own)]).view(np.int64) for x, own in zip(line_hashes(batch.column("text")), lists(batch), strict=True)]
        some = pa.array([len(x) > 0 for x in hits], pa.bool_())
        out = [*(batch.column(c) for c in ("host", "page", "text")), pa.array(hits, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["host", "page", "text", "lines"]).filter(some)

    held = stored(arrow_rows(held, holding, "host string, page long, text string, lines array<long>"), "held")
    texts = held.groupBy("page").agg(F.first("text").alias("text")).select(F.col("page").alias("doc_id"), "text")
    groups = near_duplicates(texts, *near).select(F.col("doc_id").alias("page"), F.col("component_id").alias("group"))
    grouped = settled(held.select("host", "page", "lines").distinct().join(groups, "page"))
    grouped = packed(grouped, held.count(), WIDE)
    released(pages.sparkSession, held)
    fewer = grouped.groupBy(F.col("host").alias("in")).agg((F.count_distinct("page") - F.count_distinct("group")).alias("fewer"))
    totals = totals.join(fewer, F.col("of").eqNullSafe(F.col("in")), "left").select("of", (F.col("total") - F.coalesce("fewer", F.lit(0))).alias("total"))
    on = grouped.select("host", "group", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    return _frequent(on, totals, percent, least)


def drop_boilerplate(
    pages: DataFrame, host: str = "source", percent: int = 5, least_pages: int = 3, near: tuple[int, int] | None = None
) -> DataFrame:
    """The pages with `text` without boilerplate lines, and columns n_lines and n_dropped.

    A line is boilerplate if at least `least_pages` pages of its host and more than `percent` percent
    of them hold it. Lines end at line feeds and count as equal if their 64-bit hashes are; a page counts
    once for a line however often it repeats it. Empty lines are never dropped and aren't counted.
    A null text stays null, a text whose lines all go is empty, a null host is a host of its own.
    All rows stay, repeated rows too; no rows give no rows. Columns named n_lines and n_dropped are
    replaced.

    Every row counts as a page, so lines of a text that is copied often are boilerplate. With `near`,
    a shingle size and a percentage as near_duplicates() takes them, a host's copies of one text
    count as one page, in the count of all pages too, and so do near-duplicates: no group of copies
    loses its text by its own size.
    """
    keyed = pages.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    found = boilerplate_of_groups(keyed, percent, least_pages, near) if near else boilerplate_lines(keyed, percent, least_pages)
    rows = pages.drop("n_lines", "n_dropped").withColumn("text", F.col("text").cast("string"))
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    packed = rows.select(F.struct("*").alias("_row"))  # apart from names of ours
    packed, lists = with_lists(packed, F.col("_row")[host].cast("string"), stored(found, "boilerplate"))

    def work(batch: pa.RecordBatch):
        row = batch.column("_row")
        texts = row.field("text")
        out, total, gone = texts.to_pylist(), [], []
        for r, (lines, own) in enumerate(zip(line_hashes(texts), lists(batch), strict=True)):
            bad = listed_among(lines, own)
            total.append(len(lines))
            gone.append(int(bad.sum()))
            if gone[-1]:
                each = iter(bad.tolist())
                out[r] = "\n".join(x for x in out[r].split("\n") if not x or not next(each))
        kept = [pa.array(out, pa.string()) if c == "text" else row.field(c) for c in columns]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*columns, "n_lines", "n_dropped"])

    return arrow_rows(packed, work, f"{schema}, n_lines long, n_dropped long")
