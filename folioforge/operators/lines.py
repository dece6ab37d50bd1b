"""Rules over the lines of texts as windows of each text: runs, neighbourhoods, page edges, repeats.

A text is exploded into rows (key, at, line), at from 0. Each rule marks lines or says what it found; ``joined`` puts texts
together again. No text is looked at by Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"(?i)^arxiv:\d{4}\.\d{4,5}(?:v\d+)?"
RADIUS, SHORT_RUN, REPEATS = 5, 8, 3


def lines_of(docs: DataFrame, key: str = "item_key", text: str = "document", by: str = "\n") -> DataFrame:
    """key, at, line of whole texts; a null text has no lines."""
    return docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), by)).alias("at", "line"))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def shown(line: Column) -> Column:
    """A line without the marks of headings and lists around it."""
    return F.regexp_replace(stripped(line), r"^[#* \t]+|[#* \t]+$", "")


def squeezed(line: Column) -> Column:
    return F.lower(stripped(F.regexp_replace(line, r"\s+", " ")))


def islands(lines: DataFrame, inside: Column) -> DataFrame:
    """``lines`` for which ``inside`` holds, with run: where the run of such lines begins that each is part of."""
    order = Window.partitionBy("key").orderBy("at")
    marked = lines.withColumn("_in", F.coalesce(inside, F.lit(False)))
    begins = F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(order), F.lit(False)), F.col("at"))
    return marked.withColumn("run", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_in").drop("_in")


def short_runs(lines: DataFrame, longest: int = 1, least: int = SHORT_RUN) -> DataFrame:
    """key, run, n, cells of runs of at least so many lines of at most so many characters; cells: those that are not blank, in order."""
    found = islands(lines, F.char_length(stripped(F.col("line"))) <= longest)
    cell = F.struct("at", stripped(F.col("line")).alias("text"))
    cells = F.array_sort(F.collect_list(F.when(stripped(F.col("line")) != "", cell)))
    return found.groupBy("key", "run").agg(F.count("*").alias("n"), cells.alias("cells")).filter(F.col("n") >= least)


def stamped(lines: DataFrame, stamp: str = STAMP) -> DataFrame:
    """key, at of the lines that spell a stamp, one character a line, forwards or backwards, within a run of short lines."""
    both = short_runs(lines).select("key", F.explode(F.array("cells", F.reverse("cells"))).alias("cells")).withColumn("text", F.array_join(F.transform("cells", lambda c: c["text"]), ""))
    begins = both.select("key", "cells", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("text")))).alias("i"))
    n = F.char_length(F.regexp_extract(F.expr("substring(text, i)"), stamp, 0))
    hit = begins.withColumn("n", n).filter("n > 0").select("key", F.explode(F.slice("cells", F.col("i"), F.col("n"))).alias("c"))
    return hit.select("key", F.col("c.at").alias("at")).distinct()


def near(lines: DataFrame, banner: Column, radius: int = RADIUS) -> DataFrame:
    """``lines`` with is_banner, and near: whether one is at most ``radius`` lines away."""
    around = Window.partitionBy("key").orderBy("at").rowsBetween(-radius, radius)
    return lines.withColumn("is_banner", F.coalesce(banner, F.lit(False))).withColumn("near", F.max("is_banner").over(around))


def edges(lines: DataFrame, boundary: Column) -> DataFrame:
    """``lines`` with is_edge: the first and the last line of a page that is not blank, in texts that have a ``boundary`` at all,
    and times: how often a line like it is in its text."""
    text, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("at")
    told = lines.withColumn("_break", F.coalesce(boundary, F.lit(False))).withColumn("_filled", ~F.col("_break") & (stripped(F.col("line")) != ""))
    told = told.withColumn("_page", F.sum(F.col("_break").cast("int")).over(order)).withColumn("_paged", F.max("_break").over(text)).withColumn("_last", F.max("_page").over(text))
    page = Window.partitionBy("key", "_page")
    at = F.when(F.col("_filled"), F.col("at"))
    told = told.withColumn("_lo", F.min(at).over(page)).withColumn("_hi", F.max(at).over(page))
    is_edge = F.col("_paged") & F.col("_filled") & ((F.col("at") == F.col("_lo")) | ((F.col("at") == F.col("_hi")) & (F.col("_page") < F.col("_last"))))
    like = Window.partitionBy("key", squeezed(F.col("line")))
    return told.withColumn("is_edge", is_edge).withColumn("times", F.count("*").over(like)).select(*lines.columns, "is_edge", "times")


def running_headers(lines: DataFrame, boundary: Column, header: str, least: int = REPEATS) -> DataFrame:
    """The lines at page edges that occur ``least`` times in their text and look like a header."""
    return edges(lines, boundary).filter(F.col("is_edge") & (F.col("times") >= least) & (squeezed(F.col("line")).rlike(header) | stripped(F.col("line")).rlike(header))).drop("is_edge")


def joined(lines: DataFrame) -> DataFrame:
    """key, document: the lines of each text that are left, in order."""
    return lines.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("document"))
