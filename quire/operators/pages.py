"""Page ranges, page sets and pages done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"(?U)^\s*\+?[0-9]+\s*$"


def page_range(text: Column, max_pages: Column) -> Column:
    """0-based pages of a range like '1-3, 5', sorted and distinct. Both ends of a part have to be pages; reversed
    parts count; anything else is ignored. Null and empty give no pages, which callers take as all pages."""

    def part(p: Column) -> Column:
        ends = F.split(p, "-", -1)
        one = F.when(p.rlike(_NUMBER), F.trim(p).try_cast("int"))
        a, b = (F.when(F.get(ends, F.lit(i)).rlike(_NUMBER), F.trim(F.get(ends, F.lit(i))).try_cast("int")) for i in (0, 1))
        inside = lambda x: x.between(1, max_pages)
        none = F.array().cast("array<int>")
        return F.when((F.size(ends) == 2) & inside(a) & inside(b), F.sequence(F.least(a, b) - 1, F.greatest(a, b) - 1)).when((F.size(ends) == 1) & inside(one), F.array(one - 1)).otherwise(none)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), part))))


def on_pages(segments: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments on the listed pages (key, page_idx); a missing page counts as 0."""
    at = segments.withColumn("__page", F.coalesce("page_idx", F.lit(0)))
    return at.join(pages.withColumnRenamed("page_idx", "__page"), [key, "__page"], "left_semi").drop("__page")


def off_pages(total: Column, targets: Column) -> Column:
    """Pages from 0 to total - 1 that aren't targets."""
    return F.array_except(F.sequence(F.lit(0), total - 1), targets)


def total_pages(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total_pages): the last page plus one, 1 where no page is known."""
    return segments.groupBy(key).agg(F.coalesce(F.max("page_idx") + 1, F.lit(1)).alias("total_pages"))


def any_done(segments: DataFrame, done: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, any_done): whether some target page (key, page_idx) of a document has a row that is done (key, seg_id)."""
    hit = on_pages(segments, targets, key).join(done.select(key, "seg_id").distinct(), [key, "seg_id"], "left_semi").select(key).distinct().withColumn("any_done", F.lit(True))
    return targets.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("any_done", F.lit(False)).alias("any_done"))


def range_position(page: Column, targets: Column, total: Column) -> Column:
    """1-based step of a physical page in a range; outside the range the page, at most the total."""
    at = F.array_position(targets, page - 1)
    return F.when(at > 0, at.cast("int")).otherwise(F.least(page, total))


def most_visible(boxes: DataFrame, view_height: float, key: str) -> DataFrame:
    """(key, page_idx): the page that shows most between 0 and view_height, the first on a tie; boxes (key, page_idx, top, bottom)."""
    shown = F.greatest(F.lit(0.0), F.least(F.col("bottom"), F.lit(float(view_height))) - F.greatest(F.col("top"), F.lit(0.0)))
    return boxes.groupBy(key).agg(F.max_by("page_idx", F.struct(shown.alias("h"), (-F.col("page_idx")).alias("p"))).alias("page_idx"))
