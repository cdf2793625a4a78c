"""Hierarchical code regions as column expressions.

A region is file, class, function and line range; its text form is file:<p>::class:<c>::func:<f>::lines:<a>-<b>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("file_path", "class_name", "func_name", "line_start", "line_end")


def parts(text: Column) -> Column:
    """The marked parts of a region's text, for parse: as a column of its own it is split once a row."""
    return F.split(F.trim(text), "::")


def parse(text: Column, split: Column | None = None) -> Column:
    """Text -> struct of FIELDS. Text without the file: mark is a path as a whole; blank text gives null."""
    whole = F.trim(text)
    split = parts(text) if split is None else split
    after = lambda mark, p: F.when(F.startswith(p, F.lit(mark)), F.substr(p, F.lit(len(mark) + 1)))

    def part(mark: str) -> Column:  # the first such part; lambdas are slow and only for more parts than fields
        later = F.get(F.filter(F.transform(F.slice(split, 5, F.size(split)), lambda p: after(mark, p)), lambda p: p.isNotNull()), F.lit(0))
        return F.coalesce(*[after(mark, F.get(split, F.lit(k))) for k in range(4)], F.when(F.size(split) > 4, later))

    lines = F.split(part("lines:"), "-")
    first = F.get(lines, F.lit(0)).try_cast("long")
    last = F.coalesce(F.get(lines, F.lit(1)).try_cast("long"), first)
    marked = F.startswith(whole, F.lit("file:"))
    only = lambda c: F.when(marked, c)
    made = F.struct(
        F.when(marked, part("file:")).otherwise(whole).alias("file_path"), only(part("class:")).alias("class_name"), only(part("func:")).alias("func_name"),
        only(first).alias("line_start"), only(last).alias("line_end"),
    )
    return F.when(F.length(whole) > 0, made)


def text(r: Column) -> Column:
    """The canonical text of a region struct; a single line prints as n-n."""
    mark = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name), c.cast("string")))
    lines = F.when(r["line_start"].isNotNull(), F.concat(F.lit("lines:"), r["line_start"].cast("string"), F.lit("-"), F.coalesce(r["line_end"], r["line_start"]).cast("string")))
    return F.concat_ws("::", mark("file:", r["file_path"]), mark("class:", r["class_name"]), mark("func:", r["func_name"]), lines)


def level(r: Column) -> Column:
    return F.when(r["line_start"].isNotNull(), "lines").when(r["func_name"].isNotNull(), "func").when(r["class_name"].isNotNull(), "class").otherwise("file")


def valid(r: Column) -> Column:
    """A path, and either no line range or one from 1 on that doesn't run backwards."""
    lines = r["line_start"].isNull() | r["line_end"].isNull() | ((r["line_start"] >= 1) & (r["line_start"] <= r["line_end"]))
    return F.coalesce(F.length(r["file_path"]) > 0, F.lit(False)) & lines


def contains(a: Column, b: Column) -> Column:
    """Whether region a holds region b: decided at a's own level."""
    of = level(a)
    inside = (
        F.when(of == "file", F.lit(True))
        .when(of == "class", a["class_name"].eqNullSafe(b["class_name"]))
        .when(of == "func", a["func_name"].eqNullSafe(b["func_name"]) & a["class_name"].eqNullSafe(b["class_name"]))
        .otherwise(b["line_start"].isNotNull() & (b["line_start"] >= a["line_start"]) & (b["line_end"] <= a["line_end"]))
    )
    return F.coalesce((a["file_path"] == b["file_path"]) & inside, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two regions share code: containment, crossing lines, one function, or one class left open by a side."""
    lines = a["line_start"].isNotNull() & b["line_start"].isNotNull()
    crossing = (a["line_start"] <= b["line_end"]) & (b["line_start"] <= a["line_end"])
    same_func = a["func_name"].isNotNull() & (a["func_name"] == b["func_name"]) & a["class_name"].eqNullSafe(b["class_name"])
    open_class = a["class_name"].isNotNull() & (a["class_name"] == b["class_name"]) & (a["func_name"].isNull() | b["func_name"].isNull())
    named = F.coalesce(same_func | open_class, F.lit(False))
    apart = F.when(lines, crossing).otherwise(named)
    return F.coalesce((a["file_path"] == b["file_path"]) & (contains(a, b) | contains(b, a) | apart), F.lit(False))
