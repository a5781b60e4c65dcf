"""Pipe tables: five kinds of separator, cells, noise rows, rendering. The separator tests differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, trim


def sep_quality(line: Column) -> Column:
    return trim(line).rlike(r"\A\|[\s:-]+\|\z")


def sep_trim(line: Column) -> Column:
    t = trim(line)
    return F.contains(t, F.lit("-")) & t.rlike(r"\A\|[\s:|-]+\|\z")


def table_line(line: Column) -> Column:
    return line.rlike(r"\A\s*\|.*\|\s*\z")


def sep_scan(line: Column) -> Column:
    return table_line(line) & sep_trim(line)


def sep_cross(line: Column) -> Column:
    return trim(line).rlike(r"\A\|\s*:?-{2,}")


def sep_metric(line: Column) -> Column:
    return trim(line).rlike(r"\A\|\s*---")


def sep_shape(line: Column) -> Column:
    return trim(line).rlike(r"\A\|[\s:-]+\|[\s:|-]*\z")


def row(line: Column) -> Column:
    """Starts and ends with a bar."""
    return trim(line).rlike(r"(?s)\A\|.*\|\z")


def cells(line: Column) -> Column:
    """Trimmed cells between the outer bars."""
    inner = F.regexp_replace(F.regexp_replace(trim(line), r"\A\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|", -1), trim)


def filled(line: Column) -> tuple[Column, Column]:
    """(cells, blank cells) between the outer bars, without taking them apart."""
    inner = F.regexp_replace(F.regexp_replace(trim(line), r"\A\|", ""), r"\|\z", "")
    n = F.length(inner) - F.length(F.replace(inner, F.lit("|"), F.lit(""))) + 1
    return n, F.regexp_count(F.concat(F.lit("|"), inner, F.lit("|")), F.lit(r"(?U)\|(?=\s*\|)"))


def width(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\|")) - 1


def noise(line: Column) -> Column:
    """A data row whose every cell is blank or zero."""
    return row(line) & ~sep_trim(line) & F.forall(cells(line), lambda c: (c == "") | c.rlike(r"\A[-+]?0+(?:\.0+)?%?\z"))


def cell_text(c: Column) -> Column:
    """One line, bars escaped."""
    return F.replace(trim(squeeze(F.coalesce(c, F.lit("")))), F.lit("|"), F.lit("\\|"))


def fake(grid: Column) -> Column:
    """Fewer than two rows or columns, or nothing in it."""
    widest = F.array_max(F.transform(grid, lambda r: F.size(r)))
    return F.coalesce((F.size(grid) < 2) | (widest < 2) | F.forall(F.flatten(grid), lambda c: c.isNull() | (trim(c) == "")), F.lit(True))


def rendered(grid: Column) -> Column:
    """array<array<string>> as a pipe table; short rows are filled up; a fake table is nothing."""
    widest = F.array_max(F.transform(grid, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell_text), F.array_repeat(F.lit(""), widest - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), widest), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(grid[0]), rule), F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), line))
    return F.when(fake(grid), "").otherwise(F.array_join(lines, "\n"))
