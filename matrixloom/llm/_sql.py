"""Column expressions shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of the separators between words.
SEPARATORS = r"[\x20\x09-\x0D]+"


#: Matches that one running sum goes over.
HITS = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, text, part>> of the leftmost non-overlapping matches, in code points; part is the group's text.

    Gaps between matches come from split(), so offsets need no search. Running sums go by blocks of HITS matches,
    since appending to an array copies it.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    kind = "array<struct<start:int,end:int,text:string,part:string>>"

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        item = F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("text"), x["part"].alias("part"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(b.alias("at"), F.concat(acc["out"], F.array(item)).cast(kind).alias("out")))

    def block(x: Column, b: Column) -> Column:
        return F.slice(x, b * HITS + 1, HITS)

    def placed(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / HITS).cast("int"))
        length = lambda b: F.aggregate(block(z, b), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + length(b))))
        one = lambda at, x: F.aggregate(x, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])
        many = let(starts, lambda s: F.flatten(F.transform(blocks, lambda b: one(F.get(s, b), block(z, b)))))
        return F.when(F.size(z) <= HITS, one(F.lit(0), z)).otherwise(many)

    return let(zipped, placed)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic curve (error below 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(600.0)), F.lit(-600.0))))
