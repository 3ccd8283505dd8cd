"""All matches of a pattern in a text with what stands before and after them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Control characters that mark a match's ends; texts lose their own.
OPEN, CLOSE = "\x01", "\x02"


def matches(text: Column, pattern: str, before: int, after: int) -> Column:
    """An array of left, match and right for the leftmost matches that don't overlap, in order.

    `left` holds up to `before` characters ahead of the match, `right` up to `after` behind it. The matches are marked in one
    replacement and the text is cut at the marks, so every second piece is one; a match's surroundings are joined from the ends
    of the pieces near it, which are as many as can hold characters that count.
    """
    bare = F.translate(text, OPEN + CLOSE, "")
    pieces = F.split(F.regexp_replace(bare, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")

    def ends(t: Column) -> Column:
        cut = lambda f, n: F.transform(t["pieces"], lambda p: f(p, F.lit(n)))
        return let({"pieces": t["pieces"], "tails": cut(F.right, before), "heads": cut(F.left, after)}, surrounded)

    def surrounded(t: Column) -> Column:
        def around(at: Column) -> Column:
            from_ = F.greatest(F.lit(0), at - 2 * before)
            left = F.right(F.array_join(F.slice(t["tails"], from_ + 1, at - from_), ""), F.lit(before))
            right = F.left(F.array_join(F.slice(t["heads"], at + 2, 2 * after), ""), F.lit(after))
            return F.struct(left.alias("left"), F.get(t["pieces"], at).alias("match"), right.alias("right"))

        # matches stand at odd places
        return F.when(F.size(t["pieces"]) > 1, F.transform(F.sequence(F.lit(1), F.size(t["pieces"]) - 1, F.lit(2)), around))

    none = F.array().cast("array<struct<left:string,match:string,right:string>>")
    return F.coalesce(let({"pieces": pieces}, ends), F.when(text.isNotNull(), none))
