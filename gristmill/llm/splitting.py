"""Problem 3: splitting oversized items at natural boundaries.

One regular expression cuts a text into segments: its alternatives, ordered by the strength of the
boundary, each take as much as a bounded quantifier lets them, and a single character run is the last
resort.  A piece is a segment with the end of the one before it, from a boundary on, in front.  All of it is SQL on
arrays within the row: nothing is shuffled, and a row's pieces stay in its partition until they are asked for.

Defined results: null text gives null pieces; a text within the limit, also an empty one, is one piece as it
is; pieces without their overlap join to the text exactly; lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2_000, 400
_SPACES = r"\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS, _NOT_WS = f"[{_SPACES}]", f"[^{_SPACES}]"


def segment_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """Segments of at most limit - overlap characters; a run without white space that would fit into a piece alone may fill it."""
    n = limit - overlap
    low, mid = max(1, n * 2 // 5), max(1, n // 5)
    return "|".join(
        [
            rf"(?s).{{1,{n}}}\z",  # all that is left
            rf".{{{low},{n - 4}}}(?:\r?\n){{2}}",  # a blank line
            rf".{{{low},{n - 2}}}\n(?!{_WS})",  # a line end before a line that is not indented
            rf".{{{mid},{n - 1}}}\n",  # a line end
            rf".{{{mid},{n - 2}}}[.!?;:][\"')\]]?{_WS}",  # the end of a sentence
            rf".{{0,{n - 1}}}{_WS}",  # white space
            rf"{_NOT_WS}{{{n + 1},{limit}}}(?={_WS}|\z)",  # one long word
            rf".{{1,{n}}}",  # no boundary at all
        ]
    )


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<piece_no, overlap_chars, forced, piece>> of a text column."""
    assert 0 <= overlap < limit
    cut = F.when(F.length(text) > limit, F.regexp_extract_all(text, F.lit(segment_pattern(limit, overlap)), F.lit(0))).otherwise(F.array(text))
    return F.when(text.isNotNull(), _assembled(cut, limit, overlap))


def _assembled(segments: Column, limit: int, overlap: int) -> Column:
    # slices of neighbours are zipped: an index into the array within a lambda would evaluate the extraction again for each element
    prev = F.concat(F.array(F.lit("")), segments)

    def one(x: Column, i: Column) -> Column:
        seg, before = x["seg"], x["before"]
        room = F.least(F.lit(overlap), F.lit(limit) - F.length(seg))
        tail = F.when(room > 0, F.right(before, room)).otherwise(F.lit(""))
        cut = F.length(before) > room  # the lookback begins within a segment: move on to a boundary, of a line if there is one
        nl = F.regexp_replace(tail, r"(?s)\A[^\n]*\n(?=.)", "")
        word = F.regexp_replace(tail, rf"(?s)\A{_NOT_WS}*{_WS}+(?=.)", "")
        lead = F.when(~cut, tail).when(F.length(nl) >= F.lit(overlap // 4), nl).otherwise(word)
        lead = F.when(i == 0, F.lit("")).otherwise(lead)
        forced = (i > 0) & F.right(before, F.lit(1)).rlike(_NOT_WS) & F.left(seg, F.lit(1)).rlike(_NOT_WS)
        return F.struct(i.cast("int").alias("piece_no"), F.length(lead).alias("overlap_chars"), forced.alias("forced"), F.concat(lead, seg).alias("piece"))

    return F.transform(F.arrays_zip(segments.alias("seg"), F.slice(prev, 1, F.size(segments)).alias("before")), one)


def split_items(items: DataFrame, id_col: str = "file_id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """(``id_col``, n_chars, pieces): every item with text, or those above the limit."""
    rows = items.select(F.col(id_col), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    if only_oversized:
        rows = rows.filter(F.length("__text") > limit)
    segs = F.when(F.length("__text") > limit, F.regexp_extract_all("__text", F.lit(segment_pattern(limit, overlap)), F.lit(0))).otherwise(F.array("__text"))
    # the segments are a column of their own, so that the extraction runs once for each row
    held = rows.select(id_col, F.length("__text").alias("n_chars"), F.explode(F.array(segs)).alias("seg"))
    return held.select(id_col, "n_chars", _assembled(F.col("seg"), limit, overlap).alias("pieces"))


def item_pieces(split: DataFrame, id_col: str = "file_id") -> DataFrame:
    """One row per piece."""
    return split.select(id_col, F.explode("pieces").alias("p")).select(id_col, "p.piece_no", "p.overlap_chars", "p.forced", "p.piece")


def cut_kinds(split: DataFrame, id_col: str = "file_id") -> DataFrame:
    """(``id_col``, cut_kind): forced if a piece had to begin inside a run without white space, else natural."""
    return split.select(F.col(id_col).cast("long").alias(id_col), F.when(F.exists("pieces", lambda p: p["forced"]), "forced").otherwise("natural").alias("cut_kind"))
