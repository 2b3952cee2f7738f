"""Column functions on CSS values and note vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ["top", "right", "bottom", "left"]
STYLES = ["solid", "dashed", "dotted", "double", "groove", "ridge"]
NOTE_ELEMENTS = ["footnote", "endnote", "rearnote", "doc-footnote", "doc-endnote", "doc-note"]
NOTE_AREAS = ["footnotes", "endnotes", "rearnotes", "doc-footnotes", "doc-endnotes", "doc-rearnotes"]
# CSS's absolute units in pixels; em and rem at the usual size of 16.
UNITS = {"px": 1.0, "em": 16.0, "rem": 16.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)"
_LENGTH = rf"^\s*({_NUMBER})\s*({'|'.join(UNITS)})?\s*$"


def css_length(value: Column) -> Column:
    """Pixels of a length; no unit is px; null where it is none."""
    unit = F.create_map(*[F.lit(x) for kv in ({"": 1.0} | UNITS).items() for x in kv])
    return F.regexp_extract(value, _LENGTH, 1).try_cast("double") * F.element_at(unit, F.regexp_extract(value, _LENGTH, 2))


def _words(value: Column) -> Column:
    return F.filter(F.split(value, r"\s+"), lambda x: x != "")


def css_side(value: Column, side: str) -> Column:
    """A side of a shorthand of one to four values; empty where there is none."""
    w, i = _words(value), SIDES.index(side)
    pick = [[0, 0, 0, 0], [0, 1, 0, 1], [0, 1, 2, 1], [0, 1, 2, 3]]
    n = F.least(F.size(w), F.lit(4))
    at = F.when(n == 1, pick[0][i]).when(n == 2, pick[1][i]).when(n == 3, pick[2][i]).otherwise(pick[3][i])
    return F.when(n < 1, "").otherwise(F.get(w, at))


def font_key(value: Column) -> Column:
    part = lambda x: F.lower(F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    return F.array_join(F.transform(F.filter(F.split(value, ","), lambda x: F.trim(x) != ""), part), ",")


def border_visible(props: Column, side: str) -> Column:
    """Is this side's border drawn? props: MAP of declared properties. A side's own property beats the shorthand. By CSS a border
    is drawn if it has a style other than none and hidden, and a width other than zero."""
    get = lambda k: F.element_at(props, k)
    whole = F.coalesce(get(f"border-{side}"), get("border"))
    words = _words(F.lower(F.trim(whole)))
    own_style = F.lower(F.trim(F.coalesce(get(f"border-{side}-style"), css_side(get("border-style"), side), F.lit(""))))
    own_width = css_length(F.coalesce(get(f"border-{side}-width"), css_side(get("border-width"), side)))
    widths = F.filter(F.transform(words, css_length), lambda x: x.isNotNull())
    unseen = F.arrays_overlap(F.concat(F.coalesce(words, F.array().cast("array<string>")), F.array(own_style)), F.array(F.lit("none"), F.lit("hidden")))
    # a shorthand without a style draws nothing but where it has a width
    by_whole = (F.size(words) > 0) & (F.exists(widths, lambda x: x != 0) | F.arrays_overlap(words, F.array(*map(F.lit, STYLES))))
    styled = F.when(whole.isNull(), own_style != "").otherwise(by_whole)
    return styled & ~unseen & F.coalesce(own_width != 0, F.lit(True))


def is_framed(props: Column) -> Column:
    """Borders on two opposite sides."""
    return (border_visible(props, "top") & border_visible(props, "bottom")) | (border_visible(props, "left") & border_visible(props, "right"))


def _tokens(*values: Column) -> Column:
    return _words(F.lower(F.concat_ws(" ", *values)))


def is_note_element(epub_type: Column, role: Column, rel: Column) -> Column:
    return F.arrays_overlap(_tokens(epub_type, role, rel), F.array(*map(F.lit, NOTE_ELEMENTS)))


def is_note_area(epub_type: Column, role: Column) -> Column:
    return F.arrays_overlap(_tokens(epub_type, role), F.array(*map(F.lit, NOTE_AREAS)))
