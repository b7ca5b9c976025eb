"""Content elements as JSON text, for exchange only; tables keep them nested."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from librarium.schemas import ELEMENT


def from_text(c: Column) -> Column:
    """Elements of a JSON list. Unknown keys are ignored, a type may carry a qualified name, styles that are left out are none."""
    parsed = F.from_json(c, f"ARRAY<{ELEMENT}>")
    span = lambda s: s.withField("styles", F.coalesce(s["styles"], F.array().cast("array<string>")))
    spans = lambda xs: F.transform(xs, span)

    def one(e: Column) -> Column:
        items = F.transform(e["items"], lambda i: i.withField("spans", spans(i["spans"])))
        return e.withField("type", F.substring_index(e["type"], ".", -1)).withField("spans", spans(e["spans"])).withField("items", items)

    return F.transform(parsed, one)


def to_text(c: Column) -> Column:
    """Elements as a JSON list; fields that are null are left out."""
    return F.to_json(c)
