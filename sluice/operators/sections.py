"""Configuration documents as values: sections and entries of JSON documents held in a column, checked as rows.

A document is parsed once into a VARIANT.  Nothing is collected: many documents (one a pipeline, or every version ever seeded) are checked and
exploded by one plan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESENT, MISSING, EMPTY, MALFORMED, WRONG_KIND = "PRESENT", "MISSING", "EMPTY", "MALFORMED", "NO_LIST"


def _section(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$['{name}']", "array<variant>")


def section_check(documents: DataFrame, id_col: str, text_col: str, sections: list[str]) -> DataFrame:
    """(id, section, status, n_entries): one row for each document and section that it should have.

    PRESENT; EMPTY for a list without entries; MISSING where the document has no such key, or null; NO_LIST where it holds something else;
    MALFORMED for every section of a text that is no JSON object.  n_entries is NULL but for the first two.
    """
    parsed = F.try_parse_json(F.col(text_col))
    each = documents.select(F.col(id_col), parsed.alias("_d"), F.explode(F.array(*[F.lit(s) for s in sections])).alias("section"))
    whole = F.schema_of_variant("_d").startswith("OBJECT")
    held, entries = F.lit(None).cast("variant"), F.lit(None).cast("array<variant>")
    for s in sections:
        held = F.when(F.col("section") == s, F.try_variant_get("_d", f"$['{s}']", "variant")).otherwise(held)
        entries = F.when(F.col("section") == s, _section(F.col("_d"), s)).otherwise(entries)
    each = each.select(id_col, "section", F.coalesce(whole, F.lit(False)).alias("_whole"), held.alias("_held"), entries.alias("_entries"))
    listed = F.schema_of_variant("_held").startswith("ARRAY")
    status = (F.when(~F.col("_whole"), MALFORMED).when(F.col("_held").isNull() | F.is_variant_null("_held"), MISSING).when(~listed, WRONG_KIND)
              .when(F.size("_entries") == 0, EMPTY).otherwise(PRESENT))
    return each.select(id_col, "section", status.alias("status"), F.when(status.isin(PRESENT, EMPTY), F.size("_entries")).alias("n_entries"))


def section_entries(documents: DataFrame, id_col: str, text_col: str, section: str, fields: Mapping[str, str]) -> DataFrame:
    """(id, position, fields...) of each entry of a section, in the given types; what an entry lacks, or has in no such type, is NULL."""
    entries = _section(F.try_parse_json(F.col(text_col)), section)
    rows = documents.select(F.col(id_col), F.posexplode(entries).alias("position", "_e"))
    return rows.select(id_col, "position", *[F.try_variant_get("_e", f"$['{f}']", kind).alias(f) for f, kind in fields.items()])
