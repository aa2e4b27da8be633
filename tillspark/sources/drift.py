"""Schema-drift resolver.

Some producers spell a column differently (``invoiceNo`` / ``invoice_number``).
The first spelling present in the frame wins and is renamed to the canonical
name once, at read time; this touches only the schema, never the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def resolve_columns(df: DataFrame, alternatives: dict[str, list[str]], required: bool = False) -> DataFrame:
    """Rename, for each canonical name, the first existing alternative to it.

    A canonical name already present is kept.  With ``required`` a missing
    column raises; otherwise it is left absent.
    """
    present = set(df.columns)
    renames: dict[str, str] = {}
    for canonical, spellings in alternatives.items():
        if canonical in present:
            continue
        found = next((s for s in spellings if s in present and s not in renames), None)
        if found is None:
            if required:
                raise KeyError(f"none of {spellings} present for {canonical}")
            continue
        renames[found] = canonical
    return df.withColumnsRenamed(renames) if renames else df
