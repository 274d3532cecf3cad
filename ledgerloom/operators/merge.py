"""Combine sources that were each aggregated to one row per key.

The sources are stacked and grouped once instead of being chained through outer joins. Spark keeps
the hash partitioning of the inputs across the union, so the final grouping adds no exchange, and
unmatched keys never pile up on a NULL join key as they do in a chain of outer joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_by_key(
    sources: dict[str, DataFrame],
    keys: Sequence[str],
    anchor: str | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Full outer merge of frames with unique keys; columns keep their names.

    Column names must differ between sources. NULL where a source has no row for the key.

    Without an anchor there is one row per key. With an anchor the result is that of a chain of full
    outer joins in which every condition compares with the anchor's key: a key the anchor lacks, and
    a NULL key, gives one row per source that has it. `scope` columns belong to the key but may not
    be NULL. `_source` then names the only source of a row, and is NULL for a merged one.

    The expressions are SQL text, because a hundred of them go over to the JVM much faster that way.
    """
    keys = list(keys)
    group = [*scope, *keys]
    owner = {}
    types = {}
    for name, df in sources.items():
        for field in df.schema.fields:
            if field.name in group:
                continue
            if field.name in owner:
                raise ValueError(f"column {field.name!r} occurs in two sources")
            owner[field.name] = name
            types[field.name] = field.dataType.simpleString()

    def part(name: str) -> DataFrame:
        columns = [
            f"`{c}`" if owner[c] == name else f"CAST(NULL AS {types[c]}) AS `{c}`" for c in owner
        ]
        flags = [f"{'true' if n == name else 'CAST(NULL AS boolean)'} AS `_has_{n}`" for n in sources]
        return sources[name].selectExpr(*[f"`{k}`" for k in group], *columns, *flags)

    stacked = reduce(DataFrame.union, [part(name) for name in sources])
    merged = stacked.groupBy(*group).agg(
        *[F.expr(f"max(`{c}`) AS `{c}`") for c in [*owner, *[f"_has_{n}" for n in sources]]]
    )
    if anchor is None:
        return merged.drop(*[f"_has_{name}" for name in sources])
    present = ", ".join(f"CASE WHEN `_has_{name}` THEN '{name}' END" for name in sources)
    joined = " AND ".join([f"`_has_{anchor}` IS NOT NULL", *[f"`{k}` IS NOT NULL" for k in keys]])
    whole = "array(CAST(NULL AS string))"
    split = merged.selectExpr(
        "*", f"explode(CASE WHEN {joined} THEN {whole} ELSE array_compact(array({present})) END) AS _source"
    )
    return split.selectExpr(
        *[f"`{k}`" for k in group],
        *[
            f"CASE WHEN _source IS NULL OR _source = '{name}' THEN `{c}` END AS `{c}`"
            for c, name in owner.items()
        ],
        "_source",
    )
