"""DataFrame operators: lookups, joins, rollups and metric projections."""
