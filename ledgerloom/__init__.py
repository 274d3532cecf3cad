"""Store profitability analytics on Spark: lake ingest, cost lookups, period P&L and order profit."""
