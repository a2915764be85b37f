"""Web access-log analytics on Spark: parse, enrich, store, query, stream."""
