"""User-level queries, derived tables, quality report and the load job."""
