"""Column expressions: text keys, calendar buckets, bands and guarded arithmetic."""
