"""Sources and sinks: tables, TSV reviews, relevance judgments, persisted indexes."""
