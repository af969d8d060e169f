"""Relational operators: postings, statistics, lookups, scoring, evaluation."""
