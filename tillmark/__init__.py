"""Retail analytics as Spark DataFrame jobs: feeds, marts, metrics, checks, comparisons and weekly facts."""
