"""Eligibility, planning and ingestion analytics on Spark."""
