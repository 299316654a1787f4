"""Claim analytics and corpus preparation as plain Spark jobs."""
