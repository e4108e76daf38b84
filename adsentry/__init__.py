"""Listing-fraud analytics and training-corpus operators as Spark jobs."""
