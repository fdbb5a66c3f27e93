"""Scam and phishing risk analytics as Spark DataFrame jobs."""
