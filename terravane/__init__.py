"""Terravane: place, evidence and lead analytics, and training-text preparation, on Spark."""
