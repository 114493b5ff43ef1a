"""Gatehouse: data onboarding, quality and catalogue operators for Spark DataFrames."""
