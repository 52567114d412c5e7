"""Spark-native retrieval, extraction and evaluation over semi-structured filings."""
