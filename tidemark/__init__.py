"""Tidemark: text-driven risk analytics and corpus preparation on Spark."""
