"""Storyline: news-stream intelligence and corpus preparation on PySpark."""
