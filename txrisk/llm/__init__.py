"""Operators a large training-data pipeline needs, built on the DataFrame API.

Nothing else in the library imports this package; removing it (with
``corpus_pipeline.py`` and ``tests/llm``) leaves the rest working.
"""
