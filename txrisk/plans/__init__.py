"""Composed plans: the dashboard page, the query catalog and its SQL twins."""
