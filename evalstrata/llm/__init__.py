"""Training-data operators: scoring, filtering, duplicate removal, archives and tokens.

Nothing else in the package imports from here; ``llm.registry`` holds the
queries and their oracle SQL.
"""
