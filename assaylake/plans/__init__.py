"""Queries by theme. Importing the package registers all of them in bindings.QUERIES and bindings.ORACLE_SQL."""

from assaylake.plans import advanced, bindings, genome, graphs, graphs_of_vectors, hypothesis, models, profiles, reads, tables  # noqa: F401
