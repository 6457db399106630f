"""Queries over the synthetic tables, bound to the catalogue and to images; SQL that gives the same rows."""

from quire.queries import catalog, images

QUERIES: dict = catalog.QUERIES | images.QUERIES
SQL: dict = catalog.SQL | images.SQL
