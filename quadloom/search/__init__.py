"""Declarative search: schema, query, compiler, facets, lookups and projection."""
