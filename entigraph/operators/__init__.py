"""Operators: filters, includes, aggregates, search, security, mutations, migrations."""
