"""Collects queries with the SQL that gives the same rows."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
