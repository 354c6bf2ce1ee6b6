"""The decorator that puts a query into its module's register."""

from __future__ import annotations


def registrar(register: dict):
    def query(sql: str | None = None):
        def put(f):
            register[f.__name__] = (f, sql)
            return f

        return put

    return query
