"""Errors of parsing, analysis and the catalog."""

from __future__ import annotations


class TsqError(Exception):
    """Base of all errors of this package."""


class ParsingWrong(TsqError):
    def __init__(self, err: str):
        super().__init__(f"the query text can't be read: {err}")


class Unsupported(ParsingWrong):
    """Valid PromQL outside the supported subset."""


class NoName(TsqError):
    def __init__(self):
        super().__init__("a selector needs a metric: write metric{...} or {__name__=\"metric\"}")


class InvalidRegex(TsqError):
    def __init__(self, err: str):
        super().__init__(f"this pattern doesn't compile: {err}")


class TableExists(TsqError):
    def __init__(self, name: str):
        super().__init__(f"the catalog already holds a table {name}; append to it or choose another name")


class ResourceNotExists(TsqError):
    def __init__(self, name: str):
        super().__init__(f"the catalog holds no metric {name}; register it with create_table")


class NoColumn(TsqError):
    """``op`` is the step that asked for the column: match, project or aggregate."""

    def __init__(self, op: str, table: str, name: str):
        self.op = op
        super().__init__(f"can't {op} by {name}: not a column of {table}'s schema")


class NoSupportRegex(TsqError):
    def __init__(self, label: str, name: str, table: str):
        super().__init__(f"{table}.{name} is of type {label}; patterns match string labels only")


class TypeMismatch(TsqError):
    def __init__(self, place: str, expect: str, found: str):
        super().__init__(f"{place}: a value of type {expect} is needed, not {found}")


class UnknownFunction(TsqError):
    def __init__(self, name: str):
        super().__init__(f"{name} is neither a registered function nor an aggregation")


class SchemaMismatch(TsqError):
    """A DataFrame or a row does not fit the declared schema."""
