"""Errors by code."""


class LatticaError(Exception):
    code = "QUERY_ERROR"

    def __init__(self, message: str):
        super().__init__(f"{self.code}: {message}")


class ParseError(LatticaError):
    code = "CYPHER_PARSE_ERROR"


class QueryError(LatticaError):
    code = "QUERY_ERROR"


class DatabaseError(LatticaError):
    code = "DATABASE_ERROR"


class MissingKeyError(LatticaError):
    code = "MISSING_SHARD_KEY"
