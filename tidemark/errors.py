"""Errors with the codes that callers of the service know."""

from __future__ import annotations


class EngineError(Exception):
    """``code`` is one of: invalid_argument, not_found, already_exists, dim_mismatch, revision_mismatch, payload_too_large,
    not_supported, not_enabled, sql_error."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
        self.message = message


def require(ok: bool, code: str, message: str = "") -> None:
    if not ok:
        raise EngineError(code, message)
