"""Typed failures of one row; a job never fails for a row."""

from __future__ import annotations

import errno


class RowError(Exception):
    """kind: one of the keys of functions.grammar.ERRORS."""

    def __init__(self, kind: str, message: str, detail: str | None = None):
        super().__init__(message)
        self.kind, self.message, self.detail = kind, message, detail

    def as_dict(self) -> dict:
        return {"kind": self.kind, "message": self.message, "detail": self.detail}


def undecodable(message: str) -> RowError:
    return RowError("Undecodable", message)


def classify(e: BaseException, remote: bool = False) -> RowError:
    """What an exception means: a timeout of a remote source first, then the kinds of input/output errors, then what is known about the row itself."""
    if isinstance(e, RowError):
        return e
    chain, at = [], e
    while at is not None and at not in chain:
        chain.append(at)
        at = at.__cause__ or at.__context__
    if remote and any(isinstance(x, TimeoutError) for x in chain):
        return RowError("UpstreamTimeout", "upstream image fetch timed out", repr(e))
    for x in chain:
        if isinstance(x, FileNotFoundError):
            return RowError("SourceNotFound", "image not found", repr(e))
        if isinstance(x, (PermissionError, IsADirectoryError)):
            return RowError("SourceUnreadable", "source could not be read", repr(e))
        if isinstance(x, OSError) and x.errno == errno.EFBIG:
            return RowError("SourceTooLarge", "source image too large", repr(e))
        if remote and isinstance(x, (ConnectionError, EOFError)):
            return RowError("Upstream", "upstream image fetch failed", repr(e))
    return RowError("Undecodable", str(e) or type(e).__name__, repr(e))
