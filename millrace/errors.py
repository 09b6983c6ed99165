"""What can go wrong, by kind, so that callers can tell a retry from a change that someone has to make."""

from __future__ import annotations


class MillraceError(Exception):
    """Any failure of this package."""


class ConfigError(MillraceError):
    """A setting that can never be right."""


class LogError(MillraceError):
    """A transaction log that can't be read or written."""


class CommitConflict(LogError):
    """Someone else made this version first."""

    def __init__(self, uri: str, version: int):
        super().__init__(f"{uri}: version {version} exists already")
        self.uri, self.version = uri, version


class ChangeCommitError(MillraceError):
    """The source deleted or rewrote rows, and the policy is to fail."""

    def __init__(self, version: int):
        super().__init__(f"commit {version} of the source removes data; set change_policy to skip_change_commits or ignore_changes to go on")
        self.version = version


class CommitTooLarge(MillraceError):
    """One commit exceeds the limits of a batch, and commits aren't split."""

    def __init__(self, version: int, files: int, size: int):
        super().__init__(f"commit {version} has {files} files of {size} bytes, more than a batch may hold")
        self.version, self.files, self.size = version, files, size


class DeletionVectorUnsupported(MillraceError):
    """A file comes with a deletion vector, which this reader doesn't apply."""

    def __init__(self, version: int, path: str):
        super().__init__(f"commit {version}: {path} has a deletion vector")
        self.version, self.path = version, path


class UnsupportedProtocol(MillraceError):
    """The table asks for a newer reader or writer."""


class CursorUnavailable(MillraceError):
    """The log no longer holds the commits that come next."""

    def __init__(self, version: int):
        super().__init__(f"commit {version} isn't in the log any more")
        self.version = version


class SourceFileVacuumed(MillraceError):
    """A file that a commit added is gone."""

    def __init__(self, uri: str, version: int, path: str):
        super().__init__(f"{uri}: {path}, added by commit {version}, has been removed from storage")
        self.uri, self.version, self.path = uri, version, path


class TransformError(MillraceError):
    """The SQL is refused, or fails on a batch."""


class SchemaError(MillraceError):
    """Rows don't fit the target."""


class CapacityError(MillraceError):
    """Disk or memory ran out; worth trying again later."""
