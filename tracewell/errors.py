"""Errors of the library; ``TracewellError`` is their root."""


class TracewellError(Exception):
    pass


class ConfigError(TracewellError):
    """A setting is missing or out of range."""


class PathOverlapError(ConfigError):
    """Evidence and output folders contain one another."""


class ArtifactError(TracewellError):
    """A file is unreadable, truncated or not what its name says."""


class ParseError(TracewellError):
    """An artifact's content is malformed."""


class SessionError(TracewellError):
    """A lifecycle event has no device."""


class ReportError(TracewellError):
    """A report can't be written, or its wording claims too much."""


class IntegrityError(TracewellError):
    """A digest differs from the one taken at intake."""
