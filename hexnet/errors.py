"""What can go wrong, and the status a service would answer with."""

from __future__ import annotations


class HexnetError(Exception):
    """status: the service status that a caller sees."""

    status = "INTERNAL"


class InvalidArgument(HexnetError, ValueError):
    status = "INVALID_ARGUMENT"


class NotFound(HexnetError, LookupError):
    status = "NOT_FOUND"


class MixedResolutions(InvalidArgument):
    pass


class EmptyGraph(InvalidArgument):
    pass


class TooHighResolution(InvalidArgument):
    """A target resolution isn't coarser than the source's."""


class TooShortShortcut(InvalidArgument):
    """Shortcuts of fewer than three edges are useless."""


class DestinationsNotInGraph(NotFound):
    pass


class MissingCellColumn(InvalidArgument):
    pass


class UnsupportedResolution(NotFound):
    pass


class UnidentifiedFileFormat(InvalidArgument):
    pass


class SegmentedPath(InvalidArgument):
    """A path's edges don't follow each other."""
