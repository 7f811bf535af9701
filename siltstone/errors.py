"""What can go wrong, by kind."""


class SiltstoneError(Exception):
    """Any error of the engine."""


class InvalidInput(SiltstoneError, ValueError):
    """An argument that no state of the store would accept."""


class InvalidState(SiltstoneError):
    """A request that the present state does not allow."""


class ChecksumMismatch(SiltstoneError):
    """Stored metadata does not match its checksum."""


class Conflict(SiltstoneError):
    """Two parts of a store contradict each other."""
