"""Failures of the array engine. Checks on the driver raise them before a job starts."""


class ArrayError(Exception):
    """Base of all."""


class InvalidKey(ArrayError):
    """A store key or node path that is not a portable relative path."""


class InvalidJson(ArrayError):
    """A document that is not strict JSON within the limits."""


class InvalidMetadata(ArrayError):
    """A metadata document whose fields contradict the format."""


class Unsupported(ArrayError):
    """A valid feature that this engine does not have."""


class InvalidSelection(ArrayError):
    """A region, point or axis selector outside its array."""


class DTypeMismatch(ArrayError):
    """The stored type is not the one that was asked for."""


class CodecError(ArrayError):
    """Bytes that a codec cannot read, or a value that it cannot write."""


class ResourceLimit(ArrayError):
    """A plan or an object beyond a limit."""

    def __init__(self, what: str, limit: int, found: int):
        super().__init__(f"{what}: {found} exceeds the limit of {limit}")
        self.what, self.limit, self.found = what, limit, found


class NodeNotFound(ArrayError):
    """No node where one was expected."""


class NodeExists(ArrayError):
    """Creation found something in its place; nothing is overwritten."""


class InvalidHierarchy(ArrayError):
    """Nodes that cannot stand together."""
