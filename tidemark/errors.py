"""What the engine raises."""


class TidemarkError(Exception):
    """Any of the engine's errors."""


class NotFound(TidemarkError, LookupError):
    """A device, measurement or column that doesn't exist."""


class SchemaError(TidemarkError):
    """Data that doesn't fit a registered or declared schema."""


class TypeMismatch(TidemarkError, TypeError):
    """A value of another type than its measurement's."""


class InvalidState(TidemarkError):
    """A call that is out of order, or on something that is full or incomplete."""


class Unsupported(TidemarkError, NotImplementedError):
    """A type or feature that the engine doesn't have."""


class CodecError(TidemarkError, ValueError):
    """Values that a codec can't encode, or bytes that it can't decode."""
