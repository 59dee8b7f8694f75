"""What goes wrong on the driver."""


class MatrixError(ValueError):
    """A matrix cannot be read, converted or multiplied."""


class KernelError(MatrixError):
    """A kernel cannot be set up; the message begins with the matrix's path."""


class TraceConfigError(ValueError):
    """A trace configuration is malformed or contradicts itself."""
