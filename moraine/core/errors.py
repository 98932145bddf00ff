"""Error kinds raised by the engine."""

from __future__ import annotations


class LakeError(Exception):
    """Base error: a message, context pairs and an optional source."""

    kind = "Unexpected"

    def __init__(self, message: str, source: BaseException | None = None, **context):
        super().__init__(message)
        self.message = message
        self.context = context
        self.source = source
        if source is not None:
            self.__cause__ = source

    def __str__(self) -> str:
        extra = ", ".join(f"{k}: {v}" for k, v in self.context.items())
        return f"{self.kind} => {self.message}" + (f" ({extra})" if extra else "")


class InvalidData(LakeError):
    kind = "DataInvalid"


class FeatureUnsupported(LakeError):
    kind = "FeatureUnsupported"


class TypeUnsupported(LakeError):
    kind = "DataTypeUnsupported"


class ArrowFailure(LakeError):
    kind = "ArrowError"


class NotFound(LakeError):
    kind = "NotFound"


class AlreadyExists(LakeError):
    kind = "AlreadyExists"


class CommitConflict(LakeError):
    kind = "CommitConflict"
