"""Errors, one class for each kind; all derive from LakeError."""

from __future__ import annotations


class LakeError(Exception):
    """Any error of this library."""


class StorageError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Storage error: {message}")


class NotFoundError(LakeError):
    def __init__(self, key: str):
        super().__init__(f"Not found: {key}")


class WriteConflictError(LakeError):
    def __init__(self, key: str):
        super().__init__(f"Write conflict on key: {key}")


class AlreadyExistsError(LakeError):
    def __init__(self, kind: str, name: str):
        super().__init__(f"{kind} already exists: {name}")


class EntityNotFoundError(LakeError):
    def __init__(self, kind: str, name: str):
        super().__init__(f"{kind} not found: {name}")


class SchemaError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Schema error: {message}")


class MemoryExceededError(LakeError):
    def __init__(self, worker: str, requested: int, budget: int):
        super().__init__(f"Memory exceeded for bee {worker}: requested {requested} bytes, budget {budget} bytes")


class TaskTimeoutError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Task timeout: {message}")


class TaskAbandonedError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Task abandoned: {message}")


class ConfigError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Configuration error: {message}")


class ResolutionError(LakeError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"Cannot resolve frame path '{path}': {reason}")


class UnsupportedError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Unsupported: {message}")


class LedgerError(LakeError):
    def __init__(self, frame: str, message: str):
        super().__init__(f"Ledger error for frame {frame}: {message}")


class InternalError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Internal error: {message}")


class ConflictError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Conflict: {message}")


class SerializationError(LakeError):
    def __init__(self, message: str):
        super().__init__(f"Serialization error: {message}")
