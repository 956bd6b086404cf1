"""Small files under one root: put, get, list, delete and a put that never overwrites."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from ..errors import NotFoundError, StorageError, WriteConflictError


def root_of(uri: str | None, name: str) -> str:
    """A plain path or a URI that Spark reads: local:// goes, s3:// becomes s3a://, ~ is the home folder."""
    if uri is None:
        return os.path.expanduser(f"~/.lakeloom/{name}")
    if uri.startswith("s3://"):
        return "s3a://" + uri[5:].partition("?")[0].rstrip("/")
    if uri.startswith("local://"):
        uri = uri[8:]
    if "://" in uri:
        return uri.rstrip("/")
    return os.path.abspath(os.path.expanduser(uri))


class LocalStorage:
    """A folder that driver and executors share. A key appears with all of its bytes or not at all."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def path(self, key: str) -> str:
        if key.startswith("/") or ".." in key.split("/"):
            raise StorageError(f"bad key '{key}'")
        return f"{self.root}/{key}"

    def _temporary(self, key: str, data: bytes) -> tuple[str, str]:
        path = self.path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        Path(temporary).write_bytes(data)
        return temporary, path

    def put(self, key: str, data: bytes) -> None:
        temporary, path = self._temporary(key, data)
        os.replace(temporary, path)

    def put_if_not_exists(self, key: str, data: bytes) -> None:
        temporary, path = self._temporary(key, data)
        try:
            os.link(temporary, path)  # fails if the key is there
        except FileExistsError:
            raise WriteConflictError(key) from None
        finally:
            os.unlink(temporary)

    def get(self, key: str) -> bytes:
        try:
            return Path(self.path(key)).read_bytes()
        except (FileNotFoundError, IsADirectoryError):
            raise NotFoundError(key) from None

    def exists(self, key: str) -> bool:
        return os.path.isfile(self.path(key))

    def list(self, prefix: str) -> list[str]:
        """Keys in the folder ``prefix``, sorted; not those of folders in it."""
        folder = self.path(prefix.rstrip("/"))
        if not os.path.isdir(folder):
            return []
        return sorted(f"{prefix.rstrip('/')}/{x.name}" for x in os.scandir(folder) if x.is_file() and not x.name.startswith("."))

    def delete(self, key: str) -> None:
        try:
            os.unlink(self.path(key))
        except FileNotFoundError:
            raise NotFoundError(key) from None


class HadoopStorage:
    """Any file system that Spark reaches (hdfs, s3a, viewfs). A key appears with all of its bytes or not at all.

    On file systems with a rename that fails where the target is there (HDFS), a put that never overwrites writes a
    temporary file and renames it. On object stores, where an upload appears when it is closed and a rename is a copy, it
    is the connector's conditional create (fs.option.create.conditional.overwrite), which the store itself decides."""

    CONDITIONAL = "fs.option.create.conditional.overwrite"
    STORES = ("s3a", "gs", "abfs", "abfss")

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def _create(self, key: str, data: bytes, overwrite: bool) -> None:
        self._write(self.fs.create(self._path(key), overwrite), data)

    @staticmethod
    def _write(stream, data: bytes) -> None:
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def put(self, key: str, data: bytes) -> None:
        self._create(key, data, True)

    def put_if_not_exists(self, key: str, data: bytes) -> None:
        from py4j.protocol import Py4JJavaError

        path, gone = self._path(key), None
        try:
            if self.fs.getScheme() in self.STORES:
                self._write(self.fs.createFile(path).opt(self.CONDITIONAL, True).overwrite(False).build(), data)
                return
            folder = path.getParent()
            self.fs.mkdirs(folder)
            gone = self.jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
            self._write(self.fs.create(gone, False), data)
            if not self.exists(key) and self.fs.rename(gone, path):
                return
        except Py4JJavaError as error:
            if not self.exists(key):
                raise StorageError(str(error.java_exception)) from None
        finally:
            if gone is not None:
                self.fs.delete(gone, False)
        raise WriteConflictError(key)

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise NotFoundError(key)
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        return bool(self.fs.exists(self._path(key)))

    def list(self, prefix: str) -> list[str]:
        path = self._path(prefix.rstrip("/"))
        if not self.fs.exists(path):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(path) if x.isFile()]
        return sorted(f"{prefix.rstrip('/')}/{n}" for n in names if not n.startswith("."))

    def delete(self, key: str) -> None:
        if not self.fs.delete(self._path(key), False):
            raise NotFoundError(key)


def open_storage(spark, uri: str | None, name: str):
    root = root_of(uri, name)
    if root.startswith("file://"):
        root = root[7:]
    return HadoopStorage(spark, root) if "://" in root else LocalStorage(root)
