"""Small-object access (metadata, manifests) for local paths and for any Hadoop file system.

Data files never pass through here; Spark reads and writes those on the executors.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit

from .errors import FeatureUnsupported

_HADOOP_SCHEMES = {"hdfs", "s3", "s3a", "s3n", "abfs", "abfss", "gs", "viewfs"}
_OBJECT_STORES = {"s3", "s3a", "s3n", "gs"}


def is_local(uri: str) -> bool:
    return uri.startswith("/") or uri.startswith("file:")


def local_path(uri: str) -> str:
    if uri.startswith("file:"):
        path = uri[len("file:") :]
        return "/" + path.lstrip("/")
    return uri


def join(*parts: str) -> str:
    head = parts[0].rstrip("/")
    return "/".join([head, *(p.strip("/") for p in parts[1:])])


def read_object(uri: str) -> bytes:
    """A small object, read where there is no session (on executors)."""
    from pyarrow import fs as pafs

    fs, path = (pafs.LocalFileSystem(), local_path(uri)) if is_local(uri) else pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


class Storage:
    """Read, list, publish and delete small objects."""

    def __init__(self, spark=None):
        self._spark = spark

    def _fs(self, uri: str):
        scheme = urlsplit(uri).scheme
        if scheme not in _HADOOP_SCHEMES or self._spark is None:
            raise FeatureUnsupported("storage scheme", uri=uri)
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, uri: str) -> bool:
        if is_local(uri):
            return os.path.exists(local_path(uri))
        fs, path = self._fs(uri)
        return fs.exists(path)

    def read(self, uri: str) -> bytes:
        if is_local(uri):
            with open(local_path(uri), "rb") as f:
                return f.read()
        fs, path = self._fs(uri)
        stream = fs.open(path)
        try:
            utils = self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return bytes(utils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, uri: str, data: bytes) -> bool:
        """Publish ``data`` under a name that must be free. False if somebody was first.

        Readers see the whole object or none. Local files are linked into place after they are complete. In
        object stores an object appears when its stream is closed, under an exclusive create; in other
        Hadoop file systems a complete file of another name is renamed, which fails if the name is taken.
        """
        if is_local(uri):
            target = local_path(uri)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            staged = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(staged, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(staged, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(staged)
        fs, path = self._fs(uri)
        if urlsplit(uri).scheme in _OBJECT_STORES:
            try:
                stream = fs.create(path, False)
                stream.write(bytearray(data))
                stream.close()
            except Exception:  # py4j wraps the store's FileAlreadyExistsException
                if fs.exists(path):
                    return False
                raise
            return True
        if fs.exists(path):
            return False
        staged = path.suffix(f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(staged, False)
        stream.write(bytearray(data))
        stream.close()
        if fs.rename(staged, path):
            return True
        fs.delete(staged, False)
        if not fs.exists(path):
            raise FeatureUnsupported("rename", target_uri=uri)
        return False

    def replace(self, uri: str, data: bytes) -> None:
        """Write over whatever is there, atomically where the store can."""
        if is_local(uri):
            target = local_path(uri)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            staged = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(staged, "wb") as f:
                f.write(data)
            os.replace(staged, target)
            return
        fs, path = self._fs(uri)
        stream = fs.create(path, True)
        stream.write(bytearray(data))
        stream.close()

    def listing(self, uri: str) -> list[tuple[str, bool]]:
        """(name, is directory) of the direct children; empty if the folder is missing."""
        if is_local(uri):
            path = local_path(uri)
            if not os.path.isdir(path):
                return []
            return sorted((e.name, e.is_dir()) for e in os.scandir(path))
        fs, path = self._fs(uri)
        if not fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(path))

    def size(self, uri: str) -> int:
        if is_local(uri):
            return os.path.getsize(local_path(uri))
        fs, path = self._fs(uri)
        return fs.getFileStatus(path).getLen()

    def move(self, source: str, target: str) -> None:
        if is_local(source):
            os.makedirs(os.path.dirname(local_path(target)), exist_ok=True)
            os.rename(local_path(source), local_path(target))
            return
        fs, path = self._fs(source)
        _, to = self._fs(target)
        if not fs.rename(path, to):  # a store without rename: copy, then delete
            utils = self._spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
            if not utils.copy(fs, path, to.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), to, True, self._spark.sparkContext._jsc.hadoopConfiguration()):
                raise FeatureUnsupported("rename", source_uri=source, target_uri=target)

    def delete(self, uri: str, recursive: bool = False) -> None:
        if is_local(uri):
            path = local_path(uri)
            if recursive and os.path.isdir(path):
                import shutil

                shutil.rmtree(path)
            elif os.path.exists(path):
                os.unlink(path)
            return
        fs, path = self._fs(uri)
        fs.delete(path, recursive)
