"""Uploaded files: checked, stored under a root that no path leaves, read back as rows by ``Catalog.blobs``."""

from __future__ import annotations

import secrets
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import Protocol

from treeline.access import Context
from treeline.errors import IntegrityError, ResolverError, ValidationError
from treeline.integrity import content_hash
from treeline.plugins import File, Plugin

MOST_BYTES = 25 * 1024 * 1024


class Storage(Protocol):
    def put(self, key: str, data: bytes) -> None: ...

    def get(self, key: str) -> bytes: ...

    def delete(self, key: str) -> None: ...


class LocalStorage:
    """Files below a folder."""

    def __init__(self, root: str):
        self.root = Path(root).resolve()

    def _path(self, key: str) -> Path:
        if not key or "\0" in key or PurePosixPath(key).is_absolute():
            raise ValidationError("the key is no path")
        path = (self.root / key).resolve()
        if path == self.root or self.root not in path.parents:
            raise ValidationError("the key leads out of the store")
        return path

    def put(self, key: str, data: bytes) -> None:
        path = self._path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    def get(self, key: str) -> bytes:
        path = self._path(key)
        if not path.is_file():
            raise ResolverError(f"nothing is stored as '{key}'")
        return path.read_bytes()

    def delete(self, key: str) -> None:
        self._path(key).unlink(missing_ok=True)


class HadoopStorage:
    """Files below a folder of any file system that Spark knows (s3a://, hdfs://, file:/)."""

    def __init__(self, spark, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, key: str):
        parts = PurePosixPath(key).parts
        if not parts or PurePosixPath(key).is_absolute() or ".." in parts or ":" in parts[0]:
            raise ValidationError("the key leads out of the store")
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{'/'.join(parts)}")
        return path, path.getFileSystem(self.conf)

    def put(self, key: str, data: bytes) -> None:
        path, system = self._path(key)
        out = system.create(path, True)
        out.write(bytearray(data))
        out.close()

    def get(self, key: str) -> bytes:
        path, system = self._path(key)
        if not system.exists(path):
            raise ResolverError(f"nothing is stored as '{key}'")
        source = system.open(path)
        data = self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)
        source.close()
        return bytes(data)

    def delete(self, key: str) -> None:
        path, system = self._path(key)
        system.delete(path, False)


@dataclass(frozen=True)
class Uploaded:
    key: str
    size: int
    type: str
    hash: str


class Uploads:
    """Checks size, type and (if sent) content hash before it stores."""

    def __init__(self, storage: Storage, types: tuple[str, ...] | None = None, most: int = MOST_BYTES, plugins: Sequence[Plugin] = ()):
        """``plugins``: their upload hooks see each file, in order, after its hash was checked."""
        self.storage, self.types, self.most, self.plugins = storage, types, most, plugins

    def accept(self, data: bytes, type: str, name: str = "", hash: str | None = None, folder: str = "", context: Context | None = None) -> Uploaded:
        if hash is not None and hash != content_hash(data):
            raise IntegrityError("the file is not the one that was signed")
        file = File(data, type, name, hash)
        for plugin in self.plugins:
            file = plugin.on_upload(file, context or Context())
        data, type, name = file.data, file.type, file.name
        if len(data) > self.most:
            raise ValidationError(f"the file has {len(data)} bytes, more than {self.most}")
        if self.types is not None and not any(type == t or (t.endswith("/*") and type.startswith(t[:-1])) for t in self.types):
            raise ValidationError(f"files of type '{type}' are not accepted")
        own = content_hash(data)
        ending = "".join(PurePosixPath(name).suffixes[-1:])
        key = f"{folder + '/' if folder else ''}{own[:16]}-{secrets.token_hex(4)}{ending}"
        self.storage.put(key, data)
        return Uploaded(key, len(data), type, own)
