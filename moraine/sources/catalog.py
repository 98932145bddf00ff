"""Catalogs: where tables are found and how their metadata moves forward."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from abc import ABC, abstractmethod
from collections import defaultdict

from ..core.config import TableConfig
from ..core.errors import AlreadyExists, CommitConflict, FeatureUnsupported, InvalidData, LakeError, NotFound
from ..core.storage import Storage, join
from ..format.metadata import TableMetadata, check_requirements, new_metadata
from ..format.types import PartitionSpec, Schema, SortOrder

# Option names of catalogs.
TYPE_KEY, NAME_KEY, CONFIG_PREFIX = "iceberg.catalog.type", "iceberg.catalog.name", "iceberg.catalog."
_METADATA_NAME = re.compile(r"^(?:v(\d+)|(\d+)-[0-9a-fA-F-]+)\.metadata\.json$")
HINT = "version-hint.text"


class TableIdentifier:
    """Namespace levels and a table name; ``a.b.t`` or a list of parts."""

    def __init__(self, parts: str | list[str] | tuple[str, ...]):
        parts = parts.split(".") if isinstance(parts, str) else list(parts)
        if not parts or not all(parts):
            raise InvalidData("empty table identifier", parts=parts)
        self.namespace, self.name = tuple(parts[:-1]), parts[-1]

    def __str__(self) -> str:
        return ".".join((*self.namespace, self.name))

    def __eq__(self, other) -> bool:
        return isinstance(other, TableIdentifier) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))


def _id(identifier) -> TableIdentifier:
    return identifier if isinstance(identifier, TableIdentifier) else TableIdentifier(identifier)


class Catalog(ABC):
    """All operations; what a catalog cannot do raises ``FeatureUnsupported``."""

    name = "catalog"

    def _no(self, what: str):
        raise FeatureUnsupported(f"{what} is not supported by this catalog", catalog=self.name)

    @abstractmethod
    def load_table(self, identifier): ...

    def list_tables(self, namespace) -> list[TableIdentifier]:
        self._no("list_tables")

    def create_table(self, identifier, schema: Schema, spec: PartitionSpec | None = None, properties: dict | None = None, sort_order: SortOrder | None = None):
        self._no("create_table")

    def table_exists(self, identifier) -> bool:
        try:
            self.load_table(identifier)
            return True
        except NotFound:
            return False

    def drop_table(self, identifier, purge: bool = False) -> None:
        self._no("drop_table")

    def rename_table(self, old, new) -> None:
        self._no("rename_table")

    def invalidate_table(self, identifier) -> None:
        """Forget cached state; catalogs here keep none."""

    def register_table(self, identifier, metadata_location: str):
        self._no("register_table")

    def update_table(self, identifier, requirements: list[dict], updates: list[dict]):
        self._no("update_table")


def metadata_version(name: str) -> int | None:
    m = _METADATA_NAME.match(name)
    return int(m[1] or m[2]) if m else None


class StorageCatalog(Catalog):
    """Tables as folders below a warehouse; a commit creates the next metadata file exclusively."""

    def __init__(self, spark, warehouse: str, name: str = "storage", options: dict | None = None):
        self.spark, self.warehouse, self.name = spark, warehouse.rstrip("/"), name
        self.storage = Storage(spark)
        self.config = TableConfig.parse(options or {})

    def location(self, identifier) -> str:
        i = _id(identifier)
        return join(self.warehouse, *i.namespace, i.name)

    def _versions(self, location: str) -> list[tuple[int, str]]:
        found = ((metadata_version(n), n) for n, is_dir in self.storage.listing(join(location, "metadata")) if not is_dir)
        return sorted((v, n) for v, n in found if v is not None)

    def _current(self, location: str) -> tuple[int, str]:
        """(version, file name): the newest metadata file from the hinted version on.

        The hint only saves looking at old versions: it is written after the commit, so it may
        lag behind, be missing, or be unreadable.
        """
        folder = join(location, "metadata")
        try:
            hinted = int(self.storage.read(join(folder, HINT)).decode().strip())
        except (OSError, ValueError, LakeError):
            hinted = None
        if hinted is not None and self.storage.exists(join(folder, f"v{hinted}.metadata.json")):
            while self.storage.exists(join(folder, f"v{hinted + 1}.metadata.json")):
                hinted += 1
            return hinted, f"v{hinted}.metadata.json"
        versions = self._versions(location)
        if not versions:
            raise NotFound("no such table", location=location)
        return versions[-1]

    def load_table(self, identifier):
        from .table import Table

        i, location = _id(identifier), self.location(identifier)
        version, file = self._current(location)
        path = join(location, "metadata", file)
        metadata = TableMetadata(json.loads(self.storage.read(path)))
        return Table(self.spark, i, metadata, self, self.config, version=version, metadata_path=path)

    def list_tables(self, namespace=()) -> list[TableIdentifier]:
        parts = tuple(namespace.split(".")) if isinstance(namespace, str) else tuple(namespace)
        folder = join(self.warehouse, *parts) if parts else self.warehouse
        return [TableIdentifier((*parts, n)) for n, is_dir in self.storage.listing(folder) if is_dir and self._versions(join(folder, n))]

    def create_table(self, identifier, schema, spec=None, properties=None, sort_order=None):
        location = self.location(identifier)
        metadata = new_metadata(location, schema, spec, properties, sort_order)
        if self._versions(location) or not self._publish(location, 1, metadata):
            raise AlreadyExists("table exists", table=str(_id(identifier)))
        return self.load_table(identifier)

    def register_table(self, identifier, metadata_location: str):
        metadata = TableMetadata(json.loads(self.storage.read(metadata_location)))
        if not self._publish(self.location(identifier), 1, metadata):
            raise AlreadyExists("table exists", table=str(_id(identifier)))
        return self.load_table(identifier)

    def _publish(self, location: str, version: int, metadata: TableMetadata) -> bool:
        body = json.dumps(metadata.to_json()).encode()
        if not self.storage.create(join(location, "metadata", f"v{version}.metadata.json"), body):
            return False
        self.storage.replace(join(location, "metadata", HINT), str(version).encode())
        return True

    def table_exists(self, identifier) -> bool:
        return bool(self._versions(self.location(identifier)))

    def drop_table(self, identifier, purge: bool = False) -> None:
        location = self.location(identifier)
        if not self._versions(location):
            raise NotFound("no such table", table=str(_id(identifier)))
        self.storage.delete(location if purge else join(location, "metadata"), recursive=True)

    def rename_table(self, old, new) -> None:
        """Move the folder of a table; paths inside its metadata are rewritten to the new place."""
        table = self.load_table(old)
        if table.metadata.snapshots:
            raise FeatureUnsupported("a table with snapshots holds absolute paths and cannot be moved")
        if self.table_exists(new):
            raise AlreadyExists("table exists", table=str(_id(new)))
        self.storage.move(self.location(old), self.location(new))
        self.update_table(new, [], [{"action": "set-location", "location": self.location(new)}])

    def update_table(self, identifier, requirements, updates):
        location = self.location(identifier)
        version, file = self._current(location)
        path = join(location, "metadata", file)
        current = TableMetadata(json.loads(self.storage.read(path)))
        check_requirements(current, requirements)
        after = current.updated(updates)
        after.metadata_log = [*current.metadata_log, {"timestamp-ms": current.last_updated_ms, "metadata-file": path}]
        if not self._publish(location, version + 1, after):
            raise CommitConflict("another writer committed first", table=str(_id(identifier)), version=version + 1)
        return self.load_table(identifier)


def load_table_by_path(spark, path: str):
    """A table by its folder: the parent is the warehouse, the last part the name."""
    warehouse, _, name = path.rstrip("/").rpartition("/")
    if not warehouse or not name:
        raise InvalidData("no table path", path=path)
    return StorageCatalog(spark, warehouse, "demo").load_table([name])


class RestCatalog(Catalog):
    """A catalog behind the open REST protocol."""

    def __init__(self, spark, uri: str, name: str = "rest", options: dict | None = None, warehouse: str | None = None, timeout: float = 30):
        self.spark, self.name, self.timeout = spark, name, timeout
        self.uri = uri.rstrip("/")
        self.storage = Storage(spark)
        query = "?" + urllib.parse.urlencode({"warehouse": warehouse}) if warehouse else ""
        served = self._call("GET", f"/v1/config{query}")
        # Later settings win: the server's defaults, the user's options, the server's overrides.
        self.settings = {**(served.get("defaults") or {}), **(options or {}), **(served.get("overrides") or {})}
        self.uri = self.settings.get("uri", self.uri).rstrip("/")
        self.config = TableConfig.parse(self.settings)

    def _call(self, method: str, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.uri + path, data, {"Content-Type": "application/json"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                text = answer.read()
                return json.loads(text) if text else {}
        except urllib.error.HTTPError as e:
            kind = {404: NotFound, 409: CommitConflict, 501: FeatureUnsupported}.get(e.code, LakeError)
            raise kind("REST catalog refused", e, status=e.code, path=path, answer=e.read().decode(errors="replace")[:500]) from e
        except urllib.error.URLError as e:
            raise LakeError("REST catalog cannot be reached", e, uri=self.uri) from e

    @property
    def _prefix(self) -> str:
        prefix = self.settings.get("prefix")
        return f"/v1/{prefix}" if prefix else "/v1"

    def _namespace(self, levels) -> str:
        return f"{self._prefix}/namespaces/{urllib.parse.quote(chr(0x1F).join(levels), safe='')}"

    def _path(self, identifier) -> str:
        i = _id(identifier)
        return f"{self._namespace(i.namespace)}/tables/{urllib.parse.quote(i.name, safe='')}"

    def _table(self, identifier, answer: dict):
        from .table import Table

        if not answer.get("metadata-location"):
            raise FeatureUnsupported("tables without a metadata location", table=str(_id(identifier)))
        return Table(self.spark, _id(identifier), TableMetadata(answer["metadata"]), self, self.config, metadata_path=answer["metadata-location"])

    def list_tables(self, namespace=()) -> list[TableIdentifier]:
        parts = tuple(namespace.split(".")) if isinstance(namespace, str) else tuple(namespace)
        answer = self._call("GET", f"{self._namespace(parts)}/tables")
        return [TableIdentifier((*t["namespace"], t["name"])) for t in answer.get("identifiers", [])]

    def load_table(self, identifier):
        return self._table(identifier, self._call("GET", self._path(identifier)))

    def create_table(self, identifier, schema, spec=None, properties=None, sort_order=None):
        i = _id(identifier)
        body = {"name": i.name, "schema": schema.to_json(), "partition-spec": (spec or PartitionSpec()).to_json(), "properties": properties or {}}
        if sort_order is not None:
            body["write-order"] = sort_order.to_json()
        return self._table(i, self._call("POST", f"{self._namespace(i.namespace)}/tables", body))

    def drop_table(self, identifier, purge: bool = False) -> None:
        self._call("DELETE", self._path(identifier) + ("?purgeRequested=true" if purge else ""))

    def rename_table(self, old, new) -> None:
        name = lambda i: {"namespace": list(i.namespace), "name": i.name}
        self._call("POST", f"{self._prefix}/tables/rename", {"source": name(_id(old)), "destination": name(_id(new))})

    def register_table(self, identifier, metadata_location: str):
        i = _id(identifier)
        return self._table(i, self._call("POST", f"{self._namespace(i.namespace)}/register", {"name": i.name, "metadata-location": metadata_location}))

    def update_table(self, identifier, requirements, updates):
        i = _id(identifier)
        named = {"namespace": list(i.namespace), "name": i.name}
        return self._table(i, self._call("POST", self._path(i), {"identifier": named, "requirements": requirements, "updates": updates}))


class MeteredCatalog(Catalog):
    """A layer over any catalog that counts and times its operations."""

    def __init__(self, inner: Catalog):
        self.inner, self.name = inner, inner.name
        self.counts: dict[str, int] = defaultdict(int)
        self.failures: dict[str, int] = defaultdict(int)
        self.seconds: dict[str, list[float]] = defaultdict(list)

    def _measured(self, what: str, *args, **kw):
        began = time.perf_counter()
        self.counts[what] += 1
        try:
            result = getattr(self.inner, what)(*args, **kw)
        except Exception:
            self.failures[what] += 1
            raise
        finally:
            self.seconds[what].append(time.perf_counter() - began)
        if hasattr(result, "catalog"):
            result.catalog = self  # commits through the table are measured too
        return result


for _operation in ("list_tables", "load_table", "create_table", "table_exists", "drop_table", "rename_table", "invalidate_table", "register_table", "update_table"):

    def _method(self, *args, _operation=_operation, **kw):
        return self._measured(_operation, *args, **kw)

    setattr(MeteredCatalog, _operation, _method)
MeteredCatalog.__abstractmethods__ = frozenset()


def load_catalog(spark, options: dict[str, str]) -> Catalog:
    """A catalog from options: ``iceberg.catalog.type`` (storage or rest), ``iceberg.catalog.name``,
    and below ``iceberg.catalog.<name>.`` its ``warehouse`` or ``uri``; table options as they are."""
    for key in (TYPE_KEY, NAME_KEY):
        if not options.get(key):
            raise InvalidData("option is missing", key=key)
    name = options[NAME_KEY]
    own = {k[len(CONFIG_PREFIX) + len(name) + 1 :]: v for k, v in options.items() if k.startswith(f"{CONFIG_PREFIX}{name}.")}
    rest = {k: v for k, v in options.items() if k.startswith("iceberg.table.")}
    kind = options[TYPE_KEY]
    if kind == "storage":
        warehouse = own.get("warehouse")
        if not warehouse:
            raise InvalidData("option is missing", key=f"{CONFIG_PREFIX}{name}.warehouse")
        return StorageCatalog(spark, warehouse, name, rest)
    if kind == "rest":
        if not own.get("uri"):
            raise InvalidData("option is missing", key=f"{CONFIG_PREFIX}{name}.uri")
        return RestCatalog(spark, own["uri"], name, {**own, **rest}, own.get("warehouse"))
    raise FeatureUnsupported("catalog type", type=kind)
