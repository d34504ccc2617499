"""API keys: who may call the service.  Only the SHA-256 of a key is kept, in a SQL table of the engine."""

from __future__ import annotations

import base64
import hashlib
import json
import secrets
import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import require
from .operators import sqlapi

TABLE = "sys_api_keys"
SCHEMA = "id string, key_hash string, name string, role string, permissions string, created_at_ms long"
ALL = {"allow": "*"}


def new_key(prefix: str = "tm_live_") -> str:
    """256 random bits, in URL-safe base64 without padding."""
    return prefix + base64.urlsafe_b64encode(secrets.token_bytes(32)).decode().rstrip("=")


def _hash(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


class Keys:
    def __init__(self, tables: sqlapi.Tables):
        self.tables = tables

    def _table(self) -> DataFrame:
        if TABLE not in self.tables.names():
            self.tables.create(TABLE, SCHEMA)
        return self.tables.read(TABLE)

    def bootstrap(self) -> str | None:
        """Without any key, make an admin's and return it; it can't be read again."""
        if not self._table().isEmpty():
            return None
        key = new_key()
        self.create("Admin", "admin", key, ALL)
        return key

    def ensure(self, key: str) -> None:
        """Make sure that this key is an admin's, or whatever it already is."""
        if self.validate(key) is None:
            self.create("Bootstrap", "admin", key, ALL)

    def create(self, name: str, role: str, key: str, permissions: Any, at: int | None = None) -> str:
        """The new key's id.  A key that is there already is refused with already_exists."""
        require(self.validate(key) is None, "already_exists", "key")
        id_ = str(uuid.uuid4())
        row = (id_, _hash(key), name, role, json.dumps(permissions), at if at is not None else time.time_ns() // 1_000_000)
        self.tables.insert(TABLE, self.tables.spark.createDataFrame([row], SCHEMA))
        return id_

    def create_frame(self, rows: DataFrame) -> int:
        """Keys of a frame of any size (id, key, name, role, permissions as JSON, created_at_ms); those that are there already, and
        all but the smallest id of a repeated one, are left out.  How many were made."""
        hashed = rows.withColumn("key_hash", F.sha2("key", 256)).groupBy("key_hash").agg(F.min_by(F.struct("id", "name", "role", "permissions", "created_at_ms"), "id").alias("r"))
        return self.tables.insert(TABLE, hashed.join(self._table().select("key_hash"), "key_hash", "left_anti").select("key_hash", "r.*"))

    def validate(self, key: str) -> Mapping | None:
        """The record of a key, without its hash; None if there is none.  The hash reaches the scan as a filter."""
        row = self._table().where(F.col("key_hash") == _hash(key)).drop("key_hash").first()
        return row and row.asDict() | {"permissions": json.loads(row.permissions)}

    def validate_frame(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key and any other columns) that are known, with id, name, role and permissions of their records."""
        known = self._table().select("key_hash", "id", "name", "role", "permissions")
        return keys.withColumn("key_hash", F.sha2("key", 256)).join(known, "key_hash").drop("key_hash")

    def list(self) -> DataFrame:
        """All records without the hashes, the newest first, then by id."""
        return self._table().drop("key_hash").orderBy(F.desc("created_at_ms"), "id")

    def revoke(self, id_: str) -> bool:
        """Whether there was such a key."""
        self._table()
        return self.tables.delete(TABLE, {"id": id_}) > 0
