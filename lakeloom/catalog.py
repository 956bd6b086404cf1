"""The namespace: hives (databases) of boxes (schemas) of frames (tables), as versioned JSON documents."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from .errors import ConflictError, EntityNotFoundError, SerializationError, WriteConflictError

FOLDER, ATTEMPTS, MAX_PARTITIONS = "_registry", 10, 10_000


def now() -> str:
    return datetime.now(UTC).isoformat()


class Catalog:
    def __init__(self, storage):
        self.storage = storage

    @staticmethod
    def _key(version: int) -> str:
        return f"{FOLDER}/state_{version:06d}.json"

    def load(self) -> dict[str, Any]:
        """The newest state; a new catalog is at version 1 without hives."""
        keys = [k for k in self.storage.list(FOLDER) if k.rpartition("/")[2].startswith("state_")]
        if not keys:
            return {"version": 1, "hives": {}}
        try:
            return json.loads(self.storage.get(max(keys, key=lambda k: int(k.rpartition("_")[2].partition(".")[0]))))
        except ValueError as error:
            raise SerializationError(str(error)) from None

    def _change(self, change: Callable[[dict[str, Any]], bool]) -> None:
        """Applies a change to the newest state and writes the next one, again if another writer was first."""
        for _ in range(ATTEMPTS):
            state = self.load()
            if not change(state):
                return
            state["version"] += 1
            try:
                self.storage.put_if_not_exists(self._key(state["version"]), json.dumps(state).encode())
                return
            except WriteConflictError:
                continue
        raise ConflictError(f"the catalog changed {ATTEMPTS} times meanwhile")

    @staticmethod
    def _hive(state, hive: str):
        if hive not in state["hives"]:
            raise EntityNotFoundError("Hive", hive)
        return state["hives"][hive]

    def _box(self, state, hive: str, box: str):
        boxes = self._hive(state, hive)["boxes"]
        if box not in boxes:
            raise EntityNotFoundError("Box", f"{hive}.{box}")
        return boxes[box]

    def create_hive(self, name: str) -> None:
        def change(state) -> bool:
            new = name not in state["hives"]
            state["hives"].setdefault(name, {"boxes": {}, "created_at": now(), "properties": {}})
            return new

        self._change(change)

    def create_box(self, hive: str, name: str) -> None:
        def change(state) -> bool:
            boxes = self._hive(state, hive)["boxes"]
            new = name not in boxes
            boxes.setdefault(name, {"frames": {}, "created_at": now(), "properties": {}})
            return new

        self._change(change)

    def create_frame(self, hive: str, box: str, name: str, schema: Any, partition_by: list[str] | None = None, max_partitions: int = MAX_PARTITIONS) -> None:
        def change(state) -> bool:
            frames = self._box(state, hive, box)["frames"]
            new = name not in frames
            frames.setdefault(name, {"schema": schema, "partition_by": list(partition_by or []), "created_at": now(), "max_partitions": max_partitions, "properties": {}})
            return new

        self._change(change)

    def list_hives(self) -> list[str]:
        return sorted(self.load()["hives"])

    def list_boxes(self, hive: str) -> list[str]:
        return sorted(self._hive(self.load(), hive)["boxes"])

    def list_frames(self, hive: str, box: str) -> list[str]:
        return sorted(self._box(self.load(), hive, box)["frames"])

    def get_frame(self, hive: str, box: str, name: str) -> dict[str, Any]:
        frames = self._box(self.load(), hive, box)["frames"]
        if name not in frames:
            raise EntityNotFoundError("Frame", f"{hive}.{box}.{name}")
        return frames[name]

    def stored_name(self, *parts: str) -> tuple[str, ...] | None:
        """The names as they are kept, for names in any case; exact names win. None if there is no such entity."""
        level, found = self.load()["hives"], []
        for part, below in zip(parts, ("boxes", "frames", None), strict=False):
            name = part if part in level else next((k for k in sorted(level) if k.lower() == part.lower()), None)
            if name is None:
                return None
            found.append(name)
            level = level[name][below] if below else {}
        return tuple(found)
