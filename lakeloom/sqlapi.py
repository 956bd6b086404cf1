"""SQL over frames: session commands, blocked statements, and queries over snapshots of just the files they need."""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import Catalog
from .errors import ConfigError, EntityNotFoundError, LakeError, ResolutionError, UnsupportedError
from .functions.aliases import with_aliases
from .ledger import Ledger
from .plans import not_in, resolve, skipping
from .sources.frames import read_cells
from .types import spark_schema

BLOCKED = {
    "DELETE": "DELETE is not supported: frames are appended to. overwrite_frame() replaces all rows of a frame.",
    "UPDATE": "UPDATE is not supported: frames are appended to. Write the corrected rows with overwrite_frame().",
    "INSERT": "INSERT is not supported in SQL. write_to_frame() adds rows.",
    "DROP": "DROP is not supported in SQL. Namespaces are managed by the catalog's methods.",
    "CREATE": "CREATE is not supported in SQL. create_frame() makes a frame.",
    "ALTER": "ALTER is not supported in SQL. Namespaces are managed by the catalog's methods.",
    "MERGE": "MERGE is not supported in SQL. overwrite_frame() replaces all rows of a frame.",
    "TRUNCATE": "TRUNCATE is not supported in SQL. overwrite_frame() replaces all rows of a frame.",
}
_COMMENT = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*", re.S)


@dataclass
class Report:
    """What a query did before Spark ran it."""

    relations: list[tuple[str, int, int]] = field(default_factory=list)  # frame, cells, cells that are read
    phases: dict[str, float] = field(default_factory=dict)


class SqlSession:
    def __init__(self, spark: SparkSession, storage, catalog: Catalog, node: str = "node"):
        self.spark, self.storage, self.catalog, self.node = spark, storage, catalog, node
        self.hive: str | None = None
        self.box: str | None = None
        self.report = Report()

    def sql(self, query: str) -> DataFrame:
        text = _COMMENT.sub("", query, count=1).strip().rstrip(";").strip()
        first = (text.split(None, 1) or [""])[0].upper()
        if first in BLOCKED:
            raise UnsupportedError(BLOCKED[first])
        found = self._command(text)
        return found if found is not None else self._query(text)

    # Commands

    def _rows(self, rows: list[tuple], *columns: str) -> DataFrame:
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType(), False) for c in columns]))

    def _need_hive(self, hint: str) -> str:
        if self.hive is None:
            raise ConfigError(f"No hive selected. Run USE HIVE <name> first{hint}.")
        return self.hive

    def _stored(self, kind: str, *parts: str) -> tuple[str, ...]:
        names = [p.strip().strip("`") for p in parts]
        found = self.catalog.stored_name(*names)
        if found is None:
            raise EntityNotFoundError(kind, ".".join(names))
        return found

    def _command(self, text: str) -> DataFrame | None:
        words = text.split(None, 2)
        head = " ".join(words[:2]).upper()
        rest = words[2].strip() if len(words) > 2 else ""
        if head == "USE HIVE" and rest:
            self.hive, self.box = self._stored("Hive", rest)[0], None
            return self._rows([(f"Current hive set to '{rest.strip('`').lower()}'",)], "message")
        if head == "USE BOX" and rest:
            self.box = self._stored("Box", self._need_hive(""), rest)[1]
            return self._rows([(f"Current box set to '{rest.strip('`').lower()}'",)], "message")
        if head == "SHOW HIVES" and not rest:
            return self._rows([(h,) for h in self.catalog.list_hives()], "hive")
        if head in ("SHOW BOXES", "SHOW FRAMES"):
            place = re.fullmatch(r"(?i:IN)\s+(.+)", rest, re.S)
            if rest and not place:
                return None
            parts = place[1].split(".") if place else []
            if head == "SHOW BOXES":
                hive = self._stored("Hive", place[1])[0] if place else self._need_hive(", or use SHOW BOXES IN <hive>")
                return self._rows([(b,) for b in self.catalog.list_boxes(hive)], "box")
            if place and len(parts) != 2:
                raise ConfigError("SHOW FRAMES IN requires hive.box format")
            if not place:
                hint = ", or use SHOW FRAMES IN <hive>.<box>"
                hive = self._need_hive(hint)
                if self.box is None:
                    raise ConfigError(f"No box selected. Run USE BOX <name> first{hint}.")
                parts = [hive, self.box]
            return self._rows([(f,) for f in self.catalog.list_frames(*self._stored("Box", *parts))], "frame")
        if words and words[0].upper() in ("DESCRIBE", "DESC"):
            parts = text.split(None, 1)[1].split(".") if len(words) > 1 else []
            if len(parts) != 3:
                raise ConfigError("DESCRIBE requires hive.box.frame format")
            return self._describe(*self._stored("Frame", *parts))
        if words and words[0].upper() == "EXPLAIN":
            return self._explain(text.split(None, 1)[1] if len(words) > 1 else "")
        return None

    def _describe(self, hive: str, box: str, frame: str) -> DataFrame:
        spec = self.catalog.get_frame(hive, box, frame)
        try:
            cells = list(Ledger.open(self.storage, f"{hive}/{box}/{frame}", self.node).cells.values())
        except LakeError:
            cells = []
        rows = [("schema", json.dumps(spec["schema"])), ("partition_by", ", ".join(spec["partition_by"]) or "(none)"), ("cells", str(len(cells))), ("total_rows", str(sum(c.rows for c in cells))), ("total_bytes", str(sum(c.bytes for c in cells)))]
        return self._rows(rows, "property", "value")

    def _explain(self, text: str) -> DataFrame:
        """The plan, and how many cells of each frame it reads; ANALYZE also runs the query."""
        analyze = re.match(r"(?i)(?:ANALYZE|EXTENDED|FORMATTED|VERBOSE)\s+", text)
        found = self._query(text[analyze.end() :] if analyze else text)
        lines = [f"frame {name}: reads {read} of {cells} cells" for name, cells, read in self.report.relations]
        if analyze and analyze[0].strip().upper() == "ANALYZE":
            started = time.monotonic()
            lines.append(f"rows: {found.count()}, {1000 * (time.monotonic() - started):.0f} ms")
        return self._rows([(x,) for x in [*lines, *found._jdf.queryExecution().toString().split("\n")]], "plan")

    # Queries

    def _frame(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        path = ".".join(parts)
        if len(parts) == 1:
            if self.hive is None or self.box is None:
                raise ResolutionError(path, "a one-part name needs USE HIVE and USE BOX first")
            parts = (self.hive, self.box, *parts)
        elif len(parts) == 2:
            if self.hive is None:
                raise ResolutionError(path, "a two-part name needs USE HIVE first")
            parts = (self.hive, *parts)
        if len(parts) != 3:
            raise ResolutionError(path, "names have one to three parts")
        found = self.catalog.stored_name(*parts)
        if found is None:
            raise ResolutionError(path, "there is no such frame")
        return found

    def _query(self, text: str) -> DataFrame:
        started, self.report = time.monotonic(), Report()

        def phase(name: str) -> None:
            nonlocal started
            self.report.phases[name] = time.monotonic() - started
            started = time.monotonic()

        text = with_aliases(text)
        found = resolve.relations(self.spark, text)
        if not found:
            raise ConfigError("No table references found in query")
        phase("parse")
        # One snapshot for each frame, however often it is named
        frames = {r.start: self._frame(r.parts) for r in found}
        snapshots = {}
        for key in frames.values():
            if key not in snapshots:
                spec = self.catalog.get_frame(*key)
                ledger = Ledger.create(self.storage, "/".join(key), self.node, spec["schema"], spec["partition_by"])
                snapshots[key] = (spark_schema(spec["schema"]), list(ledger.cells.values()))
        phase("file_discovery")
        places = self._places(text, found, {r.start: snapshots[frames[r.start]][0] for r in found})
        views, names = {}, []
        try:
            for k, r in enumerate(found):
                schema, cells = snapshots[frames[r.start]]
                read = skipping.needed(cells, places.get(k), schema)
                self.report.relations.append((".".join(frames[r.start]), len(cells), len(read)))
                names.append(f"lake_{uuid.uuid4().hex}")
                read_cells(self.spark, self.storage.root, "/".join(frames[r.start]), schema, read).createOrReplaceTempView(names[-1])
                views[r.start] = (r, names[-1])
            result = self.spark.sql(not_in.by_key(self.spark, resolve.replaced(text, views)))
        finally:
            for name in names:
                self.spark.catalog.dropTempView(name)
        phase("plan")
        if os.environ.get("LAKELOOM_TIMING") == "1":
            parts = " ".join(f"{k}={1000 * v:.0f}ms" for k, v in self.report.phases.items())
            print(f"[TIMING] query={text[:60]!r} total={1000 * sum(self.report.phases.values()):.0f}ms {parts}", file=sys.stderr)
        return result

    def _places(self, text: str, found, schemas: dict[int, T.StructType]) -> dict[int, list]:
        """Plans the query over empty stand-ins, whose columns are marked, to see which predicates meet which relation."""
        views, names = {}, []
        java = self.spark._jsparkSession
        try:
            for k, r in enumerate(found):
                marked = T.StructType([T.StructField(f.name, f.dataType, True, {skipping.MARK: k}) for f in schemas[r.start].fields])
                names.append(f"lake_{uuid.uuid4().hex}")
                java.createDataFrame(self.spark.sparkContext._jsc.emptyRDD(), java.parseDataType(marked.json())).createOrReplaceTempView(names[-1])
                views[r.start] = (r, names[-1])
            plan = self.spark.sql(resolve.replaced(text, views))._jdf.queryExecution().optimizedPlan()
            return skipping.by_relation(plan)
        finally:
            for name in names:
                self.spark.catalog.dropTempView(name)
