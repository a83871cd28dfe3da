"""A store of chunks that is only ever added to: versions, tombstones, and commits that two writers cannot lose.

A commit is a folder of rows, a folder of tombstones, or both, and a manifest that lists all folders of its version. It
becomes a version when the manifest's folder is renamed to the version's number: a rename to a folder that is there
already does not happen, so of two writers one is first, and the other one finds its base outdated and commits on the
new one. A reader reads one manifest, and so one version, whatever is written meanwhile.

A tombstone names a chunk, a document or a knowledge base, and hides the rows of earlier commits that it fits. So an
upsert, a delete or an update of a document writes what changes and reads nothing; a restored document is its rows of an
old version written anew. Compaction rewrites the rows that are visible and drops tombstones they do not need; what other
writers commit meanwhile stays on top of it. Old versions can be read until :meth:`ChunkStore.vacuum` removes them.

Rows have kb_id, doc, chunk and any further columns, of which a commit may add new ones. A row is one of its
(kb_id, chunk): of rows of one commit that share them, the one with the greatest content, written as JSON, stays.
A null kb_id is "default"; a null document or chunk is a value of its own, and is hidden with its knowledge base only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("kb_id", "chunk")
#: Tombstones that are sent to every task; more meet the rows by a shuffle.
SENT = 1_000_000
SCOPES = {"kb": ("kb_id",), "doc": ("kb_id", "doc"), "chunk": ("kb_id", "chunk")}


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one was to follow."""


@dataclass
class Manifest:
    """What a version consists of. segments: folder of rows -> version they are of; tombstones: folder -> version, scope, number."""

    version: int = 0
    token: str = ""
    schema: dict | None = None
    segments: dict[str, int] = field(default_factory=dict)
    tombstones: dict[str, dict] = field(default_factory=dict)
    note: str = ""


class Versioned:
    """Numbered manifests below a path, each of which is there as a whole or not at all."""

    kind = Manifest

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        there = self._at("versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(there)) if self._fs.exists(there) else []

    def manifest(self, version: int | None = None):
        """That of a version, else of the last one; an empty one of a store that has none."""
        if version is None:
            version = max(self.versions(), default=0)
            if not version:
                return self.kind()
        stream = self._fs.open(self._at("versions", f"{version:012d}", "manifest.json"))
        try:
            return self.kind(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, m) -> bool:
        """Make ``m`` a version. False if that version is there already."""
        m.token = uuid.uuid4().hex
        new = self._at("pending", m.token)
        stream = self._fs.create(self._at("pending", m.token, "manifest.json"), False)
        try:
            stream.write(bytearray(json.dumps(m.__dict__).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at("versions"))
        name = f"{m.version:012d}"
        if not self._fs.exists(self._at("versions", name)):
            self._fs.rename(new, self._at("versions", name))
        # where a folder of that name was there first, some file systems put ours inside it
        if self._fs.exists(self._at("versions", name, m.token)):
            self._fs.delete(self._at("versions", name, m.token), True)
        if self._fs.exists(new):
            self._fs.delete(new, True)
        return self.manifest(m.version).token == m.token

    def _commit(self, change, base: int | None = None) -> int:
        """Publish ``change(manifest)`` on the last version, again on a newer one if another writer was first."""
        while True:
            m = self.manifest()
            if base is not None and m.version != base:
                raise Conflict(f"version {m.version} has followed {base}")
            m.version += 1
            change(m)
            if self._publish(m):
                return m.version


class ChunkStore(Versioned):
    # writing
    def _rows(self, rows: DataFrame) -> tuple[str, dict]:
        rows = rows.withColumn("kb_id", F.coalesce(F.col("kb_id").cast("string"), F.lit("default")))
        rest = [c for c in rows.columns if c not in KEY]
        one = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_row")) if rest else rows.select(*KEY).distinct()
        one = one.select(*KEY, *([F.col("_row")[c].alias(c) for c in rest])) if rest else one
        name = uuid.uuid4().hex
        one.sortWithinPartitions(*KEY).write.parquet(f"{self.path}/rows/segment={name}")
        return name, rows.schema.jsonValue()

    def _stones(self, keys: DataFrame, scope: str) -> tuple[str, dict]:
        name = uuid.uuid4().hex
        keys = keys.withColumn("kb_id", F.coalesce(F.col("kb_id").cast("string"), F.lit("default")))
        keys.select(*SCOPES[scope]).dropna().distinct().write.parquet(f"{self.path}/tombstones/{name}")
        return name, {"scope": scope, "n": self.spark.read.parquet(f"{self.path}/tombstones/{name}").count()}

    def _change(self, rows: DataFrame | None, stones: list[tuple[DataFrame, str]], base: int | None, note: str) -> int:
        segment = self._rows(rows) if rows is not None else None
        written = [self._stones(keys, scope) for keys, scope in stones]

        def change(m: Manifest):
            m.note = note
            if segment:
                m.segments[segment[0]] = m.version
                m.schema = _joined(m.schema, segment[1])
            for name, stone in written:
                m.tombstones[name] = stone | {"version": m.version}

        return self._commit(change, base)

    def append(self, rows: DataFrame, base: int | None = None) -> int:
        """Add rows whose keys are new."""
        return self._change(rows, [], base, "append")

    def upsert(self, rows: DataFrame, base: int | None = None) -> int:
        """Add rows, in place of those of the same knowledge base and chunk. ``base``: the version they must follow, else :class:`Conflict`."""
        return self._change(rows, [(rows.select(*KEY), "chunk")], base, "upsert")

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        """Delete chunks (kb_id, chunk), documents (kb_id, doc) or knowledge bases (kb_id), by the columns of ``keys``."""
        scope = "chunk" if "chunk" in keys.columns else "doc" if "doc" in keys.columns else "kb"
        return self._change(None, [(keys, scope)], base, f"delete {scope}")

    def replace_documents(self, rows: DataFrame, base: int | None = None) -> int:
        """Documents with all their chunks, in place of all chunks those documents had, and of any other chunks with these ids."""
        return self._change(rows, [(rows.select("kb_id", "doc"), "doc"), (rows.select(*KEY), "chunk")], base, "replace documents")

    def restore(self, documents: DataFrame, version: int, base: int | None = None) -> int:
        """Documents (kb_id, doc) as they were in ``version``: those that were not there are deleted."""
        wanted = documents.select(F.coalesce(F.col("kb_id").cast("string"), F.lit("default")).alias("kb_id"), "doc").distinct()
        rows = self.read(version).join(wanted, ["kb_id", "doc"], "left_semi")
        return self._change(rows, [(wanted, "doc"), (rows.select(*KEY), "chunk")], base, f"restore from {version}")

    # reading
    def read(self, version: int | None = None, kb_id: str | None = None) -> DataFrame:
        """The rows of a version, the last one unless another is named."""
        m = self.manifest(version)
        return self._visible(m, kb_id).drop("segment_version")

    def _visible(self, m: Manifest, kb_id: str | None = None) -> DataFrame:
        """The rows that no tombstone hides, with the version of their commit."""
        if not m.segments:
            shape = T.StructType.fromJson(m.schema) if m.schema else T.StructType([T.StructField(c, T.StringType()) for c in ("kb_id", "doc", "chunk")])
            return self.spark.createDataFrame([], T.StructType([*shape, T.StructField("segment_version", T.LongType())]))
        shape = T.StructType.fromJson(m.schema)
        folders = [f"{self.path}/rows/segment={s}" for s in m.segments]
        rows = self.spark.read.schema(T.StructType([*shape, T.StructField("segment", T.StringType())])).option("basePath", f"{self.path}/rows").parquet(*folders)
        if kb_id is not None:
            rows = rows.filter(F.col("kb_id") == kb_id)
        of = F.create_map(*[F.lit(x) for pair in m.segments.items() for x in pair])
        rows = rows.withColumn("segment_version", F.element_at(of, F.col("segment")).cast("long")).drop("segment")
        rows = self._marked(rows, m).filter(F.col("hidden").isNull() | (F.col("segment_version") >= F.col("hidden")))
        return rows.select(*[f.name for f in shape], "segment_version")

    def _marked(self, rows: DataFrame, m: Manifest) -> DataFrame:
        """``rows`` with hidden: the last version whose tombstones fit a row, null if none does."""
        found = []
        for scope, columns in SCOPES.items():
            stones = self._tombstones(m, scope)
            if stones is None or not set(columns) <= set(rows.columns):
                continue
            n = sum(s["n"] for s in m.tombstones.values() if s["scope"] == scope)
            found.append(f"hidden_{scope}")
            stones = stones.withColumnRenamed("hidden", found[-1])
            rows = rows.join(F.broadcast(stones) if n <= SENT else stones, list(columns), "left")
        last = F.greatest(*found, F.lit(None)) if found else F.lit(None)
        return rows.withColumn("hidden", last.cast("long")).drop(*found)

    def _tombstones(self, m: Manifest, scope: str) -> DataFrame | None:
        """(columns of the scope, hidden): rows of commits before that version are hidden."""
        out = None
        for version in sorted({s["version"] for s in m.tombstones.values() if s["scope"] == scope}):
            names = [n for n, s in m.tombstones.items() if s["scope"] == scope and s["version"] == version]
            part = self.spark.read.parquet(*[f"{self.path}/tombstones/{n}" for n in names]).withColumn("hidden", F.lit(version).cast("long"))
            out = part if out is None else out.unionByName(part)
        return None if out is None else out.groupBy(*SCOPES[scope]).agg(F.max("hidden").alias("hidden"))

    def added(self, version: int) -> DataFrame:
        """The rows that a version's own commit wrote."""
        m = self.manifest(version)
        return self._visible(Manifest(m.version, schema=m.schema, segments={s: v for s, v in m.segments.items() if v == version})).drop("segment_version")

    def changed_since(self, version: int, until: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows of later commits that are visible in ``until`` (else the last version), and rows that were visible in ``version`` and are hidden there.

        Only the later folders are read for the first, and only what later tombstones fit is kept of the second.
        """
        before, now = self.manifest(version), self.manifest(until)
        if not set(before.segments) <= set(now.segments):
            raise Conflict("compacted since")
        later = Manifest(now.version, schema=now.schema, segments={s: v for s, v in now.segments.items() if v > version}, tombstones=now.tombstones)
        stones = Manifest(tombstones={s: v for s, v in now.tombstones.items() if v["version"] > version})
        old = self._visible(before).drop("segment_version")
        gone = self._marked(old, stones).filter(F.col("hidden").isNotNull()).drop("hidden") if stones.tombstones else old.limit(0)
        return self._visible(later).drop("segment_version"), gone

    # upkeep
    def compact(self) -> int:
        """The visible rows of the last version in one folder; commits that others make meanwhile stay on top."""
        m = self.manifest()
        if not m.segments:
            return m.version
        name = uuid.uuid4().hex
        self._visible(m).drop("segment_version").repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(f"{self.path}/rows/segment={name}")

        def change(now: Manifest):
            if not set(m.segments) <= set(now.segments):
                raise Conflict("another compaction was first")
            now.note = f"compact {m.version}"
            now.segments = {name: m.version} | {s: v for s, v in now.segments.items() if s not in m.segments}
            now.tombstones = {s: v for s, v in now.tombstones.items() if v["version"] > m.version}

        return self._commit(change)

    def vacuum(self, keep: int = 10) -> int:
        """Remove all but the last ``keep`` versions, and the folders that only they have; the number of folders removed."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        held = [self.manifest(v) for v in kept]
        live = {s for m in held for s in (*m.segments, *m.tombstones)}
        gone = set()
        for v in old:
            m = self.manifest(v)
            gone |= {("rows", f"segment={s}") for s in m.segments if s not in live} | {("tombstones", s) for s in m.tombstones if s not in live}
            self._fs.delete(self._at("versions", f"{v:012d}"), True)
        for parts in gone:
            self._fs.delete(self._at(*parts), True)
        return len(gone)


def _joined(old: dict | None, new: dict) -> dict:
    """A schema with the columns of both; the earlier type of a column stays."""
    if old is None:
        return new
    names = {f["name"] for f in old["fields"]}
    kinds = {f["name"]: f["type"] for f in old["fields"]}
    if odd := [f["name"] for f in new["fields"] if f["name"] in names and f["type"] != kinds[f["name"]]]:
        raise ValueError(f"columns of another type than the store's: {', '.join(odd)}")
    return old | {"fields": [*old["fields"], *(f for f in new["fields"] if f["name"] not in names)]}
