"""The sink of bundles, as a Python data source: tasks write parts and their lines of the manifest, the driver's commit makes them a bundle.

Rows come sorted by part, each part within one task.  Names and bytes follow from the rows alone, so a task that runs again, or twice at once, writes the
same files over.  A bundle is one only once build-info.json is there, which the commit writes last; nothing is renamed, which object stores can't do at
once.  If the job fails, or the rows counted aren't those announced, everything below the path is deleted."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plotwise.sources.footers import file_system

MANIFEST = "part long, path string, bytes long, content_hash string, n_rows long, id_lo long, id_hi long, xmin double, ymin double, xmax double, ymax double"
_SIDES = (("xmin", min), ("ymin", min), ("xmax", max), ("ymax", max))


class BundleSource(DataSource):
    """Options: rows (expected), schema, license, keys (JSON), style."""

    @classmethod
    def name(cls) -> str:
        return "plotwise_bundle"

    def schema(self) -> str:
        return MANIFEST

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BundleWriter(schema, dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its lines of the manifest, as a file's name, and their sums."""

    lines: str | None
    parts: int
    n_rows: int
    bounds: list[float | None]


def _bounds(old: list[float | None], new: list[float | None]) -> list[float | None]:
    return [b if a is None else a if b is None else f(a, b) for a, b, (_, f) in zip(old, new, _SIDES, strict=True)]


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.options, self.path = options, options["path"].rstrip("/")
        keys = {k.encode(): v.encode() for k, v in json.loads(options.get("keys", "{}")).items()}
        self.columns = [c for c in schema.names if c != "part"]
        self.kinds = to_arrow_schema(StructType([f for f in schema if f.name != "part"])).with_metadata(keys or None)

    def _part(self, number: int, batches: list[pa.RecordBatch]) -> dict:
        rows = pa.Table.from_batches(batches).select(self.columns).cast(self.kinds).combine_chunks()
        name = f"data/part={number:05d}/part-{number:05d}.parquet"
        sink = pa.BufferOutputStream()
        pq.write_table(rows, sink, compression="snappy")
        body = sink.getvalue()
        self._put(name, body)
        ids, box = pc.min_max(rows.column("id")).as_py(), rows.column("bbox").combine_chunks()
        sides = {side: getattr(pc, f.__name__)(box.field(side)).as_py() for side, f in _SIDES}
        return {"part": number, "path": name, "bytes": body.size, "content_hash": hashlib.sha256(body).hexdigest(), "n_rows": rows.num_rows, "id_lo": ids["min"], "id_hi": ids["max"], **sides}

    def _put(self, name: str, body: bytes) -> None:
        files, root = file_system(self.path)
        files.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(body)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[dict] = []
        number, held = None, []
        for batch in iterator:
            parts = batch.column("part")
            at = 0
            for run in pc.run_end_encode(parts, run_end_type=pa.int32()).run_ends.to_pylist() if batch.num_rows else []:
                if (own := parts[at].as_py()) != number:
                    if held:
                        done.append(self._part(number, held))
                    number, held = own, []
                held.append(batch.slice(at, run - at))
                at = run
        if held:
            done.append(self._part(number, held))
        bounds: list[float | None] = [None] * 4
        for line in done:
            bounds = _bounds(bounds, [line[side] for side, _ in _SIDES])
        name = f"part-{done[0]['part']:05d}.json" if done else None
        if name:
            self._put(f"manifest/{name}", "".join(json.dumps(line) + "\n" for line in done).encode())
        return Written(name, len(done), sum(line["n_rows"] for line in done), bounds)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        n_rows = sum(m.n_rows for m in told)
        if n_rows != int(self.options.get("rows", n_rows)):
            self.abort(messages)
            raise ValueError(f"rows_changed: {self.options['rows']} rows came in, {n_rows} were written")
        bounds: list[float | None] = [None] * 4
        for m in told:
            bounds = _bounds(bounds, m.bounds)
        if not any(m.lines for m in told):
            self._put("manifest/none.json", b"")
        if "style" in self.options:
            self._put("style.json", self.options["style"].encode())
        info = {"parts": sum(m.parts for m in told), "n_rows": n_rows, **dict(zip((side for side, _ in _SIDES), bounds, strict=True))}
        info |= {k: json.loads(self.options.get(k, "null")) for k in ("schema", "license")}
        self._put("build-info.json", json.dumps(info, sort_keys=True).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        files.delete_dir_contents(root, missing_dir_ok=True)
        files.delete_dir(root)
