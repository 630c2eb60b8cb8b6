"""Scenes as binary glTF: a file of each plan, and its parts read back."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.triangles import owned_triangles
from ..model import MATERIALS

#: Fixed values of the format.
MAGIC, VERSION, JSON_CHUNK, BINARY_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
FLOATS, INTEGERS, ARRAY_TARGET, ELEMENT_TARGET, TRIANGLES = 5126, 5125, 34962, 34963, 4


def upright(points: np.ndarray) -> np.ndarray:
    """The format's y points up, a plan's z does."""
    return np.stack((points[:, 0], points[:, 2], -points[:, 1]), axis=1).astype("<f4")


def glb(objects: list[tuple[str, str, str | None, np.ndarray, np.ndarray]]) -> bytes:
    """A file of objects (name, type, text, points with y up, triangles). What has no faces is a node at its first point."""
    nodes, meshes, accessors, views, parts, size = [], [], [], [], [], 0
    kinds = [k for k in MATERIALS if any(o[1] == k for o in objects)]

    def view(data: bytes, target: int) -> int:
        nonlocal size
        views.append({"buffer": 0, "byteOffset": size, "byteLength": len(data), "target": target})
        parts.append(data)
        size += len(data)
        return len(views) - 1

    for name, kind, text, at, tri in objects:
        node = {"name": name, "extras": {"type": kind} | ({} if text is None else {"text": text})}
        if len(tri):
            accessors.append({"bufferView": view(at.tobytes(), ARRAY_TARGET), "componentType": FLOATS, "count": len(at), "type": "VEC3", "min": at.min(axis=0).tolist(), "max": at.max(axis=0).tolist()})
            accessors.append({"bufferView": view(tri.astype("<u4").tobytes(), ELEMENT_TARGET), "componentType": INTEGERS, "count": tri.size, "type": "SCALAR"})
            primitive = {"attributes": {"POSITION": len(accessors) - 2}, "indices": len(accessors) - 1, "mode": TRIANGLES}
            if kind in kinds:
                primitive["material"] = kinds.index(kind)
            meshes.append({"name": name, "primitives": [primitive]})
            node["mesh"] = len(meshes) - 1
        elif len(at):
            node["translation"] = at[0].tolist()
        nodes.append(node)
    colours = [{"name": k.title(), "pbrMetallicRoughness": {"baseColorFactor": list(MATERIALS[k]), "metallicFactor": 0.0}} for k in kinds]
    head = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(nodes)))} if nodes else {}], "nodes": nodes, "meshes": meshes, "materials": colours, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": size}] if size else []}
    text = json.dumps({k: v for k, v in head.items() if v != []}, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    chunks = struct.pack("<II", len(text), JSON_CHUNK) + text
    if size:
        chunks += struct.pack("<II", size, BINARY_CHUNK) + b"".join(parts)
    return struct.pack("<III", MAGIC, VERSION, 12 + len(chunks)) + chunks


#: Plans that are made into files, or read, together: a batch of Spark's may hold thousands, whose files would all stand in memory.
PLANS = 128


def few_plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, copied out a few plans at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, PLANS):
            yield batch.take(pa.array(range(k, min(k + PLANS, batch.num_rows)), pa.int64()))


def write_glb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_plans(batches):
        plans, lists = batch.columns
        o = lists.values
        name, kind, text = (o.field(k).to_pylist() for k in ("name", "type", "text"))
        vertices, rings = o.field("vertices"), o.field("faces")
        points = np.stack([np.asarray(vertices.values.field(k)) for k in "xyz"], axis=1) if len(vertices.values) else np.zeros((0, 3))
        v_at, f_at, c_at, corners = (np.asarray(x).astype(np.int64) for x in (vertices.offsets, rings.offsets, rings.values.offsets, rings.values.values))
        # The triangles of all plans of the batch are made together.
        owner = np.repeat(np.arange(len(o)), np.diff(f_at))
        base = v_at[:-1][np.repeat(owner, np.diff(c_at))]
        tri, whose = owned_triangles(points, corners + base, c_at, owner)
        tri = (tri - v_at[:-1][whose][:, None]).astype("<u4")
        t_at, up = np.searchsorted(whose, np.arange(len(o) + 1)), upright(points)
        at = np.asarray(lists.offsets)
        out = []
        for r in range(len(plans)):
            own = range(at[r], at[r + 1])
            out.append(glb([(name[i], kind[i], text[i], up[v_at[i] : v_at[i + 1]], tri[t_at[i] : t_at[i + 1]]) for i in own]))
        yield pa.RecordBatch.from_arrays([plans, pa.array(out, pa.binary())], names=["plan_id", "glb"])


def glb_files(objects: DataFrame) -> DataFrame:
    """(plan_id, glb): the objects of build_scene() as one file of each plan, in order of type and place.

    Concave faces are cut into triangles by ear clipping. A plan's objects meet in one row; plans are many.
    """
    o = objects.select("plan_id", F.struct("type", "source_index", "name", "text", "vertices", "faces").alias("o"))
    by_plan = o.groupBy("plan_id").agg(F.sort_array(F.collect_list("o")).alias("objects"))
    return by_plan.mapInArrow(write_glb, f"plan_id {objects.schema['plan_id'].dataType.simpleString()}, glb binary")


NOTHING = np.zeros((0, 3)), np.zeros((0, 3), np.int64)


def parts(data: bytes) -> list[tuple[str, str, str | None, int, np.ndarray]]:
    """(name, type, text, number of points, corners of the triangles as (n, 3, 3)) of a file's nodes, by its own accessors."""
    magic, version, size = struct.unpack_from("<III", data)
    if (magic, version, size) != (MAGIC, VERSION, len(data)):
        raise ValueError("not a binary glTF file of version 2")
    length, _ = struct.unpack_from("<II", data, 12)
    head, body = json.loads(data[20 : 20 + length]), data[28 + length :]

    def read(k: int) -> np.ndarray:
        a = head["accessors"][k]
        v = head["bufferViews"][a["bufferView"]]
        return np.frombuffer(body, "<f4" if a["componentType"] == FLOATS else "<u4", a["count"] * (3 if a["type"] == "VEC3" else 1), v["byteOffset"])

    out = []
    for n in head.get("nodes", []):
        points, tri = NOTHING
        if "mesh" in n:
            p = head["meshes"][n["mesh"]]["primitives"][0]
            points, tri = read(p["attributes"]["POSITION"]).reshape(-1, 3).astype(np.float64), read(p["indices"]).reshape(-1, 3)
        out.append((n["name"], n["extras"]["type"], n["extras"].get("text"), len(points), points[tri]))
    return out


def read_glb(files: DataFrame) -> DataFrame:
    """(plan_id, name, type, text, n_vertices, n_triangles, area) of the nodes of (plan_id, glb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_plans(batches):
            rows, found = [], [np.zeros((0, 3, 3))]
            for plan, data in zip(batch.columns[0].to_pylist(), batch.columns[1].to_pylist(), strict=True):
                for name, kind, text, n, t in parts(data):
                    rows.append((plan, name, kind, text, n, len(t)))
                    found.append(t)
            t = np.concatenate(found)
            sizes = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) / 2
            area = np.bincount(np.repeat(np.arange(len(rows)), [r[-1] for r in rows]), sizes, len(rows)) if rows else []
            rows = [(*r, float(a)) for r, a in zip(rows, area, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["plan_id", "name", "type", "text", "n_vertices", "n_triangles", "area"])

    return files.select("plan_id", "glb").mapInArrow(run, f"plan_id {files.schema['plan_id'].dataType.simpleString()}, name string, type string, text string, n_vertices long, n_triangles long, area double")
