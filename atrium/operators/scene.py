"""Scene objects as plain rows: (plan_id, name, type, source_index, vertices, faces, attributes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import direction, ring_fault, ring_list_faults, vertex_mean
from ..functions.text import label_text
from ..model import DEFAULT, MATERIALS, Config, checked
from ..sources import plans as source
from .difference import wall_difference
from .walls import BOX_FACES as BOX_FACES
from .walls import box_corners, solid_walls, vertex

def wall_prisms(walls: DataFrame, height: float = DEFAULT.wall_height, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, wall_index, name, height, vertices) of solid walls, uncut; see box_corners() for the order."""
    return solid_walls(walls, cfg).select("plan_id", "wall_index", F.concat(F.lit("Wall_"), F.col("wall_index")).alias("name"), F.lit(float(height)).alias("height"), box_corners(height, cfg).alias("vertices"))


def opening_on_wall(openings: DataFrame, walls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Openings with their wall and along, the distance of their centre from its start.

    An opening whose wall is out of range, negative or degenerate is left out, as is one with a malformed position.
    """
    dx, dy, n = direction(*map(F.col, ("sx", "sy", "ex", "ey")), cfg.degenerate)
    w = solid_walls(walls, cfg).select("plan_id", "wall_index", "sx", "sy", "thickness", dx.alias("dx"), dy.alias("dy"), n.alias("length"))
    along = F.coalesce("along", (F.col("px") - F.col("sx")) * F.col("dx") + (F.col("py") - F.col("sy")) * F.col("dy"))
    return openings.where("not bad_position").join(w, ["plan_id", "wall_index"]).withColumn("along", along)


def rejected_openings(openings: DataFrame, walls: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The openings that opening_on_wall leaves out, with the reason."""
    seen = walls.select("plan_id", "wall_index", F.lit(True).alias("there"))
    fine = solid_walls(walls, cfg).select("plan_id", "wall_index", F.lit(True).alias("solid"))
    j = openings.join(seen, ["plan_id", "wall_index"], "left").join(fine, ["plan_id", "wall_index"], "left")
    why = F.when(F.col("bad_position"), "position").when(F.col("wall_index") < 0, "negative wall").when(F.col("there").isNull(), "no such wall").when(F.col("solid").isNull(), "degenerate wall")
    return j.withColumn("reason", why).where("reason is not null").drop("there", "solid")


def cutters(on_wall: DataFrame, wall_height: float = DEFAULT.wall_height, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, kind, opening_index, wall_index, name, centre, half extents, rotation, over_wall): boxes that cut openings out.

    Doors stand on the floor, windows on their sill; sideways a cutter goes margin thicknesses out. over_wall flags one
    that leaves its wall's length or height, which is kept as it is.
    """
    x, y = F.col("sx") + F.col("dx") * F.col("along"), F.col("sy") + F.col("dy") * F.col("along")
    z = F.col("sill") + F.col("height") / 2.0
    over = (F.col("along") - F.col("width") / 2 < 0) | (F.col("along") + F.col("width") / 2 > F.col("length")) | (F.col("sill") + F.col("height") > wall_height)
    name = F.concat(F.initcap("kind"), F.lit("Cutter_"), F.col("opening_index"))
    return on_wall.select("plan_id", "kind", "opening_index", "wall_index", name.alias("name"), x.alias("cx"), y.alias("cy"), z.alias("cz"), (F.col("width") / 2.0).alias("hx"), (F.col("thickness") * cfg.cutter_margin).alias("hy"), (F.col("height") / 2.0).alias("hz"), F.atan2("dy", "dx").alias("rotation"), over.alias("over_wall"))


def cut_walls(cut: DataFrame, prisms: DataFrame) -> DataFrame:
    """Cutters with the wall object of their wall's name; cut is false where there is none."""
    named = prisms.select("plan_id", F.col("name").alias("wall_name"), F.lit(True).alias("hit"))
    return cut.withColumn("wall_name", F.concat(F.lit("Wall_"), F.col("wall_index"))).join(named, ["plan_id", "wall_name"], "left").withColumn("cut", F.coalesce("hit", F.lit(False))).drop("hit")


#: Faults of a ring that leave no face to make. A ring that crosses itself or meets a point twice still has one.
NO_FACE = ("few points", "bad point", "no area")


def faced(rooms: DataFrame, reject: tuple[str, ...] = NO_FACE) -> DataFrame:
    """Rooms whose ring has none of the rejected faults; fault holds what else is wrong."""
    return rooms.withColumn("fault", ring_fault(F.col("polygon"))).where(~F.coalesce(F.col("fault").isin(*reject), F.lit(False)))


def slab(kind: Column, height: float = DEFAULT.wall_height) -> dict[str, Column]:
    """Name, type, vertices and faces of a room's floor at 0 or its ceiling, wound the other way, at wall height."""
    up = kind == "ceiling"
    z = F.when(up, float(height)).otherwise(0.0)
    v = F.transform("polygon", lambda p: vertex(F.get(p, F.lit(0)), F.get(p, F.lit(1)), z))
    ring = F.sequence(F.lit(0), F.size("polygon") - 1)
    return {"name": F.concat_ws("_", F.initcap(kind), "label", "room_index"), "type": kind, "vertices": v, "faces": F.array(F.when(up, F.reverse(ring)).otherwise(ring))}


def slabs(rooms: DataFrame, kinds: str | tuple[str, ...], height: float = DEFAULT.wall_height, reject: tuple[str, ...] = NO_FACE) -> DataFrame:
    """Floors at 0 or ceilings, wound the other way, at wall height, of rooms whose ring has none of the rejected faults.

    Names are of kind, label and place, so rooms of one label have names of their own. fault holds what else is wrong.
    Several kinds are made in one pass over the rooms, whose rings are looked at once.
    """
    kinds = (kinds,) if isinstance(kinds, str) else kinds
    found = faced(rooms, reject)
    if len(kinds) > 1:
        found = found.withColumn("__kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    s = slab(F.col("__kind") if len(kinds) > 1 else F.lit(kinds[0]), height)
    return found.select("plan_id", "room_index", s["name"].alias("name"), s["type"].alias("type"), "label", "fault", s["vertices"].alias("vertices"), s["faces"].alias("faces"))


def rejected_rooms(rooms: DataFrame, reject: tuple[str, ...] = NO_FACE) -> DataFrame:
    """(plan_id, room_index, label, reason, made): rooms with a faulty ring, and whether slabs are made of them all the same."""
    found = rooms.select("plan_id", "room_index", "label", ring_fault(F.col("polygon")).alias("reason")).where("reason is not null")
    return found.withColumn("made", ~F.col("reason").isin(*reject))


def room_label(cfg: Config = DEFAULT, exact: bool = True) -> dict[str, Column]:
    """Name, text and place of a room's label, at the mean of its vertices."""
    x, y = vertex_mean(F.col("polygon"))
    return {"name": F.concat_ws("_", F.lit("Label"), "label", "room_index"), "text": label_text(F.col("label"), exact), "x": x, "y": y, "z": F.lit(cfg.label_z), "size": F.lit(cfg.label_size)}


def room_labels(rooms: DataFrame, cfg: Config = DEFAULT, exact: bool = True) -> DataFrame:
    """(plan_id, room_index, name, text, x, y, z, size, area): at the mean of the vertices."""
    return rooms.where(F.size("polygon") >= 3).select("plan_id", "room_index", *[v.alias(k) for k, v in room_label(cfg, exact).items()], "area")


def materials(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """Colours by type of object, under the given names or else Wall, Floor and Ceiling."""
    return spark.createDataFrame([(k, (names or {}).get(k, k.title()), *v) for k, v in MATERIALS.items()], "type string, material string, r double, g double, b double, a double")


def with_materials(objects: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Objects with their type's material; null for types without one. The dimension has three rows."""
    return objects.join(F.broadcast(materials(objects.sparkSession, names)), "type", "left")


def adjust_height(objects: DataFrame, target: float, cfg: Config = DEFAULT) -> DataFrame:
    """scale_z of walls, from their original height, so that repeating it changes nothing; others keep 1."""
    original = F.coalesce("height", F.lit(cfg.wall_height))
    return objects.withColumn("scale_z", F.when(F.col("type") == "wall", F.lit(checked("wall_height", target)) / original).otherwise(1.0))


def build_scene(plans: DataFrame, wall_height: float = DEFAULT.wall_height, with_ceiling: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, name, type, source_index, wall_index, vertices, faces, text, area, height, n_cuts) of whole documents.

    Walls have their openings cut out; cutters aren't objects of the result, a wall counts those that cut it. Every part
    is keyed by plan_id.
    """
    checked("wall_height", wall_height)
    w, r = source.walls(plans, cfg), source.rooms(plans)
    o = source.openings(plans, "door", cfg).unionByName(source.openings(plans, "window", cfg))
    null = lambda t: F.lit(None).cast(t)
    cut = wall_difference(w, opening_on_wall(o, w, cfg), wall_height, cfg)
    walls = cut.select("plan_id", "name", F.lit("wall").alias("type"), F.col("wall_index").alias("source_index"), "wall_index", "vertices", "faces", null("string").alias("text"), null("double").alias("area"), "height", "n_cuts")
    # Floor, ceiling and label of a room come from one pass over the rooms; what isn't asked of an object isn't made.
    kinds = ("floor", "ceiling") if with_ceiling else ("floor",)
    r = r.withColumns({"fault": ring_fault(F.col("polygon")), "title": label_text(F.col("label"))})
    has_face = ~F.coalesce(F.col("fault").isin(*NO_FACE), F.lit(False))
    made = [*[F.when(has_face, F.lit(k)) for k in kinds], F.when(F.size("polygon") >= 3, F.lit("label"))]
    r = r.withColumn("type", F.explode(F.array_compact(F.array(*made))))
    s, label, is_label = slab(F.col("type"), wall_height), room_label(cfg), F.col("type") == "label"
    spot = F.array(vertex(label["x"], label["y"], label["z"]))
    vertices, faces = F.when(is_label, spot).otherwise(s["vertices"]), F.when(is_label, F.array().cast("array<array<int>>")).otherwise(s["faces"])
    flat = r.select("plan_id", s["name"].alias("name"), "type", F.col("room_index").alias("source_index"), null("int").alias("wall_index"), vertices.alias("vertices"), faces.alias("faces"), F.when(is_label, F.col("title")).alias("text"), F.when(is_label, F.col("area")).alias("area"), null("double").alias("height"), null("bigint").alias("n_cuts"))
    return walls.unionByName(flat)


def write_scene(objects: DataFrame, out: str) -> DataFrame:
    """Writes the objects in place of whatever scene stood under out, and reads them again."""
    objects.write.mode("overwrite").parquet(out)
    return objects.sparkSession.read.schema(objects.schema).parquet(out)


KINDS = ("wall", "door", "window", "floor", "ceiling", "label")


def counts(**made: Column) -> list[Column]:
    """walls, doors, ... as columns; what isn't given is 0."""
    return [F.coalesce(made.get(k, F.lit(0)), F.lit(0)).cast("long").alias(f"{k}s") for k in KINDS]


def with_summary(counted: DataFrame) -> DataFrame:
    """counted with summary, which leaves zeros out; plans of which nothing is made have no row.

    They go by a generator: a filter would be pushed down and carry all that is counted with it, over and over.
    """
    summary = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{k}s") > 0, F.concat(F.col(f"{k}s"), F.lit(f" {k}s"))) for k in KINDS])), ", ")
    one = F.array(F.struct(*[f"{k}s" for k in KINDS], summary.alias("summary")))
    return counted.select("plan_id", F.inline(F.filter(one, lambda c: c["summary"] != "")))


def scene_counts(plans: DataFrame, with_ceiling: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """(plan_id, walls, doors, windows, floors, ceilings, labels, summary): what build_scene() makes of each document that gives anything.

    Counted within the row, so nothing is shuffled: walls that aren't degenerate, openings whose wall is such a one and
    whose position isn't malformed, rings that have a face, and a label for each ring of three points or more.
    """
    at = lambda p, k: F.get(p, F.lit(k))
    solid = lambda w: direction(at(w["start"], 0), at(w["start"], 1), at(w["end"], 0), at(w["end"], 1), cfg.degenerate)[2] >= cfg.degenerate
    d = plans.withColumn("__solid", F.transform("walls", lambda w: F.coalesce(solid(w), F.lit(False))))

    def cut(part: str) -> Column:
        wall = lambda o: F.coalesce(o["wall_index"], F.lit(0))
        on = lambda o: (wall(o) >= 0) & F.coalesce(F.get("__solid", wall(o)), F.lit(False)) & ~source.bad_position(o["position"])
        return F.size(F.filter(part, on))

    d = d.withColumn("__faults", ring_list_faults(F.col("rooms.polygon")))
    floors = F.size(F.filter("__faults", lambda f: ~F.coalesce(f.isin(*NO_FACE), F.lit(False))))
    labels = F.size(F.filter("__faults", lambda f: F.coalesce(f != NO_FACE[0], F.lit(True))))
    made = {"wall": F.size(F.filter("__solid", lambda x: x)), "door": cut("doors"), "window": cut("windows"), "floor": floors, "label": labels}
    if with_ceiling:
        made["ceiling"] = floors
    return with_summary(d.select("plan_id", *counts(**made)))
