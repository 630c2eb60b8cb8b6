"""Queries on documents, files and streams: strict reading, places in an order, sinks, archives, settings, requests."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.text import PROMPTS, prompt
from ..model import CLASSES, configured
from ..operators import dataset, detect, scene
from ..operators.ranks import global_rank
from ..sources import archive, files, label_sink, plans
from ..sources.strict import strict_faults
from ..sources.svg import svg_report
from ..streaming.plans import read_scenes, stream_documents, write_scenes
from .queries import BOXES, FILES, WITH, boxes, document_rows, mm, mm_sql, query, walls_out

#: Documents around each event's properties, {"k": number}, and what is wrong with them.
FAULTY = [
    ("""'{"walls":[{"start":[0,0],"end":' || props || '}]}'""", [("$.walls[0].end", "type")]),
    ("""'{"walls":[{"start":[0,' || k || ']},{"start":[0,' || k || '],"end":[1,2],"note":null}]}'""", [("$.walls[0].end", "missing")]),
    ("""'{"walls":[{"start":[0,0],"end":[' || k || ',1],"thickness":null}],"doors":null}'""", [("$.walls[0].thickness", "null"), ("$.doors", "null")]),
    ("""'{"walls":[{"start":[0,0,' || k || '],"end":[1]}]}'""", [("$.walls[0].start", "length"), ("$.walls[0].end", "length")]),
    ("""'{"doors":[{"position":"' || k || '"},{"position":[1,"x"],"width":"w"},{"position":"x"}]}'""", [("$.doors[1].position", "type"), ("$.doors[1].width", "type"), ("$.doors[2].position", "type")]),
    ("""'{"rooms":[{"polygon":[[0,0],[1,null],[' || k || ']],"area":null}],"scale":{"pixels_per_meter":' || k || '}}'""", [("$.rooms[0].polygon[1]", "null"), ("$.rooms[0].polygon[2]", "length")]),
    ("""'{"walls":' || props || ',"rooms":[1,null,{"label":' || k || '}],"scale":1}'""", [("$.walls", "type"), ("$.rooms[0]", "type"), ("$.rooms[1]", "null"), ("$.rooms[2].label", "type"), ("$.scale", "type")]),
    ("""'{broken ' || k""", [("$", "not json")]),
    ("""'[' || props || ']'""", [("$", "type")]),
    ("""'{"walls":[{"start":[0,0],"end":[' || k || ',1.5]}],"windows":[{}],"rooms":[{"polygon":[[0,0],[1,1],[1e1,2]]}]}'""", []),
]
FOUND = " ".join(f"when {i} then [" + ", ".join("{'path': '%s', 'fault': '%s'}" % x for x in found) + "]" for i, (_, found) in enumerate(FAULTY) if found)


@query(f"select plan_id, f.path as path, f.fault as fault from (select event_id as plan_id, unnest(case event_id % 10 {FOUND} end) as f from events)")
def s1_strict_faults(spark, sf_dir):
    """Explicit nulls, missing keys, wrong types and wrong lengths, told apart and by their path."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    doc = F.lit(None).cast("string")
    for i, (text, _) in enumerate(FAULTY):
        doc = F.when(F.col("event_id") % 10 == i, F.expr(text)).otherwise(doc)
    return strict_faults(e.select(F.col("event_id").alias("plan_id"), doc.alias("doc")))


@query("select page_id, row_number() over (order by string_split(url, '/'), page_id) - 1 as rank from pages where url is not null")
def o1_path_rank(spark, sf_dir):
    """Each page's place in the order of paths."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select("page_id", dataset.path_parts(F.col("url")).alias("parts"))
    return global_rank(p, "parts", "page_id").select("page_id", "rank")


@query(f"with b as ({BOXES}), t as (select plan_id, string_agg(printf('%d %.6f %.6f 0.500000 0.250000', cls_id, ord % 8 / 8e0, ord % 4 / 4e0), chr(10) order by ord) as t from b where plan_id % 3 <> 0 group by plan_id) select case p.plan_id % 10 when 0 then 'test' when 1 then 'val' else 'train' end as split, 'p' || p.plan_id as name, coalesce(t, '') as content from (select distinct plan_id from b) p left join t on t.plan_id = p.plan_id")
def s9_label_files(spark, sf_dir):
    """A label file of each plan, written with one commit and read again from the folder."""
    b = boxes(spark, sf_dir).withColumn("name", F.concat(F.lit("p"), "plan_id"))
    k = F.col("plan_id") % 10
    samples = b.select("name", F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split")).distinct()
    labels = b.where("plan_id % 3 <> 0").select("name", F.col("ord").alias("seq"), "cls_id", (F.col("ord") % 8 / 8.0).alias("cx"), (F.col("ord") % 4 / 4.0).alias("cy"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))
    out = files.scratch(spark, "label-files")
    label_sink.write_label_files(files.label_lines(labels, samples), None, out)
    return label_sink.read_label_files(spark, out)


def opened(batches):
    """(entry, md5, size) of each piece of an archive, which with a directory of its own is an archive that the standard reader opens."""
    for batch in batches:
        rows = []
        for part in batch.columns[0].to_pylist():
            entry = part[30 : 30 + int.from_bytes(part[26:28], "little")].decode()
            directory = archive.directory_entry(entry, *(int.from_bytes(part[i : i + 4], "little") for i in (14, 22, 18)), 0)
            with zipfile.ZipFile(io.BytesIO(part + directory + archive.end_of(1, len(directory), len(part)))) as z:
                content = z.read(entry)
            rows.append((entry, hashlib.md5(content).hexdigest(), len(content)))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["entry", "md5", "size"])


@query(f"select 'code/p' || page_id || '/' || f as entry, md5(coalesce(html, '')) as md5, octet_length(encode(coalesce(html, ''))) as size from (select page_id, html, string_split({FILES}, '/')[-1] as f, {FILES} as path from pages) where not contains(path, '__pycache__') and not contains(path, '.pyc') and not contains(path, '.pyo') and not contains(path, '.DS_Store')")
def s13_archive(spark, sf_dir):
    """An archive of all pages as files, deflated in tasks; every entry is opened again."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("url", F.expr(FILES)).where("url is not null")
    path = F.concat(F.lit("/home/x/repo/p"), "page_id", F.lit("/"), F.when(F.col("url").contains("__pycache__"), "__pycache__/x").otherwise(F.substring_index("url", "/", -1)))
    pieces = archive.archive(p.select(path.alias("path"), F.col("html").cast("binary").alias("content")), "/home/x/repo/", "code")
    return pieces.where("place.kind = 0").select("part").mapInArrow(opened, "entry string, md5 string, size long")


@query(WITH + ", a as (select plan_id, 'wall' as type from w where plan_id % 3 <> 0 union all select plan_id, t from m, (select unnest(['floor', 'label']) as t) where cls_id = 3) select plan_id, type, count(*) as n from a group by plan_id, type")
def c1_stream_replaced(spark, sf_dir):
    """All documents as a stream, then those of every third plan again, without walls: each plan has the scene of its last one."""
    folder, out = files.scratch(spark, "documents"), files.scratch(spark, "scenes")
    docs = document_rows(spark, sf_dir)
    bare = F.concat(F.lit('{"rooms":'), F.coalesce(F.get_json_object("doc", "$.rooms"), F.lit("[]")), F.lit("}"))
    for part in (docs, docs.where("plan_id % 3 = 0").withColumn("doc", bare)):
        part.write.mode("append").parquet(folder)
        write_scenes(stream_documents(spark, folder), out, f"{out}-checkpoint", buckets=8).awaitTermination()
    schema = scene.build_scene(plans.parse_plans(docs, "plan_id", "doc")).schema
    return read_scenes(spark, out, schema).groupBy("plan_id", "type").agg(F.count("*").alias("n"))


@query("select p_partkey, case p_partkey % 5 when 1 then 6 when 2 then 9 else 5 end as n_walls, case p_partkey % 5 when 2 then 5 else 2 end as n_doors, case p_partkey % 5 when 1 then 125e-1 + 45e-1 + 3e0 when 2 then 80e0 else 24e0 end as area from part")
def s3_sample_requests(spark, sf_dir):
    """Requests for samples by name; unknown names and none get the apartment."""
    kind = F.get(F.array(*[F.lit(x) for x in ("apartment", "studio", "three_bedroom", "castle", None)]), (F.col("p_partkey") % 5).cast("int"))
    got = plans.sample_requests(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), kind)
    return got.select("p_partkey", F.size("walls").alias("n_walls"), F.size("doors").alias("n_doors"), F.aggregate("rooms", F.lit(0.0), lambda t, r: t + r["area"]).alias("area"))


@query(f"with b as ({BOXES}) select plan_id, count(*) as n_walls, cast(count(*) * 200 as bigint) as thickness_mm from b where conf >= 7e-1 and cls_id = 0 group by plan_id")
def s7_configured_walls(spark, sf_dir):
    """Walls by the settings of a file that is written and read; what it leaves out keeps its default."""
    out = files.scratch(spark, "config")
    text = "inference:\n  confidence_threshold: 0.7  # higher\n  device: auto\noutput: {default_wall_thickness: 0.2}\ntraining:\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(out)
    cfg = configured(files.load_config(spark, out))
    walls = detect.wall_segments(detect.to_metres(detect.confident(boxes(spark, sf_dir), cfg), cfg), cfg)
    return walls.groupBy("plan_id").agg(F.count("*").alias("n_walls"), F.sum(mm(F.col("thickness"))).alias("thickness_mm"))


@query(WITH + f"select plan_id, wall_index, {', '.join(f'{mm_sql(c)} as {c}_mm' for c in ('sx', 'sy', 'ex', 'ey'))} from w")
def s8_json_round_trip(spark, sf_dir):
    """Documents written by the JSON sink, each on a line, and read again."""
    out = files.scratch(spark, "json")
    files.json_documents(plans.parse_plans(document_rows(spark, sf_dir), "plan_id", "doc")).write.json(out)
    back = plans.parse_plans(spark.read.schema("plan_id long, json string").json(out), "plan_id", "json")
    return walls_out(plans.walls(back))


@query(f"with b as ({BOXES}), c as (select distinct cls_id from b) select concat_ws(chr(10), 'names:', string_agg('- ' || ['wall', 'door', 'window', 'room'][cls_id + 1], chr(10) order by cls_id), 'nc: ' || count(*), 'path: /out', 'test: images/test', 'train: images/train', 'val: images/val', '') as yaml from c")
def s10_manifest_of_classes(spark, sf_dir):
    """The description of a set with the classes that its boxes have."""
    found = {r.cls_id for r in boxes(spark, sf_dir).select("cls_id").distinct().collect()}  # no more than there are classes
    return spark.createDataFrame([(files.manifest("/out", [c for i, c in enumerate(CLASSES) if i in found]),)], "yaml string")


@query(WITH + ", p as (select plan_id, count(*) filter (cls_id = 0) as n_walls, count(*) filter (cls_id = 3) as n_rooms from m where cls_id in (0, 3) group by plan_id) select plan_id, case when plan_id % 5 = 0 or n_walls = 0 then null else n_walls end as n_walls, case when plan_id % 5 = 0 or n_rooms = 0 then null else n_rooms end as n_rooms, plan_id % 5 = 0 as corrupt from p")
def s1_document_files(spark, sf_dir):
    """A file of each document, every fifth cut off before its end."""
    out = files.scratch(spark, "plans")
    cut = F.when(F.col("plan_id") % 5 == 0, F.expr("left(doc, length(doc) - 1)")).otherwise(F.col("doc"))
    path = F.concat((F.col("plan_id") % 1000).cast("string"), F.lit("/"), F.col("plan_id"), F.lit(".json"))  # no folder of millions
    label_sink.write_files(document_rows(spark, sf_dir).select(path.alias("path"), cut.alias("content")), out)
    got = plans.read_documents(label_sink.read_files(spark, out))
    fine = F.col("_corrupt_record").isNull()
    sizes = [F.when(fine & F.col(c).isNotNull(), F.size(c)).cast("long").alias(f"n_{c}") for c in ("walls", "rooms")]
    return got.select(F.regexp_extract("plan_id", r"/([0-9]+)\.json$", 1).cast("long").alias("plan_id"), *sizes, (~fine).alias("corrupt"))


@query("select event_id, kind, md5(head || chr(10) || chr(10) || '{' || chr(10) || '  \"event_type\" : \"' || event_type || '\"' || chr(10) || '}' || chr(10) || chr(10) || case when kind in ('modification', 'ambiguity') then 'Request: ' || event_id || chr(10) || chr(10) else '' end || tail) as prompt_md5 from events, (values " + ", ".join(f"('{k}', '{h}', '{t}')" for k, (h, t) in PROMPTS.items()) + ") as t(kind, head, tail)")
def p24_prompt_kinds(spark, sf_dir):
    """All kinds of requests for each event, two of them with what is asked for."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    asked = lambda k: F.col("event_id").cast("string") if k in ("modification", "ambiguity") else None
    texts = [F.struct(F.lit(k).alias("kind"), F.md5(prompt(k, F.struct("event_type"), asked(k))).alias("prompt_md5")) for k in PROMPTS]
    return e.select("event_id", F.inline(F.array(*texts)))


@query("select cast(p_partkey as string) as name, cast(case p_partkey % 4 when 0 then 2 when 2 then 0 else 1 end as bigint) as n_boxes, cast(case p_partkey % 4 when 1 then 1 when 3 then 2 else 0 end as bigint) as n_rejected, p_partkey % 4 <> 2 as well_formed from part")
def s5_svg_rejects(spark, sf_dir):
    """Elements whose numbers aren't any are counted and left out, and so is a text that isn't XML."""
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    good = F.format_string('<rect x="%s" y=" 1e1 " width="3" height="4"/>', s)
    shapes = F.when(k == 0, F.concat(good, F.format_string('<line x1="-%s.5" y1="+9" x2="1" y2=".2"/>', s))).when(k == 1, F.concat(good, F.format_string('<rect x="%spx"/>', s))).when(k == 2, F.lit("<rect")).otherwise(F.concat(F.lit('<polygon points="1,1 2,x 3,3"/>'), good, F.lit('<line x1="" x2="1"/>')))
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g id="Wall">'), shapes, F.lit("</g></svg>")).alias("svg"))
    return svg_report(docs)


def strict_detector(path: str) -> list[dict]:
    """Stands in for a detector that can't open every image, and finds nothing in some."""
    if len(path) % 3 == 0:
        raise OSError(f"cannot open {len(path)}")
    return [{"cls_id": len(path) % 4, "conf": 0.5, "x1": 0.0, "y1": 0.0, "x2": float(len(path)), "y2": 1.0}] * (len(path) % 3 - 1)


@query("select page_id as plan_id, case when n % 3 = 0 then null else cast(0 as bigint) end as ord, case when n % 3 = 0 then null else cast(n as double) end as x2, case when n % 3 = 0 then 'OSError: cannot open ' || n end as error from (select page_id, length(url) as n from pages where url is not null) where n % 3 <> 1")
def s14_detector_errors(spark, sf_dir):
    """Images that fail have a row with the error, those without boxes none."""
    images = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select(F.col("page_id").alias("plan_id"), F.col("url").alias("path"))
    return detect.detect(images, strict_detector).select("plan_id", "ord", "x2", "error")
