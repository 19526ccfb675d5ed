"""Queries and SQL for catalogue work, sheets, bulk updates, metadata differences and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlake.functions import scalars
from provlake.operators import catalog, media_checks, metadata, rollups, rules, segments, upgrades

from . import program_sql
from .fixture import view, wide_edges, with_views


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _join(column, sep=","):
    return F.array_join(column, sep)


def q_pending(spark, d):
    done = _read(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("project_id"))
    return catalog.pending(view(spark, d, "journals"), done, "project_id").select("project_id")


def q_reduce(spark, d):
    listing = _read(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"))
    j = _read(spark, d, "orders").where("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").cast("timestamp").alias("updatetime"))
    return catalog.reduce_listing(listing, j, F.lit("1996-01-01").cast("timestamp"))


def q_cameras(spark, d):
    media = _read(spark, d, "part").selectExpr("p_partkey as file", "upper(p_brand) as make", "concat(p_type, '-X') as model", "if(p_size % 2 = 0, 'jpg', 'png') as format")
    cameras = _read(spark, d, "part").selectExpr("p_brand as make", "lower(split(p_type, ' ')[0]) as camera", "if(p_size % 3 = 0, 'jpg', 'png') as format", "p_size as width", "p_size % 7 as height").distinct()
    return catalog.camera_sizes(media, cameras).select("file", "camera", "width", "height")


def q_coco(spark, d):
    images = _read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    anns = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ann"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("double").alias("area"))
    return catalog.coco_subset(images, anns, 10, 12, 100).select("image_id", "ann", "part", "area")


def q_classes(spark, d):
    pixels = _read(spark, d, "part").selectExpr("p_partkey", "concat('[', p_size % 5, ', ', p_partkey % 3, ',  0]') as color")
    classes = _read(spark, d, "region").selectExpr("concat('[', r_regionkey, ',1,0]') as color", "r_name as class")
    return catalog.classify_color(pixels, classes).select("p_partkey", "class")


def q_given(spark, d):
    files = _read(spark, d, "supplier").select(F.col("s_name").alias("file"))
    given = _read(spark, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_name as file", "map('size', cast(s_nationkey as string), 'own', 'x') as arguments")
    out = catalog.fetch_arguments(files, given, {"size": "0", "mode": "fast"})
    return out.select("file", *(F.coalesce(F.try_element_at("arguments", F.lit(k)), F.lit("-")).alias(k) for k in ("size", "mode", "own")))


def q_missing(spark, d):
    refs = view(spark, d, "nodes").selectExpr("project_id", "node_id as owner", "case when node_id % 11 = 0 then '' else file end as file")
    return catalog.missing_files(refs, view(spark, d, "nodes").where("r % 4 > 0").select("file"))


def q_permute(spark, d):
    # Two dimensions of a few values each.
    lists = {c: [r[0] for r in _read(spark, d, t).select(c).distinct().orderBy(c).collect()] for t, c in (("region", "r_name"), ("customer", "c_mktsegment"))}
    chained = catalog.permute(lists, True, spark).withColumn("kind", F.lit("chained"))
    return chained.unionByName(catalog.permute({"r_name": lists["r_name"], "c_mktsegment": lists["c_mktsegment"][:3]}, False, spark).withColumn("kind", F.lit("together")))


def q_specs(spark, d):
    specs = _read(spark, d, "part").selectExpr("concat('p', p_partkey) as name", "case p_partkey % 4 when 0 then concat('int[1:', p_size, ':7]') when 1 then concat('float[0:', p_size, ':20.5]') when 2 then 'yesno' else concat('list:', p_brand, ',', p_size) end as spec")
    return catalog.spec_values(specs)


def q_qtable(spark, d):
    tables = _read(spark, d, "part").select(F.concat_ws("-", "p_name", "p_brand").alias("file"))
    return catalog.best_qtable(tables, ["green", "23", "lace"]).select("file", "hits")


def _exif(spark, d):
    return _read(spark, d, "part").selectExpr("concat('f', p_partkey, '.jpg') as file", "map('Make', p_brand, 'Model', if(p_size % 4 = 0, '-', p_type), 'Lens', if(p_size % 2 = 0, p_name, null)) as exif")


def q_exif(spark, d):
    out = catalog.exif_to_sheet(_exif(spark, d), {"CameraMake": "Make", "CameraModel": "Model", "LensModel": "Lens"})
    return out.select("file", *(F.coalesce(c, F.lit("")).alias(c) for c in ("CameraMake", "CameraModel", "LensModel")))


def q_sheet(spark, d):
    s = _read(spark, d, "part").selectExpr(
        "p_partkey as file", "case p_partkey % 4 when 0 then 'Primary' when 1 then 'secondary' when 2 then 'primary' else 'other' end as primary_secondary", "case p_size % 3 when 0 then 'Video' when 1 then 'image' else 'model' end as type",
        "case p_size % 5 when 0 then 'still' when 1 then null when 2 then '' else 'Pan' end as kinematics", "case p_size % 4 when 0 then '' when 1 then 'c1' else 'c2' end as collection", "if(p_partkey % 10 = 0, null, p_brand) as model",
        "case p_size % 6 when 0 then '' when 1 then null else concat('d', p_partkey % 9) end as local_id", "case p_partkey % 5 when 0 then 'TRUE' when 1 then 'false' when 2 then 'maybe' end as reflection",
    )
    models = _read(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_brand").alias("model"))
    local = _read(spark, d, "part").selectExpr("concat('d', p_partkey % 7) as local_id")
    return catalog.sheet_checks(s, models, ["pan", "zoom"], ["c1"], local, {"reflection": ("image", "model")})


def q_resolutions(spark, d):
    s = _read(spark, d, "part").selectExpr("p_partkey as file", "p_brand as device", "p_size as width", "p_partkey % 3 as height", "if(p_partkey % 2 = 0, 'primary', 'secondary') as camera")
    return catalog.resolution_checks(s, s.where("file % 5 = 0"))


def q_not_in_sheet(spark, d):
    return catalog.not_in_sheet(view(spark, d, "nodes").select("file"), view(spark, d, "nodes").where("node_id % 3 > 0").select("file"))


def q_keywords(spark, d):
    words = _read(spark, d, "lineitem").selectExpr("l_orderkey as file", "l_linenumber * 100000 + l_partkey as pos", "concat(l_returnflag, l_linestatus) as keyword").distinct()
    return catalog.keyword_rows(words, _read(spark, d, "lineitem").where("l_returnflag <> 'R'").selectExpr("concat(l_returnflag, l_linestatus) as keyword"))


def q_ingest(spark, d):
    s = _read(spark, d, "supplier").selectExpr("s_name as ImageFilename", "s_suppkey as OldID")
    return catalog.ingest_columns(s, {"OldID": "DeviceID", "Other": "Nothing"}, ["ImageFilename", "DeviceID", "Collection"], "2020-01-01")


def q_seeds(spark, d):
    images = _read(spark, d, "region").selectExpr("cast(r_regionkey as int) as pos", "r_name as file")
    log = _read(spark, d, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r_regionkey")), lambda x: F.concat(F.lit("made with seed: "), x * 7)), " then ").alias("log_text"))
    return catalog.attach_seeds(images, log)


def q_fixes(spark, d):
    fixes = ["0.3.1", "0.4.0", "0.4.1", "0.5.0"]
    j = _read(spark, d, "customer").selectExpr("c_custkey as project_id", "case c_custkey % 3 when 0 then array('0.3.1', '0.4.1') when 1 then array('0.3.1') else array() end as jt_upgrades")
    return catalog.needed_fixes(j, fixes)


def q_rename_ops(spark, d):
    defaults = spark.createDataFrame([("Stretch", {"purpose": "none", "direction": "up"})], "op string, arguments map<string,string>")
    e = catalog.rename_ops(wide_edges(spark, d), {"TimeWarp": "Stretch", "Blur": "Smooth"}, defaults)
    return e.select("project_id", "src", "dst", "op", *(F.coalesce(F.try_element_at("arguments", F.lit(k)), F.lit("-")).alias(k) for k in ("purpose", "direction")))


def q_flags(spark, d):
    e = view(spark, d, "edges").withColumn("recordMaskInComposite", F.expr("case dst % 4 when 0 then 'true' when 1 then 'Yes' when 2 then 'no' end"))
    return catalog.composite_flags(e, view(spark, d, "operations")).select("project_id", "src", "dst", "op", "recordMaskInComposite")


def q_rename_keys(spark, d):
    e = catalog.rename_keys(wide_edges(spark, d), "arguments", {"purpose": "Purpose", "voice": "Voice"})
    return e.select("project_id", "src", "dst", "op", _join(F.array_sort(F.map_keys("arguments"))).alias("keys"))


def q_rotation(spark, d):
    sizes = view(spark, d, "nodes").selectExpr("project_id", "node_id", "100 + 50 * (node_id % 2) as width", "if(node_id % 9 = 0, null, 150) as height")
    e = view(spark, d, "edges").selectExpr("project_id", "src", "dst", "if(op = 'OutputMp4', 'OutputTif', op) as op", "if(dst % 7 = 0, map('Image Rotated', 'no'), null) as arguments", "case dst % 5 when 0 then '(0, 0)' when 1 then '(50,-50)' when 2 then '' end as shape_change")
    return catalog.rotation_flag(e, sizes).select("project_id", "src", "dst", "op", F.coalesce(F.try_element_at("arguments", F.lit("Image Rotated")), F.lit("-")).alias("rotated"))


def q_replace(spark, d):
    return catalog.replace_value(view(spark, d, "journals"), "projecttype", "VIDEO", "film")


def q_backfill(spark, d):
    s = view(spark, d, "segments").selectExpr(
        "set_id", "seg_no", "if(set_id % 2 = 0, 'AddAudio', 'Blur') as op", "if(seg_no % 3 = 0, null, type) as type", "case seg_no % 4 when 0 then -0.03D when 1 then 30D end as rate", "if(seg_no % 4 >= 2, array(30D, 1D), null) as rates",
        "startframe", "if(seg_no % 5 = 0, null, endframe) as endframe", "cast(null as double) as starttime", "if(seg_no % 5 = 0, (endframe - 1) * 1000 / 30D, null) as endtime", "seg_no % 2 = 0 as has_end", "error",
    )
    streams = view(spark, d, "segments").where("set_id % 3 > 0").groupBy("set_id", "type").agg((F.max("endframe") + F.pmod("set_id", F.lit(3)) - 1).alias("endframe"))
    out = catalog.backfill_segments(s, streams)
    return out.select("set_id", "seg_no", "type", F.round("rate", 4).alias("rate"), "startframe", "endframe", "frames", F.round("starttime", 4).alias("starttime"), F.round("endtime", 4).alias("endtime"), F.round("error", 4).alias("error"))


def q_plain_times(spark, d):
    e = _read(spark, d, "orders").selectExpr("o_orderkey", "map('Start Time', concat('00:0', o_custkey % 10, ':10:', o_orderkey % 30), 'End Time', '00:01:00', 'note', '1:2:3:4') as arguments")
    out = catalog.plain_times(e, ["Start Time", "End Time"])
    return out.select("o_orderkey", *(F.element_at("arguments", k).alias(k.lower().replace(" ", "_")) for k in ("Start Time", "End Time", "note")))


def q_md5(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.concat(F.lit("a.b/d"), "doc_id", F.lit(".Txt")).alias("file"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return catalog.named_by_md5(catalog.file_md5(docs)).select("doc_id", "md5", "new_file")


def q_list_check(spark, d):
    n = view(spark, d, "nodes")
    return catalog.list_check(n.where("node_id % 4 > 0").select("file"), n.where("node_id % 5 > 0").select("file"))


def q_empty_masks(spark, d):
    ops = view(spark, d, "operations").withColumn("rule", F.expr("case when op in ('Blur', 'DeleteFrames') then 'checkEmpty' else rule end"))
    return catalog.empty_mask_edges(view(spark, d, "wide"), ops)


def q_streams(spark, d):
    s = view(spark, d, "nodes").selectExpr("project_id as file", "r as stream_pos", "if(node_id % 3 = 0, 'video', 'audio') as codec_type", "case node_id % 4 when 0 then 'mono' when 1 then 'stereo' end as channel_layout")
    return metadata.stream_ids(s).select("file", "stream_pos", "stream")


def _maps(spark, d, extra):
    return view(spark, d, "frames").selectExpr("media_id", "event_type as stream", f"frame_no * 40 + {extra} as time_ms", "map_filter(map('k', get_json_object(props, '$.k'), 'c', if(changed, 'yes', null)), (k, v) -> v is not null) as meta", "frame_no")


def q_stream_diff(spark, d):
    """The last frame of a stream in either half of a medium's frames, told by odd and even numbers."""
    one, two = (_maps(spark, d, "0").where(f"frame_no % 2 = {k}").groupBy(F.col("media_id").alias("file"), "stream").agg(F.max_by("meta", "frame_no").alias("meta")) for k in (0, 1))
    return metadata.diff_rows(metadata.stream_diff(one, two), "diff")


def q_packets(spark, d):
    one = _maps(spark, d, "0").where("frame_no % 5 > 0")
    two = _maps(spark, d, "if(frame_no % 3 = 0, 15, if(frame_no % 11 = 0, 40, 0))").where("frame_no % 7 > 0")
    a, b = (x.groupBy("media_id", F.lit("video").alias("stream"), "time_ms").agg(F.max_by("meta", "frame_no").alias("meta")) for x in (one, two))
    out = metadata.packet_diff(a, b, 20.0)
    return out.groupBy("media_id", "action").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum(F.coalesce(F.size("diff"), F.lit(0))).alias("keys"), F.sum("time_ms").cast("long").alias("at"))


def q_rates(spark, d):
    entry = "named_struct('action', 'change', 'old', cast({} as string), 'new', cast({} as string))"
    e = view(spark, d, "edges").withColumn("metadatadiff", F.expr(f"map_filter(map('nb_frames', {entry.format('src % 100', 'dst % 100')}, 'duration', if(src % 2 = 0, {entry.format('src % 9', 'dst % 9')}, null), 'r_frame_rate', if(dst % 3 = 0, {entry.format('29', '30')}, null)), (k, v) -> v is not null)"))
    cols = ("old_frames", "new_frames", "old_ms", "new_ms", "rate")
    return metadata.rate_change(e).select("project_id", "src", "dst", "op", *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in cols))


def q_frame_rates(spark, d):
    p = _read(spark, d, "part").selectExpr("p_partkey", "case p_size % 3 when 0 then '0/0' when 1 then concat(p_size, '/2') else 'x' end as a", "concat(p_partkey, '/', p_size % 4) as r")
    return p.select("p_partkey", F.coalesce(F.round(scalars.frame_rate(F.col("a"), F.col("r")), 4), F.lit(-1.0)).alias("rate"))


def q_scalars(spark, d):
    p = _read(spark, d, "part").withColumns({"t": F.expr("concat('0', p_size % 10, ':', lpad(p_size, 2, '0'), ':0', p_partkey % 10, if(p_partkey % 3 = 0, ':12', ''))"), "c": F.expr("concat('(', p_size, ', ', p_partkey % 9, if(p_partkey % 4 = 0, '', ')'))"), "v": F.expr("concat('v', p_size, '.', p_partkey % 7, '.3')")})
    return p.select(
        "p_partkey", scalars.valid_time(F.col("t")).alias("is_time"), scalars.valid_coordinates(F.col("c")).alias("is_place"), scalars.valid_coordinates(F.concat("c", F.lit("x"))).alias("is_not"), _join(F.transform(scalars.ints(F.col("c")), lambda x: x.cast("string"))).alias("ints"),
        scalars.short_name(F.col("p_name"), F.col("p_brand")).alias("short"), scalars.version_stem(F.col("v")).alias("version"),
    )


def q_paths(spark, d):
    nested = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), F.when(F.col("l_partkey") % 2 == 0, "s").alias("flag")))).alias("masks"))
    e = nested.select("l_orderkey", F.struct("masks", F.create_map(F.lit("a"), F.struct(F.lit("x").alias("v")), F.lit("b"), F.struct(F.lit("").alias("v"))).alias("named")).alias("e"))
    return e.select("l_orderkey", scalars.path_value(F.col("e"), "masks[0].q", -1).alias("first"), scalars.path_value(F.col("e"), "masks[40].q", -1).alias("none"), F.size(scalars.path_values(F.col("e"), "masks[].flag")).alias("n_flags"), _join(scalars.path_values(F.col("e"), "named.*.v")).alias("named"))


def q_packet_summary(spark, d):
    f = view(spark, d, "frames").selectExpr("event_type as stream", "'value' as key", "cast(floor(intensity * 100) as bigint) as delta")
    return rollups.packet_summary(f)


def q_work(spark, d):
    w = _read(spark, d, "lineitem").selectExpr("l_orderkey as project_id", "concat('u', l_suppkey) as url", "concat('f', l_partkey) as file")
    return rollups.group_work(w).select("project_id", "n", _join(F.transform("items", lambda x: F.concat_ws("/", x.url, x.file))).alias("items"))


def q_recalc(spark, d):
    s = view(spark, d, "segments").selectExpr("set_id", "seg_no", "startframe * 17.5D as starttime", "endframe * 17.5D as endtime", "rate", "startframe", "endframe")
    a = segments.recalc_frames(s).select("set_id", "seg_no", "startframe", "endframe", "frames")
    b = segments.recalc_times(s).select("set_id", "seg_no", F.round("starttime", 4).alias("starttime"), F.round("endtime", 4).alias("endtime"))
    return a.join(b, ["set_id", "seg_no"])


def q_upgraded(spark, d):
    """Journals of four ages; operations and arguments by old names."""
    j = view(spark, d, "journals").withColumn("jt_upgrades", F.expr("case project_id % 4 when 1 then array('04.0810.9381e76724') when 2 then array('x', '0.5.0918.b14aff2910') when 3 then array('0.6.0531.ce60889744') end"))
    names = "array('ColorBlendDissolve', 'SelectRemoveFromFrames', 'TransformContentAwareScale', 'BlurMotion', 'ColorColorBalance', 'OutputPng', 'AudioPan', 'TransformSeamCarving')"
    times = "map('Insertion Start Time', concat('00:00:', 10 + src % 50, ':', dst % 30), 'Left', cast(dst as string), 'Blur Type', if(src % 2 = 0, 'Motion', 'Gaussian'))"
    e = view(spark, d, "wide").withColumns({
        "op": F.expr(f"element_at({names}, cast(dst % 8 as int) + 1)"), "arguments": F.expr(f"map_filter({times}, (k, v) -> k <> 'Left' or src % 3 = 0)"), "filetype": F.col("media_type"), "rate": F.expr("if(src % 5 > 0, 25D, null)"),
        "description": F.expr("case dst % 3 when 0 then concat('angle ', 10 + dst % 80, ' and distance ', 1 + src % 50) when 1 then concat('a radius of ', dst % 10, ' pixels') end"), "recordMaskInComposite": F.expr("if(dst % 2 = 0, 'true', 'no')"),
        "global": F.expr("if(src % 2 = 0, 'yes', 'no')"), "change_category": F.lit("large"), "change_ratio": F.expr("cast(dst % 10 as double) / 10"), "mask_pixels": F.expr("cast(1000 * (src % 20) as bigint)"),
        "softwareName": F.expr("if(dst % 4 = 0, if(dst % 8 = 0, '', 'No Software'), software)"), "category": F.expr("if(dst % 8 = 5, 'Output', 'Other')"), "flatdiff": F.expr("if(dst % 2 = 0, map('0:codec', cast(src as string), '1:rate', cast(dst as string), 'x', 'y'), null)"),
    })
    out = upgrades.upgraded(e.select("project_id", "src", "dst", *(c for c in upgrades.COLUMNS if c in e.columns)), j)
    arg = lambda k, name: F.coalesce(F.try_element_at("arguments", F.lit(k)), F.lit("-")).alias(name)
    return out.select(
        "project_id", "src", "dst", "op", arg("mode", "mode"), arg("Start Time", "start"), arg("Left Pan", "pan"), arg("purpose", "purpose"), arg("inputmasktype", "masktype"), arg("Blur Radius", "radius"), arg("Blur Angle", "angle"), arg("Lens Distortion Applied", "lens"),
        "recordMaskInComposite", F.col("global").alias("widely"), "change_category", F.coalesce("softwareName", F.lit("-")).alias("software"), F.coalesce(F.try_element_at("metadatadiff", F.lit("1"))["rate"], F.lit("-")).alias("rate"), F.coalesce(F.size("applied"), F.lit(0)).alias("fixes"),
    )


def q_frame_ops(spark, d):
    """Every frame operation, on video and on sound, both ways."""
    names = "array('DeleteFrames', 'InsertFrames', 'PasteFrames', 'Blur', 'CopyPaste', 'CropFrames', 'Reverse', 'AddAudio', 'DeleteAudio', 'ReplaceAudio', 'OutputMp4')"
    b = view(spark, d, "bounds").withColumns({
        "op": F.expr(f"element_at({names}, cast(set_id % 11 as int) + 1)"), "media_type": F.expr("if(set_id % 5 = 0, 'audio', 'video')"), "add_type": F.expr("element_at(array('insert', 'overlay', null), cast(set_id % 3 as int) + 1)"),
        "to_start": 10 + F.col("set_id") % 40, "to_end": 10 + F.col("set_id") % 40 + F.col("endframe") - F.col("startframe"), "from_frames": 200 + F.col("set_id") % 100, "to_frames": 150 + F.col("set_id") % 130,
    })
    s = view(spark, d, "segments")
    out = segments.apply_frame_op(s, b).withColumn("side", F.lit("target")).unionByName(segments.apply_frame_op(s, b, donor=True).withColumn("side", F.lit("donor")))
    return out.select("side", "set_id", "seg_no", "type", "startframe", "endframe")


def _masks(spark, d):
    return view(spark, d, "frames").selectExpr("media_id as segment_id", "frame_no", "frame_no * 40D as time_ms")


def q_mask_at(spark, d):
    return segments.mask_at(_masks(spark, d), F.pmod("segment_id", F.lit(9)) * 150.0).select("segment_id", "frame_no", "time_ms")


def q_resample(spark, d):
    n = _masks(spark, d).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).withColumn("frames", F.expr("case segment_id % 3 when 0 then n * 2 when 1 then cast(n / 2 as bigint) + 1 else n + 5 end"))
    return segments.resample_mask_frames(_masks(spark, d), n.select("segment_id", "frames")).select("segment_id", "frame_no", "new_no")


def q_dictionary(spark, d):
    """R3 with recorded errors and software that is not approved."""
    e = wide_edges(spark, d).withColumns({"errors": F.expr("case when dst % 6 = 1 then array('lost', concat('e', src % 3)) when dst % 6 = 2 then array() end"), "softwareVersion": F.expr("concat(src % 3, '.0')"), "softwareName": F.expr("if(dst % 9 = 0, null, softwareName)")})
    return rules.edge_dictionary_rules(e, view(spark, d, "operations").where("category <> 'Audio'"), _software(spark, d))


def _software(spark, d):
    return view(spark, d, "wide").selectExpr("software as name", "concat(src % 2, '.0') as version").distinct()


def q_approvals(spark, d):
    e = wide_edges(spark, d).withColumn("softwareVersion", F.expr("case src % 4 when 0 then concat('CC 20', src % 30, ' x') else concat('v', src % 3, '.0.', dst % 5) end"))
    mapping = view(spark, d, "wide").selectExpr("software as name", "concat('20', src % 10) as found", "concat(src % 2, '.0') as version").groupBy("name", "found").agg(F.min("version").alias("version"))
    return rules.version_approvals(e, _software(spark, d), mapping).select("project_id", "src", "dst", "op", "approved")


def q_dimensions(spark, d):
    p = _read(spark, d, "part").selectExpr(
        "p_partkey",
        "map_filter(map('Image Width', cast(p_size as string), 'Image Height', if(p_size % 5 = 0, 'x', cast(p_partkey % 9 as string)), 'Exif Image Width', if(p_size % 2 = 0, cast(p_size * 2 as string), null), 'Exif Image Height', '7', 'AF Image Width', if(p_size % 3 = 0, '5', null), 'AF Image Height', cast(p_partkey % 4 as string), 'Cropped Image Height', '3', 'png:IHDR.width,height', if(p_size % 7 = 0, concat(p_size, ', 4'), null)), (k, v) -> v is not null) as exif",
    )
    text = lambda crop: _join(F.transform(scalars.exif_dimensions(F.col("exif"), crop), lambda s: F.concat_ws(" x ", s.height, s.width)), ";")
    return p.select("p_partkey", text(False).alias("sizes"), text(True).alias("cropped"))


def q_homography(spark, d):
    e = view(spark, d, "wide").selectExpr("project_id", "src", "dst", "op", "100 as src_w", "50 as src_h", "case dst % 5 when 0 then null when 1 then array(array(1D, 0D), array(0D, 1D)) else array(array(cast(src % 3 as double) - 0.5D, 0D, 5D), array(0D, 1D, 0D), array(if(dst % 4 = 0, -0.02D, 0D), 0D, 1D)) end as homography")
    return media_checks.homography_rules(e)


def q_png(spark, d):
    e = view(spark, d, "edges").selectExpr("project_id", "src", "dst", "op", "100 + src % 3 as src_w", "200 + src % 9 as src_h", "if(dst % 2 = 0, 101, 202) as dst_w", "if(dst % 2 = 0, 202, 101) as dst_h")
    return media_checks.png_size_rules(e)


QUERIES = {
    "dictionary_errors": q_dictionary, "version_approvals": q_approvals, "exif_dimensions": q_dimensions, "homography_rules": q_homography, "png_size": q_png,
    "pending_journals": q_pending, "reduce_listing": q_reduce, "camera_sizes": q_cameras, "coco_subset": q_coco, "color_classes": q_classes, "given_arguments": q_given, "missing_files": q_missing, "permutations": q_permute,
    "spec_values": q_specs, "best_qtable": q_qtable, "exif_sheet": q_exif, "sheet_checks": q_sheet, "resolution_checks": q_resolutions, "not_in_sheet": q_not_in_sheet, "keyword_rows": q_keywords, "ingest_columns": q_ingest,
    "attached_seeds": q_seeds, "needed_fixes": q_fixes, "rename_ops": q_rename_ops, "journal_flags": q_flags, "rename_keys": q_rename_keys, "rotation_flags": q_rotation, "replace_value": q_replace, "backfill_segments": q_backfill,
    "plain_times": q_plain_times, "md5_names": q_md5, "list_check": q_list_check, "empty_mask_edges": q_empty_masks, "stream_ids": q_streams, "stream_diff": q_stream_diff, "packet_diff": q_packets, "rate_change": q_rates,
    "frame_rates": q_frame_rates, "text_scalars": q_scalars, "nested_paths": q_paths, "packet_summary": q_packet_summary, "group_work": q_work, "recalculated": q_recalc, "frame_ops": q_frame_ops, "upgraded_journals": q_upgraded, "mask_at": q_mask_at, "resampled_masks": q_resample,
}

_N, _F, _SB = with_views("nodes"), with_views("frames"), with_views("segments", "bounds")
_PASTE = "(CASE WHEN dst % 10 = 0 THEN 1 END)"


def _cut(op: str, cond: str, left: str, right: str) -> str:
    return f"WHEN {cond} THEN [{left}, {right}]"


_KIND = "(" + program_sql.verb("['DeleteFrames', 'InsertFrames', 'PasteFrames', 'Blur', 'CopyPaste', 'CropFrames', 'Reverse', 'AddAudio', 'DeleteAudio', 'ReplaceAudio', 'OutputMp4'][s.set_id % 11 + 1]", "CASE WHEN s.set_id % 5 = 0 THEN 'audio' ELSE 'video' END", "['insert', 'overlay', NULL][s.set_id % 3 + 1]", "s.type") + ")"
_MOVED = lambda back: program_sql.parts("v", back, "seg_no", "startframe", "endframe", "b", "e", "n", "(10 + set_id % 40)", "(10 + set_id % 40 + e - b)", "(200 + set_id % 100)", "(150 + set_id % 130)")
_OPS = f"""j AS (SELECT s.*, {_KIND} AS v, b.startframe AS b, b.endframe AS e, b.endframe - b.startframe + 1 AS n FROM segments s JOIN bounds b ON b.set_id = s.set_id),
p AS (SELECT 'target' AS side, set_id, type, unnest({_MOVED(False)}) AS p FROM j UNION ALL SELECT 'donor', set_id, type, unnest({_MOVED(True)}) FROM j)"""
_META = "map_from_entries(list_filter([{'k': 'k', 'v': json_extract_string(props, '$.k')}, {'k': 'c', 'v': CASE WHEN changed THEN 'yes' END}], lambda x: x.v IS NOT NULL))"

_MSG = 'project_id, {} AS severity, src AS start, dst AS "end", \'{}\' AS module, {} AS message'
_H = "(src % 3 - 0.5)"

ORACLES = {
    "dictionary_errors": f"""{with_views('wide', 'operations')}, sw AS (SELECT DISTINCT software, src % 2 AS v FROM wide), o AS (SELECT op FROM operations WHERE category <> 'Audio')
SELECT {_MSG.format(3, 'dictionary', "concat('unknown operation ', op)")} FROM wide WHERE op NOT IN (SELECT op FROM o) UNION ALL SELECT {_MSG.format(3, 'dictionary', "concat('recorded: lost; e', src % 3)")} FROM wide WHERE dst % 6 = 1
UNION ALL SELECT {_MSG.format(2, 'dictionary', "'version is not approved'")} FROM wide w WHERE dst % 9 > 0 AND NOT EXISTS (SELECT 1 FROM sw WHERE sw.software = w.software AND sw.v = w.src % 3)""",
    "version_approvals": f"""{with_views('wide')}, sw AS (SELECT DISTINCT software, concat(src % 2, '.0') AS v FROM wide), mp AS (SELECT software, concat('20', src % 10) AS found, min(concat(src % 2, '.0')) AS v FROM wide GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER () AS rn, CASE src % 4 WHEN 0 THEN concat('CC 20', src % 30, ' x') ELSE concat('v', src % 3, '.0.', dst % 5) END AS t FROM wide),
b AS (SELECT x.*, (SELECT arg_min(mp.v, mp.found) FROM mp WHERE mp.software = x.software AND contains(x.t, mp.found)) AS m, CASE src % 4 WHEN 0 THEN concat('20', src % 30) ELSE concat(src % 3, '.0') END AS own FROM x)
SELECT project_id, src, dst, op, EXISTS (SELECT 1 FROM sw WHERE sw.software = b.software AND sw.v = coalesce(b.m, b.own)) AS approved FROM b""",
    "exif_dimensions": """WITH x AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat(p_partkey % 4, ' x 5') END AS af, CASE WHEN p_size % 5 > 0 THEN concat(p_partkey % 9, ' x ', p_size) END AS own, CASE WHEN p_size % 2 = 0 THEN concat('7 x ', p_size * 2) END AS exif, CASE WHEN p_size % 7 = 0 THEN concat('4 x ', p_size) END AS png FROM part)
SELECT p_partkey, concat_ws(';', own, exif, png) AS sizes, concat_ws(';', af, own, exif, png) AS cropped FROM x""",
    "homography_rules": f"""{with_views('wide')} SELECT {_MSG.format(3, 'homography', "'homography is not three by three'")} FROM wide WHERE dst % 5 = 1 UNION ALL SELECT {_MSG.format(3, 'homography', "'homography mirrors or flattens the image'")} FROM wide WHERE dst % 5 > 1 AND {_H} + CASE WHEN dst % 4 = 0 THEN 0.1 ELSE 0 END <= 0
UNION ALL SELECT {_MSG.format(2, 'homography', "'homography carries a corner behind the image'")} FROM wide WHERE dst % 5 > 1 AND dst % 4 = 0""",
    "png_size": f"""{with_views('edges')}, x AS (SELECT *, 100 + src % 3 AS a, 200 + src % 9 AS b FROM edges WHERE op = 'OutputPng') SELECT {_MSG.format(3, 'png_size', "'size of the image has changed by more than the border of a raw picture'")} FROM x WHERE NOT (abs(a - 101) <= 0.01 * a AND abs(b - 202) <= 0.01 * b)""",
    "pending_journals": f"{with_views('journals')} SELECT project_id FROM journals WHERE project_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)",
    "reduce_listing": "SELECT o_orderkey AS project_id, CASE WHEN o_custkey % 3 = 0 THEN 'missing' ELSE 'old' END AS status FROM orders WHERE o_custkey % 3 = 0 OR o_orderdate::TIMESTAMP < '1996-01-01'",
    "camera_sizes": """WITH c AS (SELECT DISTINCT p_brand AS make, lower(split_part(p_type, ' ', 1)) AS camera, CASE WHEN p_size % 3 = 0 THEN 'jpg' ELSE 'png' END AS format, p_size AS width, p_size % 7 AS height FROM part)
SELECT p_partkey AS file, camera, width, height FROM part JOIN c ON lower(c.make) = lower(p_brand) AND contains(lower(p_type || '-X'), camera) AND c.format = CASE WHEN p_size % 2 = 0 THEN 'jpg' ELSE 'png' END""",
    "coco_subset": "SELECT l_orderkey AS image_id, l_linenumber AS ann, l_partkey AS part, l_quantity::DOUBLE AS area FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity BETWEEN 10 AND 12 ORDER BY 1 LIMIT 100)",
    "color_classes": "SELECT p_partkey, coalesce(r_name, 'other') AS class FROM part LEFT JOIN region ON r_regionkey = p_size % 5 AND p_partkey % 3 = 1",
    "given_arguments": "SELECT s_name AS file, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE '0' END AS size, 'fast' AS mode, CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '-' END AS own FROM supplier",
    "missing_files": f"{_N} SELECT project_id, node_id AS owner, file FROM nodes WHERE node_id % 11 > 0 AND r % 4 = 0",
    "permutations": """WITH s AS (SELECT DISTINCT c_mktsegment FROM customer), a AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region), b AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS j, count(*) OVER () AS n FROM s)
SELECT a.i * b.n + b.j AS row_no, r_name, c_mktsegment, 'chained' AS kind FROM a CROSS JOIN b UNION ALL SELECT i, r_name, c_mktsegment, 'together' FROM a JOIN b ON b.j = a.i % 3""",
    "spec_values": """SELECT concat('p', p_partkey) AS name, i::INT AS pos, CASE p_partkey % 4 WHEN 0 THEN (1 + i * 7)::VARCHAR WHEN 1 THEN (i * 20.5)::DOUBLE::VARCHAR WHEN 2 THEN CASE i WHEN 0 THEN 'yes' ELSE 'no' END ELSE CASE i WHEN 0 THEN p_brand ELSE p_size::VARCHAR END END AS value
FROM (SELECT *, unnest(generate_series(0, CASE p_partkey % 4 WHEN 0 THEN (p_size - 1) // 7 WHEN 1 THEN ceil(p_size / 20.5)::BIGINT - 1 ELSE 1 END)) AS i FROM part)""",
    "best_qtable": """SELECT p_name || '-' || p_brand AS file, (contains(lower(p_name || '-' || p_brand), 'green'))::INT + (contains(p_name || '-' || p_brand, '23'))::INT + (contains(lower(p_name || '-' || p_brand), 'lace'))::INT AS hits FROM part
ORDER BY hits DESC, length(file), file LIMIT 1""",
    "exif_sheet": """SELECT concat('f', p_partkey, '.jpg') AS file, p_brand AS "CameraMake", CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS "CameraModel", CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS "LensModel" FROM part""",
    "sheet_checks": """SELECT p_partkey AS file, 'primary/secondary' AS problem FROM part WHERE p_partkey % 4 IN (0, 3)
UNION ALL SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'kinematics' ELSE 'no kinematics' END FROM part WHERE p_size % 3 = 0 AND p_size % 5 < 3
UNION ALL SELECT p_partkey, 'collection' FROM part WHERE p_size % 4 > 1 UNION ALL SELECT p_partkey, 'no model' FROM part WHERE p_partkey % 10 = 0 AND p_size % 3 < 2
UNION ALL SELECT p_partkey, 'model' FROM part WHERE p_partkey % 10 > 0 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 3 = 0)
UNION ALL SELECT p_partkey, 'no local id' FROM part WHERE p_size % 6 < 2 UNION ALL SELECT p_partkey, 'local id' FROM part WHERE p_size % 6 > 1 AND p_partkey % 9 > 6
UNION ALL SELECT p_partkey, 'reflection' FROM part WHERE p_size % 3 > 0 AND p_partkey % 5 > 1""",
    "resolution_checks": """WITH s AS (SELECT p_partkey AS file, p_brand AS device, p_size AS width, p_partkey % 3 AS height, p_partkey % 2 AS camera FROM part)
SELECT a.file, CASE WHEN NOT EXISTS (SELECT 1 FROM s b WHERE b.file % 5 = 0 AND b.device = a.device AND b.width = a.width AND b.height = a.height) THEN 'new resolution' ELSE 'opposite camera' END AS problem FROM s a
WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.file % 5 = 0 AND b.device = a.device AND b.width = a.width AND b.height = a.height AND b.camera = a.camera)""",
    "not_in_sheet": f"{_N} SELECT file FROM nodes WHERE node_id % 3 = 0",
    "keyword_rows": """WITH w AS (SELECT DISTINCT l_orderkey AS file, l_linenumber * 100000 + l_partkey AS pos, l_returnflag || l_linestatus AS keyword FROM lineitem), v AS (SELECT DISTINCT l_returnflag || l_linestatus AS keyword FROM lineitem WHERE l_returnflag <> 'R')
SELECT file, string_agg(w.keyword, chr(9) ORDER BY pos, w.keyword) AS keywords, count(*) FILTER (v.keyword IS NULL) AS n_bad FROM w LEFT JOIN v ON v.keyword = w.keyword GROUP BY 1""",
    "ingest_columns": """SELECT s_name AS "ImageFilename", s_suppkey AS "DeviceID", '' AS "Collection", '2020-01-01' AS "ImportDate" FROM supplier""",
    "attached_seeds": "SELECT r_regionkey::INT AS pos, r_name AS file, (r_regionkey * 7)::VARCHAR AS seed FROM region",
    "needed_fixes": """SELECT project_id, i::INT AS pos, f[k + i + 1] AS fix FROM (SELECT *, unnest(generate_series(0, 3 - k)) AS i FROM (SELECT c_custkey AS project_id, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS k, ['0.3.1', '0.4.0', '0.4.1', '0.5.0'] AS f FROM customer))""",
    "rename_ops": f"""{with_views('wide')} SELECT project_id, src, dst, CASE op WHEN 'TimeWarp' THEN 'Stretch' WHEN 'Blur' THEN 'Smooth' ELSE op END AS op, coalesce(purpose, CASE WHEN op = 'TimeWarp' THEN 'none' END, '-') AS purpose, CASE WHEN op = 'TimeWarp' THEN 'up' ELSE '-' END AS direction FROM wide""",
    "journal_flags": f"{with_views('edges', 'operations')} SELECT project_id, src, dst, e.op, CASE WHEN category <> 'Output' AND dst % 4 < 2 THEN 'yes' ELSE 'no' END AS \"recordMaskInComposite\" FROM edges e JOIN operations o ON o.op = e.op",
    "rename_keys": f"""{with_views('wide')} SELECT project_id, src, dst, op, concat_ws(',', CASE WHEN blur_type IS NOT NULL THEN 'Blur Type' END, CASE WHEN direct IS NOT NULL THEN 'Direct from PC' END, CASE WHEN purpose IS NOT NULL THEN 'Purpose' END, CASE WHEN voice IS NOT NULL THEN 'Voice' END,
  CASE WHEN add_type IS NOT NULL THEN 'add type' END, CASE WHEN resolution IS NOT NULL THEN 'resolution' END, CASE WHEN subject IS NOT NULL THEN 'subject' END) AS keys FROM wide""",
    "rotation_flags": f"""{with_views('edges')} SELECT project_id, src, dst, CASE op WHEN 'OutputMp4' THEN 'OutputTif' ELSE op END AS op, CASE WHEN dst % 7 = 0 THEN 'no' WHEN op NOT LIKE 'Output%' THEN '-' WHEN dst % 5 = 0 THEN 'no' WHEN dst % 5 = 1 THEN 'yes'
  WHEN src % 2 <> dst % 2 THEN 'yes' WHEN src % 9 = 0 OR dst % 9 = 0 THEN '-' ELSE 'no' END AS rotated FROM edges""",
    "replace_value": f"{with_views('journals')} SELECT project_id, username, CASE WHEN projecttype = 'video' THEN 'film' ELSE projecttype END AS projecttype FROM journals",
    "backfill_segments": f"""{_SB}, st AS (SELECT set_id, type, max(endframe) + set_id % 3 - 1 AS last FROM segments WHERE set_id % 3 > 0 GROUP BY 1, 2),
s AS (SELECT s.* REPLACE (CASE WHEN seg_no % 3 > 0 THEN type WHEN set_id % 2 = 0 THEN 'audio' ELSE 'video' END AS type) FROM segments s), j AS (SELECT s.*, st.last, seg_no % 2 > 0 AND st.last > s.endframe AS longer FROM s LEFT JOIN st ON st.set_id = s.set_id AND st.type = s.type),
k AS (SELECT *, CASE WHEN longer THEN last ELSE endframe END AS e FROM j)
SELECT set_id, seg_no, type, 30.0::DOUBLE AS rate, startframe, e AS endframe, e - startframe + 1 AS frames, round((startframe - 1) * 1000 / 30.0::DOUBLE, 4) AS starttime, round((e - 1) * 1000 / 30.0::DOUBLE, 4) AS endtime, round(error + CASE WHEN seg_no % 2 > 0 AND last IS NULL THEN 2000 / 30.0::DOUBLE ELSE 0 END, 4) AS error FROM k""",
    "plain_times": "SELECT o_orderkey, concat('00:0', o_custkey % 10, ':10') AS start_time, '00:01:00' AS end_time, '1:2:3:4' AS note FROM orders",
    "md5_names": "SELECT doc_id, md5(coalesce(text, '')) AS md5, concat('a.b/', md5(coalesce(text, '')), '.Txt') AS new_file FROM documents",
    "list_check": f"{_N} SELECT file, 'sheet' AS side FROM nodes WHERE node_id % 4 > 0 AND node_id % 5 = 0 UNION ALL SELECT file, 'folder' FROM nodes WHERE node_id % 4 = 0 AND node_id % 5 > 0",
    "empty_mask_edges": f"""{with_views('wide', recursive=True)}, dn AS (SELECT project_id, dst AS at FROM wide WHERE empty_mask = 'yes' AND op IN ('Blur', 'DeleteFrames') UNION SELECT d.project_id, e.dst FROM dn d JOIN edges e ON e.project_id = d.project_id AND e.src = d.at)
SELECT project_id, dn.at AS node_id FROM dn""",
    "stream_ids": f"""{_N}, s AS (SELECT project_id AS file, r AS stream_pos, CASE WHEN node_id % 3 = 0 THEN 'video' ELSE CASE node_id % 4 WHEN 0 THEN 'mono' WHEN 1 THEN 'stereo' ELSE 'audio' END END AS s FROM nodes),
k AS (SELECT *, row_number() OVER (PARTITION BY file, s ORDER BY stream_pos) AS k FROM s) SELECT file, stream_pos, CASE WHEN k = 1 THEN s ELSE concat(s, k - 1) END AS stream FROM k""",
    "stream_diff": f"""{_F}, m AS (SELECT media_id, event_type, frame_no, json_extract_string(props, '$.k') AS k, CASE WHEN changed THEN 'yes' END AS c FROM frames),
a AS (SELECT media_id, event_type, arg_max(ROW(k, c), frame_no) AS m FROM m WHERE frame_no % 2 = 0 GROUP BY 1, 2), b AS (SELECT media_id, event_type, arg_max(ROW(k, c), frame_no) AS m FROM m WHERE frame_no % 2 = 1 GROUP BY 1, 2),
j AS (SELECT coalesce(a.media_id, b.media_id) AS file, coalesce(a.event_type, b.event_type) AS stream, a.m AS x, b.m AS y FROM a FULL JOIN b ON a.media_id = b.media_id AND a.event_type = b.event_type),
u AS (SELECT file, stream, 'k' AS key, x[1] AS old, y[1] AS new FROM j UNION ALL SELECT file, stream, 'c', x[2], y[2] FROM j)
SELECT file, stream, key, CASE WHEN old IS NULL THEN 'add' WHEN new IS NULL THEN 'delete' ELSE 'change' END AS action, old, new FROM u WHERE old IS DISTINCT FROM new""",
    "rate_change": f"""{with_views('edges')} SELECT project_id, src, dst, op, (src % 100)::DOUBLE AS old_frames, (dst % 100)::DOUBLE AS new_frames, CASE WHEN src % 2 = 0 THEN src % 9 * 1000 ELSE -1 END::DOUBLE AS old_ms, CASE WHEN src % 2 = 0 THEN dst % 9 * 1000 ELSE -1 END::DOUBLE AS new_ms,
  CASE WHEN dst % 3 = 0 THEN 30 ELSE -1 END::DOUBLE AS rate FROM edges""",
    "frame_rates": "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 1 THEN round(p_size / 2.0::DOUBLE, 4) WHEN p_size % 4 > 0 AND p_partkey > 0 THEN round(p_partkey / (p_size % 4)::DOUBLE, 4) END, -1)::DOUBLE AS rate FROM part".replace("p_size % 4", "CAST(p_size % 4 AS INTEGER)"),
    "text_scalars": """SELECT p_partkey, true AS is_time, true AS is_place, false AS is_not, concat(p_size, ',', p_partkey % 9) AS ints,
  concat(md5(concat(p_name, p_brand)), '_', array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(w[1], w[-1])), '')) AS short, concat(p_size, '.', p_partkey % 7) AS version FROM part""",
    "nested_paths": """SELECT l_orderkey, arg_min(l_quantity::INT, ROW(l_linenumber, l_partkey, l_quantity::INT)) AS first, -1 AS none, (count(*) FILTER (l_partkey % 2 = 0))::INT AS n_flags, 'x' AS named FROM lineitem GROUP BY 1""",
    "packet_summary": f"{_F} SELECT event_type AS stream, 'value' AS key, sum(floor(intensity * 100)::BIGINT)::BIGINT AS total, count(*) AS n, round(avg(floor(intensity * 100)::BIGINT), 6) AS mean FROM frames GROUP BY 1",
    "group_work": "SELECT l_orderkey AS project_id, count(*) AS n, string_agg(concat('u', l_suppkey, '/f', l_partkey), ',' ORDER BY concat('u', l_suppkey), concat('f', l_partkey)) AS items FROM lineitem GROUP BY 1",
    "recalculated": f"""{_SB} SELECT set_id, seg_no, floor(round(startframe * 17.5::DOUBLE * 30 / 1000, 6))::BIGINT + 1 AS startframe, floor(round(endframe * 17.5::DOUBLE * 30 / 1000, 6))::BIGINT + 1 AS endframe,
  floor(round(endframe * 17.5::DOUBLE * 30 / 1000, 6))::BIGINT - floor(round(startframe * 17.5::DOUBLE * 30 / 1000, 6))::BIGINT + 1 AS frames, round((startframe - 1) * 1000 / 30.0::DOUBLE, 4) AS starttime, round((endframe - 1) * 1000 / 30.0::DOUBLE, 4) AS endtime FROM segments""",
    "frame_ops": f"""{_SB}, {_OPS}, q AS (SELECT side, set_id, p.n AS seg_no, type, p.s AS startframe, p.e AS endframe FROM p WHERE p.s <= p.e)
SELECT * FROM q WHERE seg_no > 0 UNION ALL (SELECT DISTINCT * FROM q WHERE seg_no = 0)""",
    "upgraded_journals": f"""{with_views('wide')}, a AS (SELECT project_id, src, dst, media_type, CASE project_id % 4 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 9 ELSE 0 END AS l,
  ['ColorBlendDissolve', 'SelectRemoveFromFrames', 'TransformContentAwareScale', 'BlurMotion', 'ColorColorBalance', 'OutputPng', 'AudioPan', 'TransformSeamCarving'][dst % 8 + 1] AS o, src % 3 = 0 AS lefty,
  CASE dst % 4 WHEN 0 THEN '' ELSE software END AS sw, CASE WHEN dst % 8 = 0 THEN '' WHEN dst % 4 = 0 THEN 'No Software' ELSE software END AS soft, concat('00:00:', 10 + src % 50, ':', dst % 30) AS t, dst % 8 AS k FROM wide),
u AS (SELECT project_id, arg_min(sw, ROW(-n, sw)) AS used FROM (SELECT project_id, sw, count(*) AS n FROM a WHERE sw <> '' GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT a.*, used, CASE WHEN l < 1 AND k = 0 THEN 'Blend' WHEN l < 1 AND k = 4 THEN 'ColorBalance' WHEN l < 3 AND k = 6 THEN 'AudioAmplify' WHEN l < 3 AND k = 1 THEN 'ContentAwareFill' ELSE o END AS o1 FROM a LEFT JOIN u USING (project_id)),
c AS (SELECT *, CASE WHEN l < 8 AND media_type = 'video' AND o1 IN ('TransformContentAwareScale', 'ContentAwareFill') THEN 'PasteSampled' WHEN l < 8 AND o1 = 'TransformContentAwareScale' THEN 'TransformSeamCarving' ELSE o1 END AS o2,
  CASE WHEN dst % 3 = 0 THEN concat(10 + dst % 80, '') END AS ang, CASE WHEN dst % 3 = 0 THEN concat(1 + src % 50, '') END AS dist, CASE WHEN dst % 3 = 1 THEN concat(dst % 10, '') END AS rad,
  (10 + src % 50) * 1000000 + CASE WHEN src % 5 > 0 THEN floor(dst % 30 * 1000.0 / 25)::BIGINT * 1000 ELSE 0 END AS us FROM b)
SELECT project_id, src, dst, o2 AS op, CASE WHEN l < 1 AND k = 0 THEN 'Dissolve' ELSE '-' END AS mode,
  CASE WHEN l >= 2 THEN '-' ELSE concat('00:', printf('%02d', us // 60000000), ':', printf('%02d', us // 1000000 % 60), '.', printf('%06d', us % 1000000)) END AS start,
  CASE WHEN l < 3 AND k IN (1, 6) AND lefty THEN dst::VARCHAR ELSE '-' END AS pan, CASE WHEN l < 3 AND k = 1 THEN 'remove' ELSE '-' END AS purpose,
  CASE WHEN l < 8 AND k = 2 AND media_type <> 'video' THEN 'keep' WHEN l < 8 AND k = 7 THEN 'color' ELSE '-' END AS masktype,
  CASE WHEN l >= 9 OR o2 NOT LIKE 'Blur%' THEN '-' WHEN src % 2 = 0 THEN coalesce(dist, '0') ELSE coalesce(rad, '0') END AS radius, CASE WHEN l >= 9 OR o2 NOT LIKE 'Blur%' THEN '-' WHEN src % 2 = 0 THEN coalesce(ang, '0') ELSE '0' END AS angle,
  CASE WHEN l < 8 AND k = 5 THEN 'no' ELSE '-' END AS lens, CASE WHEN l < 5 AND k = 5 THEN 'no' WHEN dst % 2 = 1 THEN 'no' WHEN l < 5 THEN 'yes' ELSE 'true' END AS "recordMaskInComposite",
  CASE WHEN src % 2 = 1 OR (l < 9 AND o2 LIKE '%Color%') THEN 'no' ELSE 'yes' END AS widely,
  CASE WHEN l < 9 AND src % 2 = 1 AND dst % 10 > 0 THEN CASE WHEN dst % 10 / 10.0::DOUBLE * (1000 * (src % 20)) < 2500 THEN 'small' WHEN dst % 10 / 10.0::DOUBLE * (1000 * (src % 20)) < 10000 THEN 'medium' ELSE 'large' END ELSE 'large' END AS change_category,
  coalesce(CASE WHEN l < 7 AND sw = '' THEN coalesce(used, soft) ELSE soft END, '-') AS software, CASE WHEN l < 7 AND dst % 2 = 0 THEN dst::VARCHAR ELSE '-' END AS rate, 9 - l AS fixes FROM c""",
    "mask_at": f"""{_F} SELECT media_id AS segment_id, arg_min(frame_no, ROW(frame_no * 40 > media_id % 9 * 150, abs(frame_no * 40 - media_id % 9 * 150))) AS frame_no, arg_min(frame_no * 40.0::DOUBLE, ROW(frame_no * 40 > media_id % 9 * 150, abs(frame_no * 40 - media_id % 9 * 150))) AS time_ms FROM frames GROUP BY 1""",
    "resampled_masks": f"""{_F}, n AS (SELECT media_id, count(*) AS n FROM frames GROUP BY 1), w AS (SELECT *, CASE media_id % 3 WHEN 0 THEN n * 2 WHEN 1 THEN n // 2 + 1 ELSE n + 5 END AS m FROM n),
g AS (SELECT *, unnest(generate_series(0, m - 1)) AS j FROM w) SELECT media_id AS segment_id, floor(j * n::DOUBLE / m)::BIGINT + 1 AS frame_no, j + 1 AS new_no FROM g""",
    "packet_diff": f"""{_F}, x AS (SELECT media_id, frame_no, frame_no * 40 AS t, json_extract_string(props, '$.k') AS k, CASE WHEN changed THEN 'yes' END AS c FROM frames),
a AS (SELECT media_id, t, k, c FROM x WHERE frame_no % 5 > 0),
b AS (SELECT media_id, t, arg_max(ROW(k, c), frame_no) AS m FROM (SELECT media_id, frame_no, k, c, t + CASE WHEN frame_no % 3 = 0 THEN 15 WHEN frame_no % 11 = 0 THEN 40 ELSE 0 END AS t FROM x WHERE frame_no % 7 > 0) GROUP BY 1, 2),
j AS (SELECT coalesce(a.media_id, b.media_id) AS media_id, coalesce(a.t, b.t) AS t, a.t IS NOT NULL AS ha, b.t IS NOT NULL AS hb, a.k, a.c, b.m[1] AS k2, b.m[2] AS c2 FROM a FULL JOIN b ON a.media_id = b.media_id AND a.t = b.t),
la AS (SELECT media_id, max(t) FILTER (ha) AS la, max(t) FILTER (hb) AS lb FROM j GROUP BY 1),
r AS (SELECT *, CASE WHEN ha <> lag(ha) OVER w AND t - lag(t) OVER w < 20 THEN 0 ELSE 1 END AS nw FROM j WHERE NOT (ha AND hb) WINDOW w AS (PARTITION BY media_id ORDER BY t)),
ch AS (SELECT *, sum(nw) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS ch FROM r), pr AS (SELECT *, (row_number() OVER (PARTITION BY media_id, ch ORDER BY t) - 1) // 2 AS p FROM ch),
o AS (SELECT media_id, t, ha, hb, k, c, k2, c2 FROM j WHERE ha AND hb UNION ALL SELECT media_id, min(t), bool_or(ha), bool_or(hb), max(k) FILTER (ha), max(c) FILTER (ha), max(k2) FILTER (hb), max(c2) FILTER (hb) FROM pr GROUP BY media_id, ch, p),
z AS (SELECT o.*, CASE WHEN NOT ha THEN 'add' WHEN NOT hb THEN 'delete' ELSE 'change' END AS action, (NOT ha AND t > coalesce(la, -1)) OR (NOT hb AND t > coalesce(lb, -1)) AS tail, (k IS DISTINCT FROM k2)::INT + (c IS DISTINCT FROM c2)::INT AS keys FROM o JOIN la ON la.media_id = o.media_id),
f AS (SELECT media_id, action, t, 1 AS n, keys FROM z WHERE NOT tail AND (action <> 'change' OR keys > 0) UNION ALL SELECT media_id, action, min(t), count(*), 0 FROM z WHERE tail GROUP BY 1, 2)
SELECT media_id, action, count(*) AS rows, sum(n)::BIGINT AS n, sum(keys)::BIGINT AS keys, sum(t)::BIGINT AS at FROM f GROUP BY 1, 2""",
}
