"""Catalogue work: media sheets against device registries, merging by content, pairing, lookup, listings and permutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.blocks import in_parts, n_parts

P = "project_id"


def pick_projects(files: DataFrame) -> DataFrame:
    """IO2: (dir, path, length): the largest file of each directory, the first by path on ties."""
    best = files.groupBy("dir").agg(F.min_by(F.struct("path", "length"), F.struct(-F.col("length"), "path")).alias("_b"))
    return best.select("dir", "_b.*")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """IO3: items whose key is not in the done list."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def merge_journals(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, md5) and edges (src, dst, op) of b into a: equal MD5 is the same node (of several in a the smallest),
    other nodes come in, edges only where a has none between the two."""
    known = nodes_a.groupBy("md5").agg(F.min("node_id").alias("_a"))
    ids = nodes_b.join(known, "md5", "left").select("node_id", "md5", F.coalesce("_a", "node_id").alias("_id"), F.col("_a").isNull().alias("_new"))
    nodes = nodes_a.select("node_id", "md5").unionByName(ids.where("_new").select("node_id", "md5"))
    m = ids.select("node_id", "_id")
    mapped = edges_b.join(m.toDF("src", "_s"), "src").join(m.toDF("dst", "_d"), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "op")
    fresh = mapped.join(edges_a.select("src", "dst").distinct(), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("op").alias("op"))
    return nodes, edges_a.select("src", "dst", "op").unionByName(fresh)


def merge_groups(journals: DataFrame, key: str) -> DataFrame:
    """(key, n, members): journals to merge, where more than one share a key; members sorted."""
    return journals.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(P)).alias("members")).where("n > 1")


def pick_paired(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files (file) with the pair (pos, prefix, to) whose prefix the name starts with; the first pair by position wins.

    A name meets the pairs by its beginnings of the lengths that prefixes have, so this is an equi-join; an empty prefix fits all.
    """
    # At most as many rows as the longest name has characters.
    lengths = sorted(r["n"] for r in pairs.select(F.length("prefix").alias("n")).distinct().collect() if r["n"] is not None)
    begins = F.explode(F.array_compact(F.array(*(F.when(F.length("file") >= n, F.left("file", F.lit(n))) for n in lengths))))
    j = files.withColumn("prefix", begins) if lengths else files.withColumn("prefix", F.lit(None).cast("string"))
    first = pairs.groupBy("prefix").agg(F.min(F.struct("pos", "to")).alias("pair"))
    # Many names begin alike: they are dealt out, and a prefix has a row for each share of them.
    n = n_parts(files.count(), files.sparkSession)
    dealt = first.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    shares = j.withColumn("_share", F.pmod(F.xxhash64("file"), F.lit(n)).cast("int")).repartition(n, "prefix", "_share")
    found = shares.join(dealt, ["prefix", "_share"])
    return in_parts(found.select("file", "pair"), "file").groupBy("file").agg(F.min("pair").alias("_pair")).select("file", F.col("_pair.to").alias("to"))


def reduce_listing(listing: DataFrame, journals: DataFrame, ts: Column) -> DataFrame:
    """(project_id, status): listed journals updated before a time are `old`, those without a journal `missing`; others go."""
    j = listing.select(P).join(journals.select(P, F.col("updatetime").alias("_t")), P, "left")
    return j.select(P, F.when(F.col("_t").isNull(), "missing").when(F.col("_t") < ts, "old").alias("status")).where("status is not null")


def new_media(files: DataFrame, sheet: DataFrame) -> DataFrame:
    """Files whose base name the sheet (OriginalImageName) lacks."""
    base = F.regexp_extract("file", r"([^/\\]+)$", 1)
    return files.withColumn("_n", base).join(sheet.select(F.col("OriginalImageName").alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def camera_sizes(media: DataFrame, cameras: DataFrame) -> DataFrame:
    """Media (make, model, format) with sizes of cameras whose make is equal in lower case and whose camera name is in the model."""
    j = media.withColumn("_m", F.lower("make")).join(cameras.select(F.lower("make").alias("_m"), F.col("format").alias("_f"), "camera", "width", "height"), "_m")
    return j.where(F.lower("model").contains(F.lower(F.col("camera"))) & (F.col("format") == F.col("_f"))).drop("_m", "_f")


def coco_subset(images: DataFrame, annotations: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """Annotations of the first n images that have one with an area in [lo, hi]."""
    ok = annotations.where(F.col("area").between(lo, hi)).select("image_id").distinct()
    kept = images.join(ok, "image_id", "left_semi").orderBy("image_id").limit(n).select("image_id")
    return annotations.join(kept, "image_id", "left_semi")


def classify_color(pixels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pixels (color text) with `class`, `other` where the colour is not listed; blanks do not count."""
    table = classes.select(F.regexp_replace("color", r"\s", "").alias("_k"), "class")
    return pixels.withColumn("_k", F.regexp_replace("color", r"\s", "")).join(table, "_k", "left").withColumn("class", F.coalesce("class", F.lit("other"))).drop("_k")


def fetch_arguments(files: DataFrame, given: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Files (file) with `arguments`: the defaults, overlaid by what is given for the file (file, arguments map)."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.coalesce("arguments", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    return files.join(given, "file", "left").withColumn("arguments", merged)


def missing_files(references: DataFrame, listing: DataFrame) -> DataFrame:
    """References (project_id, owner, file) whose file is not listed."""
    return references.where("file is not null and file <> ''").join(listing.select("file").distinct(), "file", "left_anti")


def file_index(references: DataFrame) -> DataFrame:
    """(file, n, owners): which nodes and edges name a file."""
    return references.groupBy("file").agg(F.count_distinct("owner").alias("n"), F.array_sort(F.collect_set("owner")).alias("owners"))


def orphans(listing: DataFrame, references: DataFrame) -> DataFrame:
    """Listed files that nothing names."""
    return listing.join(references.select("file").distinct(), "file", "left_anti")


def permute(lists: dict[str, list], chained: bool = True, spark=None) -> DataFrame:
    """Parameter permutations with row_no. Chained: the cartesian product, the last name fastest. Else all advance together
    and shorter lists start again until the longest is through."""
    names, sizes = list(lists), [len(v) for v in lists.values()]
    total = reduce(lambda a, b: a * b, sizes, 1) if chained else max(sizes)
    out = spark.range(total).withColumnRenamed("id", "row_no")
    step = 1
    for name, size in reversed(list(zip(names, sizes))):
        at = F.floor(F.col("row_no") / step) % size
        out = out.withColumn(name, F.get(F.array(*map(F.lit, lists[name])), at.cast("int")))
        step *= size if chained else 1
    return out.select("row_no", *names)


def _sections(specs: DataFrame) -> DataFrame:
    """Specs with _kind (int, float, yesno, list) and _parts, the sections of a range as struct(lo, hi, step): a missing end is one step
    past the start, a missing step is one."""
    inner = F.regexp_extract("spec", r"\[(.*?)\]", 1)
    number = lambda x, i: F.get(F.split(x, ":"), F.lit(i)).try_cast("double")
    part = lambda x: F.struct(number(x, 0).alias("lo"), F.coalesce(number(x, 1), number(x, 0) + 1.0).alias("hi"), F.coalesce(number(x, 2), F.lit(1.0)).alias("step"))
    kind = F.when(F.col("spec").startswith("int"), "int").when(F.col("spec").startswith("float"), "float").when(F.col("spec") == "yesno", "yesno").otherwise("list")
    return specs.withColumns({"_kind": kind, "_parts": F.transform(F.split(inner, ","), part)})


def _values(kind: Column, part: Column, spec: Column) -> Column:
    """All values of a spec, as text: an int range holds its end, a float range does not."""
    steps = F.when(kind == "int", F.floor((part.hi - part.lo) / part.step) + 1).otherwise(F.ceil((part.hi - part.lo) / part.step))
    run = F.when(steps > 0, F.transform(F.sequence(F.lit(0).cast("long"), steps - 1), lambda i: part.lo + i * part.step)).otherwise(F.array().cast("array<double>"))
    return (
        F.when(kind == "int", F.transform(run, lambda x: x.cast("long").cast("string")))
        .when(kind == "float", F.transform(run, lambda x: F.round(x, 6).cast("string")))
        .when(kind == "yesno", F.array(F.lit("yes"), F.lit("no")))
        .otherwise(F.split(F.regexp_replace(spec, "^list:", ""), ","))
    )


def _drawn(seed: int, *keys: Column) -> Column:
    """A whole number below 2^32 that seed and keys fix, so that a task that runs again draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("long")


def spec_values(specs: DataFrame, seed: int = 0) -> DataFrame:
    """Specs (name, spec) to (name, pos, value): int[a:b:s], float[a:b:s], list:x,y, yesno. Of the sections of a range (`[a:b,c:d]`) one
    counts, which seed and name draw. An int range holds its end, a float range does not; an empty range gives no row."""
    s = _sections(specs).withColumn("_part", F.get("_parts", (_drawn(seed, F.col("name"), F.lit("section")) % F.size("_parts")).cast("int")))
    return s.select("name", F.posexplode(_values(F.col("_kind"), F.col("_part"), F.col("spec"))).alias("pos", "value"))


def random_values(specs: DataFrame, draws: int, seed: int) -> DataFrame:
    """(name, draw, value): draws values of each spec with repeats, each draw of a section of its own; the same seed draws the same values,
    whatever the partitions. Int ranges, lists and yesno draw one of their values; so do float ranges with a step other than one, which
    else draw any number from the start up to the end. A spec without values draws null."""
    s = _sections(specs).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    keys = (F.col("name"), F.col("draw").cast("string"))
    s = s.withColumn("_part", F.get("_parts", (_drawn(seed, *keys, F.lit("section")) % F.size("_parts")).cast("int"))).withColumn("_u", _drawn(seed, *keys, F.lit("value")))
    part, u = F.col("_part"), F.col("_u")
    steps = F.floor((part.hi - part.lo) / part.step) + 1
    # Ranges are drawn from by number, without their list.
    ranged = F.when(F.col("_kind") == "int", F.when(steps > 0, (part.lo + u % steps * part.step).cast("long").cast("string")))
    count = F.ceil((part.hi - part.lo) / part.step)
    stepped = F.when(count > 0, F.round(part.lo + u % count * part.step, 6))
    any_ = F.round(part.lo + u / F.lit(float(2**32)) * (part.hi - part.lo), 6)
    listed = F.when(F.col("_kind") == "yesno", F.array(F.lit("yes"), F.lit("no"))).otherwise(F.split(F.regexp_replace("spec", "^list:", ""), ","))
    value = (
        F.when(F.col("_kind") == "int", ranged)
        .when(F.col("_kind") == "float", F.when(F.abs(part.step - 1.0) > 1e-9, stepped).otherwise(any_).cast("string"))
        .otherwise(F.get(listed, (u % F.size(listed)).cast("int")))
    )
    return s.select("name", "draw", value.alias("value"))


def random_donors(bases: DataFrame, seed: int) -> DataFrame:
    """Of each journal's bases (project_id, node_id) one that the seed draws; the smallest id on equal draws."""
    drawn = F.struct(_drawn(seed, F.col(P).cast("string"), F.col("node_id").cast("string")), "node_id")
    return bases.groupBy(P).agg(F.min_by("node_id", drawn).alias("node_id"))


def best_qtable(tables: DataFrame, keywords: list[str]) -> DataFrame:
    """The table (file) with the most keywords in its name, the shortest name, then the first, on ties."""
    hits = reduce(lambda a, b: a + b, [F.lower("file").contains(k.lower()).cast("int") for k in keywords])
    return tables.withColumn("hits", hits).orderBy(F.col("hits").desc(), F.length("file"), "file").limit(1)


def best_name(users: DataFrame, names: DataFrame, block: int = 1000) -> DataFrame:
    """(username, best): for user names that the list (pos, name) lacks the nearest by Levenshtein, case not counted, the least pos on ties.

    The list is the stated query set. It is dealt in blocks of about `block` names; each lost name meets every block in a row of its own
    and keeps the block's nearest, the nearest of all blocks is one aggregate more. A list without names gives no row.
    """
    lost = users.select("username").where("username is not null").distinct().join(names.select(F.col("name").alias("username")), "username", "left_anti")
    named = names.where("name is not null")
    n_blocks = named.count() // block + 1
    blocks = named.groupBy(F.pmod(F.xxhash64("pos"), F.lit(n_blocks)).alias("_b")).agg(F.collect_list(F.struct("pos", "name")).alias("_names"))
    dealt = lost.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    near = F.array_min(F.transform("_names", lambda n: F.struct(F.levenshtein(F.lower("username"), F.lower(n["name"])).alias("d"), n["pos"].alias("pos"), n["name"].alias("name"))))
    return dealt.join(blocks, "_b").select("username", near.alias("_near")).groupBy("username").agg(F.min("_near").alias("_near")).select("username", F.col("_near.name").alias("best"))


def file_md5(files: DataFrame) -> DataFrame:
    """files (path, content, as `binaryFile` reads them) with md5."""
    return files.withColumn("md5", F.md5("content"))


def named_by_md5(finals: DataFrame) -> DataFrame:
    """finals (file, md5) with new_file: the MD5 and the file's own suffix in its folder."""
    folder, tail = F.regexp_extract("file", r"^(.*[/\\\\])?", 0), F.regexp_extract("file", r"(\.[^./\\\\]*)$", 1)
    return finals.withColumn("new_file", F.concat(folder, F.col("md5"), tail))


def list_check(sheet: DataFrame, files: DataFrame) -> DataFrame:
    """(file, side): names that only the sheet or only the folder holds."""
    side = lambda t, name: t.select("file", F.lit(name).alias("side"))
    # One exchange of all names, in as many parts as keep each small.
    both = in_parts(side(sheet, "sheet").unionByName(side(files, "folder")), "file")
    return both.groupBy("file").agg(F.min("side").alias("side"), F.max("side").alias("_last")).where("side = _last").drop("_last")


def empty_mask_edges(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """(project_id, node_id) to remove: ends of empty-mask edges whose operation (op, rule) asks for checkEmpty, and all below them."""
    from . import lineage

    asked = operations.where("rule = 'checkEmpty'").select("op").distinct()
    heads = edges.where("empty_mask = 'yes'").join(asked, "op", "left_semi").select(P, F.col("dst").alias("node_id")).distinct()
    return lineage.reached(edges, heads)


def remove_duplicates(finals: DataFrame) -> DataFrame:
    """Finals (project_id, node_id, hash) after the first of each journal and hash."""
    return finals.withColumn("_k", F.expr("row_number() over (partition by project_id, hash order by node_id)")).where("_k > 1").drop("_k")


# --- sheets of high-provenance media -----------------------------------------------------------------------------------


def sheet_names(media: DataFrame, date: str, org: str, user: str, partitions: int = 8) -> DataFrame:
    """HP2: media (file) with new_name date-org-user-00001 in order of file; numbered by range partition and offset, not in one task."""
    from provlake.functions.storage import written

    ranged = written(media.repartitionByRange(partitions, "file").sortWithinPartitions("file").withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_o", F.expr("coalesce(sum(_n) over (order by _p rows between unbounded preceding and 1 preceding), 0)")).drop("_n")
    out = ranged.withColumn("_i", F.expr("row_number() over (partition by _p order by file)")).join(F.broadcast(offsets), "_p")
    return out.withColumn("new_name", F.concat(F.lit(f"{date}-{org}-{user}-"), F.lpad((F.col("_o") + F.col("_i")).cast("string"), 5, "0"))).drop("_p", "_i", "_o")


def sheet_checks(sheet: DataFrame, models: DataFrame, kinematics: list[str], collections: list[str], local_ids: DataFrame | None = None, flags: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """HP3: (file, problem), one row for each problem of a row of the sheet.

    primary/secondary must be one of both, as written; a video needs its kinematics (case not counted); a collection, if given, must be known;
    a camera model must be given, but for three-dimensional models, and known; so must a local id, where local_ids (local_id) is given.
    flags: columns that hold true or false, each with the media types that must fill it. Empty text counts as null.
    """
    filled = lambda c: F.nullif(c, F.lit(""))
    unknown = lambda c, known: c.isNotNull() & ~F.lower(c).isin(*map(str.lower, known))
    s = sheet.join(models.select("model", F.lit(True).alias("_known")).distinct(), "model", "left")
    video, kin, model = F.lower("type") == "video", filled(F.col("kinematics")), filled(F.col("model"))
    tests = [
        F.when(~F.coalesce(F.col("primary_secondary").isin("primary", "secondary"), F.lit(False)), "primary/secondary"),
        F.when(video & kin.isNull(), "no kinematics").when(video & unknown(kin, kinematics), "kinematics"),
        F.when(filled(F.col("collection")).isNotNull() & ~F.col("collection").isin(*collections), "collection"),
        F.when(model.isNull(), F.when(~F.col("type").eqNullSafe(F.lit("model")), "no model")).when(F.col("_known").isNull(), "model"),
    ]
    if local_ids is not None:
        s = s.join(local_ids.select("local_id", F.lit(True).alias("_local")).distinct(), "local_id", "left")
        tests.append(F.when(filled(F.col("local_id")).isNull(), "no local id").when(F.col("_local").isNull(), "local id"))
    for name, kinds in (flags or {}).items():
        bad = ~F.coalesce(F.lower(F.col(name).cast("string")).isin("true", "false"), F.lit(False))
        tests.append(F.when(bad & F.col("type").isin(*kinds), name))
    return s.select("file", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def device_checks(sheet: DataFrame, configs: DataFrame) -> DataFrame:
    """HP4: rows whose (device, make, model, serial, type) is not one of the device's registered configurations; nulls equal nulls."""
    keys = ["device", "make", "model", "serial", "type"]
    c = configs.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return sheet.join(c, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def resolution_checks(sheet: DataFrame, known: DataFrame) -> DataFrame:
    """HP5: (file, problem): the device's resolution is new, or is known for the opposite camera only."""
    k = known.groupBy("device", "width", "height").agg(F.collect_set("camera").alias("_c"))
    j = sheet.join(k, ["device", "width", "height"], "left")
    problem = F.when(F.col("_c").isNull(), "new resolution").when(~F.array_contains("_c", F.col("camera")), "opposite camera")
    return j.select("file", problem.alias("problem")).where("problem is not null")


def hp_sets(sheet: DataFrame) -> DataFrame:
    """(collection, n_devices, resolutions): devices and distinct resolutions of each set."""
    return sheet.groupBy("collection").agg(F.count_distinct("device").alias("n_devices"), F.count_distinct("width", "height").alias("n_resolutions"))


def not_in_sheet(files: DataFrame, sheet: DataFrame) -> DataFrame:
    """HP6: files on disk that the sheet lacks."""
    return files.join(sheet.select("file").distinct(), "file", "left_anti")


def keyword_rows(keywords: DataFrame, valid: DataFrame) -> DataFrame:
    """HP7: (file, keywords, n_bad): a file's keywords tab-joined in order, and how many are not valid."""
    ok = valid.select("keyword", F.lit(True).alias("_ok")).distinct()
    j = keywords.join(ok, "keyword", "left")
    return j.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda s: s.keyword), "\t").alias("keywords"), F.count_if(F.col("_ok").isNull()).alias("n_bad"))


def exif_to_sheet(media: DataFrame, lookup: dict[str, str]) -> DataFrame:
    """HP1: media (file, exif map) with one column for each sheet column; `-` counts as missing."""
    value = lambda k: F.nullif(F.try_element_at("exif", F.lit(k)), F.lit("-"))
    return media.select("file", *[value(k).alias(c) for c, k in lookup.items()])


def ingest_columns(sheet: DataFrame, renames: dict[str, str], wanted: list[str], import_date: str) -> DataFrame:
    """HP8: the wanted columns, old names renamed and missing ones empty, with ImportDate."""
    s = sheet.withColumnsRenamed({a: b for a, b in renames.items() if b not in sheet.columns})
    return s.select(*[F.col(c) if c in s.columns else F.lit("").alias(c) for c in wanted], F.lit(import_date).alias("ImportDate"))


def attach_seeds(images: DataFrame, log: DataFrame) -> DataFrame:
    """HP9: images (pos, file) with the seed at the same position of the log's text (log_text, one row)."""
    seeds = log.select(F.posexplode(F.regexp_extract_all("log_text", F.lit(r"[Ss]eed[:= ]+(\S+)"), F.lit(1))).alias("pos", "seed"))
    return images.join(seeds, "pos", "left")


# --- bulk updates of journals ------------------------------------------------------------------------------------------


def needed_fixes(journals: DataFrame, fixes: list[str]) -> DataFrame:
    """M1: (project_id, fix): fixes after the last one that the journal's jt_upgrades names, in order."""
    all_ = F.array(*map(F.lit, fixes))
    last = F.coalesce(F.array_max(F.transform("jt_upgrades", lambda u: F.array_position(all_, u))), F.lit(0)).cast("int")
    return journals.select(P, F.posexplode(F.slice(all_, last + 1, F.lit(len(fixes)))).alias("pos", "fix"))


def rename_ops(edges: DataFrame, renames: dict[str, str], defaults: DataFrame | None = None) -> DataFrame:
    """M2, M5: operations by their new name; arguments that are missing take the operation's default (op, arguments map)."""
    pairs = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    out = edges.withColumn("op", F.coalesce(F.try_element_at(pairs, F.col("op")), F.col("op")))
    if defaults is None:
        return out
    d = defaults.select("op", F.col("arguments").alias("_d"))
    merged = F.map_concat(F.map_filter("_d", lambda k, v: ~F.map_contains_key("arguments", k)), F.col("arguments"))
    return out.join(d, "op", "left").withColumn("arguments", F.when(F.col("_d").isNull(), F.col("arguments")).otherwise(merged)).drop("_d")


def composite_flags(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """M3: recordMaskInComposite true becomes yes; outputs and laundering are never in the composite."""
    out = operations.where(F.col("category").isin("Output", "AntiForensic", "Laundering")).select("op", F.lit(True).alias("_o"))
    flag = F.when(F.col("_o"), "no").when(F.lower("recordMaskInComposite").isin("true", "yes"), "yes").otherwise("no")
    return edges.join(out, "op", "left").withColumn("recordMaskInComposite", flag).drop("_o")


def fill_software(edges: DataFrame) -> DataFrame:
    """M6: an empty software name takes the journal's most used one (the first by name on ties); Recapture is Off Camera, donors stay."""
    used = edges.where("coalesce(softwareName, '') <> ''").groupBy(P, "softwareName").agg(F.count(F.lit(1)).alias("_n"))
    top = used.groupBy(P).agg(F.min_by("softwareName", F.struct(-F.col("_n"), "softwareName")).alias("_top"))
    empty = F.coalesce("softwareName", F.lit("")) == ""
    name = F.when(~empty | (F.col("op") == "Donor"), F.col("softwareName")).when(F.col("op") == "Recapture", "Off Camera").otherwise(F.col("_top"))
    return edges.join(top, P, "left").withColumn("softwareName", name).drop("_top")


def mend_users(edges: DataFrame, journals: DataFrame, names: DataFrame) -> DataFrame:
    """M6: edges whose username the list (username) lacks take it in lower case where the list holds that, else their journal's creator
    (project_id, creator); journals whose creator is not in the list, in lower case, stay as they are. Edges without a user stay."""
    known = names.select(F.col("username").alias("_name")).distinct()
    creators = journals.select(P, F.lower("creator").alias("_name")).join(known, "_name").select(P, F.col("_name").alias("_creator")).dropDuplicates([P])
    own = known.select(F.col("_name").alias("username"), F.lit(True).alias("_own"))
    low = known.select(F.col("_name").alias("_low"), F.lit(True).alias("_lower"))
    e = edges.join(own, "username", "left").withColumn("_low", F.lower("username")).join(low, "_low", "left").join(creators, P, "left")
    stays = F.col("_own").isNotNull() | F.col("_creator").isNull() | F.col("username").isNull()
    name = F.when(stays, F.col("username")).when(F.col("_lower").isNotNull(), F.col("_low")).otherwise(F.col("_creator"))
    return e.withColumn("username", name).drop("_own", "_low", "_lower", "_creator")


def rename_keys(df: DataFrame, column: str, renames: dict[str, str]) -> DataFrame:
    """M7: keys of a map column by their new name."""
    pairs = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return df.withColumn(column, F.transform_keys(column, lambda k, v: F.coalesce(F.try_element_at(pairs, k), k)))


def rotation_flag(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """M8: outputs as PNG or TIFF whose arguments lack `Image Rotated` get it: yes where the recorded change of size (shape_change) is not
    (0,0), or, without one, where the sizes of both ends (project_id, node_id, width, height) differ; else no. Without any size they stay.
    An argument that was given stays, and so do other operations."""
    a, b = sizes.toDF(P, "src", "_w0", "_h0"), sizes.toDF(P, "dst", "_w1", "_h1")
    j = edges.join(a, [P, "src"], "left").join(b, [P, "dst"], "left")
    given = F.coalesce("arguments", F.create_map().cast("map<string,string>"))
    wanted = F.col("op").isin("OutputPng", "OutputTif") & ~F.map_contains_key(given, "Image Rotated")
    change = F.nullif(F.regexp_replace("shape_change", r"\s", ""), F.lit(""))
    turned = F.coalesce(change != "(0,0)", (F.col("_w0") != F.col("_w1")) | (F.col("_h0") != F.col("_h1")))
    flag = F.create_map(F.lit("Image Rotated"), F.when(turned, "yes").otherwise("no"))
    out = j.withColumn("arguments", F.when(wanted & turned.isNotNull(), F.map_concat(given, flag)).otherwise(F.col("arguments")))
    return out.drop("_w0", "_h0", "_w1", "_h1")


def backfill_segments(segs: DataFrame, streams: DataFrame) -> DataFrame:
    """M4: segments of old journals (set_id, seg_no, op, type, rate, rates array, startframe, endframe, starttime, endtime, has_end, error)
    filled: a missing type by the operation's name; the first of a list of rates, a negative rate in thousands; missing fields by S1;
    and carried to the end of the source's stream (set_id, type, endframe) where it is longer and no end time was entered. Where neither
    the stream nor an end time is known, the error grows by two frames."""
    from .segments import complete_segments, time_of

    kind = F.coalesce("type", F.when(F.col("op").contains("Audio"), "audio").otherwise("video"))
    rate = F.coalesce(F.get("rates", F.lit(0)), F.when(F.col("rate") < 0, -F.col("rate") * 1000.0).otherwise(F.col("rate")))
    out = complete_segments(segs.withColumns({"type": kind, "rate": rate}))
    out = out.join(streams.select("set_id", "type", F.col("endframe").alias("_last")), ["set_id", "type"], "left")
    out = out.withColumn("_longer", F.coalesce(~F.col("has_end") & (F.col("_last") > F.col("endframe")), F.lit(False)))
    longer = F.col("_longer")
    lost = ~F.col("has_end") & F.col("_last").isNull()
    out = out.withColumns({"error": F.coalesce("error", F.lit(0.0)) + F.when(lost, 2000.0 / F.col("rate")).otherwise(0.0), "endframe": F.when(longer, F.col("_last")).otherwise(F.col("endframe"))})
    out = out.withColumns({"endtime": F.when(longer, time_of(F.col("endframe"), F.col("rate"))).otherwise(F.col("endtime")), "frames": F.col("endframe") - F.col("startframe") + 1})
    return out.drop("_last", "_longer", "rates")


def plain_times(edges: DataFrame, keys: list[str]) -> DataFrame:
    """M5: time arguments 'HH:MM:SS:frames' without the frames; the rest of the arguments stays."""
    fixed = lambda k, v: F.when(k.isin(*keys), F.regexp_replace(v, r"^(\d+:\d+:\d+(?:\.\d+)?):\d+$", "$1")).otherwise(v)
    return edges.withColumn("arguments", F.transform_values("arguments", fixed))


def replace_value(df: DataFrame, attr: str, old: str, new: str) -> DataFrame:
    """Rewrite a column's value, case not counted."""
    return df.withColumn(attr, F.when(F.lower(attr) == old.lower(), new).otherwise(F.col(attr)))
