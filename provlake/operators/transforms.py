"""What an edge does to the segments that pass over it, as a small program: an array of typed steps, run by one fold or, against the
edge's direction, undone by its inverse.

A step is struct(verb, type, b, e, to): it concerns segments of its type (null: all), with the frames b..e or, for a change of rate, b
frames that become e. `to` is a second place, struct(b, e), from which pasted frames were taken. Verbs:

    cut      frames go, what follows slides back          insert   room is made, what follows slides on
    hole     frames go, nothing moves                     drop     all goes (kept when undone)
    crop     what lies inside stays, renumbered from 1    uncrop   the inverse of crop
    mirror   order inside is reversed                     rerate   frames are scaled, and end with the stream
    give     frames of the second place belong to the set as well, in one piece
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By operation and by the source's media type, the ordered (verb, segment type) of its program; an operation that is not here, or not
#: for that media, leaves segments alone. `paste` and `copy` become an insert or a hole by the edge's add type: without one, paste
#: lays over and copy inserts.
PROGRAMS: dict[str, dict[str, list[tuple[str, str | None]]]] = {
    "DeleteFrames": {"video": [("cut", None)], "audio": [("cut", None)]},
    "InsertFrames": {"video": [("insert", "video")], "audio": [("insert", "audio")]},
    "PasteFrames": {"video": [("paste", "video")], "audio": [("paste", "audio")]},
    "CopyPaste": {"video": [("copy", "video")], "audio": [("copy", "audio")]},
    "CropFrames": {"video": [("crop", None)], "audio": [("crop", None)]},
    "Reverse": {"video": [("mirror", None)], "audio": [("mirror", None)]},
    "AddAudio": {"video": [("paste", "audio")], "audio": [("paste", "audio")]},
    "DeleteAudio": {"video": [("cut", "audio")], "audio": [("cut", "audio")]},
    "ReplaceAudio": {"video": [("drop", "audio")], "audio": [("drop", "audio")]},
    "AudioSample": {"video": [("rerate", "audio")], "audio": [("rerate", "audio")]},
    "TimeWarp": {"video": [("insert", "video")], "audio": [("insert", "audio")]},
    "OutputMp4": {"video": [("rerate", "video"), ("rerate", "audio")]},
}
VERBS = ("cut", "insert", "hole", "drop", "crop", "mirror", "rerate", "paste", "copy")
PROGRAM = "array<struct<verb:string,type:string,b:bigint,e:bigint,to:struct<b:bigint,e:bigint>>>"
_PART = "struct<n:bigint,s:bigint,e:bigint>"


def register_transform(op: str, programs: dict[str, list[tuple[str, str | None]]] | None) -> None:
    """Set an operation's programs by media type, or (None) let it leave segments alone."""
    wrong = [v for steps in (programs or {}).values() for v, _ in steps if v not in VERBS]
    if wrong:
        raise ValueError(f"no such transform: {', '.join(wrong)}")
    PROGRAMS.pop(op, None)
    if programs:
        PROGRAMS[op] = programs


def _step(verb: Column, type_: Column, b: Column, e: Column, to: Column) -> Column:
    return F.struct(verb.alias("verb"), type_.alias("type"), b.cast("long").alias("b"), e.cast("long").alias("e"), to.alias("to"))


def compiled(edges: DataFrame) -> DataFrame:
    """edges with their `program`, and without the columns that it was compiled from.

    edges: op, media_type (of the source), add_type, b_start, b_end (the frames that the edge cuts, adds or lays over), to_start, to_end (where
    pasted frames were taken), from_frames, to_frames (of source and target, for a change of rate). Missing columns count as null; steps
    without their frames are left out.
    """
    given = {"media_type": "string", "add_type": "string", **{c: "bigint" for c in ("b_start", "b_end", "to_start", "to_end", "from_frames", "to_frames")}}
    c = {k: (F.col(k) if k in edges.columns else F.lit(None)).cast(kind) for k, kind in given.items()}
    none = F.lit(None).cast("struct<b:bigint,e:bigint>")
    taken = F.when(c["to_start"].isNotNull(), F.struct(c["to_start"].alias("b"), c["to_end"].alias("e"))).otherwise(none)

    def one(x: Column) -> Column:
        rate, placed = x.verb == "rerate", x.verb.isin("paste", "copy")
        inserted = F.coalesce(c["add_type"], F.when(x.verb == "copy", "insert").otherwise("overlay")) == "insert"
        verb = F.when(placed & inserted, "insert").when(placed, "hole").otherwise(x.verb)
        return _step(verb, x.type, F.when(rate, c["from_frames"]).otherwise(c["b_start"]), F.when(rate, c["to_frames"]).otherwise(c["b_end"]), F.when(placed & ~inserted, taken))

    # The programs without their frames, by operation and media type: one constant.
    entry = lambda verb, type_: F.struct(F.lit(verb).alias("verb"), F.lit(type_).cast("string").alias("type"))
    pairs = [(f"{op}|{media}", steps) for op, by_media in PROGRAMS.items() for media, steps in by_media.items()]
    known = F.create_map(*(x for key, steps in pairs for x in (F.lit(key), F.array(*(entry(*s) for s in steps))))) if pairs else F.create_map().cast("map<string,array<struct<verb:string,type:string>>>")
    named = F.try_element_at(known, F.concat(F.col("op"), F.lit("|"), c["media_type"]))
    program = F.coalesce(F.transform(named, one).cast(PROGRAM), F.array().cast(PROGRAM))
    usable = F.filter(program, lambda x: (x.verb == "drop") | (x.b.isNotNull() & x.e.isNotNull()))
    return edges.withColumn("program", usable).drop(*(k for k in given if k in edges.columns))


def inverse(program: Column) -> Column:
    """The program that undoes one, its last step first."""

    def undone(x: Column) -> Column:
        swap = F.when(x.verb == "cut", "insert").when(x.verb == "insert", "cut").when(x.verb == "crop", "uncrop").when(x.verb == "uncrop", "crop").otherwise(x.verb)
        rate = x.verb == "rerate"
        back = _step(swap, x.type, F.when(rate, x.e).otherwise(x.b), F.when(rate, x.b).otherwise(x.e), F.lit(None).cast("struct<b:bigint,e:bigint>"))
        # What was laid over came from another place, which the set keeps.
        given = F.array(back, _step(F.lit("give"), x.type, x.to.b, x.to.e, F.lit(None).cast("struct<b:bigint,e:bigint>")))
        return F.when(x.verb == "drop", F.array().cast(PROGRAM)).when((x.verb == "hole") & x.to.isNotNull(), given.cast(PROGRAM)).otherwise(F.array(back).cast(PROGRAM))

    return F.flatten(F.transform(F.reverse(program), undone))


def _part(n: Column, s: Column, e: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), s.cast("long").alias("s"), e.cast("long").alias("e"))


def run(program: Column, type_: Column, seg_no: Column, start: Column, end: Column) -> Column:
    """array<struct<n, s, e>>: the parts of a segment after a program, n its number, or 0 for a part that was given.

    A scaled part keeps at least a frame and ends with its stream.
    """
    empty = F.array().cast(f"array<{_PART}>")

    def one(p: Column, x: Column) -> Column:
        size = x.e - x.b + 1
        before = _part(p.n, p.s, F.least(p.e, x.b - 1))
        lo, hi = F.greatest(p.s, x.b), F.least(p.e, x.e)
        scaled = F.least(F.greatest(F.round((p.s - 1) * x.e / x.b + 1), F.lit(1)), x.e)
        ended = F.least(F.greatest(F.round(p.e * x.e / x.b), scaled), x.e)
        # Taken as the union's rule has it: a part that starts inside the given frames goes whole.
        kept = F.when((p.e < x.b) | (p.s > x.e), F.array(p)).when(p.s >= x.b, empty).otherwise(F.array(before, _part(p.n, x.e + 1, p.e)))
        return (
            F.when(x.verb == "cut", F.array(before, _part(p.n, F.greatest(p.s, x.e + 1) - size, p.e - size)))
            .when(x.verb == "insert", F.array(before, _part(p.n, F.greatest(p.s, x.b) + size, p.e + size)))
            .when(x.verb == "hole", F.array(before, _part(p.n, F.greatest(p.s, x.e + 1), p.e)))
            .when(x.verb == "crop", F.array(_part(p.n, lo - x.b + 1, hi - x.b + 1)))
            .when(x.verb == "uncrop", F.array(_part(p.n, p.s + x.b - 1, p.e + x.b - 1)))
            .when((x.verb == "mirror") & (lo <= hi), F.array(before, _part(p.n, x.b + x.e - hi, x.b + x.e - lo), _part(p.n, F.greatest(p.s, x.e + 1), p.e)))
            .when(x.verb == "rerate", F.array(_part(p.n, scaled, ended)))
            .when(x.verb == "drop", empty)
            .when(x.verb == "give", kept)
            .otherwise(F.array(p))
        )

    def step(parts: Column, x: Column) -> Column:
        moved = F.filter(F.flatten(F.transform(parts, lambda p: one(p, x))), lambda p: p.s <= p.e)
        given = F.when(x.verb == "give", F.array(_part(F.lit(0), x.b, x.e))).otherwise(empty)
        return F.when(x.type.isNull() | (x.type == type_), F.concat(moved, given)).otherwise(parts)

    # Most edges have no step for a segment's type.
    idle = ~F.exists(program, lambda x: x.type.isNull() | (x.type == type_))
    whole = F.array(_part(seg_no, start, end))
    return F.when(idle, whole).otherwise(F.aggregate(program, whole, step))


def run_all(programs: Column, type_: Column, seg_no: Column, start: Column, end: Column) -> Column:
    """array<struct<n, s, e>>: the parts of a segment after several programs, each part once. Where one leaves nothing, those after it add nothing."""
    passed = lambda parts, x: F.array_distinct(F.flatten(F.transform(parts, lambda p: run(x, type_, p.n, p.s, p.e))))
    return F.aggregate(programs, F.array(_part(seg_no, start, end)), passed)
