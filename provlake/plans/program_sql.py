"""Transform programs in DuckDB's SQL: one verb for each operation, media and segment type, and what it makes of a segment."""

from __future__ import annotations


def verb(op: str, media: str, add: str, kind: str) -> str:
    """The forward verb of an operation for a segment of a type."""
    paste = f"CASE WHEN {add} = 'insert' THEN 'insert' ELSE 'hole' END"
    copy = f"CASE WHEN coalesce({add}, 'insert') = 'insert' THEN 'insert' ELSE 'hole' END"
    av, same, sound = f"{media} IN ('video', 'audio')", f"{media} = {kind} AND {media} IN ('video', 'audio')", f"{media} IN ('video', 'audio') AND {kind} = 'audio'"
    rows = [
        (f"{op} = 'DeleteFrames' AND {av}", "'cut'"), (f"{op} IN ('InsertFrames', 'TimeWarp') AND {same}", "'insert'"), (f"{op} = 'PasteFrames' AND {same}", paste), (f"{op} = 'CopyPaste' AND {same}", copy),
        (f"{op} = 'CropFrames' AND {av}", "'crop'"), (f"{op} = 'Reverse' AND {av}", "'mirror'"), (f"{op} = 'AddAudio' AND {sound}", paste), (f"{op} = 'DeleteAudio' AND {sound}", "'cut'"),
        (f"{op} = 'ReplaceAudio' AND {sound}", "'drop'"), (f"({op} = 'AudioSample' AND {sound}) OR ({op} = 'OutputMp4' AND {media} = 'video')", "'rerate'"),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN {v}" for cond, v in rows) + " ELSE 'pass' END"


def parts(v: str, back: bool, n: str, s: str, e: str, b: str, z: str, size: str, ts: str = "NULL::BIGINT", te: str = "NULL::BIGINT", f0: str = "NULL::BIGINT", f1: str = "NULL::BIGINT") -> str:
    """A list of (n, s, e), empty ones included: segment n, s..e after the verb with frames b..z, or before it."""
    part = lambda x, y, k=n: f"{{'n': {k}, 's': {x}, 'e': {y}}}"
    left = part(s, f"least({e}, {b} - 1)")
    cut = f"[{left}, {part(f'greatest({s}, {z} + 1) - {size}', f'{e} - {size}')}]"
    insert = f"[{left}, {part(f'greatest({s}, {b}) + {size}', f'{e} + {size}')}]"
    hole = f"[{left}, {part(f'greatest({s}, {z} + 1)', e)}]"
    whole = f"[{part(s, e)}]"
    lo, hi = f"greatest({s}, {b})", f"least({e}, {z})"
    crop = f"[{part(f'{s} + {b} - 1', f'{e} + {b} - 1')}]" if back else f"[{part(f'{lo} - {b} + 1', f'{hi} - {b} + 1')}]"
    mirror = f"CASE WHEN {lo} > {hi} THEN {whole} ELSE [{left}, {part(f'{b} + {z} - {hi}', f'{b} + {z} - {lo}')}, {part(f'greatest({s}, {z} + 1)', e)}] END"
    one, two = (f1, f0) if back else (f0, f1)
    start = f"least(greatest(round(({s} - 1) * {two} / {one} + 1), 1), {two})::BIGINT"
    rate = f"CASE WHEN {one} IS NULL OR {two} IS NULL THEN {whole} ELSE [{part(start, f'least(greatest(round({e} * {two} / {one}), {start}), {two})::BIGINT')}] END"
    if back:
        cut, insert = insert, cut
        split = f"CASE WHEN p.e < {ts} OR p.s > {te} THEN [p] WHEN p.s >= {ts} THEN [] ELSE [{{'n': p.n, 's': p.s, 'e': {ts} - 1}}, {{'n': p.n, 's': {te} + 1, 'e': p.e}}] END"
        given = f"list_append(flatten(list_transform(list_filter({hole}, lambda p: p.s <= p.e), lambda p: {split})), {part(ts, te, '0::BIGINT')})"
        hole = f"CASE WHEN {ts} IS NULL THEN {hole} ELSE {given} END"
    drop = whole if back else f"list_filter({whole}, lambda p: false)"
    return f"CASE {v} WHEN 'cut' THEN {cut} WHEN 'insert' THEN {insert} WHEN 'hole' THEN {hole} WHEN 'crop' THEN {crop} WHEN 'mirror' THEN {mirror} WHEN 'rerate' THEN {rate} WHEN 'drop' THEN {drop} ELSE {whole} END"
