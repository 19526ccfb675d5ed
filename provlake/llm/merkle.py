"""Document fingerprints: a Merkle tree over sections and paragraphs.

A paragraph is a line with its line end; its leaves are phrases, cut after punctuation or 80 characters. A section ends
after a blank line and after any paragraph whose hash starts with one of CUT's digits, so that its borders depend on what
stands there and an insertion leaves the other sections as they were. A leaf's hash is taken from its text, a paragraph's
from its leaves' hashes, a section's from its paragraphs' and the root's from the sections'. No character is left out, so
equal roots mean equal texts, and where two roots differ only the branches with differing hashes need a look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

PARAGRAPH = r"[^\n]*\n|[^\n]+"
LEAF = r"[^.,;:!?\n]{0,80}[.,;:!?\n]|[^.,;:!?\n]{1,80}"
#: First hex digits of a paragraph's hash that end a section: two of sixteen, so eight paragraphs on average.
CUT = "08"
#: Hex digits of a leaf's hash that the comparison keeps, and of a section's in a printed fingerprint.
LEAF_DIGITS, SECTION_DIGITS = 8, 16
#: Groups that rows without an id are dealt into.
SPREAD = 256


def digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def with_tree(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add prefix_leaves (array of all leaf hashes, shortened), prefix_tree (array of each paragraph's number of code points,
    whether it is blank, and leaf hashes), prefix_paragraphs (hashes), prefix_blocks (each section's paragraph hashes, joined),
    prefix_sections (hashes) and prefix_root. Each level is a column of its own, so that no hash is taken twice."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), digest)
        return F.struct(F.length(p).alias("n"), F.trim(p).isin("", "\n", "\r\n").alias("blank"), leaves.alias("leaves"))

    docs = docs.withColumn(f"{prefix}_tree", F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), paragraph))
    docs = docs.withColumn(f"{prefix}_leaves", F.transform(F.flatten(F.col(f"{prefix}_tree.leaves")), lambda h: F.substring(h, 1, LEAF_DIGITS)))
    docs = docs.withColumn(f"{prefix}_paragraphs", F.transform(f"{prefix}_tree", lambda p: digest(F.array_join(p.leaves, ""))))
    ends = lambda p, h: F.when(p.blank | F.substring(h, 1, 1).isin(*CUT), F.lit("|")).otherwise(F.lit(""))
    joined = F.array_join(F.zip_with(f"{prefix}_tree", f"{prefix}_paragraphs", lambda p, h: F.concat(h, ends(p, h))), "")
    docs = docs.withColumn(f"{prefix}_blocks", F.filter(F.split(joined, "[|]"), lambda b: b != ""))
    docs = docs.withColumn(f"{prefix}_sections", F.transform(f"{prefix}_blocks", digest))
    return docs.withColumn(f"{prefix}_root", F.sha2(F.array_join(f"{prefix}_sections", ""), 256))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprints, 0 to 1: 1 if the roots are equal, else distinct leaves in both over those of the larger, n; at most
    n / (n + 1), as the same leaves may stand in another order."""
    x, y = F.array_distinct(f"{a}_leaves"), F.array_distinct(f"{b}_leaves")
    most = F.greatest(F.size(x), F.size(y))
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), 1.0).when(most == 0, 0.0).otherwise(F.round(F.least(F.size(F.array_intersect(x, y)) / most, most / (most + 1)), 6))


def same_start(x: str, y: str) -> Column:
    """Number of equal elements at the start of two array columns."""
    most = F.least(F.size(x), F.size(y))
    differs = F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | (F.get(x, i) != F.get(y, i)))
    return F.get(differs, F.lit(0))


def with_edit_place(docs: DataFrame, a: str, b: str, text: str) -> DataFrame:
    """Add edit_sections (sections of tree b that tree a does not hold) and edit_start (the code point of `text`, the text of
    tree a, where the first phrase stands that differs; null if none does), by descent from the roots: the sections before
    the first differing one are passed over by their hashes, then its paragraphs, then the phrases of its first differing one.
    """
    section, paragraph, phrases, mine, its = unused(docs, "section", "paragraph", "phrases", "mine", "its")
    out = docs.withColumn("edit_sections", F.size(F.array_except(f"{b}_sections", f"{a}_sections")).cast("long"))
    out = out.withColumn(section, same_start(f"{a}_sections", f"{b}_sections"))
    # A block holds 32 digits for each paragraph.
    before = F.aggregate(F.slice(f"{a}_blocks", F.lit(1), F.col(section)), F.lit(0), lambda n, x: n + F.floor(F.length(x) / 32).cast("int"))
    out = out.withColumn(section, before)

    def rest(t: str) -> Column:
        """Hashes of the paragraphs from that section on."""
        return F.slice(f"{t}_paragraphs", F.col(section) + 1, F.greatest(F.size(f"{t}_paragraphs") - F.col(section), F.lit(0)))

    out = out.withColumns({mine: rest(a), its: rest(b)})
    out = out.withColumn(paragraph, F.col(section) + same_start(mine, its))
    at = F.aggregate(F.slice(f"{a}_tree", F.lit(1), F.col(paragraph)), F.lit(0), lambda n, p: n + p.n)
    leaves = {c: F.coalesce(F.get(F.col(f"{t}_tree"), F.col(paragraph)).leaves, F.array().cast("array<string>")) for c, t in ((mine, a), (its, b))}
    out = out.withColumns({**leaves, section: at})
    at = F.col(section)
    # The phrases of the one paragraph, whose lengths give the place.
    out = out.withColumn(phrases, F.regexp_extract_all(F.substring(text, at + 1, F.coalesce(F.get(F.col(f"{a}_tree"), F.col(paragraph)).n, F.lit(0))), F.lit(LEAF), F.lit(0)))
    start = at + F.aggregate(F.slice(phrases, F.lit(1), same_start(mine, its)), F.lit(0), lambda n, x: n + F.length(x))
    return out.withColumn("edit_start", F.when(F.col(f"{a}_root") != F.col(f"{b}_root"), start.cast("long"))).drop(section, paragraph, phrases, mine, its)


def next_ids(docs: DataFrame, key: str, partitions: int) -> DataFrame:
    """(key, next_key) over distinct non-null keys in ascending order, the last followed by the first.

    Range partitions are sorted apart; only the first key of each partition, one row a partition, meets its neighbours.
    """
    ids = docs.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(partitions, key)
    ids = materialize(ids.withColumn("_part", F.spark_partition_id()), "ranges")
    firsts = ids.groupBy("_part").agg(F.min(key).alias("_first"))
    # At most one row a partition, so its size is bounded by `partitions`.
    firsts = firsts.select("_first", F.expr("coalesce(lead(_first) over (order by _part), first(_first) over (order by _part))").alias("_after"), "_part")
    within = ids.select(key, "_part", F.expr(f"lead({key}) over (partition by _part order by {key})").alias("_lead"))
    return within.join(F.broadcast(firsts.select("_part", "_after")), "_part").select(key, F.coalesce("_lead", "_after").alias("next_key"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text and the next document's, by ascending id, and compare them.

    The edited text has the last quarter of the code points (rounded down) replaced by as many, or all, from the start of
    the next document; the last document is followed by the first. Null texts are empty. Documents that share an id have
    the same next document, that of the next larger id (of several its smallest text); null ids are followed by the first id.

    One row for each input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edit_sections, edit_start (see with_edit_place).
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both joins below deal the texts out by (no_id, id), which are never null: the optimizer adds no filter of its own to
    # either side, so the two exchanges are the same and the texts are shuffled once.
    key = F.col(doc_id).cast("long")
    # Rows without an id, which may be many, are dealt by their texts.
    dealt = F.pmod(F.xxhash64(F.col(text)), F.lit(SPREAD))
    base = docs.select(key.isNull().alias("no_id"), F.coalesce(key, dealt, F.lit(0).cast("long")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = base.where("not no_id")
    pairs = next_ids(known, "id", n).select(F.lit(False).alias("no_id"), "id", F.col("next_key").alias("next_id"))
    after_null = known.agg(F.min("id").alias("next_id")).where("next_id is not null").select(F.lit(True).alias("no_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("id"), "next_id")
    pairs = materialize(pairs.unionByName(after_null).withColumn("next_no_id", F.lit(False)), "next")
    # What a document tells those before it: up to as many code points as they replace, and its tree.
    need = base.groupBy("no_id", "id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"))
    asked = pairs.join(need, ["no_id", "id"]).groupBy(F.col("next_no_id").alias("no_id"), F.col("next_id").alias("id")).agg(F.max("need").alias("need"))
    tell = base.join(asked, ["no_id", "id"]).select(F.col("no_id").alias("next_no_id"), F.col("id").alias("next_id"), F.col("text").alias("_text"), F.expr("left(text, need)").alias("head"))
    tell = with_tree(tell, "_text", "n").groupBy("next_no_id", "next_id").agg(F.min_by(F.struct("head", "n_leaves", "n_root"), "_text").alias("t"))
    told = pairs.join(tell, ["next_no_id", "next_id"]).select("no_id", "id", "t.*")
    all_ = base.join(told, ["no_id", "id"], "left").withColumn("n_chars", F.length("text").cast("long"))
    all_ = all_.withColumn("doc_id", F.when(~F.col("no_id"), F.col("id")))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.coalesce(F.substring("head", F.lit(1), cut), F.lit("")))
    out = with_tree(all_.withColumn("edited", edited), "text", "o")
    out = with_edit_place(with_tree(out, "edited", "e"), "o", "e", "text")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        serialized("o").alias("fingerprint"),
        serialized("e").alias("edited_fingerprint"),
        likeness("o", "e").cast("double").alias("near_edited"),
        F.coalesce(likeness("o", "n"), F.lit(0.0)).cast("double").alias("near_next"),
        "edit_sections",
        "edit_start",
    )


def serialized(prefix: str) -> Column:
    """The root, the sections below it and the leaves, apart by colons: enough to tell equal texts, to find the sections that differ and to
    compute the likeness of two fingerprints from them alone."""
    sections = F.array_join(F.transform(f"{prefix}_sections", lambda h: F.substring(h, 1, SECTION_DIGITS)), ".")
    return F.concat_ws(":", f"{prefix}_root", sections, F.array_join(f"{prefix}_leaves", "."))
