"""Line deduplication by a deletion-neighbourhood join; DataFrame functions only.

A line goes if an earlier line (smaller (doc_id, place in the document)) differs from it by at most one
edit: one code point inserted, deleted or replaced.  Lines are judged on the input, so a line that goes
still counts as an earlier one.  An edit is allowed for every `min_chars` code points, up to one: of shorter
lines only exact repeats go, if they have `exact_chars` or more and a word (a letter or digit), so blank lines
and rulers stay; op8_line_dedup and the pipeline set `exact_chars` to 1 (None: short lines stay).

1. *Equal lines* meet on their hashes; the first of each stands for all.
2. *Contexts.*  For a shorter length c a line is cut into q segments; if one edit leads to another line,
   all but one segment agree (those before it counted from the left, those after it from the right).  So
   only lines whose context of some segment occurs twice can have a neighbour: first with q = 2 for all
   lines, then with q near the root of c for what is left.  Both filters lose nothing.  Segments are hashed
   once and contexts from these hashes, so a line of n code points costs some n steps and 3 sqrt(n) keys.
3. *Deletion variants* of the one open segment are emitted as keys, hashed with their context: sqrt(n)
   variants of sqrt(n) code points.  Lines of the same length join on (place, segment without that code
   point); a longer line's variants join the whole segments of lines one shorter.  Every line takes the
   earliest line it meets as witness, by aggregates, so no pairs are formed within a group.
4. Each line is compared with its witness, without the code point that the variant lacks: their edit
   distance is then one at most.  (`levenshtein` would take the square of the length.)

Edge cases: null text has no lines and stays null; an empty table gives an empty result; rows of one
doc_id count as one document (a line is never earlier than itself); rows without doc_id stay as they are;
extra columns are kept, but for columns named like the two counts, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.scratch import forget, stored

MIN_CHARS = 20
WORD = r"[\p{L}\p{N}]"
#: (doc_id, place) pairs that may be broadcast (32 MB); beyond, the join is shuffled.
SMALL_IDS = 1_000_000
COARSE = 2


def lines_of(docs: DataFrame, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    long = F.col("len") >= min_chars
    short = F.lit(False) if exact_chars is None else (F.col("len") >= exact_chars) & F.col("line").rlike(WORD)
    return lines.withColumn("len", F.char_length("line")).where(long | short)


def context_keys(q: int) -> list[str]:
    """SQL of the hashed context of each segment, for the line's own length and for one less as shorter length."""
    return [
        f"xxhash64(left(line, cast({c} * {j} / {q} as int)), right(line, {c} - cast({c} * {j + 1} / {q} as int)), {c}, {j})"
        for c in ("len", "(len - 1)") for j in range(q)
    ]


def shared(entries: DataFrame) -> DataFrame:
    """Entries whose key occurs more than once (c and j are part of the hashed key)."""
    often = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    return entries.join(often, "key", "left_semi")


def segment_hashes(lines: DataFrame) -> DataFrame:
    """(doc_id, place, len, and for both shorter lengths c: q, hashes of the segments from the left and from the right)."""
    for c, name in (("len", "same"), ("(len - 1)", "less")):
        lines = lines.withColumn(f"q_{name}", F.expr(f"cast(greatest(8, ceil(sqrt({c}))) as int)"))
    hashes = lambda c, q, shift: F.expr(
        f"transform(sequence(0, {q} - 1), j -> xxhash64(substring(line, {begin_of(c, 'j', q)} + {1 + shift}, {begin_of(c, 'j + 1', q)} - {begin_of(c, 'j', q)})))")
    return lines.select("doc_id", "place", "len", "q_same", "q_less", hashes("len", "q_same", 0).alias("same"),
                        hashes("(len - 1)", "q_less", 0).alias("left"), hashes("(len - 1)", "q_less", 1).alias("right"))


def begin_of(c: str, j: str, q: str) -> str:
    """SQL of the place where segment j begins."""
    return f"cast(cast({c} as bigint) * ({j}) div {q} as int)"


def witnesses(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, place, by): the earliest neighbours of lines(doc_id, place, line, len) that have an earlier one; and the tables it reads."""
    hashed = stored(segment_hashes(lines), "segment-hashes")  # written, so that no step computes them once for each segment
    keys = lambda c, q, left, right: (
        f"transform(sequence(0, {q} - 1), j -> named_struct('c', {c}, 'q', {q}, 'j', j, 'key', "
        f"xxhash64(slice({left}, 1, j), slice({right}, j + 2, {q}), {c}, j)))")
    found = F.expr(f"concat({keys('len', 'q_same', 'same', 'same')}, {keys('len - 1', 'q_less', 'left', 'right')})")
    entries = hashed.select("doc_id", "place", F.explode(found).alias("x")).select("doc_id", "place", "x.c", "x.q", "x.j", "x.key")
    fine = shared(entries).join(lines, ["doc_id", "place"])
    begin, end = begin_of("c", "j", "q"), begin_of("c", "j + 1", "q")
    segment = F.expr(f"substring(line, {begin} + 1, len - (c - {end}) - {begin})")
    at = F.struct("doc_id", "place").alias("at")
    segments = stored(fine.select(at, "len", "c", "key", F.expr(begin).alias("begin"), segment.alias("segment")), "segments")
    fine = segments.withColumn("n", F.char_length("segment"))
    without = "transform(sequence(1, n), p -> named_struct('p', begin + p, 'v', concat(left(segment, p - 1), substring(segment, p + 1))))"
    whole = fine.where("len = c").select("at", F.expr("xxhash64(key, 'shorter', segment)").alias("v"), F.lit(0).alias("p"))
    cut = fine.where("n > 0").select("at", "len", "c", "key", F.explode(F.expr(without)).alias("d"))
    longer = cut.where("len = c + 1").select("at", F.expr("xxhash64(key, 'shorter', d.v)").alias("v"), "d.p")
    equal = cut.where("len = c").select("at", F.expr("xxhash64(key, d.p, d.v)").alias("v"), "d.p")

    near = whole.unionByName(longer)
    place = F.struct("at", "p")
    firsts = near.groupBy("v").agg(F.min(F.when(F.col("p") == 0, place)).alias("w0"), F.min(F.when(F.col("p") > 0, place)).alias("w1"))
    near = near.join(firsts.where("w0 IS NOT NULL AND w1 IS NOT NULL"), "v").select("at", F.when(F.col("p") > 0, F.struct(F.col("w0.at"), "p", F.lit("longer").alias("kind"))).otherwise(
        F.struct("w1.at", "w1.p", F.lit("shorter").alias("kind"))).alias("by"))
    same = equal.groupBy("v").agg(F.min("at").alias("w"), F.count("*").alias("m")).where("m > 1").drop("m")
    same = equal.join(same, "v").select("at", F.struct(F.col("w").alias("at"), "p", F.lit("same").alias("kind")).alias("by"))
    met = near.unionByName(same).where("by.at < at").groupBy("at", F.col("by.at").alias("w")).agg(F.min("by").alias("by"))
    return met.select("at.doc_id", "at.place", "by"), [hashed, segments]


def verified(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, place) of found whose line and witness are the same but for the code point at the place found."""
    text = lines.select(F.col("doc_id").alias("d"), F.col("place").alias("w"), F.col("line").alias("witness"))
    both = found.join(lines, ["doc_id", "place"]).join(text, (F.col("by.at.doc_id") == F.col("d")) & (F.col("by.at.place") == F.col("w")))
    without = lambda x: f"concat(left({x}, by.p - 1), substring({x}, by.p + 1))"
    agree = (f"CASE by.kind WHEN 'same' THEN char_length(line) = char_length(witness) AND {without('line')} = {without('witness')} "
             f"WHEN 'longer' THEN {without('line')} = witness ELSE line = {without('witness')} END")
    return both.where(agree).select("doc_id", "place").distinct()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, place) of the lines that go, and the stored tables that it reads."""
    lines = lines_of(docs, min_chars, exact_chars)
    keys = [f"k{i}" for i in range(2 * COARSE)]
    hashed = stored(lines.select("doc_id", "place", "len", F.xxhash64("line").alias("h"), F.hash("line").alias("g"),
                                 *[F.expr(f"if(len >= {min_chars}, {k}, NULL)").alias(n) for n, k in zip(keys, context_keys(COARSE), strict=True)]), "lines")
    firsts = stored(hashed.groupBy("h", "g", "len").agg(F.min(F.struct("doc_id", "place", *keys)).alias("m"), F.count("*").alias("n")), "first-lines")
    often = firsts.where("n > 1").select("h", "g", "len", F.col("m.doc_id").alias("d"), F.col("m.place").alias("p"))
    equal = hashed.select("doc_id", "place", "h", "g", "len").join(often, ["h", "g", "len"]).where("doc_id <> d OR place <> p").select("doc_id", "place")

    coarse = firsts.where(F.col("len") >= min_chars).select("m.doc_id", "m.place", F.explode(F.array(*[f"m.{k}" for k in keys])).alias("key"))
    wanted = stored(shared(coarse).select("doc_id", "place").distinct(), "wanted-lines")
    texts = lines_of(docs, min_chars).join(F.broadcast(wanted) if wanted.count() <= SMALL_IDS else wanted, ["doc_id", "place"], "left_semi")
    texts = stored(texts.select("doc_id", "place", "line", "len"), "line-texts")
    found, read = witnesses(texts)
    near = stored(verified(found, texts), "near-lines")
    forget(*read)
    return equal.unionByName(near), [hashed, firsts, wanted, texts, near]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """docs with text without the lines that go, and two more columns: n_lines and n_removed."""
    joined, gone, kept = _without(docs, min_chars, exact_chars)
    return joined.select(
        *[kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


def clean_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """docs, the same columns, without the lines that go; a column n_chars follows the text where it changes."""
    joined, gone, kept = _without(docs, min_chars, exact_chars)
    length = F.when(gone.isNull(), F.col("n_chars")).otherwise(F.char_length(kept)) if "n_chars" in docs.columns else None
    own = {"text": kept, "n_chars": length}
    return joined.select(*[own[f.name].cast(f.dataType).alias(f.name) if f.name in own else F.col(f"`{f.name}`") for f in docs.schema])


def _without(docs: DataFrame, min_chars: int, exact_chars: int | None) -> tuple[DataFrame, Column, Column]:
    """docs joined with the places of the lines that go, these places and the text without them."""
    lines, sources = repeated_lines(docs, min_chars, exact_chars)
    name = "__gone"
    while name in docs.columns:
        name += "_"
    gone = stored(lines.groupBy("doc_id").agg(F.collect_set("place").alias(name)), "gone")
    forget(*sources)
    # One plan at every size: texts are dealt by doc_id, the few removed places are the hashed side.
    joined = docs.join(gone.hint("shuffle_hash"), "doc_id", "left")
    kept = F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains({name}, i)), '\\n')")
    return joined, F.col(name), F.when(F.col(name).isNull(), F.col("text")).otherwise(kept)
