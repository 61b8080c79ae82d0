"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import bind, stored, text_or_empty

LONG, SLICE = 16, 8  # words a unit has at most; words a slice of a run without borders has
REACH = 4  # lines beside a repeated chunk that are compared with those of its first occurrence
SPACE = "[\\s\\x85\\p{Z}]"


def units(text: Column, modulus: int = 4) -> Column:
    """The text cut after line ends and, as prose runs on in long lines, after sentence and clause marks; joined they give the text.

    What then has over 48 characters and more than sixteen words is cut at word borders that ``chunks`` finds, and
    slices of eight words where it finds none for long, as in one word over and over.
    """
    parts = F.array_remove(F.split(text, "(?<=\\n)|(?<=[.!?,;:] )"), "")
    is_long = lambda p: (F.length(p) > 3 * LONG) & (_n_words(p) > LONG)
    return bind(parts, lambda ps: F.when(F.exists(ps, is_long), F.flatten(F.transform(ps, lambda p: F.when(is_long(p), _pieces(p, modulus)).otherwise(F.array(p))))).otherwise(ps))


def _pieces(part: Column, modulus: int) -> Column:
    words = F.array_remove(F.split(part, f"(?<={SPACE})(?!{SPACE})"), "")
    run = lambda w, at, n: F.array_join(F.slice(w, at + 1, n), "")

    def cut(w: Column, c: Column) -> Column:
        n = c["end"] - c["start"] + 1
        return F.when(n > LONG, F.transform(F.sequence(c["start"], c["end"], F.lit(SLICE)), lambda at: run(w, at, F.least(F.lit(SLICE), c["end"] - at + 1)))).otherwise(F.array(run(w, c["start"], n)))
    return bind(words, lambda w: F.flatten(F.transform(chunks(w, modulus), lambda c: cut(w, c))))


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"{SPACE}+"), ""))


def chunks(lines: Column, modulus: int) -> Column:
    """(start, end) of the chunks of ``lines``.

    A rolling hash over the hashes of two neighbouring lines ends a chunk where it is
    divisible by ``modulus``, so borders depend on the lines around them alone: what stands
    before a passage shifts no border within it.
    """
    def of(h: Column) -> Column:
        last = F.size(h) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(modulus)) == 0))
        return bind(ends, lambda e: F.transform(e, lambda end, k: F.struct(
            F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0).alias("start"), end.alias("end"))))
    return F.when(F.size(lines) > 0, bind(F.transform(lines, lambda u: F.xxhash64(u)), of))


def _run(u: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(u, start + 1, end - start + 1), "")


def _borders(h: Column) -> Column:
    """Positions at which a chunk begins, by the hashes of the lines around alone.

    They are the first line, lines whose hash is smaller than that of both neighbours, those
    whose hash is larger if neither neighbour is such a line, and repeats of the line
    before.  So no two chunks begin at neighbouring lines (but in repeats), and of eight
    lines in a row one begins a chunk but for three times in ten thousand.
    """
    at = lambda i: F.get(h, i)["hash"]
    yes = lambda c: F.coalesce(c, F.lit(False))

    def begins(i: Column) -> Column:
        low = (at(i) < at(i - 1)) & (at(i) < at(i + 1))
        high = (at(i) > at(i - 1)) & (at(i) > at(i + 1)) & ~yes(at(i - 1) < at(i - 2)) & ~yes(at(i + 1) < at(i + 2))
        return (i == 0) | yes(at(i) == at(i - 1)) | yes(low) | yes(high)
    return F.filter(F.sequence(F.lit(0), F.size(h) - 1), begins)


def line_chunks(u: Column, least_words: int) -> Column:
    """(start, end, hash) of the chunks of the lines ``u``: from each border two lines, or four, or eight, the fewest with ``least_words`` words."""
    def of(x: Column) -> Column:
        words = lambda i: F.get(x, i)["words"]
        total = lambda b, n: sum((words(b + i) for i in range(1, n)), words(b))

        def chunk(b: Column) -> Column:
            # null beyond the last line
            lines = F.when(total(b, 2) >= least_words, 2).when(total(b, 4) >= least_words, 4).when(total(b, 8) >= least_words, 8)
            return bind(lines, lambda n: F.when(n.isNotNull(), F.struct(b.alias("start"), (b + n - 1).alias("end"), F.xxhash64(F.slice(x, b + 1, n)).alias("hash"))))
        return F.when(F.size(x) > 1, F.filter(F.transform(_borders(x), chunk), lambda c: c.isNotNull()))
    return bind(F.transform(u, lambda t: F.struct(F.xxhash64(t).alias("hash"), _n_words(t).alias("words"))), of)


def _share(part: Column, parts: Column, u: Column, text: Column) -> Column:
    """At least this share of the five-word runs of the longer document is common to both, by the lines of ``part``.

    Counted low: each text once, less four words a gap, without lines that a still earlier
    document holds; where the lines are under half of the document it is 0.
    """
    earlier = F.flatten(F.transform(F.filter(parts, lambda x: ~x["itself"] & (x["first"] < part["first"])), lambda x: x["lines"]))
    own = F.array_sort(F.array_except(part["lines"], earlier))

    def of(lines: Column) -> Column:
        gaps = F.size(F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1) != x - 1)))
        words = _n_words(F.array_join(F.array_distinct(F.transform(lines, lambda i: F.get(u, i))), ""))
        return (words - 4 * gaps) / F.greatest(F.greatest(_n_words(text), part["words"]) - 4, F.lit(1))
    return F.when(2 * F.size(part["lines"]) >= F.size(u), bind(own, of)).otherwise(0.0)


def _equal_ends(a: Column, b: Column) -> Column:
    """How many leading entries of two lists are equal."""
    differ = F.filter(F.sequence(F.lit(0), F.lit(REACH)), lambda i: F.coalesce(F.get(a, i) != F.get(b, i), F.lit(True)))
    return F.get(differ, 0)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 4, least_words: int = 8, copy_share: float | None = 0.86) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``n_lines``, ``n_removed``, ``is_copy``.

    Chunks of several lines and ``least_words`` words at least begin where the hashes of
    the lines around say so (``_borders``), so what stands before a passage does not shift
    them.  A chunk that occurs elsewhere too is removed but for its first occurrence, in the
    order of key and place, after comparing it byte by byte, and with it up to four
    lines on either side, as far as they too equal those of the first occurrence.  So a
    passage goes whole although its ends fall within chunks.  What is removed stays where
    it occurs first; where passages overlap, line by line.

    A document of which one earlier document holds ``copy_share`` (of the five-word runs of
    the longer of both) is a copy as a whole: it is left as it is and marked ``is_copy``,
    for a stage that drops documents; None takes passages out of copies too.  At 0.86 both
    have a Jaccard similarity of 0.75 at least, so near-duplicate removal drops one of
    them; a smaller value leaves repeated passages that no stage takes out.

    A null or empty text stays as it is.  Repeated rows are one document and treated
    alike; rows of one key and different texts are different documents, a null key
    comes first.  Other columns are kept; those with the names of the results are replaced.

    Every text is cut once and the hashes of its chunks written; only documents that hold a
    repeated hash are cut again, and only their repeated chunks are moved as text.  The
    table itself is moved once: both joins with it use the same columns and keys and so
    share one exchange.  A chunk of a third of all documents is one row a task in the
    counts, and one key of plain joins that the runtime may split.
    """
    new = ("n_lines", "n_removed", "is_copy")
    kept = [c for c in docs.columns if c not in new]
    # the columns of the table stay together, so that none can meet a name used here
    rows = docs.select(F.struct(*kept).alias("row")).select("row", F.col("row").getField(key).alias("id"), F.xxhash64(F.col("row").getField(text)).alias("digest"))
    body = F.col("row").getField(text)
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))

    cut = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), units(text_or_empty(text), modulus).alias("u"))
    hashed = stored(cut.select("id", "digest", F.size("u").alias("lines"), F.transform(line_chunks(F.col("u"), least_words), lambda c: c["hash"]).alias("hashes")), "line-chunks")
    seen = hashed.select("id", "digest", F.explode("hashes").alias("hash"))
    # repeated rows of one document repeat its chunks too, which costs a comparison and removes nothing
    repeated = seen.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    wanted = stored(seen.join(repeated, "hash").groupBy("id", "digest").agg(F.collect_set("hash").alias("hashes")), "wanted-chunks")

    # the hash of the whole row keeps all columns in the exchange, as the last join needs them
    found = rows.alias("r").join(wanted.alias("p"), same("r", "p")).select(
        "r.id", "r.digest", F.xxhash64("row").alias("whole"), units(F.coalesce(body, F.lit("")), modulus).alias("u"), _n_words(body).alias("words"), "hashes")
    u = F.col("u")
    held = found.select("id", "digest", "whole", "words", u, F.filter(line_chunks(u, least_words), lambda c: F.array_contains("hashes", c["hash"])).alias("cs"))
    # outer, as a filter that the optimizer infers for a plain one would cut every text a second time
    held = held.select("id", "digest", "whole", "words", u, "cs", F.posexplode_outer("cs").alias("k", "c")).where("k IS NOT NULL")
    start, end, ahead, behind = F.col("c.start"), F.col("c.end"), F.get("cs", F.col("k") + 1)["start"], F.get("cs", F.col("k") - 1)["end"]
    # lines between two chunks go with the first of them
    n_after = F.greatest(F.lit(0), F.least(F.coalesce(ahead - end - 1, F.lit(REACH)), F.lit(REACH)))
    n_before = F.when(behind.isNotNull() & (start - behind - 1 <= REACH), 0).otherwise(F.least(start, F.lit(REACH)))
    held = stored(held.select(
        "id", "digest", "whole", "words", F.col("c.hash").alias("hash"), start.alias("start"), end.alias("end"), _run(u, start, end).alias("chunk"),
        F.reverse(F.slice(u, start - n_before + 1, n_before)).alias("before"), F.slice(u, end + 2, n_after).alias("after")), "repeated-chunks")
    # the first occurrence with what is compared, in one count; repeated rows of a document give equal rows here
    firsts = held.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(
        "id", "digest", "start", "end", "words", "chunk", "before", "after")).alias("first")).where("n > 1").drop("n")
    itself = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    again = held.join(firsts, "hash").where((F.col("chunk") == F.col("first.chunk")) & ~(itself & (F.col("start") == F.col("first.start"))))
    # a chunk that overlaps its own first occurrence leaves that whole, and is not drawn out
    begin = F.when(itself, F.greatest(F.col("start"), F.col("first.end") + 1)).otherwise(F.col("start") - _equal_ends(F.col("before"), F.col("first.before")))
    stop = F.when(itself, F.col("end")).otherwise(F.col("end") + _equal_ends(F.col("after"), F.col("first.after")))
    again = again.select("id", "digest", itself.alias("itself"), F.struct("first.id", "first.digest").alias("origin"), F.col("first.words").alias("fwords"), begin.alias("begin"), stop.alias("stop")).where("begin <= stop")
    by_first = again.groupBy("id", "digest", "origin", "itself", "fwords").agg(F.collect_set(F.struct("begin", "stop")).alias("runs")).select(
        "id", "digest", F.struct("itself", F.col("origin").alias("first"), F.col("fwords").alias("words"), F.array_distinct(F.flatten(
            F.transform("runs", lambda x: F.sequence(x["begin"], x["stop"])))).alias("lines")).alias("part"))
    # written, so that the chunks and their shuffles are gone when the table is moved
    drops = stored(by_first.groupBy("id", "digest").agg(F.collect_list("part").alias("parts")), "repeated-lines")
    known = hashed.groupBy("id", "digest").agg(F.first("lines").alias("lines")).alias("h").join(drops.alias("d"), same("h", "d"), "left").select("h.id", "h.digest", "lines", "parts")

    joined = rows.alias("r").join(known.alias("k"), same("r", "k"), "left").select("row", "lines", "parts")

    def cleaned(u: Column) -> Column:
        copy = F.exists("parts", lambda x: ~x["itself"] & (_share(x, F.col("parts"), u, body) >= copy_share)) if copy_share is not None else F.lit(False)
        gone = F.array_distinct(F.flatten(F.transform("parts", lambda x: x["lines"])))
        left = lambda g: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(u) - 1), g), lambda i: F.get(u, i)), "")
        result = lambda value, n, is_copy: F.struct(value.alias("text"), n.cast("long").alias("n"), is_copy.alias("copy"))
        return bind(copy, lambda c: F.when(c, result(body, F.lit(0), F.lit(True))).otherwise(bind(gone, lambda g: result(left(g), F.size(g), F.lit(False)))))
    # in one expression that cuts the text once, as a filter on its result is moved to before the columns it is made from
    cut_again = bind(units(F.coalesce(body, F.lit("")), modulus), cleaned)
    untouched = F.struct(body.alias("text"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("copy"))
    joined = joined.withColumn("after", F.when(F.col("parts").isNotNull(), cut_again).otherwise(untouched))
    return joined.select(
        *[(F.col("after.text") if c == text else F.col("row").getField(c)).alias(c) for c in kept],
        F.coalesce("lines", F.lit(0)).cast("long").alias("n_lines"), F.col("after.n").alias("n_removed"), F.col("after.copy").alias("is_copy"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages removed; documents left without any text by that go.  All columns as before."""
    found = dedup_lines(docs, key, text, **options)
    return found.where((F.col("n_removed") == 0) | (F.regexp_replace(text, "\\s+", "") != "")).select(*docs.columns)
