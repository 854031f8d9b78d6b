"""Scanning lines into feet (S-*)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stichos.functions import feet as ft, phonemes as ph, text as tx
from stichos.functions.text import let
from stichos.operators import scan_arrays

FALLBACK = "fallback"
PASSES = (1, 2, 3, 4, 5)


def scan_lines(lines: DataFrame, sound_text: str = "text", approach: str = ph.STUDENT,
               passes=PASSES) -> DataFrame:
    """S-5 ... S-10, S-12 for one approach: one row in, one row out, no shuffle.

    Adds scan_pass, feet, scanned, ambiguous, syl (bit sets), long (set of long syllables).
    What later passes need is only computed for lines that no earlier pass can read;
    several readings end the search in failure.

    Lines in the plain alphabet (see scan_arrays) are read in batches. The steps below read the few others, and have nothing to do for a plain line.
    """
    plain = F.arrow_udf(scan_arrays.scanner(approach, tuple(passes)), scan_arrays.scan_type())
    df = lines.withColumn("_plain", plain(F.col(sound_text).cast("string")))
    known, text, sound_text = F.col("_plain.known"), sound_text, "_odd"
    df = df.withColumn("_odd", F.when(~known, F.col(text)))
    df = df.withColumn("_k", ph.skeleton(ph.merged_text(sound_text, 0), approach))
    # Running vowels together only lowers the count. A line stays open if it has enough syllables with none run together
    # and few enough with all; each pass then asks for its own count, before the sets of the line are read.
    most = max(ph.SYNIZESIS_OF_PASS[p] for p in passes)
    count = ph.nuclei_count("_k")
    merged_count = ph.nuclei_count(ph.skeleton(ph.merged_text(sound_text, most), approach))
    fits = (count >= ft.MIN_SYLLABLES) & ((count <= ft.MAX_SYLLABLES) | (merged_count <= ft.MAX_SYLLABLES))
    df = df.withColumn("_open", F.coalesce(fits, F.lit(False)))
    sets: dict[int, dict] = {}
    starts: dict[int, dict] = {}
    for p in passes:
        level, relax = ph.SYNIZESIS_OF_PASS[p], ft.LEVEL_OF_PASS[p]
        if level not in sets:
            if level == 0:
                df = df.withColumn("_t", F.when(F.col("_open"), ph.cv_pattern("_k")))
            else:
                # a line in which nothing runs together keeps its sets
                df = df.withColumn("_m", F.when(F.col("_open"), ph.merged_text(sound_text, level)))
                changed = F.contains("_m", F.lit("Y")) if 0 in sets else F.col("_m").isNotNull()
                df = df.withColumn("_t", F.when(changed, ph.cv_pattern(ph.skeleton("_m", approach))))
            df, packed = _stage(df, f"_r{level}", ph.packed_sets("_t", approach))
            own = ph.syllable_sets(packed)
            if level and 0 in sets:
                own = {c: F.coalesce(v, sets[0][c]) for c, v in own.items()}
            df, sets[level] = _stage(df, f"_b{level}", own)
            df, weight = _stage(df, f"_w{level}", ft.weights(sets[level]))
            df, starts[level] = _stage(df, f"_f{level}", ft.foot_starts(weight))
        at, n = starts[level], sets[level]["n"]
        df = df.withColumn("_ok", _apart(ft.readable(at, relax, None, 3)))
        df = df.withColumn("_ok", ft.readable(at, relax, F.col("_ok"), 2))
        found = (_apart(F.col("_open")) & n.between(ft.MIN_SYLLABLES, ft.MAX_SYLLABLES)
                 & (ph.both(F.col("_ok"), ft.first_digit(n)) != 0))
        df = df.withColumn(f"_h{p}", F.coalesce(found, F.lit(False)))
        df = df.withColumn("_open", F.col("_open") & ~F.col(f"_h{p}"))

    def of_pass(values: dict[int, dict], name: str) -> Column:
        """The value that belongs to the pass that found a reading."""
        return F.coalesce(*[F.when(F.col(f"_h{p}"), values[ph.SYNIZESIS_OF_PASS[p]][name]) for p in passes])

    hit = F.coalesce(*[F.when(F.col(f"_h{p}"), F.lit(p)) for p in passes])
    relax = F.coalesce(*[F.when(F.col(f"_h{p}"), F.lit(ft.LEVEL_OF_PASS[p])) for p in passes])
    df = df.select(*lines.columns, "_plain", "_odd", _apart(hit).alias("scan_pass"), relax.alias("_relax"),
                   *[of_pass(sets, c).alias(f"_b_{c}") for c in ph.SET_NAMES],
                   *[of_pass(starts, c).alias(f"_f_{c}") for c in ("d0", "d1", "d2", "s0", "s2", "f0", "f2")])
    at = {c: F.col(f"_f_{c}") for c in ("d0", "d1", "d2", "s0", "s2", "f0", "f2")}
    df = df.withColumn("_feet", F.when(F.col("scan_pass").isNotNull(),
                                       ft.feet_of(at, F.col("_b_n"), F.col("_relax"))))
    good = F.coalesce(F.col("_feet") != ft.AMBIGUOUS, F.lit(False))
    result = F.struct(
        F.col("scan_pass").alias("scan_pass"), F.when(good, F.col("_feet")).alias("feet"),
        good.alias("scanned"), F.coalesce(F.col("_feet") == ft.AMBIGUOUS, F.lit(False)).alias("ambiguous"),
        F.when(good, F.struct(*[F.col(f"_b_{c}").alias(c) for c in ph.SET_NAMES])).alias("syl"),
        F.when(good, ft.resolved_long("_feet", "_b_short")).alias("long"))
    read = F.struct(
        F.col("_plain.scan_pass").alias("scan_pass"), F.col("_plain.feet").alias("feet"),
        F.col("_plain.feet").isNotNull().alias("scanned"), F.col("_plain.ambiguous").alias("ambiguous"),
        F.when(F.col("_plain.feet").isNotNull(), F.struct(*[F.col(f"_plain.{c}").alias(c) for c in ph.SET_NAMES])).alias("syl"),
        F.col("_plain.resolved").alias("long"))
    result = F.when(known, read).otherwise(result)
    # A generator of one row: a filter on the result stays above it. Pushed below, it would
    # be rewritten in terms of every stage underneath, and that grows without bound.
    return df.select(*lines.columns, F.inline(F.array(result)))


def _stage(df: DataFrame, prefix: str, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """One struct per stage, NULL for plain lines: later stages read its fields many times, so they stay computed once."""
    return df.withColumn(prefix, _apart(F.struct(*[c.alias(k) for k, c in columns.items()]))), {k: F.col(f"{prefix}.{k}") for k in columns}


def _apart(value: Column) -> Column:
    """The value as a bound one, which keeps its step out of whole-stage code: all steps in one method would be too long for the JVM to compile.

    Bound values are interpreted, so they are only asked for on the lines that the steps read.
    """
    return F.when(F.col("_odd").isNotNull(), let(value, lambda v: v))


def scan_fallback(lines: DataFrame, native_text: str, student_text: str) -> DataFrame:
    """S-11: native speaker first, letters only where that fails. Still one pass over rows."""
    out = ("scan_pass", "feet", "scanned", "ambiguous", "syl", "long")
    native = scan_lines(lines, native_text, ph.NATIVE)
    for c in out:
        native = native.withColumnRenamed(c, f"_n_{c}")
    # a NULL text gives a NULL skeleton: the second approach only runs where it is needed
    rest = native.withColumn("_rest", F.when(~F.col("_n_scanned"), F.col(student_text)))
    both = scan_lines(rest, "_rest", ph.STUDENT)
    return both.select(
        *lines.columns,
        F.when(F.col("_n_scanned"), ph.NATIVE).otherwise(ph.STUDENT).alias("approach"),
        *[F.when(F.col("_n_scanned"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in out])


def scan_one_line(lines: DataFrame, line_no: int, line_col: str = "line", **kw) -> DataFrame:
    """S-13: the filter is below everything else and reaches the scan of the source."""
    return scan_lines(lines.filter(F.col(line_col) == line_no), **kw)


def success_rate(scans: DataFrame, by: list[str], counted: Column | None = None) -> DataFrame:
    """S-14: lines and successes per group and for the corpus (flagged texts left out there)."""
    per = scans.groupBy(*by).agg(F.count("*").alias("n_lines"), F.count_if("scanned").alias("n_scanned"))
    per = per.withColumn("_in", F.lit(True) if counted is None else counted)
    total = per.filter("_in").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_scanned").alias("n_scanned"))
    total = total.select(F.lit("Total").alias(by[0]), *[F.lit(None).cast(per.schema[c].dataType).alias(c)
                                                         for c in by[1:]], "n_lines", "n_scanned")
    rate = F.when(F.col("n_lines") > 0, 100.0 * F.col("n_scanned") / F.col("n_lines")).otherwise(0.0)
    return per.drop("_in").unionByName(total).withColumn("rate", rate)


def clean_verses(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines as the scanner reads them; lines without text keep their row (they fail)."""
    return lines.withColumn(text, tx.clean_verse(text))


def line_sounds(lines: DataFrame, tokens: DataFrame, keys: list[str], text: str = "text", approach: str = ph.STUDENT) -> DataFrame:
    """S-3 for one reading: `tokens` has token, sound, enclitic, proclitic; the lines get sound_text (NULL without words)."""
    return line_readings(lines, tokens, keys, {"sound_text": ("sound", approach)}, text)


def line_readings(lines: DataFrame, tokens: DataFrame, keys: list[str], readings: dict[str, tuple[str, str]], text: str = "text") -> DataFrame:
    """S-3: replace every token of a cleaned line by its sounds and apply clitics, for several readings at once.

    readings: new column -> (column of `tokens` with the sound, approach). `tokens` has one row per token type. An
    enclitic loses the blank before it, a proclitic the one after it. For the native approach a word that the table does not
    have gets default lengths, as diphthongs without a mark would be read as open.

    A task deals its lines into chunks of bounded size as they come. A word goes to its type once per chunk, however often it occurs there, and
    back to its chunk, where the lines are put together; so a few words that fill a text are a few rows per chunk. The
    lines travel with the words as rows of their own, so nothing is joined back; lines listed twice stay two, whatever their `keys`.
    """
    chunked = _chunks(lines, text)
    words = tx.standardized(chunked)
    words = words.withColumn("token", F.coalesce("token", F.concat_ws("#", F.lit(""), "chunk", "at")))
    sounds_of = sorted({c for c, _ in readings.values()})
    known = words.join(tokens.select("token", *sounds_of, "enclitic", "proclitic"), "token", "left")

    def sound(column: str, approach: str) -> Column:
        unknown = F.col("raw")
        if approach == ph.NATIVE:
            unknown = F.regexp_replace(ph.tag_lengths("raw", ph.default_lengths("raw")), r"^\.", "")
        return F.coalesce(F.col(column), unknown)

    names = list(readings)
    rows = known.select("chunk", "at", "raw", "line", F.coalesce("enclitic", F.lit(False)).alias("enclitic"), F.coalesce("proclitic", F.lit(False)).alias("proclitic"),
                        *[sound(*r).alias(f"sound_{i}") for i, r in enumerate(readings.values())])
    columns, place = lines.columns, lines.columns.index(text)

    def read(chunk: pa.Table) -> pa.Table:
        is_line = pc.is_valid(chunk.column("at"))
        held, known = chunk.filter(is_line).combine_chunks(), chunk.filter(pc.invert(is_line))
        fields = [held.column("line").combine_chunks().field(i) if held.num_rows else pa.nulls(0) for i in range(len(columns))]
        split = [None if t is None else [w for w in t.split(" ") if w] for t in fields[place].to_pylist()]
        out = []
        for i in range(len(names)):
            word = dict(zip(known.column("raw").to_pylist(), zip(*(known.column(c).to_pylist() for c in (f"sound_{i}", "enclitic", "proclitic")))))
            out.append(pa.array([_glued([word[w] for w in words]) if words else None for words in split], pa.string()))
        return pa.Table.from_arrays([*fields, *out], names=[*columns, *names])

    schema = T.StructType([*lines.schema.fields, *[T.StructField(name, T.StringType()) for name in names]])
    return rows.groupBy("chunk").applyInArrow(read, schema)


# A chunk ends with the Arrow batch that fills it.
CHUNK_BYTES, CHUNK_LINES = 1 << 23, 1 << 17


def _chunks(lines: DataFrame, text: str) -> DataFrame:
    """(chunk, at, raw, line): a row for every line with its place, and one for every distinct word of its chunk."""
    schema = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("raw", T.StringType()),
                           T.StructField("line", T.StructType(lines.schema.fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, at, size, words = TaskContext.get().partitionId(), 0, 0, 0, set()

        def row_batch(rows: int, at_, raw, line) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{no}"] * rows, pa.string()), at_, raw, line], names=["chunk", "at", "raw", "line"])

        line_type = None

        def word_batches() -> Iterator[pa.RecordBatch]:
            every = sorted(words)
            for i in range(0, len(every), 10_000):
                some = every[i:i + 10_000]
                yield row_batch(len(some), pa.nulls(len(some), pa.int32()), pa.array(some, pa.string()), pa.nulls(len(some), line_type))

        for batch in batches:
            if not batch.num_rows:
                continue
            line = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            line_type = line.type
            yield row_batch(batch.num_rows, pa.array(range(at, at + batch.num_rows), pa.int32()), pa.nulls(batch.num_rows, pa.string()), line)
            t = batch.column(batch.schema.get_field_index(text))
            words.update(w for w in pc.unique(pc.split_pattern(t, " ").flatten()).to_pylist() if w)
            at, size = at + batch.num_rows, size + (pc.sum(pc.binary_length(t)).as_py() or 0)
            if size >= CHUNK_BYTES or at >= CHUNK_LINES:
                yield from word_batches()
                no, at, size, words = no + 1, 0, 0, set()
        if words:
            yield from word_batches()

    return lines.mapInArrow(run, schema)


def _glued(words: list[tuple[str, bool, bool]]) -> str:
    """Sounds of (sound, enclitic, proclitic): an enclitic replaces a trailing blank by a dot; after a proclitic there is none."""
    out: list[str] = []
    for sound, enclitic, proclitic in words:
        if enclitic and out and out[-1].endswith(" "):
            host = out.pop().rstrip(" ")
            while not host and out:
                host = out.pop().rstrip(" ")
            out.append(host + ".")
        out.append(sound + ("." if proclitic and not enclitic else " "))
    return "".join(out)
