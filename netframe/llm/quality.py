"""Operator 2 [native]: quality rules with thresholds from mergeable quantile sketches.

DataFrame functions only.  Each text is measured once; what is measured is written to the
shared folder and used twice: for the sketches and for the filter joined with them.

A sketch is a table of counts by bin (language, source, measure, bin), so two sketches
merge by adding counts, in any order and with the same result on every run, which a
randomised sketch (KLL) would not give.  Bins are log-linear: a value, in millionths, is cut to
its DIGITS leading binary digits, so a quantile is right to one part in 64 at any size of the
value, nothing is clipped, and a sketch has at most 64 bins for each doubling.  The group-by adds
counts up before its shuffle: a hot source costs a task one row for each bin.  The sketches of a
language and of everything are merged from those of the sources.  Texts that fail the base rules
are not counted.

Thresholds: of each measure the 1st, 5th and 9th decile d1, d5 and d9 of a sketch give the limits
d9 + REACH * (d9 - d5) and, for measures with a lower end, d1 - REACH * (d5 - d1).  No constant stands
in for them: in a source whose texts have no symbols the limit is 0.  A language's limits are
averaged with those of everything, and a source's with those of its language, by their numbers of rows
against PRIOR_ROWS, so that a small source leans on its language without a switch.

A text's share is an estimate from a few countable events (symbols, lines, repeated windows); it fails
only if the share is surely above the limit: events k less SIGMAS * sqrt(k).  Word lengths are compared
as they are.

kept is false if the base rules fail (under 10 words, or over a fifth of the words in repeated
5-word windows) or a threshold is passed.

Cases: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows are judged alike; extra columns are not read, and may have any names; a very long text
is measured whole, in one row; an empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, materialize

SYMBOLS = "#*$%&|<>"
GRAM = 5
REACH = 3
SIGMAS = 2
PRIOR_ROWS = 100
DIGITS = 7
#: measure: (counted, of what, how many of the counted make one event; None for a mean with two ends)
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 1),
    "dup_line_share": ("n_dup_lines", "n_lines", 1),
    "repeat_share": ("n_repeat_words", "n_words", GRAM),
    "word_length": ("word_chars", "n_words", None),
}
_WORD_BREAK = r"[\x20\x09-\x0D]+"


def _repeated(words: Column) -> Column:
    """Words of the array in GRAM-word windows found twice or more."""
    n = F.size(words)

    def covered(sorted_windows: Column) -> Column:
        """sorted_windows: (hash, position) in order; those with an equal neighbour count."""
        m = F.size(sorted_windows)
        twice = F.filter(
            sorted_windows,
            lambda w, k: ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == w["h"])) | ((k < m - 1) & (F.get(sorted_windows, k + 1)["h"] == w["h"])),
        )
        places = F.array_sort(F.transform(twice, lambda w: w["p"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get(p, k + 1) - x, F.lit(GRAM)))), F.lit(0), lambda a, x: a + x))

    def windows(hashes: Column) -> Column:
        grams = F.transform(F.slice(hashes, 1, n - (GRAM - 1)), lambda h, k: F.xxhash64(h, *(F.get(hashes, k + j) for j in range(1, GRAM))))
        return let(
            grams,
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
                let(F.array_sort(F.transform(g, lambda h, k: F.struct(h.alias("h"), k.alias("p")))), covered)
            ),
        )

    return F.when(n < GRAM + 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), F.size(F.array_distinct(x)).cast("long").alias("different")))
    others = [c for c in docs.columns if c != text_col]
    w, n = free_name(docs, "nf_words"), free_name(docs, "nf_lines")
    chars = F.length(F.regexp_replace(text, _WORD_BREAK, ""))
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    measured = docs.select(*others, counts.alias(w), line_counts.alias(n), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"))
    return measured.select(
        *others,
        F.col(f"{w}.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col(f"{n}.lines") - F.col(f"{n}.different")).alias("n_dup_lines"),
        F.col(f"{w}.n_repeat_words").alias("n_repeat_words"),
        F.col(f"{n}.lines").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _millionths(x: Column, of: str) -> Column:
    return F.floor(F.try_divide(F.lit(1_000_000) * x, F.col(of)))


def _values() -> dict[str, Column]:
    """Each measure in millionths; null where it has no value."""
    return {name: _millionths(F.col(x), of) for name, (x, of, _) in MEASURES.items()}


def _sure(name: str) -> Column:
    """What the measure surely amounts to, in millionths."""
    x, of, unit = MEASURES[name]
    events = F.col(x) / F.lit(unit)
    return _millionths(F.lit(unit) * (events - F.lit(SIGMAS) * F.sqrt(events)), of)


def _bin(value: Column) -> Column:
    """The value's DIGITS leading binary digits."""
    cut = F.greatest(F.lit(0), F.length(F.bin(value)) - DIGITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketch(measured: DataFrame, *by: str) -> DataFrame:
    """(by..., measure, bin, n): the quantile sketches."""
    long = measured.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), x.alias("value")) for k, x in _values().items()))).alias("m"))
    return long.where("m.value is not null").select(*by, "m.measure", _bin(F.col("m.value")).alias("bin")).groupBy(*by, "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches merged to fewer keys: counts add up."""
    return sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., measure, rows long, low long, high long) of each sketch."""
    at = F.array_sort(F.collect_list(F.struct("bin", "n")))  # as many items as there are bins, at most
    listed = sketches.groupBy(*by, "measure").agg(at.alias("bins"), F.sum("n").alias("rows"))

    def decile(tenths: int) -> Column:
        """The least bin with at least that part of the rows up to it."""
        step = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["bin"], F.when(10 * (a["seen"] + x["n"]) >= F.col("rows") * tenths, x["bin"])).alias("bin")),
        )
        return step["bin"]

    each = listed.select(*by, "measure", "rows", *(decile(k).alias(f"d{k}") for k in (1, 5, 9)))
    return each.select(*by, "measure", "rows", (F.col("d1") - REACH * (F.col("d5") - F.col("d1"))).alias("low"), (F.col("d9") + REACH * (F.col("d9") - F.col("d5"))).alias("high"))


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, limits map<measure, struct<low double, high double>>) of sketches by language and source."""

    def leaning(own: DataFrame, on: DataFrame, *keys: str) -> DataFrame:
        """The limits of own drawn towards those of on, which it shares keys with."""
        towards = on.select(*keys, F.col("low").alias("to_low"), F.col("high").alias("to_high"))
        mean = lambda x: (F.col("rows") * F.col(x) + F.lit(float(PRIOR_ROWS)) * F.col(f"to_{x}")) / (F.col("rows") + F.lit(float(PRIOR_ROWS)))
        return own.join(towards, list(keys)).withColumns({x: mean(x) for x in ("low", "high")}).select(own.columns)

    languages = merge(sketches, "lang")
    by_lang = leaning(thresholds(languages, "lang"), thresholds(merge(languages)), "measure")
    by_source = leaning(thresholds(sketches, "lang", "source"), by_lang, "lang", "measure")
    return by_source.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("limits"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"), F.col(text_col).alias("text"))
    measured = materialize(measures(plain), "measures")
    sketches = materialize(sketch(measured.where(~base_failed()), "lang", "source"), "sketches")
    judged = measured.join(materialize(limits(sketches), "limits"), ["lang", "source"], "left")
    beyond = F.lit(False)
    for name, x in _values().items():
        limit = F.col("limits")[name]
        out = (x > limit["high"]) | (x < limit["low"]) if MEASURES[name][2] is None else _sure(name) > limit["high"]
        beyond = beyond | F.coalesce(out, F.lit(False))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~beyond).alias("kept")
    )
