"""Fill-in-middle transformation by one counted-quantifier match a text.

A text is n units.  Two cut points part it into prefix, middle and suffix, which are
put in the order of a training form behind marks:

    psm:   <P>prefix<S>suffix<M>middle
    spm:   <S>suffix<P>prefix<M>middle
    plain: the text as it is

``regexp_count`` gives n.  The pattern of a row is built from its own cut points:
possessive groups ``unit{a}+`` and ``unit{b-a}+`` and the rest capture the three parts in
one match without backtracking, and the replacement puts them in order.  Nothing is
shuffled; a row is read and written where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import whole_text

#: A unit is one code point; line ends count too.
UNIT = "(?s:.)"
#: Units that the first count takes at a time, so that no array of single units is built.
RUN = 1024

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are transformed, and how many of those take the form spm.
RATE, SPM_RATE = 90, 20


def count_units(text: Column) -> Column:
    """Number of code points: whole runs of ``RUN`` are counted, then what they leave."""
    run = f"{UNIT}{{{RUN}}}+"
    rest = F.regexp_replace(text, run, "")
    return (F.regexp_count(text, F.lit(run)) * F.lit(RUN) + F.regexp_count(rest, F.lit(UNIT))).cast("long")


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _times(n: Column) -> Column:
    return F.concat(F.lit(f"({UNIT}{{"), n.cast("string"), F.lit("}+)"))


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE,
) -> DataFrame:
    """One row per input row: id, ``n`` units, ``form``, ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output``.

    The cut points and the form follow from ``seed`` and the id alone, so a rerun gives
    the same rows and rows that repeat an id are cut by the same draws.  A null text is
    empty; empty texts and those that hold a mark stay plain, at any length.  A null id
    draws as an empty one.  Equal cut points give empty parts.  An empty table gives
    an empty result; other columns are ignored, whatever their names."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), count_units(text).alias("n"))
    h = draws(F.col("id"), seed)
    cut = [h[i] % (F.col("n") + 1) for i in (0, 1)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("id", "text", "n", F.least(*cut).alias("a"), F.greatest(*cut).alias("b"), form.alias("form"))
    plain = F.col("form") == "plain"
    pattern = F.concat(F.lit(r"\A"), _times(F.col("a")), _times(F.col("b") - F.col("a")), F.lit(r"((?s:.)*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(plain, F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return rows.select(
        F.col("id").alias(id_col), "n", "form", F.when(~plain, F.col("a")).alias("prefix_chars"),
        F.when(~plain, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone.  Texts that
    hold a mark are plain, so each mark of another form stands where it was put."""
    part = "((?s:.)*?)"
    psm = F.regexp_replace(output, rf"\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}((?s:.)*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}((?s:.)*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
