"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes.  The ledger, a
table in shared storage, has a row for each blob and rule version that was ever
scanned, with the spans found.  A run scans each unseen pair once, however many
paths show the blob, appends to the ledger, and joins the findings back to all
paths.  Only DataFrame functions; regular expressions run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import whole_text


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` has
    fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three kinds, in the order of ties.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
#: Cheaper patterns that hold wherever a rule has a match long enough.
_HINTS = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

#: Matches worked on together: arrays that grow inside a fold are copied at each step.
STEPS = 1_000

LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"
SPANS = "array<struct<start:int,end:int>>"


def _runs(items: Column) -> Column:
    """An array cut into arrays of STEPS items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / STEPS).cast("int")), lambda i: F.slice(items, i * STEPS + 1, F.lit(STEPS)))


def _of(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def spans(text: Column, rule: Rule) -> Column:
    """(start, end) of the rule's matches in code points, end exclusive.  The parts
    between matches and the matches themselves alternate, so their lengths add up
    to the positions."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    steps = F.arrays_zip(
        lengths(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))).alias("gap"),
        lengths(whole).alias("whole"), lengths(value).alias("value"))
    empty = F.expr(f"cast(array() as {SPANS})")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["whole"]
        found = F.when(x["value"] >= rule.least, F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["out"])
        return F.struct(end.alias("at"), found.alias("out"))

    def run(state: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPANS}>)").alias("out"))
    found = _of(steps, lambda all_: F.aggregate(_runs(all_), start, run, lambda s: F.flatten(s["out"])))
    return F.when(text.rlike(_HINTS.get(rule.kind, rule.pattern)), found).otherwise(empty)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``; None if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def address(text_col: str = "text") -> Column:
    """The blob that a row's text is."""
    return F.sha2(whole_text(text_col), 256)


def update(docs: DataFrame, ledger: str, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, append it, and return ``blob`` and ``found``
    of every blob in the ledger in which these rules found something.  A pair that was
    appended more than once, by a run that was repeated or by two at a time, counts once."""
    spark = docs.sparkSession
    text = whole_text(text_col)
    # Equal texts are combined before the shuffle, so each blob is held once.
    blobs = docs.select(address(text_col).alias("blob"), text.alias("text")).distinct()
    wanted = F.array(*[F.lit(r.key) for r in rules])
    seen = read_ledger(spark, ledger)
    if seen is None:
        blobs = blobs.withColumn("todo", wanted)
    else:
        done = seen.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.expr("cast(array() as array<string>)"))))
    results = F.array(*[
        F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r).alias("spans"))) for r in rules])
    fresh = blobs.where(F.size("todo") > 0).select("blob", F.explode(results).alias("r"))
    fresh = fresh.where("r is not null").select("blob", "r.rule", "r.spans")
    fresh.write.mode("append").parquet(ledger)

    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    hits = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    hits = hits.select("blob", F.col("rule"), order[F.col("rule")].alias("nth"), "spans")
    hits = hits.groupBy("blob").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("nth").alias("nth"), F.split_part(F.col("rule"), F.lit("@"), F.lit(1)).alias("kind"), s["end"].alias("end"))))).alias("found"))
    # A rule finds a span once, so equal ones come from repeated ledger rows.
    return hits.select("blob", F.sort_array(F.array_distinct("found")).alias("found"))


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: id, ``blob``, ``found``: array of (start, nth, kind, end)
    ordered by start, then by the order of ``rules``.

    Null texts count as empty; empty texts have no findings.  Repeated rows share a
    blob and its findings.  An empty table adds nothing to the ledger.  Columns
    other than id and text are ignored.  ``ledger`` is a shared folder."""
    hits = update(docs, ledger, text_col, rules)
    paths = docs.select(F.col(id_col).alias("id"), address(text_col).alias("blob"))
    none = F.expr("cast(array() as array<struct<start:int,nth:int,kind:string,end:int>>)")
    return paths.join(hits, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("found", none).alias("found"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span replaced by ``mark``; overlapping spans are
    replaced once."""
    def step(state: Column, s: Column) -> Column:
        # ``part`` is the text from ``base`` on: positions in it are near its start.
        between = F.substring(state["part"], state["at"] - state["base"] + 1, s["start"] - state["at"])
        fresh, longer = F.concat(state["out"], between, F.lit(mark)), state["out"]
        apart = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, fresh).otherwise(longer).alias("out"), state["base"].alias("base"), state["part"].alias("part"))

    def run(state: Column, some: Column) -> Column:
        reach = F.array_max(F.transform(some, lambda s: s["end"])) - state["at"]
        part = F.substring(text, state["at"] + 1, F.greatest(reach, F.lit(0)))
        done = F.aggregate(some, F.struct(state["at"].alias("at"), F.lit("").alias("out"), state["at"].alias("base"), part.alias("part")), step)
        return F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(_runs(found), start, run, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
