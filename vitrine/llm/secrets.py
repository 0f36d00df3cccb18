"""Secret scans over content-addressed texts, with DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.sources.shared import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has at least `least` characters. What it finds changes with its version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "base-1"

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules. Runs that are too short can't hold a shorter match that is long enough,
# so the length is part of the pattern where the whole match counts.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

NO_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: A row of a ledger: a text's digest, the rules (kind and version) that have scanned it, and what these found, rule by name.
LEDGER = "blob string, rules array<string>, spans array<struct<start:int,rule:string,end:int>>"


def rule_matches(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<kind, gap, size, counted>>: what lies between the rule's matches in `text`, and their sizes, in code points; null without a match.

    Splitting by the pattern gives the gaps; the one after the last match has no size.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length).alias("counted"),
    )
    told = F.transform(found, lambda x: F.struct(F.lit(order).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), x["counted"].alias("counted")))
    return F.when(F.rlike(text, pattern), told)


def spans_of(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) for every row of `blobs` (blob, text, wanted: a bit for each rule that is to scan it; blobs are distinct): structs (start, rule, end).

    Matches become rows, whose places are running sums of gaps and sizes by blob and rule, so the work grows with the matches and not with their square.
    """
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,counted:int>>")
    asked = [F.when(F.col("wanted").bitwiseAND(1 << k) != 0, rule_matches(F.col("text"), r, k)) for k, r in enumerate(rules)]
    rows = blobs.select("blob", F.posexplode_outer(F.concat(*(F.coalesce(m, none) for m in asked))).alias("nth", "match")).select("blob", "nth", "match.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far).cast("int"))
    least, name = (F.element_at(F.array(*(F.lit(x) for x in each)), F.col("kind") + 1) for each in ([r.least for r in rules], [r.name for r in rules]))
    span = F.when(F.col("counted") >= least, F.struct((F.col("end") - F.col("size")).alias("start"), name.alias("rule"), "end"))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast("array<struct<start:int,rule:string,end:int>>").alias("spans"))


def unseen_blobs(docs: DataFrame, ledger: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, wanted) of the texts of `docs` that some rules haven't scanned by `ledger`: a bit of `wanted` for each of these. No text is shuffled."""
    names = F.array(*(F.lit(r.name) for r in rules))
    rule = ledger.select("blob", F.explode("rules").alias("rule")).withColumn("nth", F.array_position(names, F.col("rule")).cast("int")).where("nth > 0")
    seen = rule.groupBy("blob").agg(F.bit_or(F.element_at(F.array(*(F.lit(1 << k) for k in range(len(rules)))), F.col("nth"))).alias("seen"))
    digests = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob")).distinct()
    wanted = F.lit((1 << len(rules)) - 1).bitwiseXOR(F.coalesce("seen", F.lit(0)))
    return digests.join(seen, "blob", "left").select("blob", wanted.alias("wanted")).where("wanted <> 0")


def scan_blobs(docs: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger (LEDGER) after `docs`: with a row for each distinct text that a rule hadn't scanned yet, and what the rules it lacked found.

    blob is the text's SHA-256; spans are sorted by start. Digests alone meet `ledger`; only the texts that lack a rule's version are brought together by blob, and
    only these rules scan them: a new version of a rule scans old texts by itself. If nothing is lacking no text is read. The ledger's rows are kept. A null text is the empty
    blob; it is scanned like others and has no spans. A text of any number of matches takes time in proportion.
    """
    spark = docs.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger.select("blob", "rules", "spans")
    unseen = materialize(unseen_blobs(docs, ledger, text_col, rules), "unseen")
    if unseen.isEmpty():
        return ledger
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).join(unseen, "blob")
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    scanned = F.array_compact(F.array(*(F.when(F.col("wanted").bitwiseAND(1 << k) != 0, r.name) for k, r in enumerate(rules))))
    new = spans_of(blobs, rules).join(unseen, "blob").select("blob", scanned.alias("rules"), "spans")
    return ledger.unionByName(new)


def secret_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) for every row of `docs`: the ledger's findings of these rules joined back to all versions.

    One row comes out for each row that goes in, repeated ids and null ids included; spans is empty where
    nothing was found, else structs (start, kind, end) by start and then by the rule's place in `rules`, which is kind. The new ledger is written to the shared folder, so what joins it can be
    recomputed without a scan and a text that a third of the rows share can be split in the join.
    """
    known = materialize(scan_blobs(docs, text_col, ledger, rules), "ledger")
    nth = F.array_position(F.array(*(F.lit(r.name) for r in rules)), F.col("rule")).cast("int") - 1
    told = known.where(F.size("spans") > 0).select("blob", F.inline("spans")).select("blob", "start", nth.alias("kind"), "end").where("kind >= 0")
    found = told.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).cast(NO_SPANS).alias("spans"))
    versions = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return versions.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
