"""Evaluation: ranks of expected passages, recall and MRR, grades, variation between runs, judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.numbers import rounds_thousandths


def rank_of_needles(needles: DataFrame, ranked: DataFrame) -> DataFrame:
    """needles (question_id, needle), ranked (question_id, rank, content): the last of the needles' first ranks, null if one is missing."""
    found = needles.join(ranked, "question_id", "left").groupBy("question_id", "needle").agg(F.min(F.when(F.contains("content", "needle"), F.col("rank"))).alias("first"))
    return found.groupBy("question_id").agg(F.when(F.count(F.when(F.col("first").isNull(), 1)) == 0, F.max("first")).alias("rank"))


def holders(needles: DataFrame, chunks: DataFrame) -> DataFrame:
    """needles (question_id, needle) joined to the chunks (key, content, ...) that hold them.

    A chunk that holds a needle has its inner words as whole words: candidates share the longest of these, by an equi
    join, and are then read. Needles of fewer than three words have none; they are held against every chunk.
    """
    inner = F.split("needle", r"\s+")
    inner = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    word = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = needles.withColumn("_word", F.nullif(word, F.lit("")))
    keyed = asked.where("_word is not null")
    words = chunks.select("key", F.explode(F.array_distinct(F.split("content", r"\s+"))).alias("_word"))
    met = words.join(keyed.select("question_id", "needle", "_word"), "_word").select("key", "question_id", "needle").join(chunks, "key")
    short = chunks.join(asked.where("_word is null").select("question_id", "needle"), F.contains("content", "needle"))
    return met.where(F.contains("content", "needle")).unionByName(short)


def question_tags(kind: Column, expect: Column, inputs: Column, traps: Column, filings: Column, statement: Column, version: Column) -> Column:
    """Tags of a question: its kind, whether it asks for a calculation or has traps, the companies and the statement that it was routed to, and the serving build."""
    from ledgerloom.operators.figures import asks_for_calculation

    company = F.transform(filings, lambda f: F.concat(F.lit("company:"), F.substring_index(f, "-", 1)))
    companies = F.when(F.size(filings) > 0, company).otherwise(F.array(F.lit("company:none")))
    first = F.array(F.concat(F.lit("kind:"), kind), F.when(asks_for_calculation(expect, inputs), "calculation"), F.when(F.size(traps) > 0, "has traps"))
    last = F.array(F.concat(F.lit("statement:"), F.coalesce(statement, F.lit("none"))), F.concat(F.lit("ollama:"), F.nullif(version, F.lit(""))))
    return F.array_compact(F.concat(first, companies, last))


def metrics(ranks: DataFrame, by: str, depths: tuple[int, ...] = (1, 5, 8)) -> DataFrame:
    """Recall at depths and MRR by set, and over all sets in the row `All`."""
    recall = [F.count_if(F.col("rank") <= k).alias(f"recall_{k}") for k in depths]
    out = ranks.rollup(by).agg(F.count(F.lit(1)).alias("n"), *recall, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
    return out.withColumn(by, F.coalesce(by, F.lit("All")))


#: Fixed patterns: declining, the units rule as an answer, hedging, concluding, and where sentences end.
DECLINE = (
    r"(?i)(?:don['’]t|do not|does not|doesn['’]t) (?:contain|include|provide|mention|state|specify)"
    r"|not (?:explicitly |directly |specifically )?(?:stated|provided|available|included|mentioned|found|specified|reported|disclosed)"
    r"|no (?:information|data|mention)|unable to|cannot (?:find|determine|answer)|there is no"
)
UNIT_ONLY = r"(?i)^\W*the units?\b[^.]{0,40}\bnot stated\W*$"
HEDGE = r"(?i)\bambiguous\b|\bgive both\b|\bboth (?:lines|figures)\b|\beither of (?:the )?two\b|\bcould (?:refer|mean)\b"
CONCLUSION = r"(?i)\b(?:therefore|thus|hence|so the|in total|which means)\b"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"


def _in_context(answer: Column) -> Column:
    """array<struct<t, before, after>>: the number tokens of an answer with the text on either side, up to the next number."""
    gaps = F.split(answer, text.NUMBER, -1)
    zipped = F.arrays_zip(text.number_tokens(answer).alias("t"), gaps.alias("before"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    return F.filter(zipped, lambda x: x["t"].isNotNull())


def unit_status(answer: Column, value: Column, unit: Column) -> Column:
    """ok, wrong or missing: by the first place of the value that carries a unit, else by the answer as a whole."""
    hits = F.filter(_in_context(answer), lambda x: x["t"] == value)
    percent = F.exists(hits, lambda x: F.substring(x["after"], 1, 10).rlike(r"(?i)^\)?\s*(%|percent)"))
    dollar = F.exists(hits, lambda x: F.right(x["before"], F.lit(3)).rlike(r"\$\s*\(?\s*$"))
    scales = F.filter(F.transform(hits, lambda x: F.lower(F.regexp_extract(F.substring(x["after"], 1, 12), r"(?i)^\)?\s*(million|thousand|billion)", 1))), lambda m: m != "")
    said = F.try_element_at(scales, F.lit(1))
    anywhere = F.when(unit == "million", answer.rlike(r"(?i)\bmillions?\b")).when(unit == "thousand", answer.rlike(r"(?i)\bthousands?\b")).otherwise(False)
    return (
        F.when(unit.isNull(), "ok")
        .when(unit == "%", F.when(percent, "ok").otherwise("missing"))
        .when(unit == "$", F.when(dollar, "ok").otherwise("missing"))
        .when(said == unit, "ok")
        .when(said.isNotNull(), "wrong")
        .when(anywhere, "ok")
        .otherwise("missing")
    )


def strict_grades(answers: DataFrame) -> DataFrame:
    """The rows with status and note, by the first rule that holds.

    Columns read: answer, question, kind (figure, fact, negative, routing), unit, expect, conflicts, traps
    (array<string>), accept (array<struct<value, if_label>>), exact, decline_ok. Null arrays are empty, null
    flags false. Passing are `reliable` and `decline-ok`.
    """
    none, no_pairs = F.array().cast("array<string>"), F.array().cast("array<struct<value:string,if_label:string>>")
    col, listed = F.col, lambda name: F.coalesce(F.col(name), none)
    has = lambda v: F.array_contains("_tokens", v)
    joined = lambda before, a, after="": F.concat(F.lit(before), F.array_join(a, ", "), F.lit(after))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    low = lambda c: F.contains(F.lower("answer"), F.lower(c))
    df = answers.withColumns({"_tokens": text.number_tokens(col("answer")), "_figures": text.stated_figures(col("answer"), col("question"))})
    df = df.withColumn("_declines", col("answer").rlike(DECLINE) | col("answer").isin("(no results)", "(no answer)"))
    df = df.withColumn("_declined", col("_declines") & (F.size("_figures") == 0))
    # An accepted alternative stands in for what is expected if its label is there and nothing expected is.
    found = F.filter(listed("expect"), has)
    others = F.filter(F.coalesce("accept", no_pairs), lambda a: has(a["value"]) & low(a["if_label"]))
    alternative = F.when(F.size(found) == 0, F.try_element_at(F.transform(others, lambda a: a["value"]), F.lit(1)))
    df = df.withColumn("_other", alternative)
    df = df.withColumn("_expect", F.when(col("_other").isNotNull(), F.array("_other")).otherwise(listed("expect")))
    df = df.withColumn("_found", F.filter("_expect", has))
    # Billions with decimals in the answer, and for each expected value whether one of them is its rounding.
    billions = F.filter(_in_context(col("answer")), lambda x: F.substring(x["after"], 1, 10).rlike(r"(?i)^\s*billion") & F.contains(x["t"], F.lit(".")))
    shown = F.transform(billions, lambda x: F.regexp_replace(x["t"], ",", ""))
    may_round = (col("unit") == "million") & (F.size("_found") == 0) & (F.size("_expect") > 0) & ~flag("exact")
    df = df.withColumn("_rounded", may_round & F.forall("_expect", lambda e: F.exists(shown, lambda s: rounds_thousandths(s, e))))
    first = F.try_element_at(F.filter(F.split(F.regexp_replace("answer", r"^\s+|\s+$", ""), SENTENCE_END, -1), lambda s: s.rlike(r"\S")), F.lit(1))
    conflict = F.filter(listed("conflicts"), lambda c: ~F.array_contains("_expect", c) & has(c))
    df = df.withColumns({"_conflict": conflict, "_first": text.number_tokens(F.coalesce(first, F.lit("")))})
    concludes = F.exists(F.split(col("answer"), SENTENCE_END, -1), lambda s: s.rlike(CONCLUSION) & F.arrays_overlap(text.number_tokens(s), "_conflict"))
    contrast = (F.size("_conflict") > 0) & ~col("answer").rlike(HEDGE) & F.forall("_expect", lambda e: F.array_contains("_first", e)) & ~F.arrays_overlap("_first", "_conflict") & ~concludes
    df = df.withColumns({"_contrast": contrast, "_units": F.transform("_expect", lambda e: unit_status(col("answer"), e, col("unit")))})
    missing = F.filter(listed("expect"), lambda e: ~low(e) & ~has(e))
    named = F.filter(listed("conflicts"), low)
    traps = F.filter(listed("traps"), has)
    rule = lambda when, status, note="": (when, F.lit(status), note if isinstance(note, Column) else F.lit(note))
    negative, fact = col("kind") == "negative", col("kind") == "fact"
    whole = (F.size("_expect") > 0) & (F.size("_found") == F.size("_expect"))
    absent = F.size("_found") == 0
    rules = [
        rule(col("answer").rlike(UNIT_ONLY), "malformed", "the units rule as the whole answer"),
        rule(negative & col("_declined"), "decline-ok"),
        rule(negative & col("_declines"), "check", "declines but states figures"),
        rule(negative, "wrong", "answered a negative"),
        rule(fact & (F.size(missing) == 0) & (F.size(named) > 0), "check", joined("also names ", named)),
        rule(fact & (F.size(missing) == 0), "reliable"),
        rule(fact & col("_declined") & flag("decline_ok"), "decline-ok"),
        rule(fact & col("_declined"), "declined"),
        rule(fact & col("_declines"), "check", "declines but states figures"),
        rule(fact, "wrong", joined("missing ", missing)),
        rule(F.coalesce("_rounded", F.lit(False)), "reliable", "rounded, in billions"),
        rule(whole & (F.size("_conflict") > 0) & ~col("_contrast"), "check", joined("also states ", col("_conflict"))),
        rule(whole & F.array_contains("_units", "wrong"), "wrong-unit", F.concat(F.lit("expected "), col("unit"))),
        rule(whole & F.array_contains("_units", "missing"), "no-unit", F.concat(F.lit("expected "), col("unit"))),
        rule(whole & col("_contrast"), "reliable", joined("names ", col("_conflict"), " as the contrast")),
        rule(whole, "reliable"),
        rule((col("kind") == "routing") & col("_declined"), "decline-ok", "routing test"),
        rule(col("_declined") & absent, "declined"),
        rule(col("_declines") & absent, "check", joined("declines but states ", F.when(F.size(traps) > 0, traps).otherwise(col("_figures")))),
        rule(~absent, "wrong", F.concat(joined("only ", col("_found")), joined(" of ", col("_expect")))),
        rule(F.size(traps) > 0, "wrong", joined("trap ", traps)),
    ]
    status, note = F.lit("wrong"), F.lit("expected figure absent")
    for when, s, n in reversed(rules):
        status, note = F.when(when, s).otherwise(status), F.when(when, n).otherwise(note)
    return df.withColumns({"status": status, "note": note}).select(*answers.columns, "status", "note")


def variation(answers: DataFrame) -> DataFrame:
    """answers (scenario, execution, text, figures, grade): Identical, Wording, Figures or Grade for each scenario.

    The grade "-" is none and does not count; apostrophes are compared straight.
    """
    grade = F.count_distinct(F.when(F.col("grade") != "-", F.col("grade")))
    n = {"figures": F.count_distinct("figures"), "text": F.count_distinct(F.translate("text", "’", "'"))}
    kind = F.when(grade > 1, "Grade").when(n["figures"] > 1, "Figures").when(n["text"] > 1, "Wording").otherwise("Identical")
    return answers.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), kind.alias("variation"))


def agreement(verdicts: DataFrame, strict: str, judge: str) -> DataFrame:
    """Counts of the four combinations of two verdicts, and the share that agree, rounded half to even."""
    a, b = F.col(strict), F.col(judge)
    both = verdicts.where(a.isNotNull() & b.isNotNull())
    return both.agg(F.count_if(a & b).alias("both_pass"), F.count_if(a & ~b).alias("strict_only"), F.count_if(~a & b).alias("judge_only"), F.count_if(~a & ~b).alias("both_fail"), F.bround(F.avg((a == b).cast("double")) * 100, 1).alias("agree_percent"))


def latest(results: DataFrame, by: str, at: str, keep: list[str]) -> DataFrame:
    """The row of the latest time of each scenario; ties to the larger kept values."""
    return results.groupBy(by).agg(F.max(F.struct(at, *keep)).alias("x")).select(by, "x.*")
