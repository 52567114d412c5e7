"""Where the figures of an answer come from: the excerpts that print them, or a figure that they round.

An answer meets its excerpts by id, once, and keeps the number tokens that it states; `sightings` has them by line. A figure in
millions or billions that no excerpt prints is traced to a printed figure of the same answer that it rounds: each
printed figure gives its rounded values at every unit, and scale and number of decimals that is asked for, at most 42, and the two sides
meet by equal value, not by comparing all figures with all.

Defined results: null answers and contents have no figures; a figure that an answer repeats counts once, at its
first place; an answer without excerpts has no sightings; excerpts of other answers are never looked at; answers
are told apart by `id`, which has to be unique, and null ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.storage import cut

#: Units that a printed figure may be in, scales that a stated one names, and the decimals that are compared.
UNITS, SCALES, PLACES = (1, 1000, 1_000_000), {"million": 6, "billion": 9}, range(7)


def _stated() -> Column:
    """The distinct stated figures of an answer in order, as structs (place, figure, scale): scale is the power of ten that the answer says after the first mention."""
    # The first place where the figure is a whole token: texts between tokens, and the tokens in order.
    tokens, gaps = T.number_tokens(F.col("answer")), F.split("answer", T.NUMBER, -1)
    said = lambda f: F.lower(F.regexp_extract(F.get(gaps, F.array_position(tokens, f).cast("int")), r"(?i)\A\)?\s*(million|billion)\b", 1))
    # Tokens and gaps are made for each figure: only where the answer has such a word.
    scale = lambda f: F.when(F.lower("answer").rlike("million|billion"), F.when(said(f) == "million", SCALES["million"]).when(said(f) == "billion", SCALES["billion"]))
    own = F.array_distinct(T.stated_figures(F.col("answer"), F.coalesce("question", F.lit(""))))
    return F.transform(own, lambda f, place: F.struct(place.alias("place"), f.alias("figure"), scale(f).alias("scale")))


def figures(answers: DataFrame) -> DataFrame:
    """(id, place, figure, scale): the distinct stated figures of answers (id, answer, question), and the power of ten that the answer says after the first mention."""
    return answers.where("id is not null").select("id", F.inline(_stated()))


def token_lines(excerpts: DataFrame) -> DataFrame:
    """(id, position, line_no, line, token): the distinct number tokens of each line of excerpts (id, position, content)."""
    lines = excerpts.select("id", "position", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    return lines.select("id", "position", "line_no", F.trim("line").alias("line"), F.explode(F.array_distinct(T.number_tokens(F.col("line")))).alias("token"))


def sightings(wanted: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(id, figure, position, line, more) for wanted (id, figure): each excerpt that prints it, its first such line and how many more."""
    met = token_lines(excerpts).withColumnRenamed("token", "figure").join(wanted.select("id", "figure").distinct(), ["id", "figure"])
    return met.groupBy("id", "figure", "position").agg(F.min_by("line", "line_no").alias("line"), (F.count(F.lit(1)) - 1).cast("int").alias("more"))


def _exact(figure: Column) -> Column:
    return F.regexp_replace(figure, ",", "").try_cast("decimal(20,4)")


def rounded_from(stated: DataFrame, printed: DataFrame) -> DataFrame:
    """(id, figure, source): the first printed figure (id, place, figure) that a stated one (id, figure, scale) rounds, half away from zero."""
    places = F.length(F.regexp_extract("figure", r"\.(\d+)$", 1))
    asked = stated.where("scale is not null").select("id", "figure", "scale", places.alias("places"), F.regexp_replace("figure", ",", "").try_cast("decimal(26,6)").alias("value")).where("value > 0")
    # Only what some figure of the same answer asks for, by scale and number of decimals, is spread.
    pairs = asked.groupBy("id").agg(F.collect_set(F.struct("scale", "places")).alias("_pairs"))
    known = printed.select("id", "place", F.col("figure").alias("source"), _exact(F.col("figure")).alias("x")).where("x is not null").join(pairs, "id")
    by = lambda scale, u: F.when(scale == SCALES["million"], F.lit(f"1e{u - 6}").cast("decimal(10,9)")).otherwise(F.lit(f"1e{u - 9}").cast("decimal(10,9)"))

    def value(pair: Column, u: int) -> Column:
        out, y = F.lit(None).cast("decimal(26,6)"), F.col("x") * by(pair["scale"], u)
        for k in PLACES:
            out = F.when(pair["places"] == k, F.round(y, k).cast("decimal(26,6)")).otherwise(out)
        return F.struct(pair["scale"].alias("scale"), pair["places"].alias("places"), out.alias("value"))

    spread = known.select("id", "place", "source", "x", F.explode("_pairs").alias("_pair")).select("id", "place", "source", F.inline(F.array(*(value(F.col("_pair"), u) for u in (0, 3, 6)))))
    return asked.join(spread, ["id", "scale", "places", "value"]).groupBy("id", "figure").agg(F.min_by("source", "place").alias("source"))


def _traced(answers: DataFrame, excerpts: DataFrame, *kept: str) -> DataFrame:
    """(id, kept columns, stated): a row an answer, its figures in order as structs (place, figure, scale, positions, rounds), positions null if no excerpt prints it.

    The only key is the id: each answer meets its excerpts once, and what they print of its figures is gathered in one
    row. These rows are written to the shared folder, as the figures that may be rounded are read from them again.
    """
    own = answers.where("id is not null").select("id", *kept, F.coalesce(_stated(), F.array().cast("array<struct<place:int,figure:string,scale:int>>")).alias("_stated"))
    printed = F.array_intersect(F.transform("_stated", lambda s: s["figure"]), T.number_tokens(F.col("content")))
    met = own.join(excerpts.select("id", "position", "content"), "id", "left").select("id", *kept, "_stated", F.struct("position", printed.alias("figures")).alias("_hit"))
    hits = F.collect_list(F.when(F.size("_hit.figures") > 0, F.col("_hit")))
    each = met.groupBy("id").agg(*(F.first(c).alias(c) for c in (*kept, "_stated")), hits.alias("_hits"))

    def positions(figure: Column) -> Column:
        at = F.transform(F.filter("_hits", lambda h: F.array_contains(h["figures"], figure)), lambda h: h["position"])
        return F.sort_array(F.array_distinct(F.filter(at, lambda p: p.isNotNull())))

    each = each.withColumn("_all", F.flatten(F.transform("_hits", lambda h: h["figures"])))
    found = lambda s: F.struct(s["place"].alias("place"), s["figure"].alias("figure"), s["scale"].alias("scale"), F.when(F.array_contains("_all", s["figure"]), positions(s["figure"])).alias("positions"))
    own = cut(each.select("id", *kept, F.transform("_stated", found).alias("_own")), "figures")
    asking = own.where(F.exists("_own", lambda s: s["scale"].isNotNull() & s["positions"].isNull())).select("id", F.inline("_own"))
    sources = rounded_from(asking.where("positions is null"), asking.where("positions is not null")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("figure", "source"))).alias("_sources"))
    own = own.join(sources, "id", "left")

    def final(s: Column) -> Column:
        source = F.try_element_at("_sources", s["figure"])
        far = F.filter("_own", lambda o: o["figure"] == source)[0]["positions"]
        return F.struct(s["place"].alias("place"), s["figure"].alias("figure"), s["scale"].alias("scale"), F.coalesce(s["positions"], F.when(source.isNotNull(), far)).alias("positions"), source.alias("rounds"))

    return own.select("id", *kept, F.transform("_own", final).alias("stated"))


def trace(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(id, place, figure, positions, rounds): each figure of each answer, the excerpts that print it or, with `rounds`, the figure that it rounds."""
    return _traced(answers, excerpts).select("id", F.inline("stated")).drop("scale")


def asks_for_calculation(expect: Column, inputs: Column) -> Column:
    """Two inputs or more, none of them with a number that is expected."""
    numbers = lambda c: F.flatten(F.transform(c, T.number_tokens))
    return F.coalesce((F.size(inputs) >= 2) & (F.size(expect) >= 1) & ~F.arrays_overlap(numbers(expect), numbers(inputs)), F.lit(False))


def figure_sources(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(id, status, stated, missing) for answers (id, answer, question, expect, inputs): `no figure stated`, traced, calculated or untraced.

    stated tells each figure's excerpts in words, in order; missing has those that no excerpt prints.
    """
    found = _traced(answers, excerpts, "expect", "inputs")

    def said(s: Column) -> Column:
        where = F.concat(F.when(F.size(s["positions"]) > 1, " from excerpts ").otherwise(" from excerpt "), F.array_join(F.transform(s["positions"], lambda p: p.cast("string")), ", "))
        return F.when(s["positions"].isNull(), F.concat(s["figure"], F.lit(" from no excerpt"))).otherwise(F.concat(s["figure"], F.coalesce(F.concat(F.lit(" (rounds "), s["rounds"], F.lit(")")), F.lit("")), where))

    some = F.size("stated") > 0
    each = found.select("id", "expect", "inputs", F.when(some, F.array_join(F.transform("stated", said), ", ")).alias("stated"), F.when(some, F.transform(F.filter("stated", lambda s: s["positions"].isNull()), lambda s: s["figure"])).alias("missing"))
    status = F.when(F.col("stated").isNull(), "no figure stated").when(F.size("missing") == 0, "traced").when(asks_for_calculation(F.col("expect"), F.col("inputs")), "calculated").otherwise("untraced")
    return each.select("id", status.alias("status"), "stated", "missing")


def expected_locations(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(id, place, value, positions, markers, location) for the expected values of answers (id, kind, passed, expect, inputs) that did not pass and are no negatives.

    location: `excerpt` if an excerpt prints it (a number as a token of a line, other text within a line), `derived` if
    it is not printed but all inputs that do not name it are in excerpts, else `missed`. markers are these
    inputs with the first excerpt that holds each, or null.
    """
    wanted = answers.where("id is not null and not coalesce(passed, false) and coalesce(kind, '') <> 'negative'").select("id", F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"), F.posexplode("expect").alias("place", "value"))
    wanted = wanted.withColumn("is_number", T.number_tokens(F.col("value")) == F.array("value"))
    numbers = sightings(wanted.where("is_number").select("id", F.col("value").alias("figure")), excerpts).select("id", F.col("figure").alias("value"), "position")
    lines = excerpts.select("id", "position", F.explode(F.split(F.lower("content"), "\n", -1)).alias("line"))
    texts = wanted.where("not is_number").select("id", "value").distinct().join(lines, "id").where(F.contains("line", F.lower("value"))).select("id", "value", "position").distinct()
    seen = numbers.union(texts).groupBy("id", "value").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    asked = wanted.select("id", "place", "value", F.posexplode(F.filter("inputs", lambda m: ~F.array_contains(T.number_tokens(m), F.col("value")))).alias("k", "marker"))
    first = asked.select("id", "marker").distinct().join(excerpts.select("id", "position", "content"), "id").where(F.contains("content", "marker")).groupBy("id", "marker").agg(F.min("position").alias("at"))
    from_ = asked.join(first, ["id", "marker"], "left").groupBy("id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "marker", "at"))), lambda x: F.struct(x["marker"].alias("marker"), x["at"].alias("at"))).alias("markers"))
    found = wanted.join(seen, ["id", "value"], "left").join(from_, ["id", "place"], "left")
    location = F.when(F.col("positions").isNotNull(), "excerpt").when(F.forall("markers", lambda m: m["at"].isNotNull()), "derived").otherwise("missed")
    return found.select("id", "place", "value", "positions", F.when(F.col("positions").isNull(), F.col("markers")).alias("markers"), location.alias("location"))


def answer_rank(needles: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(id, rank): the last of the needles' (id, needle) first positions in excerpts (id, position, content), null if one is in none."""
    first = needles.join(excerpts, "id", "left").groupBy("id", "needle").agg(F.min(F.when(F.contains("content", "needle"), F.col("position"))).alias("first"))
    return first.groupBy("id").agg(F.when(F.count("first") == F.count(F.lit(1)), F.max("first")).alias("rank"))
