"""A filer's taxonomy: roles, presented concepts, their parents and labels, from the schema and its linkbases."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

_LINK, _XLINK = "{http://www.xbrl.org/2003/linkbase}", "{http://www.w3.org/1999/xlink}"
STANDARD = "http://www.xbrl.org/2003/role/label"
_SCHEMA = "file string, seq int, kind string, link int, role string, label string, target string, text string"


def elements(content: bytes) -> list[tuple]:
    """(seq, kind, link, role, label, target, text) of the elements that a taxonomy is made of; link numbers the extended link that holds them."""
    root, out, link, held = ElementTree.fromstring(content), [], 0, None
    if ns := root.get("targetNamespace"):
        out.append(("namespace", 0, None, None, ns, None))
    for e in root.iter():
        x = lambda name, e=e: e.get(_XLINK + name)
        if e.tag == _LINK + "roleType":
            definition = e.find(_LINK + "definition")
            out.append(("role", 0, e.get("roleURI"), None, None, (definition.text or "").strip() if definition is not None else ""))
        elif e.tag == _LINK + "linkbaseRef":
            if x("href") is None:
                raise ValueError("a linkbaseRef without href")
            out.append(("linkbase", 0, None, None, x("href"), None))
        elif e.tag in (_LINK + "presentationLink", _LINK + "labelLink"):
            link += 1
            held = "presentation" if e.tag.endswith("presentationLink") else "label"
            out.append((f"{held}-link", link, x("role"), None, None, None))
            for c in e:
                y = lambda name, c=c: c.get(_XLINK + name)
                if c.tag == _LINK + "loc":
                    out.append((f"{held}-loc", link, x("role"), y("label"), y("href"), None))
                elif c.tag in (_LINK + "presentationArc", _LINK + "labelArc"):
                    out.append((f"{held}-arc", link, x("role"), y("from"), y("to"), None))
                elif c.tag == _LINK + "label":
                    out.append(("label", link, y("role") or STANDARD, y("label"), None, (c.text or "").strip()))
    return [(i, *row) for i, row in enumerate(out)]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, seq, kind, link, role, label, target, text) of every schema and linkbase of a folder; a linkbase that a schema names and the folder lacks raises."""
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4]
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if rows := [(name, *r) for r in elements(content)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xsd,xml}").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1)).where(~F.col("file").endswith("_htm.xml"))
    found = files.select("file", "content").mapInArrow(run, _SCHEMA)
    absent = found.where("kind = 'linkbase'").select("target").join(files.select(F.col("file").alias("target")), "target", "left_anti").head(1)
    if absent:
        raise FileNotFoundError(f"{absent[0]['target']} is named by a schema and not in {folder}")
    return found


def filing_taxonomies(rows: DataFrame, pages: DataFrame, filing: str = "filing", html: str = "html") -> DataFrame:
    """(filing, schema, file): the schema whose target namespace a page's root declares, the first by name of several, and each file that it is made of.

    A namespace says which, as saved pages may have lost their reference to the schema. Pages that declare none of a schema's have no row.
    """
    root = F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0)
    declared = F.regexp_extract_all(root, F.lit(r"""(?i)\sxmlns:[\w.-]+\s*=\s*["']([^"']*)["']"""), F.lit(1))
    named = pages.select(F.col(filing).alias("filing"), F.explode(F.array_distinct(declared)).alias("target"))
    schemas = rows.where((F.col("kind") == "namespace") & F.lower("file").endswith(".xsd")).select("target", F.col("file").alias("schema"))
    own = named.join(schemas, "target").groupBy("filing").agg(F.min("schema").alias("schema"))
    parts = rows.where("kind = 'linkbase'").select(F.col("file").alias("schema"), F.col("target").alias("file"))
    return own.select("filing", "schema", F.col("schema").alias("file")).union(own.join(parts, "schema").select("filing", "schema", "file")).distinct()


def roles(rows: DataFrame) -> DataFrame:
    """(file, uri, sort_code, type, title)."""
    named = rows.where("kind = 'role'").select("file", F.col("role").alias("uri"), T.role_definition(F.col("text")).alias("d"))
    return named.select("file", "uri", T.trimmed(F.col("d.sort_code")).alias("sort_code"), T.trimmed(F.col("d.type")).alias("type"), T.trimmed(F.col("d.title")).alias("title"))


def _concept(target):
    return T.concept_of(F.regexp_replace(target, "^[^#]*#", ""))


def _located(rows: DataFrame, kind: str) -> DataFrame:
    """(file, link, label, concept): the first locator of each label."""
    locs = rows.where(F.col("kind") == f"{kind}-loc")
    return locs.groupBy("file", "link", "label").agg(F.min_by("target", "seq").alias("target")).select("file", "link", "label", _concept(F.col("target")).alias("concept"))


def presented(rows: DataFrame) -> DataFrame:
    """(role, concepts): all concepts that a role presents."""
    return rows.where("kind = 'presentation-loc'").groupBy("role").agg(F.array_sort(F.collect_set(_concept(F.col("target")))).alias("concepts"))


def parents(rows: DataFrame) -> DataFrame:
    """(role, child, parent): the first arc to a child of a role counts."""
    arcs, at = rows.where("kind = 'presentation-arc'"), _located(rows, "presentation")
    ends = arcs.join(at.withColumnRenamed("concept", "parent"), ["file", "link", "label"]).select("role", "file", "link", "seq", F.col("target").alias("label"), "parent")
    both = ends.join(at.withColumnRenamed("concept", "child"), ["file", "link", "label"])
    return both.groupBy("role", "child").agg(F.min_by("parent", F.struct("file", "seq")).alias("parent"))


def labels(rows: DataFrame) -> DataFrame:
    """(concept, label): the standard label, the first one of a concept."""
    arcs = rows.where("kind = 'label-arc'").select("file", "link", "seq", "label", "target").join(_located(rows, "label"), ["file", "link", "label"])
    texts = rows.where((F.col("kind") == "label") & (F.col("role") == STANDARD)).groupBy("file", "link", "label").agg(F.min_by("text", "seq").alias("text")).withColumnRenamed("label", "target")
    first = F.row_number().over(Window.partitionBy("concept").orderBy("file", "seq"))
    return arcs.join(texts, ["file", "link", "target"]).withColumn("_n", first).where("_n = 1").select("concept", F.col("text").alias("label"))


def primary_statements(role_rows: DataFrame) -> DataFrame:
    return role_rows.where((F.col("type") == "Statement") & ~F.contains("title", F.lit("Parenthetical")))


def note_roles(role_rows: DataFrame) -> DataFrame:
    """Disclosure roles that are whole notes, not tables, policies or details of one."""
    return role_rows.where((F.col("type") == "Disclosure") & ~F.col("title").rlike(r"(?i)\((Tables|Policies|Details.*)\)\s*$"))


def note_topics(fact_rows: DataFrame, role_rows: DataFrame, presented_rows: DataFrame) -> DataFrame:
    """(filing, seq, place, topic): the note roles that present each text block, in the order of their sort codes; blocks of form taxonomies are none."""
    blocks = fact_rows.where(F.col("is_text_block") & ~F.col("concept").rlike("^(dei|cyd|ecd):")).select("filing", "seq", "concept")
    concepts = presented_rows.select(F.col("role").alias("uri"), F.explode("concepts").alias("concept"))
    both = blocks.join(concepts, "concept").join(note_roles(role_rows).select("uri", "sort_code", "title"), "uri")
    place = F.row_number().over(Window.partitionBy("filing", "seq").orderBy(F.length("sort_code"), "sort_code"))
    return both.select("filing", "seq", place.alias("place"), T.topic_title(F.col("title")).alias("topic"))
