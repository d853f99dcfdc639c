"""Course trees as passages and units: LaTeX files, and XML modules with their collections.

A file is one row, read by Spark's whole-text reader. Only what is sequential within one file, the stack of open
environments or the walk over a tree, is a Python kernel over Arrow batches; identifiers, cleaning,
collection paths and unit texts are column expressions, so files spread over all tasks and no
kernel sees another file. A file must fit a task's memory.

Passages: passage_id, doc_id, section, text, unit_id, seq (the order within doc_id). Units: unit_id, doc_id,
unit_type, text.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_ws

# fixed values: results depend on them
STYLES = "textbf|textit|emph|underline|texttt|textrm"
DROPPED = "label|ref|cite|citep|citet|footnote"
SKIPPED = "build|out|\\.git"
MODULE_NS = "{http://cnx.rice.edu/cnxml}"
COLLECTION_NS = "{http://cnx.rice.edu/collxml}"
META_NS = "{http://cnx.rice.edu/mdml}"
UNIT_TAGS = ("definition", "example", "equation")
UNIT_CHARS = 40  # from which a unit is a passage as well

_ROWS = "doc_id string, seq long, kind string, i long, unit_id string, unit_type string, own_id string, tail array<string>, text string"


def latex_text(c: Column) -> Column:
    """Plain text of LaTeX: references and notes dropped, styling unwrapped however deep, other commands, braces
    and dollar signs to spaces. Comments must be gone already."""
    t = F.regexp_replace(c, rf"\\(?:{DROPPED})\{{[^}}]*\}}", " ")
    wrapped = rf"\\(?:{STYLES})\{{([^}}]*)\}}"
    passes = F.sequence(F.lit(0), F.regexp_count(t, F.lit(rf"\\(?:{STYLES})")))  # each pass unwraps one at least
    t = F.aggregate(passes, t, lambda now, _: F.regexp_replace(now, wrapped, "$1"))
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " ")
    return normalize_ws(F.translate(t, "{}$", "   "))


def whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, text): every file under root that matches the name pattern, path relative to root."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # Spark states paths encoded
    full = F.regexp_replace(plain, "^[a-z0-9]+:/+", "/")
    base = re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
    return files.select(F.substring(full, len(base) + 1, 1 << 20).alias("path"), F.col("value").alias("text"))


def _tex_rows(doc: str, text: str) -> Iterator[tuple]:
    """A file's units as they open, and its text between environment lines: whole, and by paragraph."""
    opened, stack, held, seq = Counter(), [], [], 0
    current = None

    def settle():
        nonlocal seq
        if "".join(held).strip():
            seq += 1
            yield (doc, seq, "block", 0, current, None, None, None, "\n".join(held))
            blocks = re.split(r"\n(?:\n)+", "\n".join(line.strip() for line in held).strip("\n"))
            for i, block in enumerate(b for b in blocks if b):
                seq += 1
                yield (doc, seq, "para", i, current, None, None, None, block.replace("\n", " "))
        held.clear()

    for line in (text or "").splitlines():
        line = re.sub(r"(?<!\\)%.*$", "", line)
        if begin := re.search(r"\\begin\{([a-zA-Z*]+)\}", line):  # a line that opens is not looked at for an end
            yield from settle()
            kind = begin[1]
            opened[kind] += 1
            current = f"olp_unit:{doc}:{kind}:{opened[kind]}"
            stack.append((kind, current))
            seq += 1
            yield (doc, seq, "unit", 0, current, kind, None, None, None)
        elif end := re.search(r"\\end\{([a-zA-Z*]+)\}", line):
            yield from settle()
            if stack and stack[-1][0] == end[1]:
                stack.pop()
            current = stack[-1][1] if stack else None
        else:
            held.append(line)
    yield from settle()


def _kernel(files: DataFrame, rows) -> DataFrame:
    names = [f.split()[0] for f in _ROWS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                yield pd.DataFrame(list(rows(path, text)), columns=names)

    return files.mapInPandas(run, _ROWS)


def latex_course(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, units) of LaTeX files (path, text). Files under a folder named build, out or .git are left out.

    Every environment is a unit, one without text an empty one. Empty and null files give no rows."""
    kept = files.where(~F.col("path").rlike(rf"(^|/)(?:{SKIPPED})/"))
    rows = _kernel(kept, _tex_rows).withColumn("clean", latex_text(F.col("text")))
    key = F.concat_ws("::", "doc_id", F.coalesce("unit_id", F.lit("none")), F.col("i").cast("string"), "clean")
    passages = rows.where("kind = 'para' AND clean <> ''").select(
        F.concat(F.lit("olp:"), F.substring(F.sha2(key, 256), 1, 16)).alias("passage_id"), "doc_id", F.col("doc_id").alias("section"), F.col("clean").alias("text"), "unit_id", "seq"
    )
    said = F.collect_list(F.when((F.col("kind") == "block") & (F.col("clean") != ""), F.struct("seq", "clean")))
    units = rows.where("unit_id IS NOT NULL AND kind <> 'para'").groupBy("unit_id", "doc_id").agg(F.max("unit_type").alias("unit_type"), said.alias("said"))
    return passages, units.select("unit_id", "doc_id", "unit_type", F.array_join(F.transform(F.array_sort("said"), lambda s: s["clean"]), "\n").alias("text"))


def _inner(el: ET.Element) -> str:
    return " ".join((t or "").strip() for t in el.itertext())


def _title(el: ET.Element, ns: str, default: str) -> str:
    found = el.find(f"{ns}title")
    return default if found is None else (found.text or "").strip()


def _tree(path: str, text: str | None) -> ET.Element | None:
    """A file's root; None if it is null or blank. A file that is no XML fails, by name."""
    if not (text or "").strip():
        return None
    try:
        return ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError(f"{path} is not well-formed XML: {e}") from e


def _module_rows(path: str, text: str | None) -> Iterator[tuple]:
    """A module's units and paragraphs in document order, each with the titles around it."""
    module = path.split("/")[-2] if "/" in path else path
    root, numbered, seq = _tree(path, text), Counter(), 0
    if root is None:
        return
    content = root.find(f"{MODULE_NS}content")
    todo = [] if content is None else [(content, None, [_title(root, MODULE_NS, module)])]
    while todo:  # depth first: children go on top, the first uppermost
        el, unit, titles = todo.pop()
        tag = el.tag.removeprefix(MODULE_NS) if isinstance(el.tag, str) and el.tag.startswith(MODULE_NS) else None
        own, children = (el.get("id") or "").strip(), list(el)
        seq += 1
        if tag == "para":
            yield (module, seq, "para", 0, unit, None, own or None, titles, _inner(el))
            continue
        if tag == "section":
            heading = el.find(f"{MODULE_NS}title")
            titles = titles + [_title(el, MODULE_NS, "")]
            children = [c for c in children if c is not heading]
        elif tag in UNIT_TAGS:
            if not own:
                numbered[tag] += 1
            unit = f"osp_unit:{module}:{tag}:{own or numbered[tag]}"
            yield (module, seq, "unit", 0, unit, tag, None, titles, _inner(el))
        todo += [(c, unit, titles) for c in reversed(children)]


def collection_paths(files: DataFrame) -> DataFrame:
    """(doc_id, base): the title of the collection that lists a module; of several the last by path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                if (root := _tree(path, text)) is None:
                    continue
                found = root.find(f".//{META_NS}title")
                title = (found.text or "").strip() if found is not None else ""
                title = title or path.rsplit("/", 1)[-1].removesuffix(".xml")
                content = root.find(f"{COLLECTION_NS}content")
                listed = [] if content is None else [m.get("document") for m in content.iterfind(f".//{COLLECTION_NS}module")]
                yield pd.DataFrame({"doc_id": [m for m in listed if m], "base": title, "path": path})

    listed = files.mapInPandas(run, "doc_id string, base string, path string")
    return listed.groupBy("doc_id").agg(F.max_by("base", "path").alias("base"))


def xml_course(modules: DataFrame, collections: DataFrame, untitled: str = "OpenStax University Physics") -> tuple[DataFrame, DataFrame]:
    """(passages, units) of XML modules and collections, both (path, text); a module's name is its folder's.

    Null and blank files give no rows; a file that is not well-formed fails the job, by name. A unit of 40
    characters or more is a passage as well. Of units with one id the first gives the text. A module
    in no collection gets `untitled`, a fixed value."""
    rows = _kernel(modules, _module_rows).withColumn("clean", normalize_ws(F.col("text")))
    based = rows.join(collection_paths(collections), "doc_id", "left")
    titles = F.filter(F.concat(F.array(F.coalesce("base", F.lit(untitled))), "tail"), lambda t: t != "")
    first = rows.where("kind = 'unit'").groupBy("unit_id").agg(F.min_by(F.struct("doc_id", "unit_type", "clean"), "seq").alias("u"))
    units = first.select("unit_id", "u.doc_id", "u.unit_type", F.col("u.clean").alias("text"))
    said = based.join(first.select("unit_id", F.col("u.clean").alias("__unit")), "unit_id", "left")
    text = F.when(F.col("kind") == "unit", F.col("__unit")).otherwise(F.col("clean"))
    own = F.coalesce("own_id", F.substring(F.sha2(F.concat_ws("::", "doc_id", "clean"), 256), 1, 16))
    name = F.when(F.col("kind") == "unit", F.concat(F.lit("osp_passage_unit:"), "unit_id")).otherwise(F.concat_ws(":", F.lit("osp"), "doc_id", own))
    least = F.when(F.col("kind") == "unit", UNIT_CHARS).otherwise(1)
    passages = said.select(name.alias("passage_id"), "doc_id", F.array_join(titles, " / ").alias("section"), text.alias("text"), "unit_id", "seq", least.alias("__least"))
    return passages.where("length(text) >= __least").drop("__least"), units


def read_latex_course(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return latex_course(whole_files(spark, root, "*.tex"))


def read_xml_course(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """modules/m*/index.cnxml and collections/*.collection.xml under root."""
    modules = whole_files(spark, root, "index.cnxml").where(F.col("path").rlike("^modules/m[^/]*/index[.]cnxml$"))
    return xml_course(modules, whole_files(spark, root, "*.collection.xml").where(F.col("path").rlike("^collections/[^/]+$")))
