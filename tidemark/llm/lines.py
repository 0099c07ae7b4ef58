"""Line deduplication by a log-template tree.

A line's path in the tree is its number of tokens and its three leading tokens, tokens with a digit or an at sign
being variable fields (``<*>``). In a leaf, lines are generalised position by position: a token stays if at least
``min_docs`` lines of the leaf (equal lines of one document count once) have it in that place, and is a variable field
otherwise, so that fields may be ordinary words. What is left is the line's template. It is taken if at least ``similarity``
of its tokens stay, leading ones counted. A template found in at least ``min_docs`` documents is recurring: its lines are
dropped everywhere but for the first line of the document with the least id.

Equal lines travel as one form with the number of its documents; counts are taken over distinct (form,
document) pairs, which are partially aggregated, and tables of counts are joined by broadcast if they are of a checked
size, else with lines dealt to several copies of their form, so that a line of a third of all documents is no hot spot.

Edge cases: a null text is empty; an empty text is one empty line, which stays. Lines of fewer than
``min_tokens`` tokens stay, and a line that has a rare word in the place of a template's constant is not of that template.
Rows with the same id and text are one document and get the same result; a null id sorts before others. Very
long lines are read in full. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LEADING = 3
FIELD = "<*>"
#: Tokens with these are variable fields; lines with these, or with white space that isn't one space, need work.
VARIABLE = "[0-9@]"
WORK = r"[0-9@]|\s\s|[^\S ]"
SENT, COPIES = 1 << 18, 16  # most rows of forms or leaves (some 50 bytes each) that are sent to every executor; copies of a form beyond
LEAF, FORM = ["tokens", "lead"], ["tokens", "lead", "form"]


def _masked(line: Column) -> Column:
    """A line with single spaces and its variable fields generalised. Each pattern is one pass, so long lines stay cheap."""
    tokens = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    fields = F.transform(tokens, lambda t: F.when(t.rlike(VARIABLE), FIELD).otherwise(t))
    return F.when(line.rlike(WORK), F.array_join(fields, " ")).otherwise(F.trim(line))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_own": F.xxhash64(text)})


def paths(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(_id, _own, line, tokens, lead, form, masked): the tree path of each line that is long enough; form is its hash in whole."""
    # masked within the generator, which evaluates it once
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _masked)
    lines = _keyed(docs).select("_id", "_own", F.posexplode(lines).alias("line", "masked"))
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    lead = F.substring_index("masked", " ", LEADING)
    return lines.filter((F.col("masked") != "") & (tokens >= min_tokens)).select("_id", "_own", "line", tokens.alias("tokens"), F.xxhash64(lead).alias("lead"), F.xxhash64("masked", F.lit(1)).alias("form"), "masked")


def _with_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """``rows`` joined to a table of forms (one row a form), however many rows a form has."""
    if forms.count() <= SENT:
        return rows.join(F.broadcast(forms), FORM)
    copies = forms.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("_copy", F.pmod(F.xxhash64("_id", "line"), F.lit(COPIES)).cast("int")).join(copies, [*FORM, "_copy"]).drop("_copy")


def templates(lines: DataFrame, by_doc: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(tokens, lead, form, template) of the forms whose template may recur. by_doc: the distinct (form, document) pairs of ``lines``."""
    counts = by_doc.groupBy(*FORM).agg(F.count("*").alias("docs"))
    # a template of enough documents needs a leaf of enough lines
    leaves = stored(counts.groupBy(*LEAF).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select(*LEAF))
    few = F.broadcast(leaves) if leaves.count() <= SENT else leaves
    forms = stored(lines.join(few, LEAF, "left_semi").groupBy(*FORM).agg(F.min("masked").alias("masked")).join(counts, FORM))
    tokens = F.split("masked", " ")
    fixed = F.aggregate(F.slice(tokens, 1, LEADING), F.lit(0), lambda n, t: n + F.when(t == FIELD, 0).otherwise(1))
    spots = forms.select(*FORM, "docs", F.posexplode(tokens).alias("at", "word")).filter((F.col("at") >= LEADING) & (F.col("word") != FIELD))
    spots = spots.select(*FORM, "docs", "at", F.xxhash64("word").alias("word"))
    place = [*LEAF, "at", "word"]
    stay = spots.groupBy(*place).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select(*place)
    kept = spots.join(stay, place, "left_semi").groupBy(*FORM).agg(F.count("*").alias("kept"), F.bit_xor(F.xxhash64("at", "word")).alias("template"))
    whole = forms.select(*FORM, fixed.alias("fixed")).join(kept, FORM, "left").na.fill(0, ["kept", "template"])
    return whole.filter(F.col("fixed") + F.col("kept") >= similarity * F.col("tokens") - 1e-9).select(*FORM, F.xxhash64("template", "kept").alias("template"))


def recurring(lines: DataFrame, min_docs: int = 5, similarity: float = 0.7) -> DataFrame:
    """(tokens, lead, form, first): the forms of templates in at least ``min_docs`` documents, with the place of the line that stays."""
    by_doc = stored(lines.groupBy(*FORM, "_id", "_own").agg(F.min("line").alias("line")))
    found = stored(templates(lines, by_doc, min_docs, similarity))
    leaf = [*LEAF, "template"]
    held = _with_forms(by_doc, found).groupBy(*leaf, "_id", "_own").agg(F.min("line").alias("line"))
    whole = held.groupBy(*leaf).agg(F.count("*").alias("docs"), F.min(F.struct("_id", "_own", "line")).alias("first"))
    return found.join(whole.filter(F.col("docs") >= min_docs), leaf).select(*FORM, "first")


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, similarity: float = 0.7) -> DataFrame:
    """``docs`` with the text that is left, and n_lines and n_dropped."""
    lines = stored(paths(docs, min_tokens))
    found = _with_forms(lines.drop("masked"), stored(recurring(lines, min_docs, similarity)))
    stays = (F.col("first._id") == F.col("_id")) & (F.col("first._own") == F.col("_own")) & (F.col("first.line") == F.col("line"))
    # a document's own line numbers, not a group of documents
    drops = found.filter(~stays).groupBy("_id", "_own").agg(F.collect_set("line").alias("_drops"))
    whole = _keyed(docs).join(drops, ["_id", "_own"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.when(F.col("_drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.concat_ws("\n", F.filter(lines, lambda _, i: ~F.array_contains("_drops", i)))
    )
    columns = [kept.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return whole.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"))
