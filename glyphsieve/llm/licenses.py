"""Licence scans with DataFrame functions only.

Headers and licence files are held against templates as windows of words: a window has as many words as its
template, and is placed so that an anchor word of the template lies on the same word of the text.  So wrapped,
commented, in-paragraph and whole-file wordings are each one vector.  Windows and templates are sparse TF-IDF vectors
over words, with document frequencies from the whole corpus; words that no template has weigh as words never seen.

The anchors of a template are the words that the corpus has least often, as many as it takes for what is left of the
template to be shorter than the threshold allows; so a window at the threshold holds an anchor.  A wording is found
where an anchor stands in its place or, as cosines take no order, near it.

Files that are licence texts in the main, or are named so, license their directory.  A file without a licence of
its own takes that of its nearest ancestor directory, found by joins on paths.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .storage import Scratch

THRESHOLD = 0.7
#: A file is a licence file if windows that match a licence's text make up this share of its words.
FILE_SHARE = 0.5
#: Templates are sent to every task; more text than this is refused.
MOST_TEMPLATE_BYTES = 1 << 20
NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
#: A window is coded as its template's number and its first word, which may lie before the text.
_SHIFT = 1 << 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def words(text: Column) -> Column:
    """ASCII letters in lower case and digits make words."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


class Model:
    """Templates as unit vectors, with their anchors, for document frequencies df among docs documents."""

    def __init__(self, templates, df: dict[str, int], docs: int, threshold: float):
        idf = lambda n: math.log((1 + docs) / (1 + n)) + 1
        self.unseen = idf(0)
        self.idf = {w: idf(df.get(w, 0)) for _, _, t in templates for w in tokens(t)}
        self.names = [name for name, _, _ in templates]
        self.kinds = [kind for _, kind, _ in templates]
        self.words = [tokens(t) for _, _, t in templates]
        self.units: list[dict[str, float]] = []
        self.need: list[int] = []
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for number, own in enumerate(self.words):
            vector = {w: own.count(w) * self.idf[w] for w in own}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            unit = {w: x / norm for w, x in vector.items()}
            self.units.append(unit)
            rest = 1.0
            for w in sorted(unit, key=lambda w: (-self.idf[w], own.count(w), w)):
                if rest < (threshold - 1e-9) ** 2:
                    break
                rest -= unit[w] ** 2
                self.anchors.setdefault(w, []).extend((number, at) for at, x in enumerate(own) if x == w)
            mass, most = 0.0, 0  # so many of its words a window at the threshold must hold
            for x in sorted(unit.values(), reverse=True):
                most += 1
                mass += x * x
                if mass >= (threshold - 1e-9) ** 2:
                    break
            self.need.append(most)


def _windows(ws: Column, model: Model) -> Column:
    """The codes of all windows of these words in which an anchor is in its place."""
    anchors = sorted(model.anchors)
    held = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(anchors))
    places = F.create_map(*[x for w, at in sorted(model.anchors.items()) for x in (F.lit(w), F.array(*[F.lit(number * _SHIFT + (1 << 31) - offset) for number, offset in at]))])
    return F.array_distinct(F.flatten(F.transform(held, lambda x: F.transform(F.element_at(places, x["w"]), lambda c: c + x["i"]))))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, path, license, score, first_word, via, origin.

    via is `header` for a licence in the text itself (license, its cosine and its window's first word, from 0,
    being the best by cosine, then licence, then place), `inherited` for one taken from the licence file at path
    origin, else null with license null.  A licence file is one whose name says so, or of whose words FILE_SHARE
    lie in windows that match a licence's text; a notice alone licenses only its own file.  Defined cases: a null
    or empty text has no header; a null path lies in no directory and inherits nothing; of several licence files
    in a directory the one of higher cosine, then smaller path counts; every row is a file of its own, whatever
    its id, and repeated rows each get a row; empty tables give none; null ids are kept; other columns are not
    read.  A text's windows are told by numbers until they prove to hold enough words of their template.
    """
    spark = files.sparkSession
    if sum(len(t.encode()) for _, _, t in templates) > MOST_TEMPLATE_BYTES:
        raise ValueError("too much template text")
    scratch = Scratch(spark, "licenses")
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("t"))
    vocabulary = sorted({w for _, _, t in templates for w in tokens(t)})
    held = F.array_intersect(words(F.col("t")), F.array(*map(F.lit, vocabulary)))
    counts = base.filter("t is not null").select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()  # a row per template word
    df = {r["word"]: r["count"] for r in counts}
    model = Model(templates, df, df.pop("", 0), threshold)

    # the texts are split once more; what is written keeps the words of the windows only
    size = F.array(*[F.lit(len(w)) for w in model.words])
    own = base.select("id", "path", words(F.col("t")).alias("ws")).withColumn("codes", _windows(F.col("ws"), model))
    low = lambda c: F.greatest(F.lit(0), (F.pmod(c, F.lit(_SHIFT)) - (1 << 31)).cast("int"))
    number = lambda c: F.shiftright(c, 32).cast("int")
    high = lambda c: F.least(F.size("ws"), ((F.pmod(c, F.lit(_SHIFT)) - (1 << 31)).cast("int") + F.get(size, number(c))))
    inside = lambda c: F.slice("ws", low(c) + 1, high(c) - low(c))
    window = lambda c: F.struct(c.alias("code"), inside(c).alias("words"))
    table = F.array(*[F.array(*[F.lit(w) for w in sorted(unit)]) for unit in model.units])
    need = F.array(*map(F.lit, model.need))
    enough = lambda c: F.size(F.array_intersect(inside(c), F.get(table, number(c)))) >= F.get(need, number(c))
    found = own.select(F.monotonically_increasing_id().alias("rid"), "id", "path", F.size("ws").alias("size"), F.transform(F.filter("codes", enough), window).alias("windows"))
    table_of_files = scratch.write(found, "files")

    cut = table_of_files.filter(F.size("windows") > 0).select("rid", F.explode("windows").alias("x"))
    tf = cut.select("rid", "x.code", F.explode("x.words").alias("word")).groupBy("rid", "code", "word").agg(F.count("*").alias("n"))
    weights = spark.sql(_values([(w, x) for w, x in sorted(model.idf.items())], ("word", "idf")))
    units = spark.sql(_values([(i, w, x) for i, unit in enumerate(model.units) for w, x in sorted(unit.items())], ("number", "word", "weight")))
    tf = tf.join(F.broadcast(weights), "word", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(model.unseen))).withColumn("number", F.shiftright("code", 32).cast("int"))
    tf = tf.join(F.broadcast(units), ["number", "word"], "left")
    dots = tf.groupBy("rid", "code").agg(F.sum(F.col("x") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    scored = dots.select("rid", "code", F.least(F.round(F.col("dot") / F.col("norm"), 6), F.lit(1.0)).alias("score")).filter(F.col("score") >= threshold)
    kinds = spark.sql(_values([(i, n, k == "text", len(w)) for i, (n, k, w) in enumerate(zip(model.names, model.kinds, model.words))], ("number", "license", "whole", "length")))
    matched = scored.withColumn("number", F.shiftright("code", 32).cast("int")).join(F.broadcast(kinds), "number")
    begin = (F.pmod("code", F.lit(_SHIFT)) - (1 << 31)).cast("int")
    matched = matched.select("rid", "license", "score", "whole", F.greatest(F.lit(0), begin).alias("first_word"), (begin + F.col("length")).alias("end"))
    best = F.min_by(F.struct("license", "score", "first_word"), F.struct(-F.col("score"), "license", "first_word")).alias("own")
    matched = scratch.write(matched, "matched")
    owned = matched.groupBy("rid").agg(best)
    covered = matched.filter("whole").join(table_of_files.select("rid", "size"), "rid").select("rid", "size", F.explode(F.sequence("first_word", F.least("end", "size") - 1)).alias("p"))
    mainly = covered.distinct().groupBy("rid", "size").agg(F.count("*").alias("n")).filter(F.col("n") >= FILE_SHARE * F.col("size")).select("rid", F.lit(True).alias("mainly"))
    owned = scratch.write(owned.join(mainly, "rid", "left").select("rid", "own", "mainly"), "owned")

    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    slim = table_of_files.select("rid", "id", "path")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(NAMES)
    grants = owned.join(slim, "rid").filter("path is not null").filter(F.coalesce("mainly", F.lit(False)) | named).select(folder(F.col("path")).alias("dir"), "own", "path")
    grants = grants.groupBy("dir").agg(F.min_by(F.struct("own.license", "own.score", F.col("path").alias("origin")), F.struct(-F.col("own.score"), "path", "own.license")).alias("grant"))
    folders = slim.filter("path is not null").select(folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))).alias("a"))
    nearest = above.select("folder", "a.depth", "a.dir").join(grants, "dir").groupBy("folder").agg(F.max_by("grant", "depth").alias("grant"))
    nearest = scratch.write(nearest.select(F.col("folder").alias("nfolder"), "grant"), "nearest")

    out = slim.withColumn("folder", folder(F.col("path"))).join(owned.select("rid", "own"), "rid", "left")
    out = out.join(nearest, F.col("folder") == F.col("nfolder"), "left")
    has = F.col("own").isNotNull()
    return out.select(
        "id",
        "path",
        F.coalesce("own.license", "grant.license").alias("license"),
        F.coalesce("own.score", "grant.score").alias("score"),
        F.col("own.first_word").cast("long").alias("first_word"),
        F.when(has, "header").when(F.col("grant").isNotNull(), "inherited").alias("via"),
        F.when(~has, F.col("grant.origin")).alias("origin"),
    )


def _values(rows: list[tuple], names: tuple[str, ...]) -> str:
    """A literal table; its words are letters and digits only, its licence names have no quote."""
    text = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)
    return f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} AS t({', '.join(names)})"
