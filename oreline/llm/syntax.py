"""Source files that do not parse.

Files are lexed into DataFrame rows: one a stretch of tokens up to the next bracket, and one a pair of adjacent tokens that the file
holds. Three checks follow, all in the JVM:

1. Adjacent pairs: an anti-join against the pairs the language's grammar permits (a fixed table derived from the productions)
   leaves the stray ones over.
2. Nesting: a running sum of openings and closings per file gives each stretch its level, a running count on each level the bracket
   it stands in; the bracket that closes must be of the kind that opened, no level may fall below zero and none may stay open.
3. Statements: the stretches of a bracket's contents are put together, nested brackets and blocks being one symbol each, and cut into
   statements; each statement, and the contents of each round or square bracket, must match one of the
   language's statement forms. For Python, clauses (else, except ...) must follow a statement that may have them.

Python files that fail are confirmed by the language's own parser; for the other languages no exact check exists here.

Scale: equal contents are lexed once (copies are joined back by a content digest of 128 bits); all windows share one shuffle by content, so
the stretches are moved once. Permissible pairs never leave the lexing stage. The pairs are broadcast: at most a few thousand rows, fixed by the grammars.

Defined results
---------------
* Null code and files whose language is unknown (or null with an unknown ending) are not judged; empty code is valid.
* Language names are trimmed, in any case, and may be usual short forms; null or blank means that of the path's ending.
* Undeclared or repeated names, types and missing imports do not matter. Rows of equal id are each judged.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from oreline.functions.text import clean_path, strip
from oreline.llm import grammar, lexers

TOKENS = "k bigint, k2 bigint, lang string, pos int, seg string, bracket string, pair string"
KEY = ("k", "k2")
STRETCH = re.compile("([^()\\[\\]{}\x01\x02$]*)([()\\[\\]{}\x01\x02$])")
#: On a brace level a statement does not end at a closing brace that one of these follows.
GOES_ON = {
    "javascript": "EcyW;,.)]}=bsx<>?:NPS(G[fk", "typescript": "EcyW;,.)]}=bsx<>?:NPS(G[fkX", "java": "Ecy;,.)]}=bsx<>?:NP([k", "c": "E;,.)]}=bsx?:i(x[kPS", "go": "E;,.)]}=bsx:([PSBil", "python": "",
}


def language_of(language: Column, path: Column) -> Column:
    """The language's plain name, or null where it is not one of the six."""
    ending = F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), r"\.([a-z0-9]+)\s*$", 1)
    name = F.lower(strip(language))
    name = F.when(F.coalesce(name, F.lit("")) == "", ending).otherwise(name)
    short = F.create_map(*(F.lit(x) for pair in lexers.NAMES.items() for x in pair))
    full = F.coalesce(F.element_at(short, name), name)
    return F.when(full.isin(*lexers.LANGUAGES), full)


def contents(samples: DataFrame) -> DataFrame:
    """(id, file_path, lang, code, k, k2) of the samples that can be judged; ``k`` and ``k2`` digest language and code."""
    lang = language_of(F.col("language"), F.col("file_path"))
    return samples.select("id", "file_path", lang.alias("lang"), "code").where("code is not null and lang is not null").withColumn("k", F.xxhash64("lang", "code")).withColumn("k2", F.xxhash64(F.lit(1), "code", "lang"))


def lex_rows(files: DataFrame) -> DataFrame:
    """The stretches (pos from 0, tokens, the bracket after them) and the different adjacent pairs (pos -1) of (k, k2, lang, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, pos, seg, bracket, pair = [batch.column(c) for c in (*KEY, "lang")], [], [], [], [], []
            for i, (lang, code) in enumerate(zip(keys[2].to_pylist(), batch.column("code").to_pylist())):
                text = "".join((grammar.BEGIN, *lexers.lex(code, lang), grammar.END))
                found = STRETCH.findall(text, 1)
                pairs = list(set(map("".join, zip(text, text[1:]))))
                n, m = len(found) + 1, len(pairs)
                owner += [i] * (n + m)
                pos += [*range(n), *[-1] * m]
                seg += ["", *(x for x, _ in found), *[None] * m]
                bracket += [grammar.BEGIN, *(x for _, x in found), *[None] * m]
                pair += [None] * n + pairs
            take = pa.array(owner, pa.int32())
            columns = [*(c.take(take) for c in keys), pa.array(pos, pa.int32()), *(pa.array(x, pa.string()) for x in (seg, bracket, pair))]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "lang", "pos", "seg", "bracket", "pair"])

    return files.mapInArrow(run, TOKENS)


def pair_table(spark: SparkSession) -> DataFrame:
    """The permissible pairs of all languages: a fixed table."""
    rows = [(lang, a + b) for lang, spec in grammar.languages().items() for a, b in sorted(spec["pairs"])]
    return spark.createDataFrame(rows, "lang string, pair string")


def without_permissible(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stretches and the stray pairs: those that the anti-join with the permissible pairs leaves over (lexical errors are in no pair)."""
    return rows.join(F.broadcast(pairs), ["lang", "pair"], "left_anti")  # fixed by the grammars


def bracket_contents(rows: DataFrame) -> DataFrame:
    """One row per bracket, block or file: k, k2, lang, level, c (its number on the level), opened, text (its symbols) and whether it is ``wrong``
    in nesting. Stray pairs are wrong contents of a level of their own."""
    opens, closes = list(grammar.OPEN.values()), list(grammar.CLOSE.values())
    step = F.when(F.col("bracket").isin(*opens), 1).when(F.col("bracket").isin(*closes), -1).otherwise(0)
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    # an opening bracket is a symbol of the level around it and begins the level within; a closing one ends that level
    symbol = F.translate(F.col("bracket"), "".join(opens), "".join(grammar.OPEN))
    event = lambda level, sym, begin, end: F.struct(level.alias("level"), sym.alias("sym"), begin.alias("begin"), end.alias("end"))
    none, depth, seg, bracket = F.lit(""), F.col("depth"), F.col("seg"), F.col("bracket")
    events = F.when(F.col("pair").isNotNull(), F.array(event(F.lit(-1).cast("bigint"), none, none, F.col("pair"))))
    events = events.when(bracket == grammar.BEGIN, F.array(event(depth, none, bracket, none)))
    events = events.when(F.col("step") == 1, F.array(event(depth, F.concat(seg, symbol), none, none), event(depth + 1, none, bracket, none)))
    events = events.otherwise(F.array(event(depth, seg, none, bracket)))
    flat = placed.select(*KEY, "lang", "pos", F.explode(events).alias("e")).select(*KEY, "lang", "pos", "e.*")
    upto = Window.partitionBy(*KEY, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = flat.withColumn("c", F.sum((F.col("begin") != "").cast("int")).over(upto))
    found = flat.groupBy(*KEY, "lang", "level", "c").agg(
        F.max("begin").alias("opened"), F.max("end").alias("closed"), F.count_if(F.col("end") != "").alias("ends"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("sym") != "", F.struct("pos", "sym")))), lambda x: x["sym"]), "").alias("text"),
    )
    partner = F.translate(F.col("opened"), "".join(opens) + grammar.BEGIN, "".join(closes) + grammar.END)
    wrong = (F.col("level") < 0) | (F.col("c") == 0) | (F.col("ends") != 1) | (F.col("closed") != partner)
    return found.select(*KEY, "lang", "level", "c", "opened", "text", wrong.alias("wrong"))


def _cut(lang: str) -> str:
    """Where a statement ends: at a semicolon or a brace that nothing goes on; in Python at a line end without a block, or a block."""
    return "(?<=Z)(?!D)|(?<=D)" if lang == "python" else f"(?<=;)|(?<=B)(?![{re.escape(GOES_ON[lang])}])"


def failing(contents: DataFrame) -> DataFrame:
    """The keys of contents that are wrong, have a statement of no form, or, in Python, a clause that no statement before or after it takes up."""
    fits = F.lit(True)
    opened, text = F.col("opened"), F.col("text")
    for lang, spec in grammar.languages().items():
        of = spec["forms"]
        whole = lambda form: text.rlike(f"^(?:{form})$") | (text == "")
        each = lambda form, lang=lang: F.forall(F.split(text, _cut(lang), -1), lambda x: (x == "") | x.rlike(f"^(?:{form})$"))
        here = F.when(opened == "(", whole(of["P"])).when(opened == "[", whole(of["S"])).when(opened == grammar.BEGIN, each(of["top"]))
        if lang == "python":
            here = here.when(opened == "{", each(of["B"]))
        fits = F.when(F.col("lang") == lang, here.otherwise(each(of["D" if lang == "python" else "B"]))).otherwise(fits)
    lines = F.filter(F.split(text, _cut("python"), -1), lambda x: ~x.isin("", "Z"))
    head = lambda x: F.when(x.startswith("@"), "@").when(x.rlike(":(?:Z|.*Z)D?$") & ~x.startswith("Z"), F.regexp_extract(x, "^A?(.)", 1)).otherwise("")
    heads = F.transform(lines, head)

    def lost(x: Column, i: Column) -> Column:
        prev, nxt = F.coalesce(F.get(heads, i - 1), F.lit("")), F.coalesce(F.get(heads, i + 1), F.lit(""))
        out = ((x == "T") & ~nxt.isin("c", "y")) | ((x == "@") & ~nxt.isin("@", "F", "K"))
        for clause, before in (("e", "Ie"), ("E", "IeLWc"), ("c", "Tc"), ("y", "TcE")):
            out = out | ((x == clause) & ~prev.isin(*before))
        return out

    stray = (F.col("lang") == "python") & opened.isin(grammar.BEGIN, "\x01") & text.rlike("[@TeEcy]") & F.exists(F.transform(heads, lost), lambda x: x)
    return contents.where(F.col("wrong") | ~fits | stray).select(*KEY).distinct()


@F.pandas_udf(BooleanType())
def _fails_in_python(code: pd.Series) -> pd.Series:
    def fails(text: str) -> bool:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "sample", "exec", dont_inherit=True)
            return False
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return True

    return code.map(fails)


def find_invalid(samples: DataFrame) -> DataFrame:
    """(id, file_path, lang) of the samples whose code is not valid."""
    spark = samples.sparkSession
    rows = contents(samples)
    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many lexing tasks as the session wants, however small the code
    files = rows.select(*KEY, "lang", "code").repartition(parts_n, *KEY).groupBy(*KEY).agg(F.first("lang").alias("lang"), F.first("code").alias("code"))
    lexed = without_permissible(lex_rows(files), pair_table(spark)).repartition(parts_n, *KEY)
    suspects = rows.join(failing(bracket_contents(lexed)), list(KEY), "left_semi")
    # not deterministic, so that the check is not pushed below the join: only suspects are parsed
    wrong = F.when(F.col("lang") == "python", _fails_in_python.asNondeterministic()("code")).otherwise(F.lit(True))
    return suspects.where(wrong).select("id", "file_path", "lang")


def invalid_rates(samples: DataFrame) -> DataFrame:
    """Per repository (first segment of the path) and language: files judged, invalid ones and their rate."""
    repo = F.split(clean_path("file_path"), "/")[0].alias("repository")
    every = contents(samples).select(repo, F.col("lang").alias("language")).groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n_files"))
    bad = find_invalid(samples).select(repo, F.col("lang").alias("language")).groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n_invalid"))
    same = F.col("e.repository").eqNullSafe(F.col("b.repository")) & (F.col("e.language") == F.col("b.language"))
    n = F.coalesce("n_invalid", F.lit(0))
    return every.alias("e").join(bad.alias("b"), same, "left").select("e.repository", "e.language", "n_files", n.alias("n_invalid"), F.round(n / F.col("n_files"), 6).alias("rate"))
