"""Lattice dumps to nested rows, and the nodes that matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BooleanType, FloatType, IntegerType, StringType, StructField, StructType,
)

from ..functions.arrays import bind, computed_once, empty_array, span
from ..sources.ship import ship
from .node_lines import PlainParser

# The feature keys of the analyser's dump format.
KEY_FEATURE_SCORE = "特徴量スコア"
KEY_LM_SCORE = "言語モデルスコア"
KEY_ANALYSIS_SCORE = "形態素解析スコア"
KEY_RANKS = "ランク"
KEY_UNKNOWN_WORD = "未知語"
KEY_NORMAL_FORM = "正規化代表表記"
SPECIAL_KEYS = [KEY_FEATURE_SCORE, KEY_LM_SCORE, KEY_ANALYSIS_SCORE, KEY_RANKS]

# Column positions in a node line.
COL_ID, COL_PREV, COL_START, COL_END, COL_SURFACE, COL_CANONICAL, COL_READING, COL_DICFORM = range(1, 9)
COL_TAGS, COL_NUMBERS = (9, 11, 13, 15), (10, 12, 14, 16)
COL_FEATURES = 17
MIN_FIELDS = 18
END_MARK = "EOS"

TOKEN_KEY = ["surface", "reading", "dicform", "pos", "subpos", "ctype", "cform"]

#: fields of a node that a consumer may ask the parser for (all by default)
PATH_FIELDS = ("node_id", "prev", "start", "end", "surface", "ranks")
COUNT_FIELDS = ("surface", *TOKEN_KEY[3:], "ranks")
KEY_FIELDS = (*TOKEN_KEY, "ranks")


def _strict(text: Column, as_type: str) -> Column:
    """NULL for anything but a plain number; blanks around it are not accepted."""
    return F.when(~text.contains(" "), text.try_cast(as_type))


def int_list(text: Column) -> Column:
    """``1;2;3`` to an int array; empty pieces are dropped, bad ones become NULL."""
    return F.transform(F.filter(F.split(text, ";"), lambda p: p != ""), lambda p: _strict(p, "int"))


def feature_parts(text: Column) -> Column:
    return F.filter(F.split(text, "\\|"), lambda p: p != "")


def parse_features(parts: Column) -> Column:
    """B2: ``key:value`` and ``flag`` strings to an array of (key, value); a flag has no value."""
    pairs = F.transform(parts, lambda p: F.split(p, ":", 2))
    return F.transform(
        pairs, lambda kv: F.struct(kv[0].alias("key"), F.get(kv, F.lit(1)).alias("value"))
    )


def _last_value(text: Column, key: str) -> Column:
    """Value of the last ``key:`` feature; plain searches, no arrays are built for it."""
    barred = F.concat(F.lit("|"), text)
    mark = f"|{key}:"
    return F.when(
        barred.contains(mark), F.substring_index(F.substring_index(barred, mark, -1), "|", 1)
    )


def _score(text: Column, key: str) -> Column:
    """NaN where the feature is missing, NULL where it is no number."""
    missing = ~F.concat(F.lit("|"), text).contains(f"|{key}:")
    return F.when(missing, F.lit(float("nan")).cast("float")).otherwise(_last_value(text, key).try_cast("float"))


def _other_parts(text: Column) -> Column:
    parts = feature_parts(text)
    return F.filter(
        parts,
        lambda p: ~(
            p.startswith(SPECIAL_KEYS[0] + ":") | p.startswith(SPECIAL_KEYS[1] + ":")
            | p.startswith(SPECIAL_KEYS[2] + ":") | p.startswith(SPECIAL_KEYS[3] + ":")
        ),
    )


def _node(f: Column, wanted: Sequence[str] | None = None) -> Column:
    """One node from the fields of its line; numbers that do not parse become NULL. Only ``wanted`` fields are built."""

    def field(i: int) -> Column:
        return F.get(f, F.lit(i))

    text = field(COL_FEATURES)
    made = {
        "node_id": _strict(field(COL_ID), "int"),
        "prev": int_list(field(COL_PREV)),
        "start": _strict(field(COL_START), "int"),
        "end": _strict(field(COL_END), "int") + 1,
        "surface": field(COL_SURFACE),
        "canonical": field(COL_CANONICAL),
        "reading": field(COL_READING),
        "dicform": field(COL_DICFORM),
        **{n: field(c) for c, n in zip(COL_TAGS, TOKEN_KEY[3:])},
        **{f"{n}_num": _strict(field(c), "int") for c, n in zip(COL_NUMBERS, TOKEN_KEY[3:])},
        "feature_score": _score(text, KEY_FEATURE_SCORE),
        "lm_score": _score(text, KEY_LM_SCORE),
        "analysis_score": _score(text, KEY_ANALYSIS_SCORE),
        "ranks": int_list(F.coalesce(_last_value(text, KEY_RANKS), F.lit(""))),
        "features": parse_features(_other_parts(text)),
    }
    return F.struct(*[made[n].alias(n) for n in made if wanted is None or n in wanted])


def _bad_number(node: Column) -> Column:
    """Did a number of the node not parse?"""
    single = ["node_id", "start", "end", *[f"{n}_num" for n in TOKEN_KEY[3:]]]
    single += ["feature_score", "lm_score", "analysis_score"]
    bad = F.exists(node["prev"], lambda x: x.isNull()) | F.exists(node["ranks"], lambda x: x.isNull())
    for name in single:
        bad = bad | node[name].isNull()
    return bad


def _plain_line() -> str:
    """Pattern of node lines whose numbers surely parse; a line may be good without matching it."""
    number, list_, decimal = r"-?[0-9]{1,9}", r"[0-9;]{0,9}", r"-?[0-9]{1,9}(?:\.[0-9]{1,9})?"
    numbers = {COL_ID: number, COL_PREV: list_, COL_START: number, COL_END: number, **dict.fromkeys(COL_NUMBERS, number)}
    fields = [numbers.get(i, r"[^\t]*+") for i in range(COL_FEATURES)]
    scores = "|".join(SPECIAL_KEYS[:3])
    part = rf"(?:(?:{scores}):{decimal}|{KEY_RANKS}:{list_}|(?!(?:{scores}|{KEY_RANKS}):)[^|\t]*+)(?=[|\t]|\z)"
    return r"\A" + r"\t".join(fields) + rf"\t{part}(?:\|{part})*+(?:\t|\z)"


PLAIN_LINE = _plain_line()


def _plain_parser(df: DataFrame, raw: str, fields: Sequence[str] | None) -> tuple[PlainParser, StructType]:
    """The parser of plain sentences by Arrow batch, and the schema of what it returns."""
    numbers = (COL_ID, COL_START, COL_END, *COL_NUMBERS)
    places = {
        "node_id": COL_ID, "prev": COL_PREV, "start": COL_START, "end": COL_END, "surface": COL_SURFACE,
        "canonical": COL_CANONICAL, "reading": COL_READING, "dicform": COL_DICFORM,
        **{n: c for c, n in zip(COL_TAGS, TOKEN_KEY[3:])}, **{f"{n}_num": c for c, n in zip(COL_NUMBERS, TOKEN_KEY[3:])},
    }
    scores = {"feature_score": KEY_FEATURE_SCORE, "lm_score": KEY_LM_SCORE, "analysis_score": KEY_ANALYSIS_SCORE}
    ints, pair = ArrayType(IntegerType()), StructType([StructField("key", StringType()), StructField("value", StringType())])
    kinds = {n: IntegerType() if c in numbers else StringType() for n, c in places.items()} | dict.fromkeys(scores, FloatType())
    kinds |= {"prev": ints, "ranks": ints, "features": ArrayType(pair)}
    names = [n for n in kinds if fields is None or n in fields]
    node = StructType([StructField(n, kinds[n]) for n in names])
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + [
        StructField("__comment", StringType()), StructField("__nodes", ArrayType(node)), StructField("__done", BooleanType())])
    arrow = to_arrow_schema(schema)
    return PlainParser(raw, arrow, names, places, numbers, (COL_PREV,), END_MARK, COL_FEATURES, scores, KEY_RANKS), schema


def sentence_lines(raw: Column) -> Column:
    """Lines of a record up to its end mark, without the empty piece a final newline leaves.

    The text is cut before it is split, so the lines are built once.
    """
    plain = F.when(raw.contains("\r"), F.regexp_replace(raw, "\r\n?", "\n")).otherwise(raw)
    inner = f"\n{END_MARK}\n"
    body = (
        F.when((plain == END_MARK) | plain.startswith(f"{END_MARK}\n") | (plain == ""), F.lit(None))
        .when(plain.contains(inner), F.substring_index(plain, inner, 1))
        .when(plain.endswith(f"\n{END_MARK}"), F.left(plain, F.length(plain) - len(END_MARK) - 1))
        .when(plain.endswith("\n"), F.left(plain, F.length(plain) - 1))
        .otherwise(plain)
    )
    return F.coalesce(F.split(body, "\n"), empty_array("string"))


def comment_of(lines: Column) -> Column:
    """The last ``#`` line."""
    return bind(F.filter(lines, lambda x: x.startswith("#")), lambda c: F.get(c, F.size(c) - 1))


def parse_lattice(df: DataFrame, raw: str = "raw", fields: Sequence[str] | None = None) -> DataFrame:
    """B1: replaces ``raw`` by ``comment``, ``nodes`` and ``reason``.

    ``reason`` is NULL for a good sentence, else ``short_line`` or ``bad_number`` (and ``nodes`` is NULL); see
    :func:`quarantine`. ``fields`` names those of a node that are needed: the others are neither cut out nor
    parsed. Whether a sentence is good does not depend on it: numbers are tested on the line, by one pattern, and
    only sentences with a line that does not match it are parsed whole to find out. Plain sentences are built by
    Arrow batch (:mod:`node_lines`); the expressions below see the text of the others only.
    """
    others = [c for c in df.columns if c != raw]
    ship(df.sparkSession)
    parser, schema = _plain_parser(df, raw, fields)
    cut = computed_once(df.mapInArrow(parser, schema), __lines=sentence_lines(F.col(raw)))
    node_lines = F.filter("__lines", lambda x: ~x.startswith("#"))
    built = computed_once(cut, comment=F.coalesce("__comment", comment_of(F.col("__lines"))), __rows=node_lines)
    # Fewer tabs than fields need: nothing is left behind the last needed one.
    short = F.exists("__rows", lambda x: F.substring_index(x, "\t", MIN_FIELDS - 1) == x)
    plain = F.forall("__rows", lambda x: x.rlike(PLAIN_LINE))
    bad = F.exists("__rows", lambda x: bind(_node(F.split(x, "\t")), _bad_number))
    reason = F.when(F.col("__done") | plain, None).when(short, "short_line").when(bad, "bad_number")
    checked = computed_once(built, reason=reason)
    nodes = F.transform(F.transform("__rows", lambda x: F.split(x, "\t")), lambda f: _node(f, fields))
    every = F.when(F.col("__done"), F.col("__nodes")).when(F.col("reason").isNull(), nodes)
    return computed_once(checked, nodes=every).select(*others, "comment", "nodes", "reason")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad). Nothing is lost: a bad sentence keeps its keys, comment and reason."""
    good = parsed.filter(F.col("reason").isNull()).drop("reason")
    bad = parsed.filter(F.col("reason").isNotNull()).drop("nodes")
    return good, bad


def is_top(node: Column) -> Column:
    return F.array_contains(node["ranks"], 1)


def cumulative_scores(node: Column) -> Column:
    """The analysis score once per rank."""
    return F.array_repeat(node["analysis_score"], F.size(node["ranks"]))


def score_details(node: Column) -> Column:
    """(feature score, list with the language-model score if it has one) once per rank."""
    lm = node["lm_score"]
    lms = F.when(F.isnan(lm), empty_array("float")).otherwise(F.array(lm))
    return F.array_repeat(
        F.struct(node["feature_score"].alias("score"), lms.alias("lm")), F.size(node["ranks"])
    )


def top_one(df: DataFrame) -> DataFrame:
    """Drop nodes that are on no best analysis."""
    return df.withColumn("nodes", F.filter("nodes", is_top))


def best_path(df: DataFrame, nodes: str = "nodes", name: str = "path") -> DataFrame:
    """Chain of rank-1 nodes in file order, each naming its predecessor; starts at id 0.

    Usually all rank-1 nodes form that chain, which neighbours tell. Only where they do not, the
    places of the taken ones are folded out one by one.
    """

    def follows(last: Column, n: Column) -> Column:
        return F.array_contains(n["prev"], last)

    def chained(tops: Column) -> Column:
        ids = F.concat(F.array(F.lit(0)), F.transform(tops, lambda n: n["node_id"]))
        fits = bind(ids, lambda known: F.transform(tops, lambda n, i: follows(F.get(known, i), n)))
        return F.forall(fits, lambda ok: ok)

    def folded(tops: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), empty_array("int").alias("taken"))

        def merge(s: Column, i: Column) -> Column:
            n = F.get(tops, i)
            return F.when(
                follows(s["last"], n),
                F.struct(n["node_id"].alias("last"), F.array_append(s["taken"], i).alias("taken")),
            ).otherwise(s)

        taken = F.aggregate(span(F.size(tops)), start, merge, lambda s: s["taken"])
        return F.transform(taken, lambda i: F.get(tops, i))

    tops = F.col("__tops")
    rows = computed_once(df.drop(name), __tops=F.filter(nodes, is_top))
    path = F.when(chained(tops), tops).otherwise(folded(tops))
    return computed_once(rows, **{name: path}).drop("__tops")


def token_key(node: Column) -> Column:
    """The projection that the difficulty dictionary is keyed by."""
    return F.struct(*[node[k].alias(k) for k in TOKEN_KEY])


def pick_feature(node: Column, kind: str) -> Column:
    """Which form of a word stands for it."""
    if kind == "surf":
        return node["surface"]
    if kind == "norm":
        hits = F.filter(node["features"], lambda f: f["key"] == KEY_NORMAL_FORM)
        return F.coalesce(F.get(hits, F.lit(0))["value"], node["canonical"])
    return node["canonical"]
