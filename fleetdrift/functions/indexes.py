"""Reading index definitions as the server prints them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetdrift.functions.text import extract, let, strip_quotes, trim_blank
from fleetdrift.model import INDEX_METHODS


def index_method(name: Column) -> Column:
    """Lower-case access method; methods outside the model count as btree."""
    lower = F.lower(name)
    return F.when(lower.isin(INDEX_METHODS), lower).otherwise(F.lit("btree"))


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def paren_body(text: Column) -> Column:
    """Text in the first outermost parentheses, null if they never close.

    Most hold no others, and one pattern finds them.  Else folds over
    parenthesis/run tokens instead of characters: a definition has some ten of them.
    """
    return let(text, lambda t: F.coalesce(F.get(F.regexp_extract_all(t, F.lit(_FLAT), F.lit(1)), F.lit(0)), _folded_body(t)))


_FLAT = r"^[^()]*\(([^()]*)\)"


def _folded_body(text: Column) -> Column:
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("body"), F.lit(False).alias("done")
    )

    def step(state: Column, token: Column) -> Column:
        depth = (
            F.when(token == "(", state["depth"] + 1)
            .when(token == ")", state["depth"] - 1)
            .otherwise(state["depth"])
        )
        opens = (token == "(") & (state["depth"] == 0)
        closes = (token == ")") & (depth == 0)
        body = (
            F.when(opens, F.lit(""))
            .when(closes, state["body"])
            .otherwise(F.concat(state["body"], token))
        )
        grown = F.struct(depth.alias("depth"), body.alias("body"), closes.alias("done"))
        return F.when(state["done"], state).otherwise(grown)

    return F.aggregate(
        _tokens(text, r"[()]|[^()]+"), start, step, lambda s: F.when(s["done"], s["body"])
    )


def split_top_level(text: Column) -> Column:
    """Split on commas outside parentheses; a blank-free array of trimmed parts."""
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit("").alias("current"),
        F.array().cast("array<string>").alias("parts"),
    )

    def step(state: Column, token: Column) -> Column:
        cut = (token == ",") & (state["depth"] == 0)
        depth = (
            F.when(token == "(", state["depth"] + 1)
            .when(token == ")", state["depth"] - 1)
            .otherwise(state["depth"])
        )
        return F.struct(
            depth.alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(state["current"], token)).alias("current"),
            F.when(cut, F.array_append(state["parts"], trim_blank(state["current"])))
            .otherwise(state["parts"])
            .alias("parts"),
        )

    def finish(state: Column) -> Column:
        return F.when(
            state["current"] != "", F.array_append(state["parts"], trim_blank(state["current"]))
        ).otherwise(state["parts"])

    return F.aggregate(_tokens(text, r"[(),]|[^(),]+"), start, step, finish)


_NULLS = r"(?i)(?:^|\s)NULLS\s+(FIRST|LAST)$"
_DIRECTION = r"(?i)(?:^|\s)(ASC|DESC)$"


def key_column(entry: Column) -> Column:
    """One key of an index as ``struct<column_name, expression, opclass, ...>``.

    An entry starting with "(" is an expression and keeps its suffix words.
    Anything else is a column name with an optional operator class, also a
    function call without outer parentheses.
    """
    none = F.lit(None).cast("string")

    def build(text: Column, unordered: Column, words: Column) -> Column:
        is_expression = text.startswith("(")
        first = F.get(words, F.lit(0))
        return F.struct(
            F.when(is_expression, none)
            .otherwise(F.when(first == "", F.lit("?")).otherwise(strip_quotes(first)))
            .alias("column_name"),
            F.when(is_expression, text).alias("expression"),
            F.when(~is_expression, F.get(words, F.lit(1))).alias("opclass"),
            F.coalesce(F.lower(extract(unordered, _DIRECTION)), F.lit("asc")).alias("sort_order"),
            F.lower(extract(text, _NULLS)).alias("nulls_order"),
        )

    def split_words(unordered: Column) -> Column:
        return F.split(trim_blank(F.regexp_replace(unordered, _DIRECTION, "")), r"\s+")

    return let(
        trim_blank(entry),
        lambda text: let(
            trim_blank(F.regexp_replace(text, _NULLS, "")),
            lambda unordered: let(
                split_words(unordered), lambda words: build(text, unordered, words)
            ),
        ),
    )


def index_keys(definition: Column) -> Column:
    """Key columns of a full definition; one key named ``?`` when none is found."""
    entries = F.filter(split_top_level(paren_body(definition)), lambda e: e != "")
    # an empty entry is read as "?"
    missing = F.array(F.lit(""))
    return let(
        entries,
        lambda found: F.transform(F.when(F.size(found) > 0, found).otherwise(missing), key_column),
    )
