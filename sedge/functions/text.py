"""Full text, JSON and string functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

TOKEN = r"[\p{L}\p{N}]+"
#: Weight of a lexeme without a label, and so of every lexeme here.
LEXEME_WEIGHT = 0.1

#: Takes an array of lower-case tokens to an array of lexemes; it may change tokens and leave tokens out.
Analyzer = Callable[[Column], Column]

# Greek function words, folded: articles, pronouns, conjunctions, prepositions and particles that say nothing about a text's subject.
GREEK_STOP_WORDS = (
    "ο η το οι τα του τησ των τον την τουσ τισ ενασ μια ενα ενοσ μιασ εναν και κι η ειτε ουτε αλλα ομωσ ενω αν οτι που πωσ να θα δεν μην μη "
    "σε στο στη στην στον στα στισ στουσ στησ απο με για προσ κατα μετα παρα αντι χωρισ ωσ εωσ μεχρι αυτο αυτοσ αυτη αυτα αυτοι εκεινο εκεινοσ "
    "εγω εσυ εμεισ εσεισ μου σου μασ σασ ειναι ηταν εχει εχουν οπωσ οταν οποιοσ οποια οποιο"
).split()
#: Endings of inflected Greek words, longest first, that the light stemmer takes off.
GREEK_ENDINGS = "ματων|ματοσ|ματα|ουσ|εων|εωσ|εισ|ιων|ιου|ιοσ|ιασ|ιεσ|οσ|ου|οι|ων|ησ|εσ|ασ|ισ|ια|ει|ον|α|η|ι|ο|ω|ε|υ"


def simple_analyzer(words: Column) -> Column:
    """The default: tokens in lower case as they are, nothing left out or stemmed."""
    return words


def folded(words: Column) -> Column:
    """Tokens without Greek accents and breathings, final sigma as sigma."""
    return F.transform(words, lambda w: F.translate(w, "άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ"))


def greek_analyzer(words: Column) -> Column:
    """Folded tokens without function words, and without the endings of inflection where three letters are left. A light stemmer, not a server's."""
    kept = F.filter(folded(words), lambda w: ~w.isin(*GREEK_STOP_WORDS))
    return F.transform(kept, lambda w: F.regexp_replace(w, f"(?<=\\p{{IsGreek}}{{3}})(?:{GREEK_ENDINGS})$", ""))


def tokens(text: Column, analyzer: Analyzer = simple_analyzer) -> Column:
    """Lexemes of a text in order; the positions are the array's indexes. Null: none."""
    return analyzer(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def query_terms(text: Column, analyzer: Analyzer = simple_analyzer) -> Column:
    """Different lexemes of a plain query, all of which a match must hold."""
    return F.array_distinct(tokens(text, analyzer))


def matches(lexemes: Column, terms: Column) -> Column:
    """Whether every term is there. A query without terms matches nothing."""
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, lexemes)) == 0)


def rank_one_term(lexemes: Column, term: Column) -> Column:
    """Cover-density rank of a one-term query: the lexeme weight for each occurrence."""
    return F.size(F.filter(lexemes, lambda x: x == term)) * F.lit(LEXEME_WEIGHT)


def rank_cover(lexemes: Column, terms: Column) -> Column:
    """Cover-density rank of a query of any number of terms; 0 where a term is missing.

    The sum over the minimal covers of weight / (1 + words in the cover that are not of the query). One pass over the hits: each is the end
    of a cover if the least of the terms' last places has moved on since the cover before.
    """
    n = F.size(terms)
    hits = F.filter(F.transform(lexemes, lambda w, i: F.struct(i.alias("p"), F.array_position(terms, w).cast("int").alias("t"))), lambda h: h["t"] > 0)
    return F.when(n > 0, cover_sum(hits, n)).otherwise(0.0)


def cover_sum(hits: Column, n: Column) -> Column:
    """The sum over the minimal covers of ``n`` terms, from their hits (place p, term t from 1) in order of place."""
    none = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(0.0).alias("total"), F.lit(-1).alias("since"))

    def step(acc, h):
        last = F.transform(acc["last"], lambda x, i: F.when(i == h["t"] - 1, h["p"]).otherwise(x))
        start = F.array_min(last)
        cover = F.lit(LEXEME_WEIGHT) / (h["p"] - start + 2 - n)
        return F.struct(last.alias("last"), (acc["total"] + F.when(start > acc["since"], cover).otherwise(0.0)).alias("total"), F.greatest(acc["since"], start).alias("since"))

    return F.aggregate(hits, none, step, lambda acc: acc["total"])


def normal_name(name: Column) -> Column:
    """Key of an entity name: outer white space (of any script) gone, lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", ""))


_BROKEN = re.compile("\x03([0-9a-fA-F]{2})|\x00([0-9a-fA-F]{3})")


def repaired(text: str | None) -> str | None:
    """Characters again that were split into a control character and the hex digits left over: U+0003 with two, U+0000 with three."""
    if not text:
        return text
    return _BROKEN.sub(lambda m: chr(int(m[1] and "03" + m[1] or m[2], 16)), text)


@F.pandas_udf(T.StringType())
def repair_text(text: pd.Series) -> pd.Series:
    return text.map(repaired, na_action="ignore")


def repair(text: Column) -> Column:
    """:func:`repaired`; only texts that hold one of the control characters are handed to Python."""
    return F.coalesce(repair_text(F.when(text.rlike(r"[\x00\x03]"), text)), text)


def title(content: Column, path: Column) -> Column:
    """Text of the first line ``# ...`` among the first ten, else the file name without its last extension."""
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 10), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    heading = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.regexp_replace(F.substring(heading, 3, 2**31 - 1), r"(?U)^\s+|\s+$", ""), stem)


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n"))


def word_count(content: Column) -> Column:
    return F.size(F.regexp_extract_all(content, F.lit(r"(?U)\S+"), F.lit(0)))


def token_count(content: Column) -> Column:
    """Tokens by the rule of four characters each."""
    return F.floor(F.length(content) / 4).cast("int")


def front_matter(text: str | None) -> str | None:
    """JSON object of a text's YAML head; dates and other odd values become strings. Null if there is none, or none that is a mapping."""
    if not text or not text.startswith("---") or (end := text.find("\n---\n", 4)) < 0:
        return None
    try:
        import yaml

        found = yaml.safe_load(text[4:end])
    except Exception:  # a broken head is text like any other
        return None
    return json.dumps(found, default=str, sort_keys=True) if isinstance(found, dict) else None


@F.pandas_udf(T.StringType())
def front_matter_json(text: pd.Series) -> pd.Series:
    return text.map(front_matter, na_action="ignore")


def front_matter_of(text: Column) -> Column:
    """:func:`front_matter`; only texts that begin with the mark are handed to Python."""
    return front_matter_json(F.when(text.startswith("---"), text))


def reply_object(reply: Column) -> Column:
    """The JSON object in a model's reply: code fences off, outermost braces, null if what is left is not JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def json_contains(text: Column, wanted: dict) -> Column:
    """Whether a JSON object contains ``wanted``, recursively: objects by key, arrays by some element, scalars by value."""
    return F.coalesce(_contains(text, "$", wanted), F.lit(False))


def _contains(text: Column, path: str, wanted) -> Column:
    at = F.get_json_object(text, path)
    if isinstance(wanted, dict):
        parts = [F.coalesce(_contains(text, f"{path}['{k}']", v), F.lit(False)) for k, v in wanted.items()]
        out = at.startswith("{")
        for p in parts:
            out = out & p
        return out
    if isinstance(wanted, list):
        items = F.from_json(at, "array<string>")
        out = at.startswith("[")
        for v in wanted:
            out = out & F.array_contains(items, _scalar(v))
        return out
    if wanted is None:
        return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant")) == "VOID"
    kind = "BOOLEAN" if isinstance(wanted, bool) else "STRING" if isinstance(wanted, str) else None
    seen = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    typed = seen == kind if kind else seen.rlike("BIGINT|DECIMAL|DOUBLE|FLOAT")
    return typed & (at.try_cast("double") == float(wanted) if kind is None else at == _scalar(wanted))


def _scalar(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def json_merge(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects; the right one wins. Keys come out sorted, values keep their types."""
    kind = "map<string,variant>"
    sides = F.struct(*[F.coalesce(F.from_json(x, kind), F.from_json(F.lit("{}"), kind)).alias(n) for x, n in ((old, "old"), (new, "new"))])

    def merged(s):
        kept = F.map_filter(s["old"], lambda k, v: ~F.map_contains_key(s["new"], k))
        return F.to_json(F.parse_json(F.to_json(F.map_concat(kept, s["new"]))))

    # bound once as an array's element, so that the sides may come from Python functions, which lambdas can't hold
    return F.transform(F.array(sides), merged)[0]
