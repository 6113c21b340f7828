"""Text functions, each a Column of Columns that stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named references that are decoded, in the order of their table.
HTML_ENTITIES = {
    "&quot;": '"', "&amp;": "&", "&cent;": "¢", "&pound;": "£", "&sect;": "§", "&copy;": "©", "&laquo;": "«", "&raquo;": "»", "&reg;": "®",
    "&deg;": "°", "&plusmn;": "±", "&para;": "¶", "&middot;": "·", "&frac12;": "½", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’",
    "&sbquo;": "‚", "&ldquo;": "“", "&rdquo;": "”", "&bdquo;": "„", "&dagger;": "†", "&bull;": "•", "&hellip;": "…", "&prime;": "′", "&euro;": "€",
    "&trade;": "™", "&asymp;": "≈", "&ne;": "≠", "&le;": "≤", "&ge;": "≥", "&lt;": "<", "&gt;": ">",
}


def substituted(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression substitutions in order."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, text)


def symbols_replaced(text: Column) -> Column:
    """Underscores become spaces, braces go."""
    return F.translate(text, "_{}", " ")


def code_point(number: Column) -> Column:
    """The character of a code point of up to four decimal digits."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 4, "0")), "UTF-16BE")


def html_decoded(text: Column) -> Column:
    """Named and numeric references decoded in one pass: the ampersand's own come last, so what they uncover stays.

    Names outside the table, names with digits or capitals stay as they are.
    """
    named = reduce(lambda c, e: F.replace(c, F.lit(e), F.lit(HTML_ENTITIES[e])), [e for e in HTML_ENTITIES if e[1:-1].isalpha() and e != "&amp;"], text)
    codes = F.array_distinct(F.regexp_extract_all(named, F.lit("&#([0-9]{1,4});"), 1))
    numbered = F.aggregate(codes, named, lambda acc, d: F.when(d.cast("int") == 38, acc).otherwise(F.replace(acc, F.concat(F.lit("&#"), d, F.lit(";")), code_point(d))))
    return F.regexp_replace(F.when(named.contains("&#"), numbered).otherwise(named), "&amp;|&#0{0,2}38;", "&")


def entity_kind(reference: Column) -> Column:
    """'character' for a named reference of the table, else 'numeric'."""
    return F.when(reference.isin(*HTML_ENTITIES), "character").otherwise("numeric")


def special_symbols_replaced(text: Column) -> Column:
    return html_decoded(symbols_replaced(text))


def regex_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([.()\[\]|{}*+\-?^$/\\])", r"\\$1")


def errors_replaced(question: Column, replacement: Column) -> Column:
    """ERROR marks replaced by literal text and the final question mark closed up; untouched where there is no replacement."""
    quoted = F.regexp_replace(replacement, r"([\\$])", r"\\$1")
    new = F.regexp_replace(F.regexp_replace(question, F.lit("ERROR[0-9]+"), quoted), r"( )?(\?)$", "?")
    return F.when(replacement.isNull(), question).otherwise(new)


def chosen_question(question: Column, paraphrase: Column, template: Column) -> Column:
    """The question if longer than 15, else its paraphrase if longer than 20, else the template's, which must exist."""
    found = F.when(F.length(question) > 15, question).when(F.length(paraphrase) > 20, paraphrase).otherwise(template)
    return F.coalesce(found, F.raise_error(F.lit("no question to translate")).cast("string"))


def ids_of(sparql: Column) -> Column:
    """Distinct entity and property ids in the order of their bytes."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(sparql, F.lit("[QP][0-9]+"), 0)))


def id_kind(id_: Column) -> Column:
    """'entity' or 'property' by the first letter; anything else is an error."""
    first = F.substring(id_, 1, 1)
    return F.when(first == "Q", "entity").when(first == "P", "property").otherwise(F.raise_error(F.concat(F.lit("neither entity nor property: "), id_)))


def is_mask_symbol(text: Column) -> Column:
    return text.rlike("^[PQ][0-9]+$")


def folded(text: Column, steps: Column, old: str, new: str) -> Column:
    """Literal replacements one after the other; a later one sees what an earlier one wrote. ``steps``: array of structs."""
    return F.aggregate(steps, text, lambda acc, x: F.replace(acc, x[old], x[new]))


def variables_renamed(answer: Column) -> Column:
    """?name becomes var_i by first appearance, each throughout the text before the next."""
    names = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\?[^ ]+"), 0))
    steps = F.transform(names, lambda v, i: F.struct(v.alias("old"), F.concat(F.lit("var_"), (i + 1).cast("string")).alias("new")))
    return folded(answer, steps, "old", "new")


def question_finished(question: Column) -> Column:
    return substituted(F.lower(question), [("[pq][0-9]+", " $0 "), (r"(\?)$", " ?"), ("( ){2,}", " ")])


# The words that symbols of a query become.
ANSWER_WORDS = {"{": " brack_open ", "}": " brack_close ", "(": " attr_open ", ")": " attr_close ", ".": " sep_dot ", ",": " , "}


def answer_finished(answer: Column) -> Column:
    worded = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(ANSWER_WORDS[s])), ANSWER_WORDS, F.lower(answer))
    bare = F.regexp_replace(worded, "([a-z]+:)(?=[pq][0-9]+)", "")
    return substituted(variables_renamed(bare), [("[ ]{2,}", " "), ("( )+$", "")])


def url_encoded(text: Column) -> Column:
    """RFC 3986: letters, digits and -_.~ stay."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def masks_switched(text: Column, back: bool = False) -> Column:
    """P and Q masks to R and S, or back."""
    pairs = [("R", "P"), ("S", "Q")] if back else [("P", "R"), ("Q", "S")]
    return substituted(text, [(f"{a}([0-9]+)", f"{b}$1") for a, b in pairs])


def alpha_equivalent(proposal: Column, reference: Column, strict: bool = False) -> Column:
    """Are two masked sentences equal but for the numbers of their masks.

    The first mask at each new reference mask stands for it; replacements are plain and in order. ``strict``
    compares mask by mask instead and asks for a one-to-one mapping.
    """
    masks = lambda c: F.regexp_extract_all(c, F.lit("[PQ][0-9]+"), 0)
    ours, theirs = masks(proposal), masks(reference)
    both = F.arrays_zip(theirs.alias("r"), ours.alias("p"))
    if strict:
        bare = lambda c: F.regexp_replace(c, "([PQ])[0-9]+", "$1#")
        ranks = lambda m: F.transform(m, lambda x: F.array_position(m, x))
        return (bare(proposal) == bare(reference)) & (ranks(ours) == ranks(theirs))
    first = F.filter(both, lambda z, i: F.array_position(theirs, z["r"]) == i + 1)
    steps = F.transform(first, lambda z: F.struct(z["r"].alias("old"), masks_switched(z["p"]).alias("new")))
    return (F.size(ours) == F.size(theirs)) & (masks_switched(folded(reference, steps, "old", "new"), back=True) == proposal)


def prediction_joined(prediction: Column) -> Column:
    """A predicted sentence with the spaces that its tokens' writing asks for."""
    text = F.replace(F.replace(F.trim(prediction), F.lit("< "), F.lit("<")), F.lit(" >"), F.lit(">"))
    text = F.regexp_replace(text, r""" ?([!"#$%&'(’)*+,\-./:;=?@\\^_`{|}~]) ?""", "$1")
    for old, new in (("attr_close>", "attr_close >"), ("_attr_open", "_ attr_open"), (" [ ", " ["), (" ] ", "] "), ("_obd_", " _obd_ "), ("_oba_", " _oba_ ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def words_of(text: Column) -> Column:
    """Split on white space after stripping; an empty text has none."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"\s+"))


def decoded(binary: Column) -> Column:
    """The text of UTF-8 bytes; other bytes are an error."""
    return F.validate_utf8(binary.cast("string"))


def major_minor(version: Column) -> Column:
    return F.array(*[F.regexp_extract(version, r"^(\d+)\.(\d+)", i).cast("int") for i in (1, 2)])


def first_bounds(text: Column, part: Column) -> Column:
    """(start, end) of the first occurrence, counted from 1, both inclusive; null if there is none."""
    at = F.nullif(F.position(part, text), F.lit(0))
    return F.when(at.isNotNull(), F.struct(at.alias("start"), (at + F.length(part) - 1).alias("end")))


def first_replaced(text: Column, part: Column, new: Column) -> Column:
    at = F.position(part, text)
    return F.when(at > 0, F.overlay(text, new, at, F.length(part))).otherwise(text)


def unique_code_points(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != "")))


def longest_common_substring(first: Column, second: Column) -> Column:
    """The longest text that both hold, the smallest by code points of equals; null if there is none.

    All substrings are formed within the row: meant for names and questions. ``lcs.longest_common`` makes a function for long texts.
    """
    def substrings(c: Column) -> Column:
        n = F.length(c)
        every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(c, i, k))))
        return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))

    ranked = F.array_sort(F.transform(F.array_intersect(substrings(first), substrings(second)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.try_element_at(ranked, F.lit(1))["x"]
