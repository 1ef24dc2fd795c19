"""Text functions as Column expressions: names, numbers, terms, answers, question wording.

Character classes are explicit ASCII ones, so other engines give the same results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words in the order in which they are looked for.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
#: Relationship terms, the more specific first.
RELATIONSHIPS = (
    "father's brother's child", "father's sister's child", "mother's brother's child", "mother's sister's child",
    "paternal grandfather", "paternal grandmother", "maternal grandfather", "maternal grandmother",
    "paternal uncle", "maternal uncle", "paternal aunt", "maternal aunt", "father's brother", "father's sister", "mother's brother", "mother's sister",
    "cross-cousin", "parallel cousin", "classificatory sibling", "classificatory father", "classificatory mother",
    "uncle", "aunt", "cousin", "nephew", "niece", "grandparent", "grandchild", "grandfather", "grandmother",
    "fbc", "fzc", "mbc", "mzc", "fb", "fz", "mb", "mz",
)
#: Markers of a final answer, in the order in which they are tried on a line.
MARKERS = ("FINAL ANSWER:", "Final Answer:", "final answer:", "ANSWER:", "Answer:", "**FINAL ANSWER:**", "**Answer:**", "The answer is:", "The answer is")
_S = r"[ \t\n\r\x0B\x0C]"


def file_stem(path: Column) -> Column:
    """The name of a file without its folders and last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def strip(x: Column, more: str = "") -> Column:
    """x without white space, and the characters of more, at both ends."""
    c = rf"[ \t\n\r\x0B\x0C{more}]" if more else _S
    return F.regexp_replace(x, rf"^{c}+|{c}+$", "")


def is_error(x: Column) -> Column:
    """Responses that report an error or a block."""
    return x.startswith("[ERROR") | x.startswith("[BLOCKED")


def predicate_words(pred: Column) -> Column:
    """hasFather -> father."""
    return F.lower(F.replace(pred, F.lit("has"), F.lit("")))


def plural(term: Column) -> Column:
    """term + s; a closing parenthesis keeps its group last."""
    return F.when(term.endswith(")"), F.regexp_replace(term, r"^(.*) (\(.*)$", "$1s $2")).otherwise(F.concat(term, F.lit("s")))


def normalize_name(x: Column) -> Column:
    """Lower case, single spaces, no punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), rf"{_S}+", " "), r"[^A-Za-z0-9_ ]", "")


def extract_names(x: Column) -> Column:
    """First and last names in order, each once whatever its case; else one capitalised word; else the whole text; none of an error."""
    full = F.regexp_extract_all(x, F.lit(r"\b([A-Z][a-z]+[ \t\n\r\x0B\x0C]+[A-Z][a-z]+)\b"), 1)
    once = F.aggregate(full, F.array().cast("array<string>"), lambda a, n: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(n)), a).otherwise(F.concat(a, F.array(n))))
    one = F.regexp_extract(x, r"\b([A-Z][a-z]{2,})\b", 1)
    whole = strip(x)
    none = F.array().cast("array<string>")
    return F.when(x.isNull() | (x == "") | is_error(x), none).when(F.size(full) > 0, once).when(one != "", F.array(one)).when(whole != "", F.array(whole)).otherwise(none)


def extract_number(x: Column, strict: bool = False) -> Column:
    """The first run of digits; else the first number word, as a word only or (strict) anywhere."""
    low = F.lower(x)
    word = reduce(lambda rest, k: F.when(F.contains(low, F.lit(NUMBERS[k])) if strict else low.rlike(rf"\b{NUMBERS[k]}\b"), k).otherwise(rest), reversed(range(len(NUMBERS))), F.lit(None).cast("long"))
    digits = F.regexp_extract(x, r"\b([0-9]+)\b", 1)
    return F.when(x.isNull() | is_error(x), F.lit(None)).when(digits != "", digits.try_cast("long")).otherwise(word)


def extract_relationship(x: Column) -> Column:
    """The first listed term in the text, else the whole text in lower case; null of an error or nothing."""
    low = F.lower(x)
    term = reduce(lambda rest, t: F.when(F.contains(low, F.lit(t)), t).otherwise(rest), reversed(RELATIONSHIPS), F.lower(strip(x)))
    return F.when((x != "") & ~is_error(x), term)


def same_relationship(predicted: Column, gold: Column) -> Column:
    """Equality or containment either way, as they are or without parentheses."""
    a, b = F.lower(strip(predicted)), F.lower(strip(gold))
    bare = lambda x: strip(F.regexp_replace(x, r"[ \t\n\r\x0B\x0C]*\([^)]*\)", ""))
    within = lambda x, y: F.contains(x, y) | F.contains(y, x)
    return F.coalesce((predicted != "") & (gold != "") & (within(a, b) | within(bare(a), bare(b))), F.lit(False))


def question_type(x: Column) -> Column:
    """count, relationship or name."""
    low = F.lower(x)
    return F.when(F.contains(low, F.lit("how many")), "count").when(F.contains(low, F.lit("biological relationship")) | F.contains(low, F.lit("what is their")), "relationship").otherwise("name")


def clean_answer(x: Column, strict: bool = False) -> Column:
    """The bare answer of a sentence: what follows the copula, a "Based on ..." clause or a conclusion word. strict lets copula and conclusion words end or begin inside a name."""
    edge = "" if strict else r"\b"
    trim = lambda y: strip(F.regexp_replace(F.regexp_replace(y, r"^\*+|\*+$", ""), r"^\.+|\.+$", ""))
    a = trim(x)
    copula = trim(strip(F.regexp_extract(a, rf"(?is)^(?:(?:.*?(?:'s|is|are)\s+)?|.*?){edge}(?:is|are)\s+(.+)$", 1)))
    clause = trim(strip(F.regexp_extract(a, r"(?is)^based on.*,([^,]+)$", 1)))
    rest = trim(F.regexp_replace(F.regexp_extract(a, rf"(?is)^(?:therefore|thus|so|hence){edge}(.*)$", 1), r"^,*\s*", ""))
    return F.when(copula != "", copula).when(clause != "", clause).when(rest != "", rest).otherwise(a)


def cot_answer(response: Column, strict: bool = False) -> Column:
    """The answer of a reasoned response: the last line with a marker, else the last line of step 5, else the last line that isn't structure, else the last."""
    text = strip(F.coalesce(response, F.lit("")))
    lines = F.transform(F.split(text, "\n"), lambda y: strip(y))
    after = lambda y, m: strip(F.substring(y, F.instr(y, m) + F.lit(len(m)), F.lit(2147483647)))
    marked = lambda y: F.coalesce(*[F.nullif(F.when(F.contains(y, F.lit(m)), clean_answer(after(y, m), strict)), F.lit("")) for m in MARKERS])
    found = F.filter(F.transform(lines, marked), lambda y: y.isNotNull())
    step5 = F.filter(F.transform(lines, lambda y, i: F.when(y.rlike("STEP 5|Step 5"), i)), lambda i: i.isNotNull())
    tail = F.filter(F.slice(lines, F.coalesce(F.get(step5, F.lit(0)), F.lit(0)) + 2, F.greatest(F.size(lines), F.lit(1))), lambda y: (y != "") & ~y.rlike("^(STEP|Step)"))
    plain = F.filter(lines, lambda y: (y != "") & ~y.rlike("^(STEP|Step|---|Begin)"))
    last = lambda a: F.element_at(a, -1)
    pick = F.when((F.size(step5) > 0) & (F.size(tail) > 0), F.try_element_at(tail, F.lit(-1))).when(F.size(plain) > 0, F.try_element_at(plain, F.lit(-1))).otherwise(last(lines))
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).otherwise(clean_answer(pick, strict))
