"""English stems as column expressions: the published Porter2 rules, as an English text index uses them.

`stem` is one expression; each step only shortens or swaps the word's end, so the two regions found at the start hold
for all of them. Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of an English text index.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()

# Words with a stem of their own, and words left alone after step 1a.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]

# Endings of steps 2 to 4 and what replaces them.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
STEP_4 = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti",
                        "ous", "ive", "ize", "ion"], "")

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"  # a consonant y is written Y on the way
_SHORT_END = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: the expression stays linear in the steps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        value = _let(value, step)
    return value


def _head(word: Column, end: Column) -> Column:
    return word.substr(F.lit(1), F.length(word) - F.length(end))


def _start(word: Column, after: Column) -> Column:
    """Length up to the first consonant behind a vowel, looked for past ``after`` characters; the word's length if none."""
    found = F.length(F.regexp_extract(word.substr(after + 1, F.length(word)), f"^{_OTHER}*{_VOWEL}+{_OTHER}", 0))
    return F.when(found == 0, F.length(word)).otherwise(after + found)


def _at_end(word: Column, endings: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the longest of the endings that the word has ('' if none) and what stands before it."""
    found = F.regexp_extract(word, f"({endings})$", 1)  # the leftmost match is the longest ending
    return _let(found, lambda end: _let(_head(word, end), lambda head: body(end, head)))


def _swap(table: dict[str, str], allowed: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """A step that replaces the longest ending found, where it is allowed."""
    into = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def step(word: Column) -> Column:
        return _at_end(word, "|".join(table), lambda end, head: F.when(
            (end != "") & allowed(end, head), F.concat(head, F.coalesce(into[end], F.lit("")))).otherwise(word))

    return step


def _plural(word: Column) -> Column:
    """Step 1a."""
    return _at_end(word, "sses|ied|ies|us|ss|s", lambda end, head: (
        F.when(end == "sses", F.concat(head, F.lit("ss")))
        .when(end.isin("ied", "ies"), F.concat(head, F.when(F.length(head) > 1, "i").otherwise("ie")))
        .when((end == "s") & head.rlike(f"{_VOWEL}.+$"), head).otherwise(word)))


def _past(r1: Column) -> Callable[[Column], Column]:
    """Step 1b: past and -ing forms; what is left may need its e again, or one letter less."""

    def mend(w: Column) -> Column:
        short = (F.length(w) <= r1) & w.rlike(_SHORT_END)
        return (F.when(w.rlike("(at|bl|iz)$") | short, F.concat(w, F.lit("e")))
                .when(w.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))

    def step(word: Column) -> Column:
        return _at_end(word, "eedly|eed|ingly|edly|ing|ed", lambda end, head: (
            F.when(end.isin("eed", "eedly"), F.when(F.length(head) >= r1, F.concat(head, F.lit("ee"))).otherwise(word))
            .when((end != "") & head.rlike(_VOWEL), mend(head)).otherwise(word)))

    return step


def _later_steps(word: Column, r1: Column, r2: Column) -> Column:
    def in_r1(head: Column) -> Column:
        return F.length(head) >= r1

    def in_r2(head: Column) -> Column:
        return F.length(head) >= r2

    def linked(end: Column, head: Column) -> Column:
        return F.when(end == "ogi", head.endswith("l")).when(end == "li", head.rlike("[cdeghkmnrt]$")).otherwise(True)

    def last_letter(w: Column) -> Column:
        return _let(w.substr(F.lit(1), F.length(w) - 1), lambda head: (
            F.when(w.endswith("e") & (in_r2(head) | (in_r1(head) & ~head.rlike(_SHORT_END))), head)
            .when(w.endswith("ll") & in_r2(head), head).otherwise(w)))

    return _chain(
        word, _past(r1),
        lambda w: F.regexp_replace(w, f"(?<=.{_OTHER})[yY]$", "i"),  # step 1c
        _swap(STEP_2, lambda end, head: in_r1(head) & linked(end, head)),
        _swap(STEP_3, lambda end, head: in_r1(head) & ((end != "ative") | in_r2(head))),
        _swap(STEP_4, lambda end, head: in_r2(head) & ((end != "ion") | head.rlike("[st]$"))),
        last_letter,
        lambda w: F.regexp_replace(w, "Y", "y"))


def stem(word: Column) -> Column:
    """The stem of a lower-case word.

    Null stays null and the empty word empty; words of one or two letters, and words with other
    characters than a to z (digits, accents), stay as they are.
    """
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "(?<=[aeiouy])y", "Y")
    prefix = F.length(F.regexp_extract(word, "^(gener|commun|arsen)", 1))

    def regions(w: Column) -> Column:
        first = F.when(prefix > 0, prefix).otherwise(_start(w, F.lit(0)))
        return _let(first, lambda r1: _let(_start(w, r1), lambda r2: _let(
            _plural(w), lambda p: F.when(p.isin(SETTLED), p).otherwise(_later_steps(p, r1, r2)))))

    own = F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair])[word]
    plain = word.isNull() | (F.length(word) <= 2) | ~word.rlike("^[a-z]+$")
    return F.when(plain, word).when(own.isNotNull(), own).otherwise(_let(marked, regions))
