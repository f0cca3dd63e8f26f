"""Instruction constraints as column expressions, and the metric over them.

A constraint takes the response column and its arguments and gives a boolean column.  More register with
``@constraint(name)``.  An unknown name is skipped; a blank response meets nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sentences import Boundaries, Counted

CONSTRAINTS: dict[str, Callable[..., Column]] = {}


def constraint(name: str):
    def add(fn: Callable[..., Column]) -> Callable[..., Column]:
        CONSTRAINTS[name] = fn
        return fn

    return add


def _compare(n: Column, relation: str, value: int) -> Column:
    return n < value if relation in ("less than", "moins de", "menos de", "menys de") else n >= value


def _strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)\w+(?:['’-]\w+)*"), F.lit(0))


constraint("case:capital")(lambda x: (x == F.upper(x)) & (x != F.lower(x)))
constraint("case:lowercase")(lambda x: (x == F.lower(x)) & (x != F.upper(x)))
constraint("case:capital_words")(lambda x, relation, n: _compare(F.size(F.filter(_words(x), lambda w: (w == F.upper(w)) & (w != F.lower(w)))), relation, n))
constraint("format:options")(lambda x, options: F.exists(F.array(*map(F.lit, options)), lambda o: F.contains(x, o)))
constraint("end:phrase")(lambda x, phrase: F.lower(_strip(F.regexp_replace(x, r'"\s*$', ""))).endswith(phrase.strip().lower()))
constraint("end:quotation")(lambda x: _strip(x).startswith('"') & _strip(x).endswith('"') & (F.length(_strip(x)) > 1))
constraint("repeat:prompt")(lambda x, prompt: F.lower(_strip(x)).startswith(prompt.strip().lower()))
constraint("keywords:forbidden")(lambda x, words: ~F.exists(F.array(*map(F.lit, words)), lambda w: F.call_function("rlike", x, F.concat(F.lit(r"(?iU)\b"), w, F.lit(r"\b")))))
constraint("keywords:existence")(lambda x, words: F.forall(F.array(*map(F.lit, words)), lambda w: F.call_function("rlike", x, F.concat(F.lit("(?iu)"), w))))
constraint("keywords:frequency")(lambda x, word, relation, n: _compare(F.regexp_count(x, F.lit(f"(?iu){word}")), relation, n))
constraint("keywords:letter")(lambda x, letter, relation, n: _compare(F.length(x) - F.length(F.replace(F.lower(x), F.lit(letter.lower()), F.lit(""))), relation, n))
constraint("format:json")(lambda x: F.try_parse_json(_strip(F.regexp_replace(x, r"(?i)^\s*```(?:json)?|```\s*$", ""))).isNotNull())
constraint("format:sections")(lambda x, mark, n: F.size(F.split(x, rf"\s?{mark}\s?\d+\s?")) - 1 >= n)
def _paragraphs(x: Column, n: int) -> Column:
    """So many parts between ``***``; a blank part counts for nothing at either end and spoils the count within."""
    parts = F.split(x, r"\s?\*\*\*\s?")
    blank = lambda p: _strip(p) == ""
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return ~F.exists(inner, blank) & (F.size(F.filter(parts, lambda p: ~blank(p))) == n)


constraint("length:paragraphs")(_paragraphs)
constraint("length:nth_paragraph")(lambda x, n, nth, first: (F.size(F.filter(F.split(x, r"\n\n"), lambda p: _strip(p) != "")) == n) & (F.lower(F.regexp_extract(F.get(F.filter(F.split(x, r"\n\n"), lambda p: _strip(p) != ""), nth - 1), r"(?U)^\W*(\w+)", 1)) == first.lower()))
constraint("format:bullets")(lambda x, n: F.regexp_count(x, F.lit(r"(?m)^\s*(?:\*[^*]|-).*$")) == n)
def _highlights(x: Column, n: int) -> Column:
    """Texts between single stars and texts between double stars, each counted as a reader of either would."""
    single = F.filter(F.regexp_extract_all(x, F.lit(r"\*[^\n*]*\*"), F.lit(0)), lambda h: _strip(F.replace(h, F.lit("*"), F.lit(""))) != "")
    double = F.filter(F.regexp_extract_all(x, F.lit(r"\*\*([^\n*]*)\*\*"), F.lit(1)), lambda h: _strip(h) != "")
    return F.size(single) + F.size(double) >= n


constraint("format:highlights")(_highlights)
constraint("format:placeholders")(lambda x, n: F.regexp_count(x, F.lit(r"\[[^\n]*?\]")) >= n)
constraint("format:title")(lambda x: F.exists(F.regexp_extract_all(x, F.lit(r"<<([^\n]+)>>"), F.lit(1)), lambda t: _strip(F.regexp_replace(t, "[<>]", "")) != ""))
constraint("format:postscript")(lambda x, mark: F.lower(x).rlike(r"(?s)\s*" + {"P.P.S": r"p\.\s?p\.\s?s", "P.S.": r"p\.\s?s\."}.get(mark, r"\Q" + mark.lower() + r"\E") + ".*"))
@constraint("length:sentences")
def _sentences(x: Column, relation: str, n: int, boundaries: Boundaries | Counted | None = None) -> Column:
    """With learnt ``boundaries`` a stop after an abbreviation ends no sentence; without, a sentence ends at every mark before white space."""
    count = boundaries.count(x) if boundaries else F.size(F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: _strip(s) != ""))
    return _compare(count, relation, n)


constraint("length:words")(lambda x, relation, n: _compare(F.size(_words(x)), relation, n))
constraint("punctuation:no_comma")(lambda x: ~F.contains(x, F.lit(",")))
constraint("content:no_digits")(lambda x: ~x.rlike(r"\d"))
constraint("content:no_accents")(lambda x: ~x.rlike("[àâäáãåçéèêëíìîïñóòôöõúùûüÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜŸ]"))
constraint("content:letters")(lambda x, letters: ~x.rlike(f"(?iu)[{letters}]"))
constraint("content:informal")(lambda x, words: ~F.exists(F.array(*map(F.lit, words)), lambda w: F.call_function("rlike", x, F.concat(F.lit(r"(?iU)\b"), w, F.lit(r"\b")))))
constraint("combination:two_responses")(lambda x: (F.size(F.filter(F.split(x, r"\*{6}"), lambda p: _strip(p) != "")) == 2) & (F.size(F.array_distinct(F.transform(F.filter(F.split(x, r"\*{6}"), lambda p: _strip(p) != ""), lambda p: _strip(p)))) == 2))


def language_is(language: Column, wanted: str) -> Column:
    """The response's language comes as a column; where it is unknown the constraint holds."""
    return F.coalesce(language == wanted, F.lit(True))


constraint("content:has_accents")(lambda x: ~CONSTRAINTS["content:no_accents"](x))

#: Answers of which a constrained response must hold one, by language.
RESPONSES = {
    "en": ["My answer is yes.", "My answer is no.", "My answer is maybe."],
    "fr": ["Oui.", "Non.", "Peut-être."],
    "es": ["Mi respuesta es sí", "Mi respuesta es no", "Mi respuesta es tal vez"],
    "ca": ["La meva resposta és sí.", "La meva resposta és no.", "La meva resposta és potser."],
}
#: Public ids of instructions, the constraint each stands for, and its arguments' names there and here.
IDS: dict[str, tuple[str, dict[str, str]]] = {
    "change_case:capital": ("case:capital", {}),
    "change_case:capital_letters": ("case:capital", {}),
    "change_case:english_capital": ("case:capital", {}),
    "change_case:lowercase": ("case:lowercase", {}),
    "change_case:lowercase_letters": ("case:lowercase", {}),
    "change_case:english_lowercase": ("case:lowercase", {}),
    "change_case:capital_word_frequency": ("case:capital_words", {"capital_relation": "relation", "capital_frequency": "n"}),
    "detectable_format:constrained_response_with_argument": ("format:options", {"options": "options"}),
    "startend:end_checker": ("end:phrase", {"end_phrase": "phrase"}),
    "startend:quotation": ("end:quotation", {}),
    "combination:repeat_prompt": ("repeat:prompt", {"prompt_to_repeat": "prompt"}),
    "combination:two_responses": ("combination:two_responses", {}),
    "keywords:forbidden_words": ("keywords:forbidden", {"forbidden_words": "words"}),
    "keywords:existence": ("keywords:existence", {"keywords": "words"}),
    "keywords:frequency": ("keywords:frequency", {"keyword": "word", "relation": "relation", "frequency": "n"}),
    "keywords:letter_frequency": ("keywords:letter", {"letter": "letter", "let_relation": "relation", "let_frequency": "n"}),
    "detectable_format:json_format": ("format:json", {}),
    "detectable_format:multiple_sections": ("format:sections", {"section_spliter": "mark", "num_sections": "n"}),
    "detectable_format:number_bullet_lists": ("format:bullets", {"num_bullets": "n"}),
    "detectable_format:number_highlighted_sections": ("format:highlights", {"num_highlights": "n"}),
    "detectable_format:title": ("format:title", {}),
    "detectable_content:number_placeholders": ("format:placeholders", {"num_placeholders": "n"}),
    "detectable_content:postscript": ("format:postscript", {"postscript_marker": "mark"}),
    "length_constraints:number_paragraphs": ("length:paragraphs", {"num_paragraphs": "n"}),
    "length_constraints:nth_paragraph_first_word": ("length:nth_paragraph", {"num_paragraphs": "n", "nth_paragraph": "nth", "first_word": "first"}),
    "length_constraints:number_sentences": ("length:sentences", {"relation": "relation", "num_sentences": "n"}),
    "length_constraints:number_words": ("length:words", {"relation": "relation", "num_words": "n"}),
    "punctuation:no_comma": ("punctuation:no_comma", {}),
    "detectable_content:no_digits": ("content:no_digits", {}),
    "special_character:no_accents": ("content:no_accents", {}),
    "special_character:accents": ("content:has_accents", {}),
    "special_character:ethel_or_cedilla": ("content:letters", {"forbidden_char": "letters"}),
    "change_case:french_capital": ("case:capital", {}),
    "change_case:french_lowercase": ("case:lowercase", {}),
    "change_case:spanish_capital": ("case:capital", {}),
    "change_case:spanish_lowercase": ("case:lowercase", {}),
    "change_case:catalan_capital": ("case:capital", {}),
    "change_case:catalan_lowercase": ("case:lowercase", {}),
}


def by_id(instruction: str, arguments: dict, boundaries: Boundaries | Counted | None = None) -> tuple[str, dict] | None:
    """Name and arguments of the constraint that a public id stands for, with or without a language's prefix.

    ``boundaries`` (``sentences.learn``, or ``sentences.Counted``) are used where sentences are counted.
    """
    head, _, rest = instruction.partition(":")
    language, plain = (head, rest) if head in ("fr", "es", "ca") else ("en", instruction)
    if plain == "detectable_format:constrained_response":
        return "format:options", {"options": RESPONSES[language]}
    if plain not in IDS:
        return None
    name, names = IDS[plain]
    out = {names[k]: v for k, v in arguments.items() if k in names and v is not None}
    return name, out | ({"boundaries": boundaries} if boundaries and name == "length:sentences" else {})


def met(response: Column, name: str, **arguments) -> Column | None:
    if name not in CONSTRAINTS:
        return None
    return (_strip(response) != "") & F.coalesce(CONSTRAINTS[name](response, **arguments), F.lit(False))


def instruction_accuracy(df: DataFrame, by: list[str], response: str, instructions: list[tuple[str, dict]]) -> DataFrame:
    """Share of met constraints over all responses and constraints of each group."""
    checks = [c for c in (met(F.col(response), name, **arguments) for name, arguments in instructions) if c is not None]
    rows = df.select(*by, F.explode(F.array(*checks)).alias("_met"))
    return rows.groupBy(*by).agg(F.avg(F.col("_met").cast("double")).alias("instruction_accuracy"))
