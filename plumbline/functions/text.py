"""Column functions on identifiers, labels, numbers and display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_anchor(c: Column) -> Column:
    """The text of the first HTML anchor in a value, or the value if it has none."""
    inner = F.trim(F.regexp_extract(c, r"<a\s[^>]*>([^<]+)</a>", 1))
    return F.when(inner != "", inner).otherwise(c)


def plain_model_id(c: Column) -> Column:
    """Without anchor and variant note, whose words may come in any order; ``#parameter`` and ``@revision`` stay."""
    return F.regexp_replace(strip_anchor(c), r"\s*\((?:zero-shot|val)(?:,\s*(?:zero-shot|val))*\)$", "")


def strip_val(c: Column) -> Column:
    """The id with ``val`` taken from its note, or null where the note has none."""
    pattern = r"^(.*)\s*\(([^()]+)\)(\s*</a>)?$"
    notes = F.transform(F.split(F.regexp_extract(c, pattern, 2), ","), lambda x: F.trim(x))
    rest = F.array_remove(notes, "val")
    head, tail = F.rtrim(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 3)
    return F.when(F.array_contains(notes, "val"), F.concat(head, F.when(F.size(rest) > 0, F.concat(F.lit(" ("), F.array_join(rest, ", "), F.lit(")"))).otherwise(""), tail))


def variant_id(name: Column, few_shot: Column, validation: Column) -> Column:
    """The id with its note: zero-shot unless few-shot (the default), val if on the validation split."""
    note = F.array_compact(F.array(F.when(~F.coalesce(few_shot, F.lit(True)), "zero-shot"), F.when(F.coalesce(validation, F.lit(False)), "val")))
    return F.concat(strip_anchor(name), F.when(F.size(note) > 0, F.concat(F.lit(" ("), F.array_join(note, ", "), F.lit(")"))).otherwise(""))


def split_model_id(c: Column) -> Column:
    """``id``, ``revision`` (main if none) and ``parameter`` (null if none) of ``id@revision#parameter``."""
    part = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(F.regexp_extract(c, r"^([^@#]*)", 1).alias("id"), F.coalesce(part(r"@([^@#]+)"), F.lit("main")).alias("revision"), part(r"#([^@#]+)").alias("parameter"))


def flag(c: Column) -> Column:
    """A three-valued flag kept as a boolean or as text."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text == "true", True).when(text == "false", False)


def number(c: Column) -> Column:
    """A number that is not negative, or null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (x >= 0), x)


def version(c: Column) -> Column:
    """Whole-number parts, which compare as versions do; parts that are not numbers count as 0."""
    return F.transform(F.split(F.regexp_replace(c, r"\.dev\d*$", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def epoch(c: Column) -> Column:
    """Seconds from text that is a number of seconds or an ISO time; 0 if neither."""
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(c)) / 1e6, F.lit(0.0))


def split_label(validation: Column) -> Column:
    return F.when(validation.isNull(), "none").when(validation, "val").otherwise("test")


def shot_label(few_shot: Column) -> Column:
    return F.when(few_shot.isNull(), "none").when(few_shot, "fewshot").otherwise("zeroshot")


def record_path(model: Column, dataset: Column, validation: Column, few_shot: Column) -> Column:
    """Where a record is kept: a folder for each model, a file for each identity."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._@#-]+", "__")
    return F.concat(safe(model), F.lit("/"), safe(dataset), F.lit("__"), split_label(validation), F.lit("__"), shot_label(few_shot), F.lit(".json"))


def parameters_in(c: Column) -> Column:
    """Model size named in an id (``7B``, ``270m``), in units of one; not that of an active part (``A3B``).

    The first number, whole or decimal, that no letter or digit precedes and that a B or M follows which ends its word.
    """
    pattern = r"(?i)(?:^|[^a-z0-9])([0-9]+(?:[.][0-9]+)?)([bm])(?![a-z])"
    scale = F.when(F.lower(F.regexp_extract(c, pattern, 2)) == "b", 1e9).otherwise(1e6)
    return F.round(F.regexp_extract(c, pattern, 1).try_cast("double") * scale).cast("long")


#: Keyword patterns of model ids in the order they are tried, and the type each stands for (encoders: none).
TYPE_KEYWORDS = [("bert|xlm-r|encoder", None), ("-base|-pt", "base"), ("-instruct|-it$|-chat", "instruction_tuned"), ("^o[1-9]$|^o[1-9]-|deepseek-r1", "reasoning")]


def type_of(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(TYPE_KEYWORDS):
        out = F.when(c.rlike(f"(?i){pattern}"), F.lit(name).cast("string")).otherwise(out)
    return out


def size_bucket(parameters: Column, bounds: dict[str, float]) -> Column:
    """The first bucket whose upper bound is above the value; unknown for null."""
    out = F.lit("large")
    for name, high in sorted(bounds.items(), key=lambda x: -x[1]):
        out = F.when(parameters < high, name).otherwise(out)
    return F.when(parameters.isNull(), "unknown").otherwise(out)


def size_order(parameters: Column, bounds: dict[str, float]) -> Column:
    """Place of the value's bucket among all, smallest first; unknown sizes come last."""
    return F.when(parameters.isNull(), len(bounds) + 1).otherwise(sum((F.when(parameters >= high, 1).otherwise(0) for high in bounds.values()), F.lit(0)))


def model_type(generative_type: Column, behind_interface: Column) -> Column:
    """What a model is listed as: behind an interface, an encoder where it generates nothing, else a kind of decoder."""
    kinds = {"instruction_tuned": "instruction_tuned_decoder", "reasoning": "reasoning_decoder"}
    out = F.lit("base_decoder")
    for kind, name in kinds.items():
        out = F.when(generative_type == kind, name).otherwise(out)
    return F.when(F.coalesce(behind_interface, F.lit(False)), "api").when(generative_type.isNull(), "encoder").otherwise(out)


#: Upper bounds of a decoder's parameters by the bucket that it is listed in; beyond them and unknown are xlarge.
DECODER_SIZES = {"tiny": 2e9, "small": 10e9, "medium": 40e9, "large": 80e9}


def listed_bucket(kind: Column, parameters: Column) -> Column:
    """The bucket of a model on a list: its type where it is no decoder, else by size."""
    known = F.when(~F.isnan(parameters.cast("double")), parameters)
    size = F.lit("xlarge")
    for name, high in sorted(DECODER_SIZES.items(), key=lambda x: -x[1]):
        size = F.when(known < high, name).otherwise(size)
    return F.when(kind.isin("encoder", "api"), kind).otherwise(size)


def score_text(score: Column, margin: Column) -> Column:
    return F.when(score.isNull(), "-").otherwise(F.format_string("%.2f ± %.2f", score, F.coalesce(margin, F.lit(0.0))))


def tick(c: Column) -> Column:
    return F.when(c, "✓").when(~c, "✗").otherwise("?")


#: Marks of model types on a board.
TYPE_MARKS = {"base": "🧠", "instruction_tuned": "📝", "reasoning": "🤔"}


def type_mark(c: Column) -> Column:
    """A type's mark; the magnifier for models that generate nothing."""
    out = F.lit("🔍")
    for kind, mark in TYPE_MARKS.items():
        out = F.when(c == kind, mark).otherwise(out)
    return out


def or_not_applicable(value: Column, applicable: Column) -> Column:
    """A cell as text, ``N/A`` where the column says nothing about a row's type, ``?`` where the value is unknown."""
    return F.when(~applicable, "N/A").otherwise(F.coalesce(value.cast("string"), F.lit("?")))


def issue_model_id(title: Column, body: Column, prefix: str = "[MODEL EVALUATION REQUEST]", placeholder: str = "<model-name>") -> Column:
    """The model of a request: the line under its ``Model ID`` heading, else the title after its prefix."""
    said = F.regexp_replace(F.trim(F.regexp_extract(body, r"(?:^|\n)#{1,6}\s*Model ID\s*\n+([^\n]+)", 1)), r"^[\s`*_]+|[\s`*_]+$", "")
    rest = F.trim(F.substr(title, F.lit(len(prefix) + 2)))
    titled = F.when(title.startswith(prefix + " ") & ~rest.isin("", placeholder), rest)
    return F.when(F.coalesce(~said.isin("", placeholder), F.lit(False)), said).otherwise(titled)


def ticked(body: Column, names: list[str]) -> Column:
    """Those of the names whose box is ticked in a list of boxes."""
    kept = [F.when(body.rlike(r"-\s*\[[xX]\]\s*\Q" + n + r"\E"), F.lit(n)) for n in names]
    return F.array_compact(F.array(*kept))


def compact_number(c: Column) -> Column:
    out = F.when(c.isNotNull(), F.format_string("%.0f", c))
    for limit, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(c >= limit, F.concat(F.regexp_replace(F.format_string("%.1f", c / limit), r"\.0$", ""), F.lit(mark))).otherwise(out)
    return out


def listed(c: Column, word: str = "or") -> Column:
    """Quoted values, the last joined by a word."""
    quoted = F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    n = F.size(c)
    return F.when(n < 2, F.array_join(quoted, "")).otherwise(F.concat(F.array_join(F.slice(quoted, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(f" {word} "), F.element_at(quoted, -1)))


def cell(c: Column) -> Column:
    """A board's cell: its text without tags, before and after ``@@`` (shown, sorted by), and as a number."""
    text = F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    shown, key = F.split(text, "@@")[0], F.get(F.split(text, "@@"), 1)
    n = F.regexp_replace(F.regexp_extract(F.coalesce(key, shown), r"^\s*(-?[\d,]*\.?\d+)", 1), ",", "").try_cast("double")
    return F.struct(shown.alias("shown"), F.coalesce(key, shown).alias("sort"), n.alias("number"))


#: Characters of a snippet before and after the term, and of one without the term.  Fixed values.
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_WITHOUT = 50, 90, 140


def snippet(text: Column, term: Column) -> Column:
    """The text around the first place of a term, in any case; the text's start if it does not hold the term.  A cut is marked."""
    at = F.call_function("locate", F.lower(term), F.lower(text))
    start = F.greatest(at - 1 - SNIPPET_BEFORE, F.lit(0))
    end = F.least(F.length(text), at - 1 + F.length(term) + SNIPPET_AFTER)
    around = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at == 0, F.substring(text, 1, SNIPPET_WITHOUT)).otherwise(around)


def json_object(c: Column) -> Column:
    """The first flat ``{…}`` of a text as a map, single quotes and bare names allowed; null if it is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(\{[^{}]*\})", 1), F.lit("")), "map<string,string>", {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})


def choices_named(prompt: Column, letters: list[str]) -> Column:
    """Those of the letters that stand as ``x. `` in a prompt."""
    return F.filter(F.array(*map(F.lit, letters)), lambda x: F.call_function("rlike", prompt, F.concat(F.lit(r"(?i)\b"), x, F.lit(r"\. "))))


def last_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def telling_lines(log: Column, noise: list[str]) -> Column:
    """The lines of a log that are not blank and hold none of the given marks of noise."""
    wanted = lambda x: (F.trim(x) != "") & ~reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in noise], F.lit(False))
    return F.filter(F.split(log, "\r?\n"), wanted)


def last_traceback(log: Column) -> Column:
    """From the last ``Traceback`` line to the first line after it that is not indented, or null."""
    start = r"Traceback \(most recent call last\):\n(?:[ \t][^\n]*\n?)*[^\n]*"
    return last_match(log, start)


def joined_tokens(tokens: Column) -> Column:
    """Tokens as a sentence: no space before closing marks or after opening ones, nor within quotes that come in pairs."""
    text = F.regexp_replace(F.regexp_replace(F.array_join(tokens, " "), r" ([.,;:?!)\]}])", "$1"), r"([(\[{]) ", "$1")
    return F.when(F.regexp_count(text, F.lit('"')) % 2 == 0, F.regexp_replace(text, '" ([^"]*) "', '"$1"')).otherwise(text)
