"""Labels from generated text, and tag sequences: the row functions that need Python run on Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw
from plumbline.functions.matching import weighted_distance


def closest(text: str, options: list[str], insert: int = 1000, delete: int = 1, substitute: int = 1000) -> tuple[str, int]:
    """The option of least distance, letter case aside; the first among equals."""
    costs = [weighted_distance(text.lower(), o.lower(), insert, delete, substitute) for o in options]
    best = costs.index(min(costs))
    return options[best], costs[best]


def extracted_label(df: DataFrame, text: str, labels: list[str], into: str = "label", failed_at: int = 1000) -> DataFrame:
    """``df`` with the label its text names: a boxed one, else the one it starts with, else the nearest; and
    ``{into}_failed`` where even the nearest needs a letter that the text lacks."""
    @F.pandas_udf("label string, cost long")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([closest(t or "", labels) for t in texts], columns=["label", "cost"])

    options = F.array(*map(F.lit, sorted(labels, key=len, reverse=True)))
    said = F.lower(F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(text, r"\\boxed\{([^}]*)\}", 1), F.lit("")), F.col(text)), r"^\s+|\s+$", ""))
    named = F.get(F.filter(options, lambda o: said.startswith(F.lower(o))), 0)
    easy = df.withColumn("_named", named).withColumn("_near", F.when(named.isNull(), nearest(F.when(named.isNull(), said).otherwise(""))))
    return easy.withColumns({into: F.coalesce("_named", "_near.label"), f"{into}_failed": F.coalesce(F.col("_named").isNull() & (F.col("_near.cost") >= failed_at), F.lit(False))}).drop("_named", "_near")


def labels_from_logprobs(df: DataFrame, logprobs: str, labels: list[str], batch: list[str], into: str = "label") -> DataFrame:
    """The label whose beginning is the likeliest first token of each row (``array<struct<token, logprob>>``).

    A token that begins several labels is ambiguous; one ambiguous row makes its whole batch null.
    """
    options = F.array(*map(F.lit, labels))
    clean = F.filter(F.transform(logprobs, lambda x: F.struct(x["logprob"].alias("p"), F.lower(F.trim(x["token"])).alias("t"))), lambda x: x["t"] != "")
    fits = F.transform(clean, lambda x: F.struct(x["p"].alias("p"), F.filter(options, lambda o: F.lower(o).startswith(x["t"])).alias("names")))
    best = F.array_max(F.filter(fits, lambda x: F.size(x["names"]) > 0))
    rows = df.withColumn("_best", best["names"])
    bad = rows.groupBy(*batch).agg(F.max(F.coalesce(F.size("_best") != 1, F.lit(True)).cast("int")).alias("_bad"))
    return rows.join(bad, batch).withColumn(into, F.when(F.col("_bad") == 0, F.get("_best", 0))).drop("_best", "_bad")


def question_and_choices(text: Column) -> Column:
    """The question of a prompt, and the lettered options that end it."""
    lines = F.split(F.trim(text), "\n")
    option = r"^\s*[a-z]\.\s"
    last = F.aggregate(F.transform(lines, lambda x, i: F.when(~x.rlike(option), i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    head = F.slice(lines, F.lit(1), F.greatest(last + 1, F.lit(0)))
    tail = F.filter(lines, lambda x, i: i > last)
    return F.struct(F.regexp_replace(F.trim(F.array_join(head, "\n")), r"\n[^\n]*:$", "").alias("question"), F.transform(tail, lambda x: F.trim(F.regexp_replace(x, option, ""))).alias("choices"))


def choice_text(letter: Column, choices: Column) -> Column:
    return F.get(choices, F.ascii(F.lower(letter)) - 97)


def tags_to_json(tokens: Column, tags: Column, kinds: list[str]) -> Column:
    """Entities of a tag sequence as JSON: kind to list of texts."""
    @F.pandas_udf("string")
    def run(words: pd.Series, marks: pd.Series) -> pd.Series:
        from plumbline.operators.metrics import bio_chunks

        out = []
        for w, m in zip(words, marks, strict=True):
            found = {k: [] for k in kinds}
            for kind, start, end in sorted(bio_chunks(list(m)), key=lambda c: c[1]):
                if kind in found:
                    found[kind].append(" ".join(w[start : end + 1]))
            out.append(json.dumps(found, ensure_ascii=False))
        return pd.Series(out)

    return run(tokens, tags)


def json_to_tags(tokens: Column, answer: Column, kinds: list[str]) -> Column:
    """Tags of tokens from JSON of kind to texts; each text tags the first run of free tokens equal to it."""
    @F.pandas_udf("array<string>")
    def run(words: pd.Series, answers: pd.Series) -> pd.Series:
        out = []
        for w, a in zip(words, answers, strict=True):
            tags, low = ["o"] * len(w), [x.lower() for x in w]
            try:
                named = json.loads(a or "{}")
            except ValueError:
                named = {}
            for kind in kinds:
                for text in named.get(kind, []) if isinstance(named, dict) and isinstance(named.get(kind, []), list) else []:
                    own = str(text).lower().split()
                    for i in range(len(low) - len(own) + 1):
                        if own and low[i : i + len(own)] == own and tags[i : i + len(own)] == ["o"] * len(own):
                            tags[i : i + len(own)] = [f"b-{kind}"] + [f"i-{kind}"] * (len(own) - 1)
                            break
            out.append(tags)
        return pd.Series(out)

    return run(tokens, answer)


def known_tags(tags: Column, kinds: list[str], keep_misc: bool = True) -> Column:
    """Tags of unknown kind as ``misc``, or as ``o``; without ``keep_misc`` misc goes as well."""
    def one(x: Column) -> Column:
        kind = F.regexp_extract(F.lower(x), r"^[bi]-(.+)$", 1)
        inside = F.regexp_extract(F.lower(x), r"^([bi])-", 1)
        known = kind.isin(*[k for k in kinds if keep_misc or k != "misc"])
        return F.when(inside == "", "o").when(known, F.lower(x)).when(F.lit(keep_misc and "misc" in kinds), F.concat(inside, F.lit("-misc"))).otherwise("o")

    return F.transform(tags, one)


def merged_spans(spans: Column) -> Column:
    """Spans (``start``, ``end``) in order, with those that overlap or touch made one: a fold over the sorted array."""
    kind = "array<struct<start:int,end:int>>"
    plain = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(a, F.array(s))).cast(kind)

    return F.aggregate(plain, F.array().cast(kind), step)


def tagged(text: Column, spans: Column, tag: str) -> Column:
    """The text with each of its merged spans between tags."""
    def step(a: Column, s: Column) -> Column:
        part = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(f"<{tag}>"), F.substr(text, s["start"] + 1, s["end"] - s["start"]), F.lit(f"</{tag}>"))
        return F.struct(part.alias("out"), s["end"].alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(merged_spans(spans), start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def prompt(prefix: str, template: str, few_shot: Column, fields: dict[str, Column]) -> Column:
    """A prompt: prefix, filled examples and the template with its ``{name}`` places filled."""
    body = F.lit(template)
    for name, value in fields.items():
        body = F.replace(body, F.lit("{" + name + "}"), value)
    return F.concat_ws("\n\n", F.nullif(F.lit(prefix), F.lit("")), few_shot, body)


#: Fields of an example by task group, for a template's ``{name}`` places.
FIELDS: dict[str, dict[str, str]] = {
    "sequence-classification": {"text": "text", "label": "label"},
    "multiple-choice-classification": {"text": "text", "label": "label"},
    "text-to-text": {"text": "text", "target_text": "target_text"},
    "token-classification": {"text": "text", "label": "tags_json"},
    "question-answering": {"text": "context", "question": "question", "label": "answer"},
}


def prompts(df: DataFrame, task_group: str, prefix: str, template: str, examples: DataFrame | None = None, into: str = "prompt") -> DataFrame:
    """``df`` with its prompt: prefix, the examples filled in by ``turn``, and the row's own with an empty answer.

    The rows have the columns that the task group's fields name.  Examples are few: they become one array, broadcast.
    """
    fields = FIELDS[task_group]
    answer = list(fields)[-1]

    def filled(known: set[str]) -> Column:
        body = F.lit(template)
        for place, column in fields.items():
            value = F.coalesce(F.col(column).cast("string"), F.lit("")) if place in known else F.lit("")
            body = F.replace(body, F.lit("{" + place + "}"), value)
        return body

    own = F.rtrim(filled(set(fields) - {answer}))
    head = F.nullif(F.lit(prefix), F.lit(""))
    if examples is None:
        return df.withColumn(into, F.concat_ws("\n\n", head, own))
    shots = examples.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", filled(set(fields)).alias("text")))), lambda x: x["text"]).alias("_shots"))
    rows = df.join(F.broadcast(shots))
    return rows.withColumn(into, F.concat_ws("\n\n", head, F.array_join("_shots", "\n\n"), own)).select(*df.columns, into)


#: Parts of speech without which a sentence may still be right, nouns, and those that are no words.
DISPENSABLE, NOUNS, MARKS = ["ADJ", "ADV", "PUNCT", "SYM", "DET", "NUM", "PART"], ["NOUN", "PROPN"], ["PUNCT", "SYM"]


def _picked(places: Column, number: Column) -> Column:
    return F.get(places, (number % F.greatest(F.size(places), F.lit(1))).cast("int"))


def deleted(tokens: Column, tags: Column, number: Column) -> Column:
    """``tokens`` without one: not of a kind a sentence can do without, nor a noun beside a noun; null if none is left."""
    noun = lambda i: F.coalesce(F.get(tags, i).isin(*NOUNS), F.lit(False))
    free = lambda i: ~F.get(tags, i).isin(*DISPENSABLE) & ~(noun(i) & (noun(i - 1) | noun(i + 1)))
    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), free)
    at = _picked(places, number)
    return F.when((F.size(tokens) > 0) & (F.size(places) > 0), F.concat(F.slice(tokens, F.lit(1), at), F.slice(tokens, at + 2, F.size(tokens))))


def flipped(tokens: Column, tags: Column, number: Column) -> Column:
    """``tokens`` with two neighbours swapped: words of different kinds, not a pronoun with its auxiliary; null if there are none.

    A new first word is capitalised and the one after it is not, unless they are all capitals.
    """
    word = lambda i: ~F.get(tags, i).isin(*MARKS)
    pair = lambda i: F.array_sort(F.array(F.get(tags, i), F.get(tags, i + 1)))
    fits = lambda i: word(i) & word(i + 1) & (F.get(tags, i) != F.get(tags, i + 1)) & (pair(i) != F.array(F.lit("AUX"), F.lit("PRON")))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 2, F.lit(0))), lambda i: F.coalesce(fits(i), F.lit(False)))
    at = _picked(places, number)
    first, second = F.get(tokens, at + 1), F.get(tokens, at)
    cased = lambda x, new: F.when((at == 0) & (x != F.upper(x)), new).otherwise(x)
    swapped = F.array(cased(first, F.initcap(first)), cased(second, F.lower(second)))
    return F.when((F.size(tokens) > 1) & (F.size(places) > 0), F.concat(F.slice(tokens, F.lit(1), at), swapped, F.slice(tokens, at + 3, F.size(tokens))))


def corrupted(tokens: Column, tags: Column, key: Column, seed: int = 4242) -> Column:
    """``kind`` and ``tokens``: a token deleted or two neighbours flipped, by seeded draws; the other where one cannot be."""
    less, turned = deleted(tokens, tags, draw(seed, key)), flipped(tokens, tags, draw(seed + 1, key))
    flip = (draw(seed + 2, key) % 2 == 0) & turned.isNotNull() | less.isNull()
    return F.when(less.isNotNull() | turned.isNotNull(), F.struct(F.when(flip, "flip_neighbours").otherwise("delete").alias("kind"), F.when(flip, turned).otherwise(less).alias("tokens")))


def repaired_tags(text: Column, tag: str) -> Column:
    """A text whose ``<tag>`` and ``</tag>`` are balanced and not nested, whatever was written.

    Tags glued together (``<T<T>>``) count as one; of nested tags the outermost stay; closing tags without an opening go;
    a tag left open is closed at the end.  A fold over the pieces between tags keeps the depth.
    """
    plain = F.regexp_replace(F.regexp_replace(text, f"(?:<{tag})+>+", f"<{tag}>"), f"(?:</{tag})+>+", f"</{tag}>")
    pieces = F.split(F.regexp_replace(plain, f"(</?{tag}>)", "\u0000$1\u0000"), "\u0000")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        opens, closes = x == f"<{tag}>", x == f"</{tag}>"
        kept = F.when(opens, F.when(a["depth"] == 0, x).otherwise("")).when(closes, F.when(a["depth"] == 1, x).otherwise("")).otherwise(x)
        depth = F.when(opens, a["depth"] + 1).when(closes, F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), F.concat(a["out"], kept).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["depth"] > 0, F.concat(F.regexp_replace(a["out"], r"\s+$", ""), F.lit(f"</{tag}>"))).otherwise(a["out"]))


def tagged_to_spans(text: Column, tag: str) -> Column:
    """``text`` without its (balanced) tags, and ``spans`` (``start``, ``end``) of what stood between them."""
    pieces = F.split(text, f"</?{tag}>")
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit("").alias("out"), F.array().cast(kind).alias("spans"), F.lit(False).alias("inside"))

    def step(a: Column, x: Column) -> Column:
        at = F.length(a["out"])
        more = F.when(a["inside"] & (F.length(x) > 0), F.array(F.struct(at.alias("start"), (at + F.length(x)).alias("end")))).otherwise(F.array().cast(kind))
        return F.struct(F.concat(a["out"], x).alias("out"), F.concat(a["spans"], more).cast(kind).alias("spans"), (~a["inside"]).alias("inside"))

    return F.aggregate(pieces, start, step, lambda a: F.struct(a["out"].alias("text"), a["spans"].alias("spans")))


def entity_tags(text: Column, kinds: dict[str, str]) -> Column:
    """Array of ``token`` and ``label`` of a text marked with ``<NAME …>`` and ``</NAME>``, by the innermost open name.

    ``kinds`` gives each name's label; others are ``MISC``.  A tag of any kind ends the entity before it, so what follows
    starts a new one.  The fold's state is the stack of open names.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)</?\w+[^<>]*>|\w+|[^\w\s]"), F.lit(0))
    labels = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]) if kinds else F.create_map().cast("map<string,string>")
    out = "array<struct<token:string,label:string>>"
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(None).cast("string").alias("last"), F.array().cast(out).alias("out"))

    def step(a: Column, x: Column) -> Column:
        is_tag = (F.length(x) > 2) & x.startswith("<")
        name, closes = F.regexp_extract(x, r"^</?(\w+)", 1), x.startswith("</")
        top = F.try_element_at(a["open"], F.lit(-1))
        shorter = F.when(top == name, F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1)).otherwise(a["open"])
        kind = F.when(top.isNotNull(), F.coalesce(F.try_element_at(labels, top), F.lit("MISC")))
        label = F.when(kind.isNull(), "O").otherwise(F.concat(F.when(a["last"] == kind, "I-").otherwise("B-"), kind))
        return F.struct(
            F.when(is_tag, F.when(closes, shorter).otherwise(F.concat(a["open"], F.array(name)))).otherwise(a["open"]).alias("open"),
            F.when(~is_tag, kind).alias("last"),
            F.when(is_tag, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(x.alias("token"), label.alias("label"))))).cast(out).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def sentences_of(tokens: Column, ends: str = "^[.!?]+$") -> Column:
    """Arrays of ``token``, ``label`` structs, parted after a token that ends a sentence, but never within an entity."""
    kind = "array<array<struct<token:string,label:string>>>"

    def step(a: Column, x: Column) -> Column:
        new = a["ended"] & ~x["label"].startswith("I-")
        last = F.coalesce(F.try_element_at(a["out"], F.lit(-1)), F.array().cast("array<struct<token:string,label:string>>"))
        head = F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0)))
        grown = F.concat(head, F.array(F.concat(last, F.array(x))))
        ended = F.when(new | ~a["ended"], x["token"].rlike(ends)).otherwise(a["ended"])
        return F.struct(F.when(new, F.concat(a["out"], F.array(F.array(x)))).otherwise(grown).cast(kind).alias("out"), ended.alias("ended"))

    return F.aggregate(tokens, F.struct(F.array().cast(kind).alias("out"), F.lit(False).alias("ended")), step, lambda a: a["out"])
