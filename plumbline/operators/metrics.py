"""Metrics as grouped aggregates over rows of (group, prediction, reference).

Every metric takes the grouping columns, so models, datasets and iterations are scored in one job.
Class-based metrics aggregate to a confusion table before the shuffle; its size is that of the classes.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw
from plumbline.functions.matching import common_length, fewest_crossings
from plumbline.functions.stems import porter

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def metric(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers a metric under its name; user metrics register the same way."""
    REGISTRY[fn.__name__] = fn
    return fn


def confusion(df: DataFrame, by: list[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    return df.where(F.col(prediction).isNotNull() & F.col(reference).isNotNull()).groupBy(*by, F.col(prediction).alias("p"), F.col(reference).alias("r")).agg(F.count(F.lit(1)).alias("n"))


@metric
def accuracy(df: DataFrame, by: list[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(prediction) == F.col(reference)).cast("double")).alias("accuracy"))


def _margins(cells: DataFrame, by: list[str]) -> DataFrame:
    """``label``, ``tp``, ``predicted`` and ``actual`` of every class of every group."""
    sides = F.explode(F.array(F.struct(F.col("p").alias("label"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("actual"), F.when(F.col("p") == F.col("r"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("r").alias("label"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("tp"))))
    return cells.select(*by, sides.alias("s")).groupBy(*by, F.col("s.label").alias("label")).agg(F.sum("s.tp").alias("tp"), F.sum("s.predicted").alias("predicted"), F.sum("s.actual").alias("actual"))


@metric
def macro_f1(df: DataFrame, by: list[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Unweighted mean over all classes predicted or present."""
    classes = _margins(confusion(df, by, prediction, reference), by)
    return classes.groupBy(*by).agg(F.avg(2 * F.col("tp") / (F.col("predicted") + F.col("actual"))).alias("macro_f1"))


@metric
def mcc(df: DataFrame, by: list[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Multi-class Matthews correlation; 0 where it has no value."""
    classes = _margins(confusion(df, by, prediction, reference), by)
    d = [F.col(c).cast("double") for c in ("tp", "predicted", "actual")]
    sums = classes.groupBy(*by).agg(F.sum(d[0]).alias("c"), F.sum(d[1]).alias("s"), F.sum(d[1] * d[2]).alias("pt"), F.sum(d[1] * d[1]).alias("pp"), F.sum(d[2] * d[2]).alias("tt"))
    below = (F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt"))
    return sums.select(*by, F.when(below > 0, (F.col("c") * F.col("s") - F.col("pt")) / F.sqrt(below)).otherwise(0.0).alias("mcc"))


@metric
def bias(df: DataFrame, by: list[str]) -> DataFrame:
    """Bias, accuracy and accuracy less bias on ambiguous contexts; every row counts in the denominators.

    Needs ``prediction``, ``stereo_idx``, ``counter_idx`` and ``unknown_idx``.
    """
    share = lambda c: F.count_if(F.col("prediction") == F.col(c)) / F.count(F.lit(1))
    out = df.groupBy(*by).agg((share("stereo_idx") - share("counter_idx")).alias("bias"), share("unknown_idx").alias("accuracy"))
    return out.withColumn("adjusted", F.greatest(F.lit(0.0), F.col("accuracy") - F.abs("bias")))


@metric
def bits_per_character(df: DataFrame, by: list[str], value: str = "bpc") -> DataFrame:
    """Mean over the finite values."""
    return df.groupBy(*by).agg(F.avg(F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))).alias("bits_per_character"))


def bits(logprobs: Column, text: Column) -> Column:
    """Bits per character of a text from its tokens' natural log probabilities."""
    return -F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / math.log(2) / F.nullif(F.length(text), F.lit(0))


@metric
def hallucination_rate(df: DataFrame, by: list[str], flag: str = "flag") -> DataFrame:
    """Share of tokens flagged."""
    return df.groupBy(*by).agg((F.sum(F.col(flag).cast("long")) / F.count(F.lit(1))).alias("hallucination_rate"))


@metric
def judge_mean(df: DataFrame, by: list[str], answer: str = "answer", field: str = "score") -> DataFrame:
    """Mean of the score field of JSON answers; answers that do not parse are left out."""
    return df.groupBy(*by).agg(F.avg(F.get_json_object(answer, f"$.{field}").try_cast("double")).alias("judge_mean"))


def majority_vote(df: DataFrame, by: list[str], choice: str) -> DataFrame:
    """The commonest choice of each group; among equals the smallest."""
    counts = df.where(F.col(choice).isNotNull()).groupBy(*by, choice).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(choice).alias("c"))).alias("m")).select(*by, F.col("m.c").alias(choice), (-F.col("m.n")).alias("votes"))


def normalised_answer(text: Column) -> Column:
    """Lower case, without punctuation, English articles and spare spaces."""
    text = F.regexp_replace(F.lower(text), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def _numbered(tokens: Column) -> Column:
    """Each token with the number of its occurrence, so that no entry comes twice."""
    # A one-element array holds the sorted tokens, so that they are sorted once for a row.
    number = lambda s: F.transform(s, lambda x, i: F.concat_ws("\u0001", x, (i - F.array_position(s, x)).cast("string")))
    return F.element_at(F.transform(F.array(F.sort_array(tokens)), number), 1)


def token_overlap(a: Column, b: Column) -> Column:
    """Tokens in common, counted as often as in both: occurrences are numbered, and the numbered tokens intersected."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


@metric
def question_answering(df: DataFrame, by: list[str], prediction: str = "prediction", answers: str = "answers") -> DataFrame:
    """Mean exact match and token F1, each against the best of the reference answers; no answer expected is an empty list."""
    golds = F.transform(F.when(F.size(answers) > 0, F.col(answers)).otherwise(F.array(F.lit(""))), normalised_answer)
    tokens = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    said = normalised_answer(F.coalesce(F.col(prediction), F.lit("")))
    # A row for each reference answer: texts are normalised once, and the best answer of a row is a partial maximum.
    rows = df.select(*by, said.alias("_said"), golds.alias("_golds")).withColumn("_row", F.monotonically_increasing_id())
    pairs = rows.select(*by, "_row", "_said", F.explode("_golds").alias("_gold")).select(*by, "_row", (F.col("_said") == F.col("_gold")).cast("double").alias("_em"), tokens(F.col("_said")).alias("_a"), tokens(F.col("_gold")).alias("_b"))
    a, b = F.size("_a"), F.size("_b")
    f1 = F.when((a == 0) | (b == 0), (a == b).cast("double")).otherwise(2.0 * token_overlap(F.col("_a"), F.col("_b")) / (a + b))
    best = pairs.groupBy(*by, "_row").agg(F.max(f1).alias("_f1"), F.max("_em").alias("_em"))
    return best.groupBy(*by).agg(F.avg("_f1").alias("f1"), F.avg("_em").alias("em"))


def rouge_l_score(prediction: str, reference: str) -> float:
    """Over runs of the letters a-z and digits, letter case aside, as the usual scorer takes them."""
    a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (prediction, reference))
    n = common_length(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def meteor_score(prediction: str, reference: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Exact and stem matches, then recall-weighted precision less a penalty for broken order (Banerjee, Lavie, 2005).

    Each stage aligns the words that the stage before left free: as many pairs as can be, with the fewest crossings.
    Stems are Porter's.  The synonym stage needs a lexicon and is left out.
    """
    a, b = (re.findall(r"\w+|[^\w\s]", x.lower()) for x in (prediction, reference))
    pairs, free_a, free_b = [], list(range(len(a))), list(range(len(b)))
    for of in (str, porter):
        new = [(free_a[i], free_b[j]) for i, j in fewest_crossings([of(a[i]) for i in free_a], [of(b[j]) for j in free_b])]
        pairs += new
        met_a, met_b = {i for i, _ in new}, {j for _, j in new}
        free_a, free_b = [i for i in free_a if i not in met_a], [j for j in free_b if j not in met_b]
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(pairs[k + 1] != (pairs[k][0] + 1, pairs[k][1] + 1) for k in range(len(pairs) - 1))
    precision, recall = len(pairs) / len(a), len(pairs) / len(b)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return mean * (1 - gamma * (chunks / len(pairs)) ** beta)


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _words_and_marks(text: str) -> list[str]:
    """Words, with a mark at a word's end or start as a word of its own."""
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def chrf_score(prediction: str, reference: str, characters: int = 6, words: int = 0, beta: float = 2.0) -> float:
    """Mean over n-gram orders of precision and recall, then their F-score, between 0 and 1; an empty pair is 1."""
    if not prediction and not reference:
        return 1.0
    orders = [(list("".join(prediction.split())), list("".join(reference.split())), n) for n in range(1, characters + 1)]
    orders += [(_words_and_marks(prediction), _words_and_marks(reference), n) for n in range(1, words + 1)]
    precision = recall = used = 0.0
    for a, b, n in orders:
        x, y = _grams(a, n), _grams(b, n)
        if x and y:
            same = (x & y).total()
            precision, recall, used = precision + same / x.total(), recall + same / y.total(), used + 1
    if not used or not precision + recall:
        return 0.0
    p, r = precision / used, recall / used
    return (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def sari_score(source: str, prediction: str, references: list[str]) -> float:
    """Mean of the scores for what is added, kept and deleted, over n-grams of one to four words (Xu et al., 2016)."""
    def f(p: float, r: float) -> float:
        return 2 * p * r / (p + r) if p + r else 0.0

    total, n_refs = 0.0, len(references)
    for n in range(1, 5):
        s, c = _grams(source.lower().split(), n), _grams(prediction.lower().split(), n)
        r = sum((_grams(x.lower().split(), n) for x in references), Counter())
        many_s, many_c = Counter({k: v * n_refs for k, v in s.items()}), Counter({k: v * n_refs for k, v in c.items()})
        keep, keep_good, keep_all = many_s & many_c, (many_s & many_c) & r, many_s & r
        kp = sum(keep_good[k] / keep[k] for k in keep_good) / len(keep) if keep else 1.0
        kr = sum(keep_good[k] / keep_all[k] for k in keep_good) / len(keep_all) if keep_all else 1.0
        drop, drop_good = many_s - many_c, (many_s - many_c) - r
        dp = sum(drop_good[k] / drop[k] for k in drop_good) / len(drop) if drop else 1.0
        new, wanted = set(c) - set(s), set(r) - set(s)
        good = new & wanted
        ap, ar = len(good) / len(new) if new else 1.0, len(good) / len(wanted) if wanted else 1.0
        total += (f(ap, ar) + f(kp, kr) + dp) / 3
    return total / 4


def bio_chunks(tags: list[str]) -> set[tuple[str, int, int]]:
    """Entities of a tag sequence: type, first and last place.  ``i-`` after another type starts a new one."""
    out, kind, start = set(), None, 0
    for i, tag in enumerate([*tags, "o"]):
        head, _, name = tag.lower().partition("-")
        if kind is not None and (head != "i" or name != kind):
            out.add((kind, start, i - 1))
            kind = None
        if head in "bi" and name and kind is None:
            kind, start = name, i
    return out


def _mean_udf(name: str, score: Callable[..., float]) -> Callable[..., DataFrame]:
    """A metric that is the mean of a score of each row, evaluated on Arrow batches."""
    def run(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
        @F.pandas_udf("double")
        def of(frame: pd.DataFrame) -> pd.Series:
            return pd.Series([score(*x) for x in frame.itertuples(index=False)], dtype="float64")

        return df.groupBy(*by).agg(F.avg(of(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]))).alias(name))

    run.__name__ = name
    return metric(run)


def permuted_cells(prediction: str, label: str) -> float:
    """Share of right cells under the best matching of the prediction's objects to the label's (logic puzzles).

    Both are JSON objects of lists; the matching is an exact assignment, so any number of objects will do.
    """
    try:
        p, r = json.loads(prediction), json.loads(label)
        mine, theirs = [[str(x).casefold() for x in v] for v in p.values()], [[str(x).casefold() for x in v] for v in r.values()]
    except (ValueError, TypeError, AttributeError):
        return 0.0
    if len(mine) != len(theirs) or not theirs:
        return 0.0
    cells = sum(map(len, theirs))
    return _best_assignment([[len(set(a) & set(b)) for b in theirs] for a in mine]) / max(cells, 1)


def _best_assignment(gain: list[list[int]]) -> int:
    """Largest total of a square table with one entry of each row and column (Hungarian method, cubic time)."""
    n = len(gain)
    rows, columns, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # potentials; the row of each column, from 1
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, done = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            done[at], row = True, owner[at]
            for j in range(1, n + 1):
                if not done[j] and (cost := -gain[row - 1][j - 1] - rows[row] - columns[j]) < least[j]:
                    least[j], back[j] = cost, at
            to = min((j for j in range(1, n + 1) if not done[j]), key=least.__getitem__)
            step = least[to]
            for j in range(n + 1):
                if done[j]:
                    rows[owner[j]] += step
                    columns[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return sum(gain[owner[j] - 1][j - 1] for j in range(1, n + 1))


def tool_call_right(functions: str, prediction: str, reference: str) -> float:
    """1 if the calls match one for one: same name, every required argument given, every argument among those allowed."""
    try:
        required = {f["name"]: f.get("parameters", {}).get("required", []) for f in json.loads(functions)}
        calls, wanted = json.loads(prediction), json.loads(reference)
        if len(calls) != len(wanted):
            return 0.0
        for call, want in zip(calls, wanted, strict=True):
            (name, allowed), given = next(iter(want.items())), call["arguments"]
            if call["function"] != name or any(k not in given for k in required.get(name, [])):
                return 0.0
            if any(k not in allowed or v not in allowed[k] for k, v in given.items()):
                return 0.0
    except (ValueError, TypeError, KeyError, AttributeError, StopIteration):
        return 0.0
    return 1.0


rouge_l = _mean_udf("rouge_l", rouge_l_score)
chrf = _mean_udf("chrf", chrf_score)
chrf_words = _mean_udf("chrf_words", lambda p, r: chrf_score(p, r, words=2))
meteor = _mean_udf("meteor", meteor_score)
sari = _mean_udf("sari", lambda s, p, r: sari_score(s, p, list(r)))
puzzle_best_permutation = _mean_udf("puzzle_best_permutation", permuted_cells)
tool_calling = _mean_udf("tool_calling", tool_call_right)


@metric
def entity_f1(df: DataFrame, by: list[str], predicted: str = "predicted", labels: str = "labels", skip: list[str] | None = None) -> DataFrame:
    """Micro F1 over entities; groups without any entity on either side score 1.  ``skip``: types left out."""
    gone = set(skip or [])

    @F.pandas_udf("same long, predicted long, actual long")
    def counts(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(p, r, strict=True):
            a, b = ({c for c in bio_chunks(list(x)) if c[0] not in gone} for x in (a, b))
            rows.append((len(a & b), len(a), len(b)))
        return pd.DataFrame(rows, columns=["same", "predicted", "actual"])

    sums = df.withColumn("_c", counts(predicted, labels)).groupBy(*by).agg(*[F.sum(f"_c.{c}").alias(f"_{c}") for c in ("same", "predicted", "actual")])
    total = F.col("_predicted") + F.col("_actual")
    return sums.select(*by, F.when(total == 0, 1.0).otherwise(2 * F.col("_same") / total).alias("entity_f1"))


@metric
def puzzle_accuracy(df: DataFrame, by: list[str], prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Share of right cells and of puzzles right in all cells; both columns are maps of lists."""
    keys = F.map_keys(reference)
    right = F.aggregate(keys, F.lit(0), lambda n, k: n + F.coalesce(F.size(F.array_intersect(F.element_at(prediction, k), F.element_at(reference, k))), F.lit(0)))
    cells = F.aggregate(F.map_values(reference), F.lit(0), lambda n, v: n + F.size(v))
    return df.groupBy(*by).agg(F.avg(right / cells).alias("cell_accuracy"), F.avg((right == cells).cast("double")).alias("puzzle_accuracy"))


def language_gate(df: DataFrame, confidences: str, wanted: str, least: float = 0.75) -> DataFrame:
    """``gate``: 1 where the wanted languages' confidences sum to more than ``least``, else 0."""
    total = F.aggregate(wanted, F.lit(0.0), lambda a, k: a + F.coalesce(F.element_at(confidences, k), F.lit(0.0)))
    return df.withColumn("gate", (total > least).cast("int"))


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0; null if any value is NaN."""
    return F.when(~F.exists(values, F.isnan), F.array_position(values, F.array_max(values)) - 1)


def failed_instances(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Rows whose answer, letter case aside, is not the reference."""
    return df.where(~F.lower(prediction).eqNullSafe(F.lower(reference)))


def best_span(df: DataFrame, k: int, most: int) -> DataFrame:
    """``df`` with ``span``: of the ``k`` best starts and ends, the valid pair (start before end, within ``most`` tokens) of the best sum."""
    def best(column: str) -> Column:
        scored = F.transform(column, lambda x, i: F.struct(x.alias("score"), (-i).alias("back")))
        return F.transform(F.slice(F.sort_array(scored, asc=False), 1, k), lambda s: F.struct(s["score"].alias("score"), (-s["back"]).alias("at")))

    pairs = F.flatten(F.transform(best("start_logits"), lambda s: F.transform(best("end_logits"), lambda e: F.struct((s["score"] + e["score"]).alias("score"), s["at"].alias("start"), e["at"].alias("end")))))
    valid = F.filter(pairs, lambda p: (p["end"] >= p["start"]) & (p["end"] - p["start"] < most))
    return df.withColumn("span", F.array_max(valid))


def gated_mean(df: DataFrame, by: list[str], score: str, confidences: str, wanted: str) -> DataFrame:
    """``by`` and ``gated``: mean of a row's score where its language is a wanted one, else 0."""
    return language_gate(df, confidences, wanted).groupBy(*by).agg(F.avg(F.col(score) * F.col("gate")).alias("gated"))


def chosen_values(df: DataFrame, by: list[str], question: str, choice: str, flagged: dict[int, int]) -> DataFrame:
    """One choice for each question of a survey: the commonest among its phrasings (the smallest of equals); questions of
    which only one choice counts (``flagged``) become 1 for it and 0 for others."""
    votes = majority_vote(df, [*by, question], choice)
    value = F.col(choice)
    for number, wanted in flagged.items():
        value = F.when(F.col(question) == number, (F.col(choice) == wanted).cast("int")).otherwise(value)
    return votes.select(*by, question, value.alias("value"))


def survey_score(values: DataFrame, by: list[str], parameters: DataFrame, slope: float, centre: float) -> DataFrame:
    """``by`` and ``score``: a logistic of the centred mean log-likelihood of the choices.

    ``parameters`` (small: a row for each question) has ``question``, ``mean`` and ``sd``: the choices' likelihood is that of
    a normal variable for each question.  A fitted pipeline's own numbers come in through this table.
    """
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    likelihood = -0.5 * z * z - F.log(F.col("sd")) - 0.5 * math.log(2 * math.pi)
    means = values.join(parameters, "question").groupBy(*by).agg(F.avg(likelihood).alias("_mean"))
    return means.select(*by, (1 / (1 + F.exp(-slope * (F.col("_mean") - centre)))).alias("score"))


def totals(df: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``metric``, ``total``, ``margin`` (1.96 standard errors; null for one score) and ``n_failed``.

    ``df`` has a row for each iteration: ``scores`` (map of metric, with or without ``test_``, to a share) and
    ``failed_instances`` (array or null).  Shares become percent; failures are summed over the iterations.
    """
    rows = df.select(*by, F.explode("scores").alias("name", "share"))
    plain = rows.withColumn("metric", F.regexp_replace("name", "^test_", "")).where(F.col("share").isNotNull() & ~F.isnan("share"))
    n = F.count("share")
    out = plain.groupBy(*by, "metric").agg((100 * F.avg("share")).alias("total"), (100 * 1.96 * F.stddev_samp("share") / F.sqrt(n)).alias("margin"))
    failed = df.groupBy(*by).agg(F.sum(F.coalesce(F.size(F.coalesce("failed_instances", F.array())), F.lit(0))).alias("n_failed"))
    return out.join(failed, by)


def uniform_baseline(df: DataFrame, key: str, labels: list[str], seed: int = 4242) -> DataFrame:
    """``df`` with ``prediction``, a label drawn by a seeded hash of the key, and ``logprobs``, the same for every label."""
    options = F.array(*map(F.lit, labels))
    even = F.transform(options, lambda x: F.struct(x.alias("token"), F.lit(math.log(1 / len(labels))).alias("logprob")))
    return df.withColumns({"prediction": F.get(options, (draw(seed, F.col(key)) % len(labels)).cast("int")), "logprobs": even})


def paired(predictions: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions beside their references by key, never by position; a prediction without a reference is left out."""
    return predictions.join(references, keys)


def with_context(predictions: DataFrame, examples: DataFrame, key: str, context: str) -> DataFrame:
    """Predictions with the context of their example; those of an unknown example keep a null."""
    return predictions.join(examples.select(key, context), key, "left")


def spans_of_examples(features: DataFrame, example: str, k: int, most: int) -> DataFrame:
    """``example`` and the best ``span`` over all of its features (windows), the first feature among equals."""
    best = best_span(features, k, most).where("span IS NOT NULL")
    order = F.struct(F.col("span.score").alias("score"), (-F.col("feature")).alias("back"))
    return best.groupBy(example).agg(F.max_by(F.struct("feature", "span"), order).alias("b")).select(example, "b.feature", "b.span")
