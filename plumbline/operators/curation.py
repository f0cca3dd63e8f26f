"""Curating text datasets: filters, deduplication, sampling, splitting and labels.

Every random choice is the order of a seeded hash of a stable key, so it repeats on any number of
machines.  Exact sample sizes use a top-k (one small heap for each task) or ranks within a stratum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_order
from plumbline.session import settled

#: Splits in order of priority.
SPLITS = ["train", "val", "test"]


def standardised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Renames columns (old to new); a different column that already has a new name is dropped."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    taken = [new for old, new in columns.items() if new in df.columns and new not in columns and new != old]
    return df.drop(*taken).withColumnsRenamed(columns)


def require_columns(df: DataFrame, columns: list[str], where: str = "") -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns{where}: {', '.join(missing)}; there are {', '.join(sorted(df.columns))}")
    return df


def require_in_splits(splits: dict[str, DataFrame], columns: list[str]) -> dict[str, DataFrame]:
    """The splits, once each of them is known to have the columns."""
    return {name: require_columns(df, columns, f" in split {name}") for name, df in splits.items()}


def helper(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def target_column(task_group: str) -> str:
    return {"token-classification": "labels", "text-to-text": "target_text"}.get(task_group, "label")


def with_choices(df: DataFrame, question: str, choices: str, heading: str) -> DataFrame:
    """``text`` of the question and its lettered options; ``bare_input`` and ``raw_choices`` keep the parts."""
    lettered = F.transform(choices, lambda c, i: F.concat(F.char(i + 97), F.lit(". "), F.trim(c)))
    text = F.concat(F.col(question), F.lit(f"\n{heading}:\n"), F.array_join(lettered, "\n"))
    return df.withColumns({"text": text, "bare_input": F.col(question), "raw_choices": F.col(choices)})


def choice_letter(label: Column, choices: Column) -> Column:
    """A label given as the option's text, its number or its letter, as a lower-case letter; null if none fits."""
    text = label.cast("string")
    by_text, by_number = F.array_position(choices, text), text.try_cast("int") + 1
    place = F.when(by_text > 0, by_text).when(by_number.isNotNull(), by_number.cast("long"))
    return F.when(place.between(1, F.size(choices)), F.char(place + 96)).when(F.lower(text).rlike("^[a-z]$"), F.lower(text))


def mapped(column: Column | str, mapping: dict[str, str], default: str | None = None) -> Column:
    """Value by value through a small mapping; others become ``default``, or stay if it is ``"same"``."""
    c = F.col(column) if isinstance(column, str) else column
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c if default == "same" else F.lit(default))


def mapped_array(column: str, mapping: dict[str, str]) -> Column:
    return F.transform(column, lambda x: mapped(x, mapping, "same"))


def dense_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """``df`` with a dense number from 0 in the order of a key.

    Counts by range partition give each partition its start; no window goes over the rows.  The ranged rows are settled
    first, since two evaluations of a range partitioning may sample other bounds.
    """
    at, part, start, n = (helper(df, x) for x in ("_at", "_part", "_start", "_n"))
    ranged = settled(df.repartitionByRange(key).sortWithinPartitions(key).withColumn(at, F.monotonically_increasing_id()))
    # The high bits are the partition's number, the 33 low ones the row's place in it.
    number, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    starts = ranged.groupBy(number.alias(part)).agg(F.count(F.lit(1)).alias(n)).withColumn(start, F.sum(n).over(Window.orderBy(part)) - F.col(n))
    rows = ranged.join(F.broadcast(starts), number == F.col(part))
    return rows.withColumn(name, F.col(start) + place).select(*[c for c in df.columns if c != name], name)


def non_empty(df: DataFrame, column: str) -> DataFrame:
    size = F.size(column) if df.schema[column].dataType.typeName() == "array" else F.length(column)
    return df.where(size > 0)


def length_between(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    return df.where(F.length(column).between(low, high))


def more_often_than(text: Column, most: int) -> Column:
    """Whether a white-space token occurs more than ``most`` times: whether, of the sorted tokens, one equals that ``most`` places on."""
    tokens = F.sort_array(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    hits = lambda s: F.size(F.filter(s, lambda x, i: x == F.get(s, i + most))) > 0
    # A one-element array holds the sorted tokens, so that they are sorted once for a row.
    return F.element_at(F.transform(F.array(tokens), hits), 1)


def not_repetitive(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    return df.where(~more_often_than(F.col(column), most))


def options_between(df: DataFrame, column: str, low: int, high: int, most: int = 50) -> DataFrame:
    """All options of fitting length, and none repetitive."""
    return df.where(F.forall(column, lambda x: F.length(x).between(low, high)) & ~F.exists(column, lambda x: more_often_than(x, most)))


def answerable(df: DataFrame, answers: str = "answers") -> DataFrame:
    return df.where((F.size(f"{answers}.text") > 0) & (F.get(F.col(f"{answers}.text"), 0) != ""))


def eligible_sentences(df: DataFrame, tokens: str, tags: str, doc: str) -> DataFrame:
    """More than five tokens and tags, balanced quotes, no leading mark, at most one ``=``."""
    first = F.get(F.col(tokens), 0)
    return df.where((F.size(tokens) > 5) & (F.size(F.array_distinct(tags)) > 5) & (F.regexp_count(doc, F.lit('"')) % 2 == 0) & ~first.rlike(r"^\p{Punct}") & (F.regexp_count(doc, F.lit("=")) <= 1))


def drop_exact_duplicates(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The row of least ``order`` of each combination of ``columns``, combined in the tasks before the shuffle."""
    others = [c for c in df.columns if c not in columns]
    rest = F.struct(F.col(order).alias("_order"), *[F.col(c).alias(f"_{c}") for c in others])
    best = df.groupBy(*columns).agg(F.min_by(rest, F.col(order)).alias("_best"))
    return best.select(*[F.col(c) if c in columns else F.col(f"_best._{c}").alias(c) for c in df.columns])


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 4242) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer."""
    return df.orderBy(seeded_order(seed, key), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 4242) -> DataFrame:
    return df.orderBy(seeded_order(seed, key), key)


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def _ranked(df: DataFrame, by: list[str], key: str, seed: int, buckets: int = 64) -> tuple[DataFrame, str]:
    """``df`` with its place from 1 in the seeded order of its group, and the name of that column.

    A group is ordered bucket by bucket of its hash, so a group that holds a third of all rows is many tasks' work.
    """
    h, b, n, before, within, rank = (helper(df, x) for x in ("_h", "_b", "_n", "_before", "_in", "_rank"))
    hashed = df.withColumn(h, seeded_order(seed, key)).withColumn(b, (F.conv(F.substring(h, 1, 2), 16, 10).cast("int") * buckets / 256).cast("int"))
    sizes = hashed.groupBy(*by, b).agg(F.count(F.lit(1)).alias(n))
    sums = sizes.withColumn(before, F.sum(n).over(Window.partitionBy(*by).orderBy(b)) - F.col(n)).drop(n)
    inner = hashed.withColumn(within, F.row_number().over(Window.partitionBy(*by, b).orderBy(h, key)))
    condition = reduce(lambda x, y: x & y, [inner[c].eqNullSafe(sums[c]) for c in [*by, b]])
    return inner.join(sums, condition).select(*[inner[c] for c in df.columns], (F.col(before) + F.col(within)).alias(rank)), rank


def stratified_split(df: DataFrame, stratum: str, key: str, shares: dict[str, int], seed: int = 4242) -> DataFrame:
    """``df`` with ``split``: within each stratum the given percentages, as near as whole rows allow."""
    size = helper(df, "_size")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias(size))
    ranked, rank = _ranked(df, [stratum], key, seed)
    rows = ranked.join(sizes, ranked[stratum].eqNullSafe(sizes[stratum])).drop(sizes[stratum])
    split = F.lit(None).cast("string")
    for name in reversed(list(shares)):
        split = F.when((F.col(rank) - 1) * 100 < F.col(size) * share_until(shares, name), name).otherwise(split)
    return rows.withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def share_until(shares: dict[str, int], name: str) -> int:
    names = list(shares)
    return sum(shares[n] for n in names[: names.index(name) + 1])


def fixed_split(df: DataFrame, key: str, sizes: dict[str, int], seed: int = 4242) -> DataFrame:
    """Splits of exact sizes, disjoint, in one seeded order; rows beyond them are left out."""
    every = helper(df, "_all")
    ranked, rank = _ranked(df.withColumn(every, F.lit(0)), [every], key, seed)
    split = _by_rank(F.col(rank), sizes)
    return ranked.withColumn("split", split).where("split IS NOT NULL").select(*[c for c in df.columns if c != "split"], "split")


def _by_rank(rank: Column, sizes: dict[str, int]) -> Column:
    """The split that a place from 1 falls into, or null beyond all."""
    split, before = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        split = F.when(rank.between(before + 1, before + n), name).otherwise(split)
        before += n
    return split


def balanced_splits(df: DataFrame, label: str, key: str, sizes: dict[str, int], n_labels: int = 2, seed: int = 4242) -> DataFrame:
    """Disjoint splits with as many rows of each label: within a label one seeded order is cut into equal shares."""
    ranked, rank = _ranked(df.where(F.col(label).isNotNull()), [label], key, seed)
    split = _by_rank(F.col(rank), {name: n // n_labels for name, n in sizes.items()})
    return ranked.withColumn("split", split).where("split IS NOT NULL").select(*[c for c in df.columns if c != "split"], "split")


def adaptive_sizes(n: int, test: int = 2048, val: int = 256, train: int = 1024, least_test: int = 128) -> dict[str, int]:
    """Split sizes for ``n`` rows: the test split is halved until all fit; below its least size 64, 32 and the rest."""
    while test >= least_test:
        if train + val + test <= n:
            return {"train": train, "val": val, "test": test}
        test //= 2
    return {"train": min(64, n), "val": min(32, max(0, n - 64)), "test": max(0, n - 96)}


def balanced(df: DataFrame, label: str, key: str, per_label: int | None = None, seed: int = 4242) -> DataFrame:
    """As many rows of each label as the rarest has, or ``per_label``."""
    known = df.where(F.col(label).isNotNull())
    ranked, rank = _ranked(known, [label], key, seed)
    if per_label is not None:
        return ranked.where(F.col(rank) <= per_label).select(*df.columns)
    least, n = helper(ranked, "_least"), helper(ranked, "_n")
    smallest = known.groupBy(label).agg(F.count(F.lit(1)).alias(n)).agg(F.min(n).alias(least))
    return ranked.join(F.broadcast(smallest), F.col(rank) <= F.col(least)).select(*df.columns)


#: Lengths under which examples count as short, tried in order.
SHORT = [512, 1024, 2048, 4096, 8192]


def _short(df: DataFrame, text: str, n: int) -> DataFrame:
    """Rows whose text is under the least of the lengths of which there are ``n``."""
    counts = df.agg(*[F.count_if(F.length(text) < b).alias(str(b)) for b in SHORT]).head()
    bound = next((b for b in SHORT if counts[str(b)] >= n), None)
    if bound is None:
        raise ValueError("not enough short examples")
    return df.where(F.length(text) < bound)


def _round_robin(picked: list[DataFrame], n: int, at: str, columns: list[str]) -> DataFrame:
    """First rows of each list in turn, and ``turn``; the lists hold ``n`` rows at most, so one task orders them."""
    rows = reduce(DataFrame.unionByName, [p.withColumn(f"{at}_place", F.lit(i)) for i, p in enumerate(picked)])
    rows = rows.withColumn(f"{at}_turn", F.row_number().over(Window.partitionBy(f"{at}_place").orderBy(at)))
    first = rows.orderBy(f"{at}_turn", f"{at}_place").limit(n)
    return first.withColumn("turn", F.row_number().over(Window.orderBy(f"{at}_turn", f"{at}_place"))).select(*[c for c in columns if c != "turn"], "turn")


def _seeded(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, str]:
    at = helper(df, "_at")
    return df.withColumn(at, F.concat(seeded_order(seed, key), F.lit(":"), F.col(key).cast("string"))), at


def few_shot(df: DataFrame, labels: list[str], n: int, key: str, text: str = "text", label: str = "label", seed: int = 4242) -> DataFrame:
    """``n`` short examples, round-robin over the labels, no text twice.  Of each label at most ``n`` rows are ranked
    further, taken by a seeded top-k."""
    rows, at = _seeded(_short(df, text, n), key, seed)
    short = drop_exact_duplicates(rows, [text], at)
    picked = [short.where(F.lower(F.col(label).cast("string")) == value.lower()).orderBy(at).limit(n) for value in labels]
    return _round_robin(picked, n, at, df.columns)


def few_shot_distinct(df: DataFrame, n: int, key: str, column: str = "text", short: bool = False, seed: int = 4242) -> DataFrame:
    """``n`` examples of different ``column``, and ``turn``: the text of text-to-text tasks, or the context of questions (``short``)."""
    rows, at = _seeded(_short(df, column, n) if short else df, key, seed)
    first = drop_exact_duplicates(rows, [column], at).orderBy(at).limit(n)
    return first.withColumn("turn", F.row_number().over(Window.orderBy(at))).select(*[c for c in df.columns if c != "turn"], "turn")


def few_shot_tokens(df: DataFrame, labels: list[str], n: int, key: str, tokens: str = "tokens", tags: str = "labels", seed: int = 4242) -> DataFrame:
    """``n`` examples, in turn one for each ``b-`` label that holds it, no token list twice, and ``turn``.

    A row that is taken for one label is not there for the next.  Only the first ``n`` rows by seeded order of each label
    can be taken, so these few go to the driver; labels that no row is left for are passed over.
    """
    starts = [x.lower() for x in labels if x.lower().startswith("b-")]
    rows, at = _seeded(df, key, seed)
    rows = drop_exact_duplicates(rows, [tokens], at)
    holds = lambda x: F.exists(F.col(tags), lambda t: F.lower(t) == x)
    # A label's rows may be taken by n - 1 earlier turns of others.
    lists = [[r[0] for r in rows.where(holds(x)).orderBy(at).select(at).limit(n).collect()] for x in starts]
    taken: list[str] = []
    while len(taken) < n and any(x not in taken for own in lists for x in own):
        for own in lists:
            first = next((x for x in own if x not in taken), None)
            if first is not None and len(taken) < n:
                taken.append(first)
    if not taken:
        return df.limit(0).withColumn("turn", F.lit(0))
    turn = F.array_position(F.array(*map(F.lit, taken)), F.col(at)).cast("int")
    return rows.where(F.col(at).isin(*taken)).withColumn("turn", turn).select(*[c for c in df.columns if c != "turn"], "turn")


def validation_as_test(splits: dict[str, DataFrame], test_wanted: bool) -> dict[str, DataFrame]:
    """The splits with validation rows in place of the test rows, unless the test split itself is wanted."""
    return splits if test_wanted or "val" not in splits else {**splits, "test": splits["val"]}


def ends_with(df: DataFrame, column: str, suffix: str, keep: bool = True) -> DataFrame:
    hit = F.col(column).endswith(suffix)
    return df.where(hit if keep else ~hit)


def labelled_union(parts: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """All rows of the parts, repeated ones too, each with its part's name as label."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def with_corruptions(df: DataFrame, text: str, corruptions: str, kinds: tuple[str, str] = ("correct", "incorrect")) -> DataFrame:
    """``text`` and ``label``: every text as it is, and a row for each of its corrupted forms (an array of texts)."""
    good = df.select(F.col(text).alias("text"))
    bad = df.select(F.explode(corruptions).alias("text"))
    return labelled_union({kinds[0]: good, kinds[1]: bad})


def bias_indices(answers: Column, stereotype: Column, renamed: dict[str, list[str]]) -> Column:
    """``stereo_idx``, ``counter_idx`` and ``unknown_idx`` of three answers (array of ``number``, ``tag``).

    The stereotype's tag may go by other names (``renamed``: tag in lower case, without blanks, to those tried in order);
    all are null where no answer has it.
    """
    by_tag = F.map_from_entries(F.transform(answers, lambda a: F.struct(a["tag"], a["number"])))
    tag = F.replace(stereotype, F.lit(" "), F.lit(""))
    wanted = tag
    for name, others in renamed.items():
        for other in reversed(others):
            wanted = F.when((F.lower(tag) == name) & F.map_contains_key(by_tag, other), F.lit(other)).otherwise(wanted)
    stereo, unknown = F.try_element_at(by_tag, wanted), F.try_element_at(by_tag, F.lit("unknown"))
    counter = F.array_min(F.array_except(F.array(*map(F.lit, range(3))), F.array(stereo, unknown)))
    return F.when(stereo.isNotNull(), F.struct(stereo.alias("stereo_idx"), counter.alias("counter_idx"), unknown.alias("unknown_idx")))


def prompt_parts(prompt: Column, lines: int = 6) -> Column:
    """``instruction`` (the first two lines), ``option_a`` and ``option_b`` (the next two, without ``Option A:``) of a prompt.

    A prompt of another number of lines fails the job.
    """
    parts = F.split(prompt, "\n")
    option = lambda i, letter: F.trim(F.regexp_replace(F.get(parts, i), rf"[^ ]+ {letter}: ?", ""))
    checked = F.when(F.size(parts) == lines, F.trim(F.concat_ws(" ", F.get(parts, 0), F.get(parts, 1)))).otherwise(F.raise_error(F.lit(f"a prompt has not {lines} lines")))
    return F.struct(checked.alias("instruction"), option(2, "A").alias("option_a"), option(3, "B").alias("option_b"))


def tokens_with_offsets(text: Column) -> Column:
    """Words and single marks with the place at which each starts: array of ``token``, ``start``, ``end``.

    Everything between two tokens is white space, so a token starts where the text without the white space before it goes on.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s*(?:\w+|[^\w\s])"), F.lit(0))
    at = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        token = F.regexp_replace(piece, r"(?U)^\s+", "")
        end = a["end"] + F.length(piece)
        return F.struct(end.alias("end"), F.concat(a["out"], F.array(F.struct(token.alias("token"), (end - F.length(token)).alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pieces, at, step, lambda a: a["out"])


def with_answers(df: DataFrame, cache: DataFrame, prompt: str, into: str = "answer") -> DataFrame:
    """``df`` with a model's cached answer to its prompt (``cache``: ``prompt``, ``answer``; the last of several), or null."""
    key = helper(df, "_prompt")
    known = cache.groupBy(F.col("prompt").alias(key)).agg(F.max("answer").alias(into))
    return df.join(known, F.col(prompt) == F.col(key), "left").drop(key)


def bootstrap_indices(spark, n: int, iterations: int, seed: int = 4242) -> DataFrame:
    """``iteration``, ``slot``, ``index``: ``n`` draws with replacement for each iteration, to join by index."""
    rows = spark.range(n).withColumnRenamed("id", "slot").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    return rows.select("iteration", "slot", F.pmod(F.xxhash64(F.lit(seed), "iteration", "slot"), F.lit(n)).alias("index"))


def without_overlap(splits: dict[str, DataFrame], text: str = "text") -> dict[str, DataFrame]:
    """Rows whose text stands in a split of higher priority (train, val, test) go."""
    out: dict[str, DataFrame] = {}
    for name in [s for s in SPLITS if s in splits]:
        rows = splits[name]
        for earlier in out:
            rows = rows.join(splits[earlier].select(text).distinct(), text, "left_anti")
        out[name] = rows.select(splits[name].columns)
    return out


def first_split(df: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """The same for one table with a split column."""
    priority = F.array_position(F.array(*map(F.lit, SPLITS)), F.col(split))
    name = helper(df, "_least")
    least = df.groupBy(text).agg(F.min(priority).alias(name))
    return df.join(least, text).where(priority == F.col(name)).select(*df.columns)


def value_counts(df: DataFrame, column: str, least: int = 1) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def frequent_values(df: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose value occurs ``least`` times or more."""
    return df.join(value_counts(df, column, least).select(column), column, "left_semi")


def grouped_lists(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(f"{value}s"))


def merged_ternary(a: Column, b: Column) -> Column:
    """Two annotators' labels of -1, 0, 1 as a word: one missing, the other; equal, either; adjacent, the one that is
    not neutral; opposite or both missing, null."""
    number = F.when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b)).when(F.abs(a - b) == 1, a + b)
    return F.get(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), (number + 1).cast("int"))


def answer_starts(answers: Column, context: Column) -> Column:
    """Answers that stand in the context, each with its first place from 0."""
    found = F.transform(answers, lambda a: F.struct(a.alias("text"), (F.call_function("locate", a, context) - 1).alias("answer_start")))
    return F.filter(found, lambda x: x["answer_start"] >= 0)


def runs_to_bio(flags: Column, mark: str = "F", kind: str = "ERR") -> Column:
    """Runs of a mark as ``B-`` and ``I-`` tags, the rest as ``O``."""
    return F.transform(flags, lambda x, i: F.when(x != mark, "O").when((i > 0) & (F.get(flags, i - 1) == mark), f"I-{kind}").otherwise(f"B-{kind}"))


def marked_runs(df: DataFrame, tokens: str, flags: str, mark: str = "F", kind: str = "ERR", into: str = "labels") -> DataFrame:
    """``df`` with the flags as tags, without rows whose tokens and flags are not as many."""
    return df.where(F.size(tokens) == F.size(flags)).withColumn(into, runs_to_bio(F.col(flags), mark, kind))


def spans_to_bio(starts: Column, ends: Column, entities: Column) -> Column:
    """Tags of tokens from entities (``start``, ``end``, ``label``) that contain them by character."""
    def tag(start: Column, i: Column) -> Column:
        inside = F.filter(entities, lambda e: (e["start"] <= start) & (F.get(ends, i) <= e["end"]))
        e = F.get(inside, 0)
        return F.when(F.size(inside) == 0, "O").otherwise(F.concat(F.when(e["start"] == start, "B-").otherwise("I-"), e["label"]))

    return F.transform(starts, tag)


def normalised_questions(df: DataFrame, question: str, order: str) -> DataFrame:
    """String columns without white space at their ends, the question without final periods, and each question once."""
    text = {f.name: F.btrim(f.name, F.lit(" \t\n\x0b\f\r")) for f in df.schema if f.dataType.typeName() == "string"}
    text[question] = F.regexp_replace(text[question], r"\.+\z", "")
    return drop_exact_duplicates(df.withColumns(text), [question], order)


def regrouped_choices(df: DataFrame, question: str, choice: str, order: str, label: str) -> DataFrame:
    """Flat (question, choice) rows as nested ones; questions with another number of choices than most are an error."""
    nested = df.groupBy(question).agg(F.sort_array(F.collect_list(F.struct(order, choice, label))).alias("options"))
    width = nested.groupBy(F.size("options").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    checked = nested.join(F.broadcast(width))
    return checked.select(question, F.when(F.size("options") == F.col("n"), F.col("options")).otherwise(F.raise_error(F.lit("questions differ in their number of choices"))).alias("options"))


def windows(df: DataFrame, tokens: str, length: int | Column, stride: int) -> DataFrame:
    """Overlapping windows of a token array: ``window``, ``start``; consecutive ones share ``stride`` tokens."""
    step = length - stride
    n = F.greatest(F.size(tokens) - length, F.lit(0))
    starts = F.sequence(F.lit(0), F.ceil(n / step).cast("int") * step, F.lit(step))
    return df.withColumn("start", F.explode(starts)).withColumn("window", F.slice(tokens, F.col("start") + 1, length))


def first_piece_labels(words: Column, pieces: Column, labels: Column) -> Column:
    """A label for each piece: the word's for its first piece, -100 for the others and for pieces of no word."""
    return F.transform(pieces, lambda w, i: F.when(w.isNull() | ((i > 0) & w.eqNullSafe(F.get(pieces, i - 1))), -100).otherwise(F.get(labels, w)))
