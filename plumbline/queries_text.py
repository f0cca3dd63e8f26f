"""Curation, labels, tags and display texts on the driver's tables, with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.functions import labels as L
from plumbline.functions import text as T
from plumbline.functions.hashing import draw_sql
from plumbline.operators import curation, planning, serving
from plumbline.session import scratch_folder
from plumbline.sources import files, store


def _docs(spark, d, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select(*columns)


@query(r"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '-' ELSE printf('%.2f', p_retailprice) || ' ± ' || printf('%.2f', CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size / 4.0 END) END AS score,
    CASE WHEN p_size % 3 = 0 THEN '✓' WHEN p_size % 3 = 1 THEN '✗' ELSE '?' END AS tick, CASE p_size % 4 WHEN 0 THEN '🧠' WHEN 1 THEN '📝' WHEN 2 THEN '🤔' ELSE '🔍' END AS mark,
    CASE WHEN p_size % 4 = 3 THEN 'N/A' WHEN p_size % 3 = 2 THEN '?' ELSE p_size::VARCHAR END AS size, CASE WHEN p_size < 10 THEN p_size::VARCHAR WHEN p_size < 20 THEN regexp_replace(printf('%.1f', p_size * 1003 / 1e3), '\.0$', '') || 'K' ELSE regexp_replace(printf('%.1f', p_size * 1003001 / 1e6), '\.0$', '') || 'M' END AS compact,
    CASE WHEN p_size < 5 THEN 'tiny' WHEN p_size < 20 THEN 'small' ELSE 'large' END AS bucket, CASE WHEN p_size < 5 THEN 0 WHEN p_size < 20 THEN 1 ELSE 2 END AS bucket_order, CASE WHEN p_size % 7 = 0 THEN 'api' WHEN p_size % 4 = 0 THEN 'base_decoder' WHEN p_size % 4 = 1 THEN 'instruction_tuned_decoder' WHEN p_size % 4 = 2 THEN 'reasoning_decoder' ELSE 'encoder' END AS kind, CASE WHEN p_size % 7 = 0 THEN 'api' WHEN p_size % 4 = 3 THEN 'encoder' WHEN p_size < 2 THEN 'tiny' WHEN p_size < 10 THEN 'small' WHEN p_size < 40 THEN 'medium' ELSE 'large' END AS listed_as,
    CASE p_size % 3 WHEN 0 THEN quote || p_brand || quote ELSE quote || p_brand || quote || ', ' || quote || p_type || quote || ' and ' || quote || 'x' || quote END AS listed FROM part, (SELECT chr(39) AS quote)""")
def board_cells(spark, d):
    """What a board shows of scores, flags, types, sizes and labels."""
    n = F.col("p_size")
    kind = F.when(n % 4 == 0, "base").when(n % 4 == 1, "instruction_tuned").when(n % 4 == 2, "reasoning")
    bounds = {"tiny": 5, "small": 20}
    many = F.when(n < 10, n).when(n < 20, n * 1003).otherwise(n * 1003001).cast("double")
    return table(spark, d, "part").select(
        "p_partkey", T.score_text(F.when(n % 5 > 0, F.col("p_retailprice")), F.when(n % 3 > 0, n / 4)).alias("score"), T.tick(F.when(n % 3 < 2, n % 3 == 0)).alias("tick"), T.type_mark(kind).alias("mark"),
        T.or_not_applicable(F.when(n % 3 != 2, n), n % 4 != 3).alias("size"), T.compact_number(many).alias("compact"), T.size_bucket(n, bounds).alias("bucket"), T.size_order(n, bounds).alias("bucket_order"),
        T.model_type(kind, n % 7 == 0).alias("kind"), T.listed_bucket(T.model_type(kind, n % 7 == 0), n * 1e9).alias("listed_as"), T.listed(F.when(n % 3 == 0, F.array("p_brand")).otherwise(F.array("p_brand", "p_type", F.lit("x"))), "and").alias("listed"),
    )


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_acctbal::VARCHAR || ' ± 1.00' END AS shown, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE s_acctbal::VARCHAR || ' ± 1.00' END AS sort, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::DOUBLE ELSE s_acctbal END AS number, s_name LIKE '%#%' OR TRUE AS is_text FROM supplier")
def parsed_cells(spark, d):
    """Cells with markup and a hidden sort key."""
    k = F.col("s_suppkey")
    value = F.when(k % 2 == 0, F.concat(F.lit("<b>"), "s_name", F.lit("</b>@@"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit(" <i>"), F.col("s_acctbal").cast("string"), F.lit("</i> ± 1.00")))
    cell = T.cell(value)
    return table(spark, d, "supplier").select("s_suppkey", cell["shown"].alias("shown"), cell["sort"].alias("sort"), cell["number"].alias("number"), cell["shown"].isNotNull().alias("is_text"))


@query("""SELECT doc_id, CASE WHEN p < 0 THEN substr(text, 1, 140) ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(text, s + 1, e - s) || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS snippet
FROM (SELECT *, greatest(p - 50, 0) AS s, least(length(text), p + length(term) + 90) AS e FROM (SELECT doc_id, text, term, strpos(lower(text), term) - 1 AS p FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE 'mentre' END AS term FROM documents)))""")
def search_snippets(spark, d):
    """All documents, searched for one of two terms; many do not hold theirs."""
    term = F.when(F.col("doc_id") % 2 == 0, "the").otherwise("mentre")
    return _docs(spark, d, "doc_id", "text").select("doc_id", T.snippet(F.col("text"), term).alias("snippet"))


@query("""SELECT item_id, text || chr(10) || 'more' AS question, 'first ' || item_id || '|second' AS choices, 'second' AS chosen, 'a,b' AS letters FROM benchmark""")
def parsed_prompts(spark, d):
    """Prompts taken apart: question, final options, the text of an answer's letter and the letters named."""
    prompt = F.concat("text", F.lit("\nmore\nOptions:\na. first "), F.col("item_id").cast("string"), F.lit("\nb.  second"))
    parts = L.question_and_choices(prompt)
    return table(spark, d, "benchmark").select("item_id", parts["question"].alias("question"), F.array_join(parts["choices"], "|").alias("choices"), L.choice_text(F.lit("B"), parts["choices"]).alias("chosen"), F.array_join(T.choices_named(F.regexp_extract(prompt, r"Options:[\s\S]*", 0), ["a", "b", "c"]), ",").alias("letters"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS label FROM events")
def json_in_text(spark, d):
    """The first flat object of a text, strict or with single quotes and bare names."""
    loose = F.concat(F.lit("Sure: {label: '"), "event_type", F.lit("'} {x: 1}"))
    return table(spark, d, "events").select("event_id", T.json_object(F.concat(F.lit("It is "), "props", F.lit(".")))["k"].alias("k"), T.json_object(loose)["label"].alias("label"))


@query("SELECT item_id, regexp_replace(text, '[\\s`*_]+$', '') AS model, CASE WHEN item_id % 2 = 0 THEN 'Nordic' ELSE 'Baltic,Nordic' END AS groups, 'ValueError: ' || item_id AS error, 2 AS n_lines FROM benchmark WHERE regexp_matches(text, '^[A-Za-z0-9][^\\n]*$')")
def parsed_requests(spark, d):
    """Request bodies: the model under its heading, the ticked groups, and the last error of a log without its noise."""
    item = F.col("item_id").cast("string")
    body = F.concat(F.lit("### Model ID\n\n`"), "text", F.lit("`\n- ["), F.when(F.col("item_id") % 2 == 0, " ").otherwise("x"), F.lit("] Baltic\n- [X] Nordic"))
    log = F.concat(F.lit("Traceback (most recent call last):\n  File a\nKeyError: 1\nwarn: noise\n\nTraceback (most recent call last):\n  File b\nValueError: "), item, F.lit("\nend"))
    rows = table(spark, d, "benchmark").where(F.col("text").rlike(r"^[A-Za-z0-9][^\n]*$"))
    last = F.element_at(F.split(T.last_traceback(log), "\n"), -1)
    return rows.select("item_id", T.issue_model_id(F.lit("[MODEL EVALUATION REQUEST] x/y"), body).alias("model"), F.array_join(T.ticked(body, ["Baltic", "Nordic"]), ",").alias("groups"), last.alias("error"), (F.size(T.telling_lines(log, ["noise", "File", "Traceback", "KeyError"]))).alias("n_lines"))


@query("SELECT item_id, '<T>' || substr(text, 1, 5) || 'x</T>' || substr(text, 6) AS repaired, 'left' || substr(text, 1, 5) || 'x' || substr(text, 6) AS bare, 4 AS span_start, 10 AS span_end FROM benchmark")
def repaired_tags(spark, d):
    """Nested, glued, stray and open tags set right; then spans from tags."""
    broken = F.concat(F.lit("</T><T<T>>"), F.substring("text", 1, 5), F.lit("<T>x</T></T></T>"), F.substr("text", F.lit(6)), F.lit("</T>"))
    spans = L.tagged_to_spans(F.concat(F.lit("left"), L.repaired_tags(broken, "T")), "T")
    return table(spark, d, "benchmark").select("item_id", L.repaired_tags(broken, "T").alias("repaired"), spans["text"].alias("bare"), spans["spans"][0]["start"].alias("span_start"), spans["spans"][0]["end"].alias("span_end"))


@query(r"""SELECT item_id, 'Start|B-PER|I-PER|O|B-MISC|O' AS first_labels, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')) + 6 AS n_tokens, 'Start Mary Ann .|went|home !' AS sentences FROM benchmark""")
def marked_entities(spark, d):
    """Documents marked with tags as tokens with labels, and as sentences that part no entity."""
    marked = F.concat(F.lit("Start <WHO X='1'>Mary Ann</WHO> . <OTHER>went</OTHER> home "), "text")
    tokens = L.entity_tags(marked, {"WHO": "PER"})
    head = L.entity_tags(F.lit("Start <WHO>Mary Ann .</WHO> went"), {"WHO": "PER"})
    joined = lambda s: F.array_join(F.transform(s, lambda t: t["token"]), " ")
    sentences = F.array_join(F.concat(F.transform(L.sentences_of(head), joined), F.transform(L.sentences_of(L.entity_tags(F.lit("home !"), {})), joined)), "|")
    labels = F.concat_ws("|", tokens[0]["token"], F.array_join(F.transform(F.slice(tokens, 2, 5), lambda t: t["label"]), "|"))
    return table(spark, d, "benchmark").select("item_id", labels.alias("first_labels"), F.size(tokens).cast("long").alias("n_tokens"), sentences.alias("sentences"))


@query(r"""WITH t AS (SELECT item_id, text, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]') AS w FROM benchmark)
    SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS tokens, TRUE AS offsets_right FROM t""")
def tokens_with_offsets(spark, d):
    tokens = curation.tokens_with_offsets(F.col("text"))
    right = F.forall(tokens, lambda t: F.substr("text", t["start"] + 1, t["end"] - t["start"]) == t["token"])
    return table(spark, d, "benchmark").select("item_id", F.size(tokens).cast("long").alias("n"), F.array_join(F.transform(tokens, lambda t: t["token"]), " ").alias("tokens"), right.alias("offsets_right"))


_FLAGS = "list_transform(range(0, 6), lambda i: CASE WHEN (item_id // (1 << i)) % 2 = 1 THEN 'F' ELSE 'R' END)"


@query(f"""WITH f AS (SELECT item_id, {_FLAGS} AS flags FROM benchmark WHERE item_id % 3 > 0)
    SELECT item_id, array_to_string(list_transform(flags, lambda x, i: CASE WHEN x = 'R' THEN 'O' WHEN i > 1 AND flags[i - 1] = 'F' THEN 'I-ERR' ELSE 'B-ERR' END), ' ') AS labels,
    array_to_string(list_transform(flags, lambda x, i: CASE WHEN x = 'R' THEN 'o' WHEN i > 1 AND flags[i - 1] = 'F' THEN 'i-misc' ELSE 'b-misc' END), ' ') AS known, array_to_string(list_transform(flags, lambda x: CASE x WHEN 'F' THEN 'wrong' ELSE x END), ' ') AS mapped, 'B-X I-X O O B-Y O' AS spans FROM f""")
def tag_sequences(spark, d):
    """Runs of marks as tags, unknown kinds as misc, labels mapped with a default, and tags from character spans."""
    flags = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(F.floor(F.col("item_id") / F.pow(F.lit(2.0), i)) % 2 == 1, "F").otherwise("R"))
    rows = table(spark, d, "benchmark").withColumn("flags", flags).withColumn("tokens", F.slice("flags", 1, F.when(F.col("item_id") % 3 == 0, 5).otherwise(6)))
    starts, ends = F.array(*[F.lit(4 * i) for i in range(6)]), F.array(*[F.lit(4 * i + 3) for i in range(6)])
    entities = F.array(F.struct(F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit("X").alias("label")), F.struct(F.lit(16).alias("start"), F.lit(19).alias("end"), F.lit("Y").alias("label")))
    rows = curation.marked_runs(rows, "tokens", "flags")
    return rows.select("item_id", F.array_join("labels", " ").alias("labels"), F.array_join(L.known_tags(F.col("labels"), ["per", "misc"]), " ").alias("known"), F.array_join(curation.mapped_array("flags", {"F": "wrong"}), " ").alias("mapped"), F.array_join(curation.spans_to_bio(starts, ends, entities), " ").alias("spans"))


@query("SELECT doc_id, strpos(text, 'the') - 1 AS first_start FROM documents WHERE strpos(text, 'the') > 0")
def answer_starts(spark, d):
    """Answers found in their context with their start; those not in it are left out, and so are rows without any."""
    answers = F.array(F.lit("the"), F.lit("\x01never"))
    rows = _docs(spark, d, "doc_id", "text").withColumn("found", curation.answer_starts(answers, F.col("text")))
    rows = rows.select("doc_id", F.struct(F.transform("found", lambda x: x["text"]).alias("text"), F.transform("found", lambda x: x["answer_start"]).alias("answer_start")).alias("answers"))
    return curation.answerable(rows).select("doc_id", F.col("answers.answer_start")[0].cast("long").alias("first_start"))


@query(r"SELECT question, min(doc_id) AS doc_id FROM (SELECT doc_id, regexp_replace(trim(substr(text, 1, 12), e' \t\n\x0b\x0c\r'), '\.+$', '') AS question FROM documents) GROUP BY question")
def distinct_questions(spark, d):
    """Questions here are the first twelve characters of texts, with blanks put around them."""
    rows = _docs(spark, d, "doc_id", F.concat(F.lit(" "), F.substring("text", 1, 12), F.lit("\n ")).alias("question"))
    return curation.normalised_questions(rows, "question", "doc_id")


@query("SELECT conv_id FROM (SELECT conv_id, list(text) AS t FROM conversations GROUP BY conv_id) WHERE len(list_filter(t, lambda x: length(x) < 10 OR length(x) > 400)) = 0 AND len(list_filter(t, lambda x: list_max(map_values(list_histogram(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')))) > 3)) = 0")
def fitting_options(spark, d):
    """Conversations whose turns, taken as options, are all of fitting length and none repetitive."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("options"))
    return curation.options_between(rows, "options", 10, 400, 3).select("conv_id")


@query("SELECT item_id, array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN i IN (0, 5) THEN -100 WHEN i = 1 THEN item_id WHEN i = 3 THEN item_id + 1 ELSE -100 END), ' ') AS labels FROM benchmark")
def piece_labels(spark, d):
    """A word's label for its first piece only: pieces of the words 0, 0, 1, 1 between two of none."""
    pieces = F.array(*[F.lit(x).cast("int") for x in (None, 0, 0, 1, 1, None)])
    labels = F.array(F.col("item_id").cast("int"), (F.col("item_id") + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(curation.first_piece_labels(F.array(), pieces, labels), lambda x: x.cast("string")), " ").alias("labels"))


@query("SELECT n_name, string_agg(s, ',' ORDER BY o) AS options FROM (SELECT n_name, unnest([0, 1, 2]) AS o, unnest([n_regionkey::VARCHAR, 'x', 'y']) AS s FROM nation) GROUP BY n_name")
def nested_choices(spark, d):
    rows = table(spark, d, "nation").select("n_name", F.posexplode(F.array(F.col("n_regionkey").cast("string"), F.lit("x"), F.lit("y"))).alias("o", "choice")).withColumn("label", F.col("o") == 1)
    return curation.regrouped_choices(rows, "n_name", "choice", "o", "label").select("n_name", F.array_join(F.transform("options", lambda x: x["choice"]), ",").alias("options"))


@query("SELECT doc_id FROM documents WHERE length(text) > 0 AND lang = 'en' AND text NOT LIKE '%.' ORDER BY doc_id LIMIT 70")
def first_unended(spark, d):
    """The first rows by key of those that are not empty and do not end with a period."""
    rows = curation.ends_with(curation.non_empty(table(spark, d, "documents").where("lang = 'en'"), "text"), "text", ".", keep=False)
    return curation.head(rows, 70, "doc_id").select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('4242:' || doc_id), doc_id) - 1 AS place FROM documents")
def shuffled_rows(spark, d):
    """Rows in seeded order; the place shows it."""
    from plumbline.functions.hashing import seeded_order

    rows = curation.shuffled(_docs(spark, d, "doc_id"), "doc_id").withColumn("at", F.struct(seeded_order(4242, "doc_id").alias("h"), "doc_id"))
    return curation.dense_index(rows, "at", "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("""WITH n AS (SELECT count(*) AS n FROM labels), s AS (SELECT CASE WHEN n >= 256 THEN 128 WHEN n >= 192 THEN 64 ELSE 16 END AS test, CASE WHEN n >= 192 THEN 32 ELSE 16 END AS val, CASE WHEN n >= 192 THEN 96 ELSE 32 END AS train, n FROM n),
    sizes AS (SELECT CASE WHEN n >= 256 THEN 96 WHEN n >= 192 THEN 96 ELSE least(64, n) END AS train, CASE WHEN n >= 192 THEN 32 ELSE least(32, greatest(0, n - 64)) END AS val, CASE WHEN n >= 256 THEN 128 WHEN n >= 192 THEN 64 ELSE greatest(0, n - 96) END AS test FROM n)
    SELECT doc_id, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + val THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('4242:' || doc_id), doc_id) AS rn FROM labels), sizes WHERE rn <= train + val + test""")
def adaptive_split(spark, d):
    """Splits as large as the labelled rows allow."""
    rows = table(spark, d, "labels").select("doc_id")
    return curation.fixed_split(rows, "doc_id", curation.adaptive_sizes(rows.count(), test=128, val=32, train=96, least_test=64))


@query("SELECT doc_id, quality, CASE WHEN rn <= 10 THEN 'train' ELSE 'val' END AS split FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('4242:' || doc_id), doc_id) AS rn FROM labels) WHERE rn <= 15")
def balanced_splits(spark, d):
    """Disjoint train and val rows, as many of each label."""
    return curation.balanced_splits(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", {"train": 20, "val": 10})


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'val' ELSE 'other' END AS origin, n_chars FROM documents WHERE doc_id % 10 = 7")
def validation_rows_as_test(spark, d):
    """What is evaluated where the test split is not asked for; every split has the columns."""
    docs = table(spark, d, "documents")
    splits = {"val": docs.where("doc_id % 10 = 7").withColumn("origin", F.lit("val")), "test": docs.where("doc_id % 10 > 7").withColumn("origin", F.lit("test"))}
    return curation.validation_as_test(curation.require_in_splits(splits, ["doc_id", "n_chars"]), False)["test"].select("doc_id", "origin", "n_chars")


@query("SELECT iteration, slot, n_chars > 0 AS drawn FROM (SELECT unnest(range(0, 3)) AS iteration), (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS slot, greatest(n_chars, 1) AS n_chars FROM documents)")
def bootstrap_rows(spark, d):
    """Draws with replacement: as many rows as there are, three times over; which they are rests on a seeded hash."""
    docs = curation.dense_index(_docs(spark, d, "doc_id", "n_chars"), "doc_id")
    draws = curation.bootstrap_indices(spark, docs.count(), 3)
    return draws.join(docs.withColumn("index", F.col("index").cast("long")), "index").select(F.col("iteration").cast("long").alias("iteration"), "slot", (F.greatest("n_chars", F.lit(1)) > 0).alias("drawn"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY pos) AS turn FROM (SELECT doc_id, pos FROM (SELECT doc_id, md5('4242:' || doc_id) || ':' || doc_id AS pos, row_number() OVER (PARTITION BY text ORDER BY md5('4242:' || doc_id) || ':' || doc_id) AS first FROM documents) WHERE first = 1 ORDER BY pos LIMIT 12)""")
def few_shot_texts(spark, d):
    """Examples of a text-to-text task: of different texts."""
    return curation.few_shot_distinct(_docs(spark, d, "doc_id", "text"), 12, "doc_id").select("doc_id", F.col("turn").cast("long").alias("turn"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY pos) AS turn FROM (SELECT doc_id, pos FROM (SELECT doc_id, md5('4242:' || doc_id) || ':' || doc_id AS pos, row_number() OVER (PARTITION BY text ORDER BY md5('4242:' || doc_id) || ':' || doc_id) AS first FROM documents
    WHERE length(text) < (SELECT min(b) FROM (SELECT b FROM (SELECT unnest([512, 1024, 2048, 4096, 8192]) AS b), documents GROUP BY b HAVING count(*) FILTER (WHERE length(text) < b) >= 8))) WHERE first = 1 ORDER BY pos LIMIT 8)""")
def few_shot_contexts(spark, d):
    """Examples of a question task: short contexts, each once."""
    rows = _docs(spark, d, "doc_id", F.col("text").alias("context"))
    return curation.few_shot_distinct(rows, 8, "doc_id", "context", short=True).select("doc_id", F.col("turn").cast("long").alias("turn"))


@query("""WITH RECURSIVE rows AS (SELECT doc_id, md5('4242:' || doc_id) || ':' || doc_id AS pos, [CASE WHEN doc_id % 3 = 0 THEN 'B-per' ELSE 'o' END, CASE WHEN doc_id % 5 = 0 THEN 'b-LOC' ELSE 'o' END] AS tags, row_number() OVER (PARTITION BY text ORDER BY md5('4242:' || doc_id) || ':' || doc_id) AS first FROM documents),
    best AS (SELECT (SELECT list(pos ORDER BY pos) FROM rows WHERE first = 1 AND doc_id % 3 = 0) AS per, (SELECT list(pos ORDER BY pos) FROM rows WHERE first = 1 AND doc_id % 5 = 0) AS loc),
    picks AS (SELECT 0 AS turn, []::VARCHAR[] AS taken UNION ALL SELECT turn + 1, list_append(taken, list_filter(CASE WHEN turn % 2 = 0 THEN per ELSE loc END, lambda x: NOT list_contains(taken, x))[1]) FROM picks, best WHERE turn < 6)
    SELECT doc_id, list_position(taken, pos) AS turn FROM rows, (SELECT taken FROM picks WHERE turn = 6) WHERE list_contains(taken, pos)""")
def few_shot_tags(spark, d):
    """Examples of a token task: in turn one that has each kind of entity."""
    tags = F.array(F.when(F.col("doc_id") % 3 == 0, "B-per").otherwise("o"), F.when(F.col("doc_id") % 5 == 0, "b-LOC").otherwise("o"))
    rows = _docs(spark, d, "doc_id", F.array("text").alias("tokens"), tags.alias("labels"))
    return curation.few_shot_tokens(rows, ["B-PER", "I-PER", "b-loc"], 6, "doc_id").select("doc_id", F.col("turn").cast("long").alias("turn"))


_POS = "list_transform(w, lambda x: ['NOUN', 'VERB', 'DET', 'PRON', 'AUX', 'PUNCT'][length(x) % 6 + 1])"
_DELETE = "list_filter(range(0, len(w)), lambda i: t[i + 1] NOT IN ('DET', 'PUNCT') AND NOT (t[i + 1] = 'NOUN' AND (coalesce(t[i], '') = 'NOUN' AND i > 0 OR coalesce(t[i + 2], '') = 'NOUN')))"
_FLIP = "list_filter(range(0, len(w) - 1), lambda i: t[i + 1] <> 'PUNCT' AND t[i + 2] <> 'PUNCT' AND t[i + 1] <> t[i + 2] AND NOT (t[i + 1] IN ('AUX', 'PRON') AND t[i + 2] IN ('AUX', 'PRON')))"
_CASED = "CASE WHEN {at} = 0 AND {x} <> upper({x}) THEN {new} ELSE {x} END"


@query(rf"""WITH a AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), b AS (SELECT *, {_POS} AS t FROM a), c AS (SELECT *, {_DELETE} AS dels, {_FLIP} AS flips FROM b),
    e AS (SELECT *, dels[({draw_sql(4242, 'item_id')}) % greatest(len(dels), 1) + 1] AS dat, flips[({draw_sql(4243, 'item_id')}) % greatest(len(flips), 1) + 1] AS fat, (({draw_sql(4244, 'item_id')}) % 2 = 0 AND len(flips) > 0) OR len(dels) = 0 AS flip FROM c WHERE len(dels) + len(flips) > 0),
    f AS (SELECT item_id, 'correct' AS label, w AS words, 'none' AS kind FROM e UNION ALL SELECT item_id, 'incorrect', CASE WHEN flip THEN w[1:fat] || [{_CASED.format(at='fat', x='w[fat + 2]', new='upper(left(w[fat + 2], 1)) || lower(substr(w[fat + 2], 2))')}, {_CASED.format(at='fat', x='w[fat + 1]', new='lower(w[fat + 1])')}] || w[fat + 3:] ELSE w[1:dat] || w[dat + 2:] END, CASE WHEN flip THEN 'flip_neighbours' ELSE 'delete' END FROM e)
    SELECT item_id, label, kind, CASE WHEN len(regexp_extract_all(j, '"')) % 2 = 0 THEN regexp_replace(j, '" ([^"]*) "', '"\1"', 'g') ELSE j END AS text FROM (SELECT item_id, label, kind, regexp_replace(regexp_replace(array_to_string(words, ' '), ' ([.,;:?!)\]}}])', '\1', 'g'), '([(\[{{]) ', '\1', 'g') AS j FROM f)""")
def corrupted_sentences(spark, d):
    """Every sentence as it is and corrupted once, under the constraints of (made-up) parts of speech."""
    kinds = F.array(*map(F.lit, ["NOUN", "VERB", "DET", "PRON", "AUX", "PUNCT"]))
    rows = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("tokens"))
    rows = rows.withColumn("c", L.corrupted(F.col("tokens"), F.transform("tokens", lambda x: F.get(kinds, F.length(x) % 6)), F.col("item_id"))).where("c IS NOT NULL")
    parts = {"correct": rows.select("item_id", F.lit("none").alias("kind"), T.joined_tokens(F.col("tokens")).alias("text")), "incorrect": rows.select("item_id", "c.kind", T.joined_tokens(F.col("c.tokens")).alias("text"))}
    return curation.labelled_union(parts)


@query("SELECT text, 'correct' AS label FROM benchmark UNION ALL SELECT unnest([text || '!', 'no ' || text]), 'incorrect' FROM benchmark")
def exploded_corruptions(spark, d):
    rows = table(spark, d, "benchmark").select("text", F.array(F.concat("text", F.lit("!")), F.concat(F.lit("no "), "text")).alias("corrupted"))
    return curation.with_corruptions(rows, "text", "corrupted")


@query("SELECT doc_id, doc_id % 3 AS stereo_idx, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS counter_idx, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 2 END AS unknown_idx FROM documents")
def bias_indices(spark, d):
    """Places of the stereotype, its counterpart and ``unknown`` among three answers; the tag goes by another name."""
    k = (F.col("doc_id") % 3).cast("int")
    unknown = F.when(k == 2, 1).otherwise(2)
    tag = lambda i: F.when(k == i, "vrouw").when(unknown == i, "unknown").otherwise("man")
    answers = F.array(*[F.struct(F.lit(i).alias("number"), tag(i).alias("tag")) for i in range(3)])
    return _docs(spark, d, "doc_id", curation.bias_indices(answers, F.lit(" F"), {"f": ["vrouw", "meisje"]}).alias("b")).select("doc_id", "b.*")


@query("SELECT item_id, 'Fill _ in. ' || trim(text) AS instruction, 'left ' || item_id AS option_a, 'right' AS option_b FROM benchmark WHERE strpos(text, chr(10)) = 0")
def prompt_lines(spark, d):
    prompt = F.concat(F.lit("Fill _ in.\n"), "text", F.lit("\nOption A: left "), F.col("item_id").cast("string"), F.lit("\nOption B:right \nAnswer with A or B.\nAnswer:"))
    return table(spark, d, "benchmark").where(~F.contains("text", F.lit("\n"))).select("item_id", curation.prompt_parts(prompt).alias("p")).select("item_id", "p.*")


@query("SELECT doc_id, quality AS answer FROM documents LEFT JOIN (SELECT text AS t, max(quality)::VARCHAR AS quality FROM documents JOIN labels USING (doc_id) GROUP BY text) ON t = text")
def cached_answers(spark, d):
    """A model's cached answers by prompt."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("question"))
    cache = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("question").alias("prompt"), F.col("quality").cast("string").alias("answer"))
    return curation.with_answers(docs, cache, "question").select("doc_id", "answer")


@query("SELECT n_regionkey AS k, n_name AS name FROM nation UNION ALL SELECT n_regionkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all_rows(spark, d):
    one = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    return planning.union_of(one, one, table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 1 FROM region")
def union_distinct_keys(spark, d):
    return planning.union_of(table(spark, d, "nation").select(F.col("n_regionkey").alias("k")), table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("k")), distinct=True)


@query("SELECT unnest(['added', 'removed']) AS change, unnest(['doc_id,lang,source', 'label,vec_id']) AS columns")
def schema_drift(spark, d):
    """Columns of documents that embeddings lack, and the other way round, but for the long ones."""
    added, removed = serving.schema_changes(table(spark, d, "embeddings").drop("embedding"), table(spark, d, "documents").drop("text", "n_chars"))
    return spark.createDataFrame([("added", ",".join(added)), ("removed", ",".join(removed))], "change string, columns string")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS language, n_chars AS length FROM documents")
def standard_columns(spark, d):
    """Columns under standard names, a column in the way dropped; languages mapped with a default."""
    rows = table(spark, d, "documents").withColumn("length", F.lit("in the way"))
    rows = curation.standardised(rows, {"n_chars": "length", "lang": "language"})
    return rows.select("doc_id", curation.mapped("language", {"en": "English", "de": "German"}, "other").alias("language"), "length")


@query("SELECT source, max(n_chars) AS longest, count(*) AS n FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 11) GROUP BY source")
def rows_of_frequent_sources(spark, d):
    rows = curation.frequent_values(table(spark, d, "documents"), "source", 11)
    return rows.groupBy("source").agg(F.max("n_chars").alias("longest"), F.count(F.lit(1)).alias("n"))


@query("""SELECT item_id, len(w) AS n FROM (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark) WHERE len(w) > 5 AND len(list_distinct(list_transform(w, lambda x: length(x)))) > 5 AND len(regexp_extract_all(text, '"')) % 2 = 0 AND NOT regexp_matches(w[1], '^[!-/:-@\\[-`{-~]') AND len(regexp_extract_all(text, '=')) <= 1""")
def eligible_sentences(spark, d):
    """Sentences with enough tokens and kinds (here word lengths), paired quotes and no mark at the front."""
    rows = table(spark, d, "benchmark").select("item_id", "text", F.split("text", " ").alias("tokens"), F.transform(F.split("text", " "), F.length).alias("tags"))
    return curation.eligible_sentences(rows, "tokens", "tags", "text").select("item_id", F.size("tokens").cast("long").alias("n"))


@query("SELECT doc_id, 'Read this.' || chr(10) || chr(10) || 'Text: ' || lang || chr(10) || 'Label: ' || source AS prompt FROM documents")
def filled_prompts(spark, d):
    filled = L.prompt("Read this.", "Text: {text}\nLabel: {label}", F.lit(None).cast("string"), {"text": F.col("lang"), "label": F.col("source")})
    return _docs(spark, d, "doc_id", filled.alias("prompt"))


@query("SELECT event_id, CASE WHEN NOT max(event_id % 37 = 0) OVER (PARTITION BY event_id // 10) THEN CASE WHEN event_type < 'd' THEN 'negative' ELSE 'positive' END END AS label FROM events")
def labels_from_logprobs(spark, d):
    """The label that each row's likeliest first token begins; a token that begins two makes its batch null."""
    first = F.when(F.col("event_id") % 37 == 0, "n").when(F.col("event_type") < "d", "neg").otherwise("pos")
    logprobs = F.array(F.struct(F.lit("x").alias("token"), F.lit(-0.1).alias("logprob")), F.struct(F.concat(F.lit(" "), first).alias("token"), F.lit(-0.5).alias("logprob")), F.struct(F.lit("neu").alias("token"), F.lit(-3.0).alias("logprob")))
    rows = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("batch"), logprobs.alias("logprobs"), "event_type")
    return L.labels_from_logprobs(rows, "logprobs", ["positive", "negative", "neutral"], ["batch"]).select("event_id", "label")


@query("""SELECT doc_id, 'Judge.' || chr(10) || chr(10) || (SELECT string_agg('T: ' || lang || chr(10) || 'L: ' || source, chr(10) || chr(10) ORDER BY doc_id) FROM documents WHERE doc_id < 3) || chr(10) || chr(10) || 'T: ' || lang || chr(10) || 'L:' AS prompt FROM documents""")
def few_shot_prompts(spark, d):
    """Prompts of a classification task: three examples and each row without its label."""
    rows = _docs(spark, d, "doc_id", F.col("lang").alias("text"), F.col("source").alias("label"))
    shots = rows.where("doc_id < 3").withColumn("turn", F.col("doc_id"))
    return L.prompts(rows, "sequence-classification", "Judge.", "T: {text}\nL: {label}", shots).select("doc_id", "prompt")


@query("SELECT CASE n_regionkey WHEN 0 THEN 'zero' ELSE n_regionkey::VARCHAR END AS region, n_name AS first_choice, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation")
def json_choices(spark, d):
    """Lines of JSON with lists and a JSON array of objects, joined; a value mapped, a list's first element taken."""
    lines, whole = _folder(spark, "ndjson"), _folder(spark, "array")
    nation = table(spark, d, "nation")
    nation.select("n_regionkey", F.array("n_name", F.lit("x")).alias("choices")).write.json(lines)
    nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.to_json(F.collect_list(F.struct("k", "n"))).alias("value")).coalesce(1).write.text(whole)
    rows = files.jsonl_records(spark, lines, strict=True, schema="n_regionkey string, choices array<string>")
    sizes = files.json_table(spark, whole, "k string, n long")
    return rows.join(sizes, F.col("n_regionkey") == F.col("k")).select(curation.mapped("n_regionkey", {"0": "zero"}, "same").alias("region"), F.element_at("choices", 1).alias("first_choice"), "n")


@query("SELECT 'org/m' || (user_id % 40) AS model, event_type AS dataset, max(event_id) AS newest FROM events GROUP BY ALL")
def streamed_records(spark, d):
    """Records that arrive as files in three runs of a stream, folded by identity: the newest version of each stays."""
    from plumbline.streaming import ingest

    inbox, store, checkpoint, folded = (_folder(spark, x) for x in ("inbox", "store", "checkpoint", "compacted"))
    name = F.concat(F.lit("org/m"), (F.col("user_id") % 40).cast("string"))
    event = F.struct(F.lit("0.2.1").alias("schema_version"), F.col("event_id").cast("string").alias("evaluation_id"), F.struct(name.alias("name")).alias("model_info"), F.struct(F.lit("any").alias("name"), F.concat(F.lit("15.0."), F.col("event_id").cast("string")).alias("version"), F.struct(F.col("event_type").alias("dataset")).alias("additional_details")).alias("eval_library"))
    for part in range(3):
        table(spark, d, "events").where(F.col("event_id") % 3 == part).select(event.alias("r")).select("r.*").write.mode("append").json(inbox)
        ingest.keep_newest(ingest.record_stream(spark, inbox), store, checkpoint).awaitTermination()
    ingest.compacted(spark, store, folded)
    rows = ingest.newest(spark, folded)
    return rows.select(F.col("model_info.name").alias("model"), F.col("eval_library.additional_details.dataset").alias("dataset"), F.col("evaluation_id").cast("long").alias("newest"))


# Files: each query writes what it reads to a new folder of the shared scratch space.


def _folder(spark, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, '0.2.1' AS version FROM customer")
def json_lines(spark, d):
    """Records written as JSON lines, two objects glued on each line and noise between, read back leniently."""
    path = _folder(spark, "lines")
    text = F.format_string('{"schema_version": "0.2.1", "evaluation_id": "%s", "model_info": {"name": "%s"}}', F.col("c_custkey").cast("string"), F.col("c_name"))
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("g"), text.alias("value")).groupBy("g").agg(F.collect_list("value").alias("v"))
    lines = rows.select(F.explode(F.array(F.array_join("v", ""), F.lit(""), F.lit("[1, 2]"), F.lit("noise"))).alias("value"))
    lines.write.text(path)
    return files.jsonl_records(spark, path).select(F.col("evaluation_id").alias("id"), F.col("model_info.name").alias("name"), F.col("schema_version").alias("version"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' 2' ELSE '' END AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def record_tree(spark, d):
    """Records in a store, a third of them replaced by new versions; read as a folder tree, then more of them appended and merged in order."""
    held, tree, lines, merged = (_folder(spark, x) for x in ("store", "tree", "lines", "merged"))
    record = lambda key, name: F.struct(F.lit("0.2.1").alias("schema_version"), key.alias("evaluation_id"), F.struct(name.alias("name")).alias("model_info"))
    for name in (F.col("n_name"), F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, " 2").otherwise(""))):
        nations = table(spark, d, "nation").select(record(F.col("n_nationkey").cast("string"), name).alias("r"))
        files.write_changed(nations.select("r.*"), held, "evaluation_id")
    # A file for each record, as the reader of trees wants them.
    store.read(spark, held).select(F.from_json("value", files.RECORD_SCHEMA).alias("r"), "key").select("r.*", "key").write.partitionBy("key").json(tree)
    regions = table(spark, d, "region").select(record(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.col("r_name")).alias("r")).select("r.*")
    files.append_results(regions.where("evaluation_id < 'r2'"), lines)
    files.append_results(regions.where("evaluation_id >= 'r2'"), lines)
    files.write_merged(planning.union_of(files.record_tree(spark, tree), files.jsonl_records(spark, lines, strict=True)).drop("path"), merged, ["evaluation_id"])
    return spark.read.json(merged).select(F.col("evaluation_id").alias("id"), F.col("model_info.name").alias("name"))


@query("""SELECT c_custkey::VARCHAR AS key, c_name AS name, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS balance FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 's' || s_suppkey, s_name, s_acctbal FROM supplier""")
def versioned_records(spark, d):
    """A store after three writes: all customers, then a third changed and a seventh removed, then suppliers added."""
    folder, k = _folder(spark, "store"), F.col("c_custkey")
    first = table(spark, d, "customer").select(k.cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), k)
    second = first.where(k % 7 != 0).withColumn("balance", F.col("balance") + F.when(k % 3 == 0, 1).otherwise(0))
    for rows in (first, second):
        store.write(store.changed(rows.drop("c_custkey"), folder, "key", remove_missing=True), folder)
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    store.write(store.changed(suppliers, folder, "key"), folder)
    return store.read(spark, folder).select(F.from_json("value", "key string, name string, balance double").alias("r")).select("r.*")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, 'a, \"b\"' AS note FROM nation")
def csv_splits(spark, d):
    """Local CSV files of two splits, with quotes and commas in them."""
    path = _folder(spark, "csv")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit('a, "b"').alias("note"), (F.col("n_nationkey") % 2).alias("odd"))
    for odd, split in ((0, "train"), (1, "test")):
        rows.where(F.col("odd") == odd).drop("odd").write.option("header", True).option("escape", '"').csv(f"{path}/{split}.csv")
    return files.csv_splits(spark, {s: f"{path}/{s}.csv" for s in ("train", "test")})


@query("SELECT r_name AS name, CASE WHEN r_regionkey < 2 THEN 'val' ELSE 'test' END AS split FROM region")
def hub_files(spark, d):
    """Parquet files named by their split in a configuration's folder; ``validation`` is renamed to ``val``."""
    path = _folder(spark, "hub")
    rows = table(spark, d, "region")
    for low, high, name in ((0, 2, "validation-00000-of-00001"), (2, 9, "test-00000-of-00001")):
        rows.where(f"r_regionkey >= {low} AND r_regionkey < {high}").coalesce(1).write.parquet(f"{path}/da/{name}.parquet")
    df = files.hub_table(spark, path, "da", {"validation": "val"})
    # Spark writes folders, so the split stands in the folder's name.
    split = files.split_of_file(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.parquet)/part", 1))
    renamed = files.find_split(["validation", "test"], "val")
    return df.select(F.col("r_name").alias("name"), F.when(split == renamed, "val").otherwise(split).alias("split"))


@query("SELECT item_id, text AS doc, 'a-b' AS token, 'X Z' AS tags FROM benchmark WHERE item_id % 2 = 0 AND regexp_matches(text, '^[^\\s].*[^\\s]$') AND strpos(text, chr(10)) = 0")
def treebank(spark, d):
    """Sentences of a treebank with Unix and Windows line ends; a range keeps its form and its first part's tag."""
    path = _folder(spark, "treebank")
    end = F.when(F.col("item_id") % 4 == 0, "\r\n").otherwise("\n")
    lines = F.array(F.lit("# comment"), F.concat(F.lit("# source = "), F.col("item_id").cast("string")), F.concat(F.lit("# text = "), "text"), F.lit("1-2\ta-b\t_\t_"), F.lit("1\ta\t_\tX"), F.lit("2\tb\t_\tY"), F.lit("3\tc\t_\tZ"))
    sentence = F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))
    rows = table(spark, d, "benchmark").where(r"item_id % 2 = 0 AND text RLIKE '^\\S.*\\S$' AND instr(text, '\n') = 0")
    rows.select(F.replace(sentence, F.lit("\n"), end).alias("value"), (F.col("item_id") % 4).alias("part")).repartition(2).write.option("lineSep", "\n").partitionBy("part").text(path)
    return files.conllu(spark, path).select(F.col("source").cast("long").alias("item_id"), "doc", F.col("tokens")[0].alias("token"), F.array_join("tags", " ").alias("tags"))


@query("SELECT s_name AS model, 'A' AS grp, 'score' AS col, printf('%.2f', s_acctbal) AS value FROM supplier UNION ALL SELECT s_name, 'A', 'margin', '1' FROM supplier UNION ALL SELECT s_name, 'B', 'x', s_nationkey::VARCHAR FROM supplier")
def board_file(spark, d):
    """A board written as CSV with two header rows and read back cell by cell; its simplified form and note beside it."""
    path = _folder(spark, "board")
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("c0"), F.format_string("%.2f", "s_acctbal").alias("c1"), F.lit("1").alias("c2"), F.col("s_nationkey").cast("string").alias("c3"))
    files.write_board_files(rows, path, ["c0", "c1"], {"made": "today"})
    heads = spark.createDataFrame([("", "~~~ A ~~~", "", "~~~ B ~~~"), ("model", "score", "margin", "x")], rows.schema)
    heads.coalesce(1).union(spark.read.option("header", True).schema(rows.schema).csv(f"{path}/board")).coalesce(1).write.csv(f"{path}/headed")
    cells = files.board_csv(spark, f"{path}/headed")
    names = cells.where("column = 'model'").select("row", F.col("value").alias("model"))
    return cells.where("column <> 'model'").join(names, "row").select("model", F.col("group").alias("grp"), F.col("column").alias("col"), "value")


@query("SELECT o_orderpriority AS split, count(*) AS n FROM orders GROUP BY 1")
def published_splits(spark, d):
    path = _folder(spark, "splits")
    files.write_splits(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 40 AS n_pieces, 'name:b' || s_suppkey AS second FROM supplier WHERE s_suppkey <= 20")
def catalogue_pieces(spark, d):
    """A catalogue in one long line, parted at each match."""
    rows = table(spark, d, "supplier").where("s_suppkey <= 20").select("s_suppkey", F.concat(F.lit("var x={"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("name:a"), i.cast("string"), F.lit("name:b"), F.col("s_suppkey").cast("string"))), ""), F.lit("}")).alias("line"))
    pieces = files.between_matches(F.col("line"), "name:")
    return rows.select(F.size(pieces).alias("n_pieces"), F.element_at(pieces, 2).alias("second"))


@query("SELECT TRUE AS same, FALSE AS other, count(*) AS n FROM supplier")
def snapshot_hashes(spark, d):
    """A content hash does not depend on order or partitioning, but on every row; the snapshot's rows are as they should be."""
    rows = table(spark, d, "supplier").withColumn("path", F.col("s_name"))
    one, two, three = files.content_hash(rows), files.content_hash(rows.orderBy(F.desc("s_suppkey")).repartition(3)), files.content_hash(rows.where("s_suppkey > 1"))
    files.checked_snapshot(rows, F.col("s_suppkey").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(one == two).alias("same"), F.lit(one == three).alias("other"), "n")
