"""Metrics, survey scores and baselines on the driver's tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, r6, table
from plumbline.functions import labels as L
from plumbline.functions.hashing import draw_sql
from plumbline.operators import constraints, language, metrics, sentences

_BAG = r"list_filter(string_split(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'), ' '), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


@query(f"""WITH rows AS (SELECT c.role, {_BAG.format('c.text')} AS p, {_BAG.format("r.text")} AS g FROM conversations c JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = 0),
    scored AS (SELECT role, p = g AS em, len(p) AS np, len(g) AS ng, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS same FROM rows)
    SELECT role, round(avg(CASE WHEN np = 0 OR ng = 0 THEN (np = ng)::INT ELSE 2.0 * same / (np + ng) END), 6) AS f1, round(avg(em::INT), 6) AS em FROM scored GROUP BY role""")
def answer_overlap(spark, d):
    """Each turn as an answer, against its conversation's first turn."""
    turns = table(spark, d, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.array("text").alias("answers"))
    rows = metrics.paired(turns.withColumnRenamed("text", "prediction"), first, ["conv_id"])
    return metrics.question_answering(rows, ["role"]).select("role", r6("f1").alias("f1"), r6("em").alias("em"))


_TAG = "list_transform({w}, lambda x, i: CASE WHEN ({n}) % 5 = 0 THEN 'b-per' WHEN ({n}) % 5 = 1 THEN 'i-per' WHEN ({n}) % 5 = 2 THEN 'b-misc' ELSE 'o' END)"
_CHUNKS = "(SELECT g, item_id, side, k, any_value(kind) AS kind, min(i) AS first, max(i) AS last FROM (SELECT *, sum(new::INT) OVER (PARTITION BY item_id, side ORDER BY i) AS k FROM (SELECT *, tag LIKE 'b-%' OR (tag LIKE 'i-%' AND kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY item_id, side ORDER BY i)) AS new FROM (SELECT *, CASE WHEN tag <> 'o' THEN substr(tag, 3) END AS kind FROM tags))) WHERE kind IS NOT NULL GROUP BY g, item_id, side, k)"


@query(f"""WITH words AS (SELECT item_id, item_id % 3 AS g, string_split(text, ' ') AS w FROM benchmark),
    tags AS (SELECT item_id, g, 'p' AS side, unnest({_TAG.format(w='w', n='length(x) + item_id')}) AS tag, generate_subscripts(w, 1) AS i FROM words
             UNION ALL SELECT item_id, g, 'r', unnest({_TAG.format(w='w', n='length(x) + item_id + (length(x) // 9)')}), generate_subscripts(w, 1) FROM words),
    chunks AS {_CHUNKS},
    n AS (SELECT g, count(*) FILTER (WHERE side = 'p') AS predicted, count(*) FILTER (WHERE side = 'r') AS actual FROM chunks WHERE kind <> 'misc' GROUP BY g),
    s AS (SELECT a.g, count(*) AS same FROM chunks a JOIN chunks b ON a.item_id = b.item_id AND a.kind = b.kind AND a.first = b.first AND a.last = b.last WHERE a.side = 'p' AND b.side = 'r' AND a.kind <> 'misc' GROUP BY a.g)
    SELECT n.g, round(2.0 * coalesce(same, 0) / (predicted + actual), 6) AS entity_f1 FROM n LEFT JOIN s ON s.g = n.g""")
def entity_overlap(spark, d):
    """Two tag sequences of each benchmark text, made from its words' lengths; entities of kind misc are left out."""
    kind = lambda n: F.when(n % 5 == 0, "b-per").when(n % 5 == 1, "i-per").when(n % 5 == 2, "b-misc").otherwise("o")
    words, item = F.split("text", " "), F.col("item_id")
    rows = table(spark, d, "benchmark").select((item % 3).alias("g"), F.transform(words, lambda x: kind(F.length(x) + item)).alias("predicted"), F.transform(words, lambda x: kind(F.length(x) + item + F.floor(F.length(x) / 9))).alias("labels"))
    return metrics.entity_f1(rows, ["g"], skip=["misc"]).select("g", r6("entity_f1").alias("entity_f1"))


@query("""WITH cells AS (SELECT o_orderkey % 4 AS g, o_orderkey AS id, [o_orderkey % 3, o_orderkey % 5 + 10]::VARCHAR[] AS p1, [o_custkey % 3, o_custkey % 5 + 10]::VARCHAR[] AS p2, [o_orderkey % 2, o_custkey % 5 + 10]::VARCHAR[] AS r1, [o_custkey % 2, o_orderkey % 5 + 10]::VARCHAR[] AS r2 FROM orders),
    n AS (SELECT g, len(list_intersect(p1, r1)) AS a, len(list_intersect(p2, r2)) AS b, len(list_intersect(p1, r2)) AS c, len(list_intersect(p2, r1)) AS e FROM cells)
    SELECT g, round(avg((a + b) / 4.0), 6) AS cell_accuracy, round(avg((a + b = 4)::INT), 6) AS puzzle_accuracy, round(avg(greatest(a + b, c + e) / 4.0), 6) AS puzzle_best_permutation FROM n GROUP BY g""")
def puzzle_scores(spark, d):
    """Puzzles of two objects with two cells each, made from orders."""
    x, y = F.col("o_orderkey"), F.col("o_custkey")
    lists = lambda a, b: F.array(a.cast("string"), (b % 5 + 10).cast("string"))
    both = lambda a, b: F.create_map(F.lit("object_1"), a, F.lit("object_2"), b)
    rows = table(spark, d, "orders").select((x % 4).alias("g"), both(lists(x % 3, x), lists(y % 3, y)).alias("prediction"), both(lists(x % 2, y), lists(y % 2, x)).alias("reference"))
    texts = rows.select("g", F.to_json("prediction").alias("p"), F.to_json("reference").alias("r"))
    out = metrics.puzzle_accuracy(rows, ["g"]).join(metrics.puzzle_best_permutation(texts, ["g"], "p", "r"), "g")
    return out.select("g", *[r6(c).alias(c) for c in ("cell_accuracy", "puzzle_accuracy", "puzzle_best_permutation")])


@query("""SELECT l_returnflag AS g, round(avg((l_linenumber % 2 = 0 AND l_suppkey % 3 <= 1 AND l_partkey % 4 <> 3)::INT), 6) AS tool_calling FROM lineitem GROUP BY 1""")
def tool_call_scores(spark, d):
    """Calls with a right name for even lines, an allowed value for two suppliers of three, and the required argument unless ``l_partkey % 4 = 3``."""
    functions = '[{"name": "find", "parameters": {"required": ["id"]}}]'
    given = F.when(F.col("l_partkey") % 4 != 3, F.format_string('"id": %d, ', F.col("l_suppkey") % 3)).otherwise("")
    call = F.concat(F.lit('[{"function": "'), F.when(F.col("l_linenumber") % 2 == 0, "find").otherwise("seek"), F.lit('", "arguments": {'), given, F.lit('"unit": "cm"}}]'))
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.lit(functions).alias("f"), call.alias("p"), F.lit('[{"find": {"id": [0, 1], "unit": ["cm", ""]}}]').alias("r"))
    return metrics.tool_calling(rows, ["g"], "f", "p", "r").select("g", r6("tool_calling").alias("tool_calling"))


@query("SELECT event_type, round(avg(CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END), 6) AS judge_mean FROM events GROUP BY ALL")
def judge_scores(spark, d):
    """Scores in JSON answers, one in seven of which is cut off."""
    rows = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("answer"))
    return metrics.judge_mean(rows, ["event_type"], field="k").select("event_type", r6("judge_mean").alias("judge_mean"))


@query("SELECT lang, round(sum((length(w) > 6)::INT) / count(*), 6) AS hallucination_rate FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY lang")
def hallucination_rates(spark, d):
    """Share of tokens flagged: here those of more than six letters."""
    rows = table(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("w")).select("lang", (F.length("w") > 6).alias("flag"))
    return metrics.hallucination_rate(rows, ["lang"]).select("lang", r6("hallucination_rate").alias("hallucination_rate"))


@query("SELECT source, round(avg(n_chars * ((CASE WHEN lang = 'en' THEN (doc_id % 10) / 10.0 ELSE 0.0 END) + (CASE WHEN lang = 'de' THEN 0.8 ELSE 0.1 END) > 0.75)::INT), 6) AS gated FROM documents GROUP BY source")
def language_gated_lengths(spark, d):
    """Text lengths as scores, that count only where English and German confidences sum to more than three quarters."""
    confidences = F.create_map(F.lit("en"), F.when(F.col("lang") == "en", (F.col("doc_id") % 10) / 10.0).otherwise(0.0), F.lit("de"), F.when(F.col("lang") == "de", 0.8).otherwise(0.1))
    rows = table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("score"), confidences.alias("confidences"), F.array(F.lit("en"), F.lit("de"), F.lit("xx")).alias("wanted"))
    return metrics.gated_mean(rows, ["source"], "score", "confidences", "wanted").select("source", r6("gated").alias("gated"))


@query("SELECT vec_id, CASE WHEN vec_id % 50 <> 0 THEN list_position(embedding, list_max(embedding)) - 1 END AS place FROM embeddings")
def largest_coordinate(spark, d):
    values = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 50 == 0) & (i == 1), float("nan")).otherwise(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", metrics.argmax(values).alias("place"))


@query("SELECT doc_id FROM labels WHERE quality <> toxic OR doc_id % 5 = 0")
def failed_rows(spark, d):
    """Answers in capitals that differ from the reference, or are missing."""
    said = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("LABEL "), F.col("toxic")))
    rows = table(spark, d, "labels").select("doc_id", said.alias("p"), F.concat(F.lit("label "), F.col("quality")).alias("r"))
    return metrics.failed_instances(rows, "p", "r").select("doc_id")


@query("""WITH rows AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'f1' ELSE 'acc' END AS metric, value / 100 AS share, event_id % 3 AS failed FROM events)
    SELECT r.user_id, metric, round(100 * avg(share), 6) AS total, round(196 * stddev_samp(share) / sqrt(count(*)), 6) AS margin, n_failed FROM rows r
    JOIN (SELECT user_id, sum(failed)::BIGINT AS n_failed FROM rows GROUP BY user_id) f ON f.user_id = r.user_id GROUP BY r.user_id, metric, n_failed""")
def metric_totals(spark, d):
    """Totals with margins of each metric, and failures over all iterations; an event is an iteration of one metric."""
    name = F.when(F.col("event_id") % 2 == 0, "test_f1").otherwise("acc")
    failed = F.when(F.col("event_id") % 3 > 0, F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("event_id") % 3).cast("int")))
    rows = table(spark, d, "events").select("user_id", F.create_map(name, F.col("value") / 100).alias("scores"), failed.alias("failed_instances"))
    return metrics.totals(rows, ["user_id"]).select("user_id", "metric", r6("total").alias("total"), r6("margin").alias("margin"), "n_failed")


@query("""WITH votes AS (SELECT user_id % 5 AS model, question, choice, count(*) AS n FROM (SELECT user_id, event_id % 6 AS question, event_id // 7 % 4 AS choice FROM events) GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, question ORDER BY n DESC, choice) AS rn FROM votes) WHERE rn = 1),
    vals AS (SELECT model, question, CASE question WHEN 0 THEN (choice = 1)::INT WHEN 3 THEN (choice = 2)::INT ELSE choice END AS v FROM best)
    SELECT model, round(1 / (1 + exp(-3.0 * (avg(-0.5 * pow((v - (1 + question / 10.0)) / (0.5 + question / 4.0), 2) - ln(0.5 + question / 4.0) - 0.5 * ln(2 * pi())) + 1.5))), 6) AS score FROM vals GROUP BY model""")
def survey_scores(spark, d):
    """Commonest choice of each question's phrasings, and the logistic of its mean log-likelihood."""
    rows = table(spark, d, "events").select((F.col("user_id") % 5).alias("model"), (F.col("event_id") % 6).alias("question"), (F.floor(F.col("event_id") / 7) % 4).alias("choice"))
    values = metrics.chosen_values(rows, ["model"], "question", "choice", {0: 1, 3: 2})
    parameters = spark.range(6).select(F.col("id").alias("question"), (1 + F.col("id") / 10).alias("mean"), (0.5 + F.col("id") / 4).alias("sd"))
    return metrics.survey_score(values, ["model"], parameters, 3.0, -1.5).select("model", r6("score").alias("score"))


@query(f"SELECT doc_id, ['no', 'yes', 'maybe'][({draw_sql(4242, 'doc_id')}) % 3 + 1] AS prediction, round(ln(1 / 3.0), 6) AS logprob, 3 AS n_labels FROM documents")
def uniform_baseline(spark, d):
    rows = metrics.uniform_baseline(table(spark, d, "documents").select("doc_id"), "doc_id", ["no", "yes", "maybe"])
    return rows.select("doc_id", "prediction", r6(F.col("logprobs")[2]["logprob"]).alias("logprob"), F.size("logprobs").alias("n_labels"))


@query("SELECT l.doc_id, l.toxic AS prediction, d.lang AS reference, b.text AS context FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = l.doc_id")
def outputs_beside_examples(spark, d):
    """Predictions paired with references by key, and with the context of their example where there is one."""
    outputs = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("prediction"))
    pairs = metrics.paired(outputs, table(spark, d, "documents").select("doc_id", F.col("lang").alias("reference")), ["doc_id"])
    contexts = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("context"))
    return metrics.with_context(pairs, contexts, "doc_id", "context")


@query("""WITH f AS (SELECT vec_id, vec_id // 4 AS example, vec_id % 4 AS feature, embedding[1:8]::DOUBLE[] AS s, embedding[5:12]::DOUBLE[] AS e FROM embeddings),
    starts AS (SELECT * FROM (SELECT example, feature, s, i, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn FROM (SELECT vec_id, example, feature, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM f)) WHERE rn <= 5),
    ends AS (SELECT * FROM (SELECT example, feature, e, j, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, j) AS rn FROM (SELECT vec_id, example, feature, unnest(e) AS e, generate_subscripts(e, 1) - 1 AS j FROM f)) WHERE rn <= 5)
    SELECT example, feature, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY example ORDER BY score DESC, feature, start DESC, "end" DESC) AS rn FROM (SELECT a.example, a.feature, s + e AS score, i AS start, j AS "end" FROM starts a JOIN ends b ON b.example = a.example AND b.feature = a.feature WHERE j >= i AND j - i < 4)) WHERE rn = 1""")
def best_answer_spans(spark, d):
    """Coordinates as start and end logits: of the five best of each the best valid span, then the best window of an example."""
    part = lambda at: F.transform(F.slice("embedding", at, 8), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("example"), (F.col("vec_id") % 4).alias("feature"), part(1).alias("start_logits"), part(5).alias("end_logits"))
    return metrics.spans_of_examples(rows, "example", 5, 4).select("example", "feature", F.col("span.start").cast("long").alias("start"), F.col("span.end").cast("long").alias("end"))


_INSTRUCTIONS = [
    ("change_case:capital", {}, "text = upper(text) AND text <> lower(text)"),
    ("fr:punctuation:no_comma", {}, "NOT contains(text, ',')"),
    ("detectable_content:number_placeholders", {"num_placeholders": 1}, r"regexp_matches(text, '\[[^\n]*?\]')"),
    ("es:detectable_format:title", {}, r"regexp_matches(text, '<<[^\n<>]*[^\s<>][^\n<>]*>>')"),
    ("length_constraints:number_words", {"relation": "at least", "num_words": 12}, r"len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+(?:[''’-][\p{L}\p{N}\p{M}_]+)*')) >= 12"),
    ("keywords:letter_frequency", {"letter": "e", "let_relation": "less than", "let_frequency": 9}, "length(text) - length(replace(lower(text), 'e', '')) < 9"),
    ("keywords:existence", {"keywords": ["a", "e"]}, "regexp_matches(text, '(?i)a') AND regexp_matches(text, '(?i)e')"),
    ("keywords:frequency", {"keyword": "the", "relation": "at least", "frequency": 1}, "regexp_matches(text, '(?i)the')"),
    ("startend:quotation", {}, """left(trim(text), 1) = '"' AND right(trim(text), 1) = '"' AND length(trim(text)) > 1"""),
    ("startend:end_checker", {"end_phrase": "."}, "right(rtrim(text), 1) = '.'"),
    ("combination:repeat_prompt", {"prompt_to_repeat": "the"}, "starts_with(lower(trim(text)), 'the')"),
    ("special_character:accents", {}, "regexp_matches(text, '[àâäáãåçéèêëíìîïñóòôöõúùûüÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜŸ]')"),
    ("fr:special_character:ethel_or_cedilla", {"forbidden_char": "ç"}, "NOT regexp_matches(text, '(?i)ç')"),
    ("fr:detectable_format:constrained_response", {}, "contains(text, 'Oui.') OR contains(text, 'Non.') OR contains(text, 'Peut-être.')"),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 1}, "NOT contains(text, '***')"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 1}, r"regexp_matches(text, '\*[^\n*]*[^\s*][^\n*]*\*')"),
    ("no:such_instruction", {}, None),
]


@query(f"SELECT role, round(avg(m::INT), 6) AS instruction_accuracy, count(*) AS n FROM (SELECT role, unnest([{', '.join(sql for *_, sql in _INSTRUCTIONS if sql)}]) AS m FROM conversations) GROUP BY role")
def instructions_by_id(spark, d):
    """Instructions under their public ids, of several languages; an unknown one is passed over."""
    wanted = [x for x in (constraints.by_id(name, arguments) for name, arguments, _ in _INSTRUCTIONS) if x]
    turns = table(spark, d, "conversations")
    counts = turns.groupBy("role").agg((F.count(F.lit(1)) * len(wanted)).alias("n"))
    return constraints.instruction_accuracy(turns, ["role"], "text", wanted).join(counts, "role").select("role", r6("instruction_accuracy").alias("instruction_accuracy"), "n")


@query()
def overlap_metrics(spark, d):
    """METEOR and chrF++ of each turn against its conversation's first, and SARI of it between that and itself in lower case."""
    turns = table(spark, d, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("reference"))
    rows = metrics.paired(turns, first, ["conv_id"]).withColumn("references", F.array("reference", F.lower("text")))
    out = metrics.meteor(rows, ["role"], "text", "reference").join(metrics.chrf_words(rows, ["role"], "text", "reference"), "role").join(metrics.sari(rows, ["role"], "reference", "text", "references"), "role")
    return out.select("role", *[r6(c).alias(c) for c in ("meteor", "chrf_words", "sari")])


@query()
def nearest_label_tags(spark, d):
    """Tags from JSON answers and JSON from tags: each benchmark text's capitalised words as entities, there and back."""
    rows = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("tokens"))
    named = F.array_distinct(F.filter("tokens", lambda t: t.rlike("^[A-Z]")))
    tags = L.json_to_tags(F.col("tokens"), F.to_json(F.struct(named.alias("per"))), ["per"])
    rows = rows.withColumn("tags", tags).withColumn("json", L.tags_to_json(F.col("tokens"), F.col("tags"), ["per"]))
    return rows.select("item_id", F.array_join("tags", " ").alias("tags"), "json")


@query()
def sentence_counts(spark, d):
    """Sentences of every document by boundaries learnt from all of them, and a public constraint that counts these."""
    # The constraint asks of a text itself only whether it is blank: its first word tells.
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce(F.regexp_extract("text", r"\S+", 0), F.lit("")).alias("first_word"))
    counted = sentences.learn(docs).counted(docs, ["doc_id", "first_word"])
    name, arguments = constraints.by_id("length_constraints:number_sentences", {"relation": "at least", "num_sentences": 10}, sentences.Counted(F.col("n_sentences")))
    return counted.select("doc_id", "n_sentences", constraints.met(F.col("first_word"), name, **arguments).alias("at_least_10"))


@query(r"""WITH codes AS (SELECT doc_id, lang, list_transform(string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', ''), lambda c: unicode(c)::BIGINT) AS c FROM documents),
    three AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: ((c[i] * 31 + c[i + 1]) * 31 + c[i + 2]) % 4096)) AS bucket FROM codes),
    n AS (SELECT lang, bucket, count(*) AS n FROM three WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS t FROM n GROUP BY lang),
    w AS (SELECT t.lang AS language, b.bucket, round(1000 * ln((coalesce(n, 0) + 1)::DOUBLE / (t + 4096)))::BIGINT AS w FROM t CROSS JOIN (SELECT unnest(range(4096)) AS bucket) b LEFT JOIN n ON n.lang = t.lang AND n.bucket = b.bucket),
    bags AS (SELECT doc_id, bucket, count(*) AS k FROM three GROUP BY ALL), s AS (SELECT doc_id, language, sum(k * w) AS s FROM bags JOIN w USING (bucket) GROUP BY ALL),
    best AS (SELECT doc_id, min_by(language, (-s, language)) AS language, max(s) AS top FROM s GROUP BY doc_id), c AS (SELECT doc_id, 1.0 / sum(exp((s - top)::DOUBLE / 1000)) AS c FROM s JOIN best USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, d.doc_id % 5 = 0 AS held_out, best.language, round(c, 6) AS confidence FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN c USING (doc_id)""")
def detected_languages(spark, d):
    """Every document's language by a model of four fifths of them; the rest are held out."""
    docs = table(spark, d, "documents")
    model = language.learn(docs.where("doc_id % 5 <> 0"), "text", "lang")
    return model.scored(docs, ["doc_id"], "text").select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "language", r6("confidence").alias("confidence"))
