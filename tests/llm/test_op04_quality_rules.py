from plumbline.llm import op04_quality_rules as op
from tests.llm import brute

TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "x " * 400, "The same line here\n" * 6, "AND SO ON!! " * 30,
    "a b c d e a b c\td e\x0bf\x0c\rg", "\xa0é 　ü#*$%&|<> \n\nÄÖÜ x", "\n".join(f"word{i} and{i % 7} more{i}" for i in range(60)),
    " ".join(f"w{i * i % 997}" for i in range(30_000)), "no_space" * 20_000,
]


def rows(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, failed_bits string, n_words int")


def test_ledger_against_plain_python(spark):
    got = {r.doc_id: r for r in op.ledger(rows(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[None if i == 3 else i]
        assert {k: r[k] for k in op.MEASURES} == brute.measures(text), text and text[:40]
        assert r.failed_bits == sum(1 << k for k, bad in enumerate(brute.rules_fail(text)) if bad)


def test_policies_filter_and_ablation_agree(spark):
    df = rows(spark, TEXTS)
    for policy, names in op.POLICIES.items():
        on = [k for k, (name, _) in enumerate(op.RULES) if name in names]
        want = [t for t in TEXTS if not any(brute.rules_fail(t)[k] for k in on)]
        kept = op.filter_documents(df, policy)
        assert kept.columns == df.columns
        assert sorted(r.text for r in kept.collect()) == sorted(want)
        got = {r.rule: (r.n_failed, r.n_only) for r in op.ablations(op.ledger(df), policy).collect()}
        for k in on:
            fails = [brute.rules_fail(t) for t in TEXTS]
            assert got[op.RULES[k][0]] == (sum(f[k] for f in fails), sum(f[k] and not any(f[j] for j in on if j != k) for f in fails))


def test_empty_table_and_no_python(spark):
    assert op.ledger(rows(spark, TEXTS).limit(0)).count() == 0
    plan = op.ledger(rows(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all(coalesce(text") <= 4
