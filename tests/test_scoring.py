import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from models import f1, lcs_dp, needle_at_sentence, normalize_answer
from pyspark.sql import functions as F

from longloom.functions import scoring as S
from longloom.functions import tokens as TK
from longloom.operators import haystack as H


def one(spark, col, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(col.alias("r")).first().r


def test_normalize(spark):
    assert one(spark, S.normalize_answer(F.lit("The  Cat's, an APPLE!"))) == "cats apple"
    assert one(spark, S.normalize_answer(F.lit("an ançeau the été a éa"))) == "ançeau été éa"


def test_normalize_matches_python_on_conversations(spark):
    from longloom.sources.tables import read_table
    c = read_table(spark, "/root/testdata/sf0.01", "conversations")
    rows = c.select("text", S.normalize_answer("text").alias("n")).collect()
    assert all(r.n == normalize_answer(r.text) for r in rows)


def test_token_f1(spark):
    p, g = F.array(*map(F.lit, "a b b c".split())), F.array(*map(F.lit, "b b b c d".split()))
    assert one(spark, S.multiset_overlap(p, g)) == 3
    assert one(spark, S.f1_tokens(p, g)) == pytest.approx(2 / 3)
    e = F.array().cast("array<string>")
    assert one(spark, S.f1_tokens(e, e)) == 0.0
    assert one(spark, S.qa_f1(F.lit(""), F.array(F.lit("")))) == 0.0


def test_qa_f1_against_python(spark):
    from longloom.plans.qa import pairs
    p = pairs(spark, "/root/testdata/sf0.01").select("prediction", "answers", S.qa_f1("prediction", "answers").alias("s"))
    for r in p.collect():
        want = max(f1(normalize_answer(r.prediction).split(), normalize_answer(a).split()) for a in r.answers)
        assert r.s == pytest.approx(want)


def test_matches(spark):
    assert one(spark, S.first_int_match(F.lit("abc 007"), F.lit("7"))) == 0
    assert one(spark, S.first_int_match(F.lit("abc 007"), F.lit("007"))) == 1
    assert one(spark, S.first_int_match(F.lit("none"), F.lit(""))) == 1
    assert one(spark, S.in_match(F.lit("anything"), F.lit(""))) == 1


def test_choice(spark):
    opts = F.array(*map(F.lit, ["x", "Paris", "y", "z"]))
    assert one(spark, S.expand_choice(F.lit("b"), opts)) == "b paris"
    assert one(spark, S.expand_choice(F.lit(""), opts)) == ""
    assert one(spark, S.expand_choice(F.lit("b Paris"), opts)) == "b Paris"
    assert list(one(spark, S.answer_letters(F.array(F.lit("Paris")), opts))) == ["Paris", "B"]
    assert list(one(spark, S.answer_letters(F.array(F.lit("Paris"), F.lit("B")), opts))) == ["Paris", "B"]
    with pytest.raises(Exception, match="not one of the options"):
        one(spark, S.answer_letters(F.array(F.lit("Rome")), opts))


def test_truncation(spark):
    x = F.array(*[F.lit(str(i)) for i in range(11)])
    a = one(spark, TK.truncate_middle(x, 7))
    b = one(spark, TK.truncate_middle_exact(x, 7))
    items = [str(i) for i in range(11)]
    assert list(a) == items[:3] + items[-3:]
    assert list(b) == items[:3] + items[-4:]


def test_windows(spark):
    w = one(spark, TK.right_aligned_windows(F.lit(6000), 2500))
    assert [(r.lo, r.hi) for r in w] == [(0, 999), (999, 3499), (3499, 5999)]
    assert list(one(spark, TK.right_aligned_windows(F.lit(1), 2500))) == []


def test_extractors(spark):
    from longloom.functions import prompts as PR
    assert one(spark, PR.extract_call(F.lit("… func_12(-3) …"))) == "func_12(-3)"
    assert one(spark, PR.call_name(PR.extract_call(F.lit("… func_12(-3) …")))) == "func_12"
    assert one(spark, PR.find_target(F.lit("The 2nd largest of list"))) == "the 2nd largest"
    assert one(spark, PR.extract_call(F.lit("no call"))) is None


def test_sentence_insert(spark):
    assert one(spark, H.insert_needle_sentence(F.lit("A. B. C. D"), F.lit("NEEDLE"), F.lit(0.5))) == \
        needle_at_sentence("A. B. C. D", "NEEDLE", 0.5) == "A. B.NEEDLE C. D"


def test_needle_recall_quirk(spark):
    exp = "eat a sandwich and sit in Dolores Park on a sunny day."
    assert one(spark, S.needle_recall(F.lit(exp))) == pytest.approx(11 / 12)
    assert one(spark, S.needle_recall(F.lit(None).cast("string"))) == 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.lists(st.sampled_from("abcde"), max_size=30))
def test_lcs_bitparallel(a, b):
    assert S.lcs_length(a, b) == lcs_dp(a, b)


def test_rouge_l_column(spark):
    rnd = random.Random(7)
    rows = [(" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))),
             " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))) for _ in range(50)]
    df = spark.createDataFrame(rows, "p string, g string")
    for r in df.select("p", "g", S.rouge_l("p", "g").alias("s")).collect():
        a, b = r.p.split(), r.g.split()
        lcs = lcs_dp(a, b)
        want = 0.0 if lcs == 0 else 2 * (lcs / len(a)) * (lcs / len(b)) / (lcs / len(a) + lcs / len(b))
        assert r.s == pytest.approx(want)


def test_rouge_l_zh_against_dp(spark):
    from longloom.plans.qa import pairs
    p = pairs(spark, "/root/testdata/sf0.01").select("prediction", "answer",
                                                     S.rouge_l_zh("prediction", "answer").alias("s"))
    for r in p.collect():
        a, b = list(r.prediction), list(r.answer)
        lcs = lcs_dp(a, b)
        want = 0.0 if lcs == 0 else 2 * (lcs / len(a)) * (lcs / len(b)) / (lcs / len(a) + lcs / len(b))
        assert r.s == pytest.approx(want)


def test_overlap_time_is_linear(spark):
    """2,000-word pairs cost no more than a few times 500-word pairs (same number of pairs)."""
    import time
    from longloom.functions import scoring as S

    def seconds(n):
        df = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 7919 % 977).cast("string")).alias("p"),
                                    F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 104729 % 983).cast("string")).alias("g"))
        df = df.select(S.multiset_overlap(F.col("p"), F.col("g")).alias("c"))
        df.collect()
        t = time.time()
        df.collect()
        return time.time() - t
    assert seconds(2000) <= 8 * seconds(500) + 1


def test_render_edge_rows(spark):
    from longloom.functions import prompts as PR
    rows = [("code_run", 1, "no call here", "ctx", ["a"]), ("longbook_choice_eng", 2, "which {context}?", "C {question}", ["a", "b", "c", "d"]),
            ("longbook_choice_eng", 3, "which?", "C", ["a", "b", "c"]), ("unknown", 4, "x", "y", [])]
    ex = spark.createDataFrame(rows, "task string, id long, input string, context string, options array<string>")
    out = {(r.id, r.model): r for r in PR.render(ex, PR.templates_frame(spark)).collect()}
    assert out[(4, None)].problem == "no template"
    ok = out[(2, "gpt4")]
    assert ok.problem is None and "which {context}?" in ok.prompt and "C {question}" in ok.prompt
    assert out[(3, "gpt4")].prompt is None and "OPTION_D" in out[(3, "gpt4")].problem
    assert "func" in out[(1, "gpt4")].problem
    with_content = ex.withColumn("content", F.lit("spare")).withColumn("context", F.lit(None).cast("string"))
    assert "spare" in [r for r in PR.render(with_content, PR.templates_frame(spark)).collect() if r.id == 2][0].prompt


def test_needle_chat_and_long_prompt(spark):
    from longloom import constants as K
    from longloom.functions import prompts as PR
    one_row = spark.range(1)
    chat = one_row.select(PR.needle_chat(F.lit("ctx")).alias("m")).first().m
    assert [x.role for x in chat] == ["system", "user", "user", "assistant"] and chat[1].content == "ctx"
    assert chat[2].content == K.DEFAULT_RETRIEVAL_QUESTION + K.NEEDLE_QUESTION_SUFFIX
    text = " ".join(f"w{i}" for i in range(30))
    cut = one_row.select(PR.chat_messages(F.lit(text), F.lit("passkey"), 11).alias("m")).first().m[-1].content
    import re
    tokens = re.findall(r"[^ \t\n\r.]+|[.]|[ \t\n\r]+", text)
    assert cut == "".join(tokens[:5] + tokens[-6:])
    calc = one_row.select(PR.chat_messages(F.lit("1 + 2"), F.lit("math_calc")).alias("m")).first().m
    assert [x.content for x in calc] == [K.CALC_SYSTEM_MESSAGE, K.CALC_EXAMPLE_QUESTION, K.CALC_EXAMPLE_ANSWER, "1 + 2"]


def test_native_rouge_l_equals_the_dynamic_program(spark):
    import random
    from models import lcs_dp
    from longloom.functions import scoring as S
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", "same words here", "x " * 60]
    rows = [(a, b) for a in texts[::3] for b in texts[::7]] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "p string, g string")
    got = df.select("p", "g", S.lcs_native(S.words("p"), S.words("g")).alias("n"), S.rouge_l_native("p", "g").alias("f"), S.rouge_l("p", "g").alias("u"))
    assert "Python" not in df.select(S.rouge_l_native("p", "g"))._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        if r.p is None or r.g is None:
            assert r.f is None
            continue
        assert r.n == lcs_dp(r.p.split(), r.g.split()) and abs(r.f - r.u) < 1e-12


def test_rouge_l_takes_few_rows_out_of_arrow(spark, monkeypatch):
    """Tokens become numbers a few rows at a time; null texts and null tokens keep their places."""
    import pyarrow as pa
    rnd = random.Random(11)
    texts = [None if rnd.random() < 0.1 else [None if rnd.random() < 0.1 else rnd.choice("abc漢") for _ in range(rnd.randint(0, 9))] for _ in range(400)]
    p, g = texts[:200], texts[200:]
    sizes, lcs = [], S.lcs_length
    monkeypatch.setattr(S, "lcs_length", lambda a, b: sizes.extend(type(x) for x in (*a, *b)) or lcs(a, b))
    got = S._rouge_l_udf.func(pa.array(p, pa.list_(pa.string())), pa.array(g, pa.list_(pa.string()))).to_pylist()
    assert set(sizes) == {int}
    for a, b, s in zip(p, g, got):
        c = 0 if a is None or b is None else lcs_dp(a, b)
        assert s == (None if a is None or b is None else 0.0 if c == 0 else 2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)))
