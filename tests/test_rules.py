"""Known answers of the text, grading and level rules, Chinese text included."""

import pytest
from pyspark.sql import functions as F

from studylake.functions import grading as G
from studylake.functions import text as T
from studylake.functions.rounding import level, ratio2
from studylake.operators import curriculum as U
from studylake.operators import exam as X
from studylake.operators import progress as P


def one(spark, fn, *args):
    names = [f"a{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {'string' if a is None or isinstance(a, str) else 'long'}" for n, a in zip(names, args)))
    return df.select(fn(*[F.col(n) for n in names]).alias("r")).first().r


@pytest.mark.parametrize("s,c,want", [
    ("5", "5", True), ("A", "a", True), ("  hello  ", "hello", True), ("五", "5", False), ("7", "5", False), ("", "5", False),
    ("x=3", "3", True), ("5cm", "5", True), ("A", "B", False), ("-3", "3", True), ("苹果个", "苹果", True), ("　5　", "5", True),
])
def test_match_answers(spark, s, c, want):
    assert one(spark, G.match_answers, s, c) is want


@pytest.mark.parametrize("s,c,want", [
    ("B", "B", False), ("选B", "B", True), ("(B)", "B", True), ("x=5", "5", True), ("绝对值的概念", "绝对值", True),
    ("解方程", "方程", False), ("A", "C", False), ("1 2", "1 3", True), ("1", "2 3", False),
])
def test_match_semantic(spark, s, c, want):
    assert one(spark, G.match_semantic, s, c) is want


@pytest.mark.parametrize("text,want", [
    ("一年级数学题", "primary_low"), ("小学六年级毕业考", "primary_high"), ("初一数学", "middle"), ("", ""),
])
def test_infer_grade(spark, text, want):
    assert one(spark, T.infer_grade, text) == want


@pytest.mark.parametrize("text,want", [
    ("这是一段正常的中文句子，用于测试。", False), ("ab", True), ("@#$%^&*()_+{}|:<>?@#$%", True), ("测试" + "x" * 20, True),
    ("[STUB: ocr] 这是一段正常的中文句子", True), ("EMBED Equation.3\nOBJECT 1\n正文", True), ("正常文字����内容文字内容", True),
])
def test_is_garbled(spark, text, want):
    assert one(spark, T.is_garbled, text) is want


@pytest.mark.parametrize("text,want", [
    ("第一题：求和", "第1题：求和"), ("第 3 题", "第3题"), ("第十二题和第二十题", "第12题和第20题"), ("第三十题", "第0题"), ("无题", "无题"),
])
def test_normalize_qnum(spark, text, want):
    assert one(spark, T.normalize_qnum, text) == want


@pytest.mark.parametrize("text,want", [
    ("正确答案是B。", "B"), ("因此选C", "C"), ("D选项正确", "D"), ("正确答案：3.14。", "3.14"), ("答案是 -5", "-5"), ("2+12=14。", "14"),
    ("正确答案是绝对值。", "绝对值"), ("所以x=7", "7"), ("a=1, b=2 c", "2"), ("42", "42"), ("没有提示", None),
    ("答案是6\n第2题：x+5=14", "6"),
])
def test_extract_correct_answer(spark, text, want):
    assert one(spark, G.extract_correct_answer, text) == want


def test_extract_question_text(spark):
    assert one(spark, G.extract_question_text, "好的【第3题】求 x\n的值\nA. 1\nB. 2") == "求 x\n的值"
    assert one(spark, G.extract_question_text, "没有题目") == ""


@pytest.mark.parametrize("text,want", [
    ("求值\nA. 1\nB. 2", "求值"), ("求值 A. 1 B. 2", "求值"), ("A. only", "A. only"), ("没有选项", "没有选项"), ("a\n\nA、x", "a"),
])
def test_strip_options(spark, text, want):
    assert one(spark, G.strip_options, text) == want


@pytest.mark.parametrize("text,want", [
    ("考试时间：90分钟\n2023年期中考试试卷\n1. 题目", "2023年期中考试试卷"), ("1. 题目一\n有理数的加法", "有理数的加法"), ("", ""),
    ("A. 选项\n| a | b |\n—— 第一单元复习", "—— 第一单元复习"),
])
def test_derive_title(spark, text, want):
    assert one(spark, T.derive_title, text) == want


@pytest.mark.parametrize("text,want", [("第1题 第12题", 12), ("1. 一\n3、二", 3), ("none", 0), ("1．求", 1)])
def test_total_questions(spark, text, want):
    assert one(spark, T.total_questions, text) == want


@pytest.mark.parametrize("text,want", [("2H2+O2=2H2O", True), ("水 H2O", False), ("plain words", False)])
def test_has_formula(spark, text, want):
    assert one(spark, T.has_formula, text) is want


@pytest.mark.parametrize("text,want", [("如图所示", True), ("图3", True), ("Fig. 2", True), ("纯文字", False), ("函数图像", True)])
def test_mentions_diagram(spark, text, want):
    assert one(spark, T.mentions_diagram, text) is want


@pytest.mark.parametrize("text,want", [("家里wifi状态怎样", "wifi_status"), ("设备温度多少度", "device_temp"), ("你好", "none"), ("", "none")])
def test_intent(spark, text, want):
    assert one(spark, lambda c: T.classify_intent(c)[0], text) == want


def test_scene(spark):
    assert one(spark, lambda c: T.detect_scene(c)[1], "清理一下") == "device"
    assert one(spark, lambda c: T.detect_scene(c)[1], "出题 教材") == "medium"
    assert one(spark, lambda c: T.detect_scene(c)[0], "出题 教材") == "full"


@pytest.mark.parametrize("name,size,want", [
    ("", 10, "empty filename"), ("test_1.pdf", 900, "test or temp filename"), ("test_1.txt", 900, ""), ("新建-1.docx", 900, "test or temp filename"),
    ("a.pdf", 10, "file too small"), ("a.md", 10, ""), ("化学.pdf", 900, ""),
])
def test_admission(spark, name, size, want):
    assert one(spark, T.admission_reject, name, size) == want


def test_html_and_pages(spark):
    assert one(spark, T.sanitize_html, "<p onclick='x()'>a</p><SCRIPT>bad</SCRIPT><iframe src=1></iframe>") == "<p>a</p>"
    assert one(spark, T.strip_page_marks, "--- Page 1 ---\nabc\n--- Page 2 ---\n") == "abc"


def test_markers(spark):
    reply = "答对了\n[ANSWER:correct:math/kp1] 下一题 [KP_ID:math/kp2] [ANSWER_KEY:B]"
    parts = {n: one(spark, lambda c, n=n: T.parse_markers(c)[n], reply) for n in ("answer_key", "kp_id", "verdict", "verdict_kp", "clean_text")}
    assert parts == {"answer_key": "B", "kp_id": "math/kp2", "verdict": "correct", "verdict_kp": "math/kp1", "clean_text": "答对了 下一题"}


def test_levels_round_like_floats(spark):
    cases = [(n, d) for d in range(1, 140) for n in range(0, d + 1)]
    df = spark.createDataFrame(cases, "n long, d long").select("n", "d", ratio2("n", "d").alias("r"))
    assert all(r.r == round(r.n / r.d, 2) for r in df.collect())
    counts = [(c, p, t) for t in range(1, 45) for c in range(t + 1) for p in range(t - c + 1)]
    df = spark.createDataFrame(counts, "correct long, partial long, total long").withColumn("level", level())
    assert all(r.level == round((r.correct + 0.5 * r.partial) / r.total, 2) for r in df.collect())


def test_points_level(spark):
    df = spark.createDataFrame([(0,), (50,), (100,), (400,), (10000,), (10**7,)], "points long")
    assert [r.l for r in df.select(P.level_of_points("points").alias("l")).collect()] == [1, 1, 2, 3, 11, 100]


def test_streak_restarts_after_a_gap(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08"]
    df = spark.createDataFrame([(1, d) for d in days], "learner_id long, day string").withColumn("day", F.col("day").cast("date"))
    got = P.streaks(df).first()
    assert (got.current, got.longest) == (1, 5)


def test_prerequisites(spark):
    edges = spark.createDataFrame([("数轴", "绝对值"), ("相反数", "绝对值"), ("正数和负数", "数轴"), ("正数和负数", "相反数")], "pre string, kp string")
    levels = spark.createDataFrame([(1, "数轴", 0.9), (1, "相反数", 0.2)], "learner_id long, kp string, level double")
    got = U.prerequisite_chain(spark.createDataFrame([(1, "绝对值")], "learner_id long, kp string"), edges, levels).orderBy("rn").collect()
    assert [(r.pre, r.depth) for r in got] == [("相反数", 1), ("正数和负数", 2)]


def test_prerequisites_deep_and_cyclic(spark):
    """Six steps up a chain of string ids, a diamond and a cycle: every ancestor once, at its least depth."""
    pairs = [(f"k{i + 1}", f"k{i}") for i in range(7)] + [("k3", "k0"), ("k0", "k4"), (None, "k1"), ("k5", None)]
    edges = spark.createDataFrame(pairs, "pre string, kp string")
    levels = spark.createDataFrame([(1, "k3", 0.9)], "learner_id long, kp string, level double")
    got = U.prerequisite_chain(spark.createDataFrame([(1, "k0")], "learner_id long, kp string"), edges, levels, max_depth=6, limit=99)
    assert {(r.pre, r.depth) for r in got.collect()} == {("k1", 1), ("k2", 2), ("k4", 2), ("k5", 3), ("k6", 4), ("k7", 5)}


def test_prerequisites_of_the_curriculum(spark):
    """Ids as the curriculum loader makes them."""
    path = "math/g7s1/ch01/"
    edges = spark.createDataFrame([(path + "a", path + "b"), (path + "b", path + "c")], "pre string, kp string")
    levels = spark.createDataFrame([(1, path + "c", 0.1)], "learner_id long, kp string, level double")
    got = U.prerequisite_chain(levels.select("learner_id", "kp"), edges, levels).orderBy("rn").collect()
    assert [(r.pre, r.level, r.depth, r.rn) for r in got] == [(path + "b", 0.0, 1, 1), (path + "a", 0.0, 2, 2)]


def test_model_replies(spark):
    good = '{"question": {"index": 1, "total": 3, "question_type": "choice", "content": "q\\nA. 1", "answer_key": "A", "explanation": "e", "options": {"A": "1"}}}'
    cases = [
        (1, f"text\n```json\n{{}}\n```\n```json\n{good}\n```"), (2, good), (3, "no json at all"),
        (4, good.replace('"index": 1', '"index": 5')), (5, good.replace(', "options": {"A": "1"}', "")), (6, good.replace('"choice"', '"odd"')),
    ]
    got = {r.id: list(r.errors) for r in X.parse_model_replies(spark.createDataFrame(cases, "id long, reply string")).collect()}
    assert got == {1: [], 2: [], 3: ["no json"], 4: ["index exceeds total"], 5: ["choice without options"], 6: ["invalid question_type"]}


def test_paper_metadata(spark):
    header = "2023年八年级物理期末考试\n满分：100 时间 90分钟"
    got = {n: one(spark, lambda c, n=n: X.paper_metadata(c)[n], header) for n in ("subject", "grade", "exam_type", "year", "total_score", "minutes")}
    assert got == {"subject": "physics", "grade": "八年级", "exam_type": "final", "year": 2023, "total_score": 100.0, "minutes": 90}
