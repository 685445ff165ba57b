import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.sources import files

KEEP = ["이 문장은 본문이다.", "1\t토기\t3점\t북문지", "| 1 | 2 | 3 |", "[페이지 35]", "2) Ⅰ-3호 수혈유구 조사 결과", "• 프로토타입의 긍정적인 점(P)"]
DROP = ["![이미지](./images/a_page006_img001.png)", "![image](/image/placeholder)", "2) 제목················80", "모델 •••••", "11.6", "35", "이미지", "**이미지**: 페이지 20의 이미지 ./images/a.png"]


def test_junk_lines_kept(column):
    assert column(KEEP, T.drop_junk_lines) == KEEP


@pytest.mark.parametrize("line", DROP)
def test_junk_lines_dropped(column, line):
    assert column([f"앞 문장\n{line}\n뒤 문장"], T.drop_junk_lines)[0].replace("\n\n", "\n") == "앞 문장\n뒤 문장"


def test_alt_text_and_tokens(column):
    assert column(["![북문지 석축 전경](images/north(1).png)"], T.drop_junk_lines) == ["북문지 석축 전경"]
    assert column(["<|begin_of_box|>토기편 출토<|end_of_box|>", "<|beginofbox|>토기편"], T.drop_junk_lines) == ["토기편 출토", "토기편"]


def test_markdown(column):
    text = "---\ntitle: x\n---\n# 제목\n\n- **굵은** [링크](http://a) ![그림](b.png)\n1. `코드`\n```python\nx = 1\n```"
    assert column([text], T.clean_markdown) == ["제목\n\n굵은 링크 그림\n코드\nx = 1"]


def test_markdown_to_text_keeps_fences(column):
    text = "# 제목\n![그림](a.png) [링크](b)\n```\n# not a heading\n**x**\n```\n**굵게**"
    assert column([text], T.markdown_to_text) == ["제목\n그림 링크\n```\n# not a heading\n**x**\n```\n굵게"]


def test_structure(column):
    assert column(["  1. 서론  \n본문"], T.keep_structure) == ["\n1. 서론\n\n본문"]


def test_punctuation(column):
    assert column(["몽촌토성abc 「인용」 끝 ."], T.normalize_punctuation) == ['몽촌토성 abc "인용" 끝.']
    assert column(["abc【x】．，；："], T.normalize_hangul_text) == ["abc【x】.,;:"]


def test_patterns(column):
    assert column(["<p>본문[1]!!</p>&nbsp; Page 3", "<b></b>"], T.clean_patterns) == ["본문!", "<b></b>"]


def test_search_form(column):
    assert column(["1998 년 3 점 토기 편"], lambda c: T.optimize_for_search(c)) == ["1998년 3점 토기 편"]
    assert column(["토기 편"], lambda c: T.optimize_for_search(c, True)) == ["토기편"]


def test_redaction(column):
    texts = ["Authorization: Bearer abc123def456ghi789", "key AIzaSyA1234567890abcdefghijklmn", "문서 12개 처리 완료, 검색 0.32초", "sk-abcdefgh12345678"]
    got = column(texts, T.redact_secrets)
    assert got == ["Authorization: ***", "key ***", texts[2], "***"]
    assert column(["pw=longsecret1 short"], lambda c: T.redact_secrets(c, ["longsecret1", "short"])) == ["pw=*** short"]


def test_artifacts(column):
    assert column(["[본문]\n내용이다.\n---\n\n\n\n끝."], T.strip_artifacts) == ["내용이다.\n\n끝."]


def test_context_clean(column):
    assert column(["답변 예시: x\nuser\n본문 내용\n예시 둘", "예시 하나\n답변 예시"], T.clean_context) == ["본문 내용", "예시 하나 답변 예시"]


def test_output_clean(column):
    assert column(["<|im_start|>user 질문\n답변 예시입니다\n내용"], T.clean_output) == ["내용"]


def test_inline_markup(column):
    assert column(["**굵게** <b> [출처 1, 2]"], T.inline_markup) == [
        '<strong>굵게</strong> &lt;b&gt; <span class="cite">출처 1</span> <span class="cite">출처 2</span>'
    ]


def test_lists(column):
    assert column(["1. 하나\n  2) 둘\n• 셋\n넷"], T.normalize_lists) == ["- 하나\n  - 둘\n- 셋\n넷"]


def test_headings(column):
    assert column(["### 다.\n### 가.\n### 서론"], T.fix_headings) == ["다.\n가.\n### 서론"]


def test_answer_repair(column):
    assert column(["내용### 참고 자료- 문서 1"], T.repair_answer_markdown) == ["내용\n\n### 참고 자료\n- 문서 1"]
    table = "| a | b || --- | --- || 1 | 2 |"
    assert column([table], T.repair_answer_markdown) == ["| a | b |\n| --- | --- |\n| 1 | 2 |"]
    fenced = "```\n| a || --- |\n```"
    assert column([fenced], T.repair_answer_markdown) == [fenced]


def test_error_guard(column):
    assert column(["처리 중 오류가 발생했습니다.", "정상 답변"], T.is_error_message) == [True, False]


def test_validity_and_names(column):
    assert column(["짧다", "이 문장은 열 글자를 넘는다"], T.is_valid_text) == [False, True]
    decomposed = unicodedata.normalize("NFD", "한글") + "\x01:a  b?.txt"
    assert column([decomposed], files.sanitized_name) == ["한글_a b_.txt"]


def test_run_lengths(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "x array<string>")
    got = df.select(T.run_lengths(F.col("x")).alias("h"), T.first_seen_counts(F.col("x")).alias("f")).collect()
    assert [(r["item"], r["n"]) for r in got[0]["h"]] == [("a", 1), ("b", 3), ("c", 1)]
    assert [(r["item"], r["n"], r["first"]) for r in got[0]["f"]] == [("a", 1, 1), ("b", 3, 0), ("c", 1, 3)]
    assert got[1]["h"] == [] and got[1]["f"] == []


def test_jaccard(spark):
    sets = [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "a"], 1.0), (["a"], ["b"], 0.0)]
    df = spark.createDataFrame(sets, "a array<string>, b array<string>, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.jaccard(F.col("a"), F.col("b"))).collect())
