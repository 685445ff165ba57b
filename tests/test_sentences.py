import pytest
from pyspark.sql import functions as F

from corpusflow.functions import sentences as L
from corpusflow.operators import structure

COMPLETE = ["", "   ", "안녕하세요.", "Really?", "좋다!", "합니다.", "음.", "였다.", "제1장", "This is a complete English sentence."]
INCOMPLETE = """다 음 그것은 중요하다|좋다|이 값은 확인되었다|구분하고 있|설치되고 있|놓고 있|만들어 있|확인하고|하며|하면서|건설되어|만드는|중요한|오는|만들|할
삼국사기 백|조선왕조실록 태|서울특별시 송|경기도 하|온조왕 태|475년 고|6세기 신|조선시대 전|자료 사|유물 발|보고서|그리고|또한|마지막으로|발굴흔적|유구|주요한
측정치를|자료의|현장에서|조사에|박물관에서|2024|Figure 3|abc|문화재 정 리|기단 석조물|조사하여,|발굴 하여|기록되며|완료 ㄹ|진행 ㅁ|No period here friend"""
INCOMPLETE = ["다", "음"] + [p for line in INCOMPLETE.replace("다 음 ", "", 1).split("\n") for p in line.split("|")]


def test_incomplete_lines(column):
    assert len(INCOMPLETE) == 51
    got = dict(zip(COMPLETE + INCOMPLETE, column(COMPLETE + INCOMPLETE, L.is_incomplete)))
    assert [k for k in COMPLETE if got[k]] == []
    assert [k for k in INCOMPLETE if not got[k]] == []


@pytest.mark.parametrize("following", ["| 표 | 행 |", "<표 IV-18> 현황", "1. 서론", "그러나 결과는", "제2장 조사"])
def test_never_joined(spark, following):
    row = spark.range(1).select(L.can_join(F.lit("도입의 필요성이"), F.lit(following)).alias("j")).first()
    assert row["j"] is False


def test_heading_is_not_joined(spark):
    assert spark.range(1).select(L.can_join(F.lit("# 제목"), F.lit("본문")).alias("j")).first()["j"] is False


def test_first_sentence_keeps_decimals(column):
    text = "497.5㎞이며 서울 구간은 42.9㎞이다. 다음 문장."
    assert column([text], L.sentence_head) == ["497.5㎞이며 서울 구간은 42.9㎞이다."]
    assert column([text], L.sentence_rest) == ["다음 문장."]


def joined(spark, pages):
    df = spark.createDataFrame([(pages,)], "p array<string>")
    return df.select(structure.join_pages(F.col("p")).alias("p")).first()["p"]


def test_page_boundary_is_joined(spark):
    pages = joined(spark, ["이 장에서는 기능 개선 및 추가", "도입의 필요성이 제기되었다.\n다음 문단이다."])
    assert pages == ["이 장에서는 기능 개선 및 추가 도입의 필요성이 제기되었다.", "다음 문단이다."]


@pytest.mark.parametrize("pages", [
    ["완결된 문장이다.", "새 페이지 문장이다.", ""],
    ["2. 평가 기록 누적 및 공유 114", "3. 결과 분석 120", "4. 향후 과제 131"],
])
def test_pages_left_alone(spark, pages):
    assert joined(spark, pages) == pages


def test_at_most_three_lines_are_carried(spark):
    pages = joined(spark, ["시작하는 줄이고 아직 끝나지 않은 문장", "첫째줄 조사\n두번째 유물\n세번째 유구\n네번째 토층"])
    assert pages[0].endswith("세번째 유구") or pages[0] == "시작하는 줄이고 아직 끝나지 않은 문장"
    assert "네번째 토층" in pages[1]


def test_many_pages_are_joined_in_parts(spark, monkeypatch):
    """Sentences cut at every page end: the size of the parts that finished pages are kept in does not matter."""
    pages = [f"{i}번째 문장의 끝이다.\n이 장에서는 기능 개선 및 추가" if i % 3 else f"도입의 필요성이 제기되었다.\n{i} 문단이다." for i in range(1, 200)]
    whole = joined(spark, pages)
    assert len(whole) == len(pages) and whole != pages
    monkeypatch.setattr(structure, "PAGES_AT_ONCE", 3)
    assert joined(spark, pages) == whole
    monkeypatch.setattr(structure, "PAGES_AT_ONCE", 10_000)
    assert joined(spark, pages) == whole


def test_connect_lines_in_pairs(spark):
    docs = spark.createDataFrame([(1, "구분하고 있\n다고 했다.\n끝이다."), (2, "abc\ndef\nghi")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["out"] for r in structure.connect_cut_lines(docs).collect()}
    assert out[1] == "구분하고 있다고 했다.\n끝이다."
    assert out[2] == "abcdef\nghi"


def test_heading_levels(column):
    lines = ["제1장 서론", "제 2 절 배경", "1. 서론", "1.1 배경", "가. 개요", "(가) 개요", "1) 목적", "Ⅱ. 본론", "기타"]
    assert column(lines, L.heading_level) == [1, 2, 2, 2, 3, 4, 4, 2, 2]
    assert column(["1.1.1 항", "1.1 절", "1. 장"], lambda c: L.heading_level(c, True)) == [4, 3, 2]
