"""Fixed values that decide results: word lists, patterns, sizes and weights.

Everything here is data.  Every operator takes these as defaults of keyword arguments, so a caller with another
language or domain passes lists of their own.
"""

# --- fixed values: sizes, thresholds and weights -------------------------------------------------------------------
CHUNK_SIZE = 150
CHUNK_OVERLAP = 50
TOP_K = 12
DISTANCE_THRESHOLD = 1.5
SIMILARITY_THRESHOLD = 0.30
MMR_DIVERSITY = 0.3
VECTOR_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
MAX_FEATURES = 5000
MIN_SIMILARITY = 0.1
BM25_K1 = 1.5
BM25_B = 0.75
LARGE_CONTEXT_CHARS = 50000
MAX_CONTEXT_CHUNK = 30000
CACHE_TTL_SECONDS = 300
MAX_FILE_BYTES = 104857600
FILE_TYPES = ("txt", "md", "pdf", "docx")
TEXT_LAYER_CHARS_PER_PAGE = 50
CLEANUP_TARGET = 3000
CLEANUP_MAX = 4500
CLEANUP_CONTEXT = 300
CLEANUP_RATIO = (0.85, 1.15)
SEMANTIC_MIN = 300
SEMANTIC_MAX = 1500
SEMANTIC_SIMILARITY = 0.3

# --- fixed values: separators of the recursive splitter, in order of preference -------------------------------------
DEFAULT_SEPARATORS = ("\n\n\n", "\n\n", "\n", "。", ".", "!", "?", ";", ":", ",", " ", "")
MARKDOWN_SEPARATORS = (
    "\n\n\n", "\n\n", "\n#", "\n##", "\n###", "\n- ", "\n* ", "\n", "。", ".", "!", "?", ";", ",", " ", "",
)
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")

# --- fixed values: junk, colophon and artefact patterns --------------------------------------------------------------
MARKDOWN_IMAGE = r"!\[([^\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)"
PLACEHOLDER_IMAGE = (
    r"(?i)!\[\s*(?:이미지|이メージ|image)?\s*\d*\s*(?:\(페이지\s*\d+\))?\s*\]\((?:[^()\n]|\([^()\n]*\))*\)"
)
MODEL_BOX_TOKEN = r"<\|(?:begin|end)_?of_?box\|>"
JUNK_LINES = (
    r"[·.…•∙]{5,}\s*\d*\s*$",
    r"^[\d\s.,%~\-]+$",
    r"(?i)^(이미지|이メージ)(\s+\d+\s+\(페이지\s*\d+\))?(\s.*\.(png|jpe?g|gif|webp)\)?)?$",
    r"(?i)페이지\s*\d+의 이미지\s+\S+\.(png|jpe?g|gif|webp)$",
)
COLOPHON = r"ISBN\s*[\d\-]{10,}"
ARTIFACT_PATTERNS = (
    r"^\s*\[본문\]\s*\n?",
    r"한국어 문서 전문가로서[^\n]*\n?",
    r"한국문화사 문서에서[^\n]*\n?",
    r"다음은[^\n]*(교정된|텍스트입니다)[^\n]*:\n?",
    r"교정된 텍스트[^\n]*:\n?",
    r"문맥을[^\n]*연결(하겠습니다|하여[^\n]*제공합니다)[^\n]*\n?",
    r"텍스트의 문맥을[^\n]*연결[^\n]*\n?",
    r"PDF에서 추출된[^\n]*연결하여[^\n]*\n?",
    r"^#+\s*한국어 문서[^\n]*제공합니다[^\n]*\n?",
    r"^\s*```[a-z]*\s*$",
    r"^\s*---+\s*$",
)
SECRET_PATTERNS = (
    r"sk-[A-Za-z0-9_-]{8,}",
    r"AIza[0-9A-Za-z_-]{20,}",
    r"Bearer\s+[A-Za-z0-9._-]{8,}",
)
SECRET_MASK = "***"
SECRET_MIN_LENGTH = 8
PAGE_MARKER = r"^\[페이지 \d+\]$"

# --- fixed values: context and output cleaning ------------------------------------------------------------------------
CONTEXT_TOKENS = ("<|im_start|>", "<|im_end|>")
CONTEXT_BANNED_LINES = (
    r"(?i)^\s*답변\s*시\s*지켜야\s*할\s*규칙.*$",
    r"(?i)^\s*이런\s*식으로\s*답변.*$",
    r"(?i)^\s*답변\s*예시.*$",
    r"(?i)^\s*예시.*$",
)
CONTEXT_ROLE_LINES = ("user", "assistant", "system")
OUTPUT_BANNED_FRAGMENTS = ("답변 시 지켜야 할 규칙", "이런 식으로 답변", "답변 예시")
OUTPUT_ROLE_PREFIXES = ("user ", "assistant ", "system ")

# --- fixed values: punctuation tables ----------------------------------------------------------------------------------
FULLWIDTH_PUNCTUATION = {"．": ".", "，": ",", "；": ";", "：": ":"}
HANGUL_PUNCTUATION = {
    "．": ".", "，": ",", "：": ":", "；": ";", "？": "?", "！": "!", "（": "(", "）": ")",
    "「": '"', "」": '"', "『": '"', "』": '"',
}

# --- fixed values: heading rules ----------------------------------------------------------------------------------------
HEADING_STOP_ENDINGS = (".", "다", "음", "었다", "였다", "한다", "된다", "이다", "않다")
HEADING_PATTERNS = (
    r"^제\s*\d+\s*장", r"^제\s*\d+\s*절", r"^\d+\.\s*[가-힣]", r"^[가-힣]\.\s*[가-힣]", r"^\([가-힣]\)",
    r"^\d+\)\s*[가-힣]", r"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\.", r"^【[^】]+】", r"^◎|^○|^●|^■|^□",
)
HEADING_KEYWORDS = (
    "서론", "결론", "요약", "개요", "배경", "목적", "방법", "결과", "고찰", "참고문헌", "조사", "발굴", "유적", "유물",
    "분석", "검토", "연구", "현황",
)
HEADING_LEVELS = (
    (r"^제\s*\d+\s*장", 1), (r"^제\s*\d+\s*절", 2), (r"^\d+\.", 2), (r"^\d+\.\d+", 3), (r"^\d+\.\d+\.\d+", 4),
    (r"^[가-힣]\.", 3), (r"^\([가-힣]\)", 4), (r"^\d+\)", 4), (r"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\.", 2),
)
DEFAULT_HEADING_LEVEL = 2
TITLE_PATTERNS = (r"^\d+\.\s+[가-힣]+", r"^[가-힣]\.\s+[가-힣]+", r"^\d+\)\s+[가-힣]+", r"^[IVX]+\.\s+[가-힣]+")
SENTENCE_CLOSERS = (
    "다", "음", "였다", "었다", "한다", "된다", "이다", "않다", "있다", "없다", ".", "!", "?", ":", ";", ")", '"', "'",
    "』", "】",
)

# --- fixed values: incomplete-sentence rules ------------------------------------------------------------------------------
COMPLETE_ENDINGS = (
    ".", "!", "?", "다.", "음.", "였다.", "었다.", "한다.", "된다.", "이다.", "않다.", "습니다.", "니다.",
)
KOREAN_ENDINGS = ("다", "음", "였다", "었다", "한다", "된다", "이다", "않다", "있다", "없다", "습니다", "니다")
COMPLETE_VERBS = (
    "다", "음", "였다", "었다", "한다", "된다", "이다", "않다", "있다", "없다", "습니다", "니다", "하였다", "하였음",
    "되었다", "있었다",
)
VERB_STEMS = (
    r"하고\s*있$", r"되고\s*있$", r"고\s*있$", r"어\s*있$", r"아\s*있$", r"하고$", r"되고$", r"이고$", r"며$", r"면서$",
    r"하여$", r"되어$", r"하는$", r"되는$", r"인$", r"는$", r"을$", r"ㄹ$",
)
PROPER_NOUN_CUTS = (
    r"삼국사기\s*백$", r"삼국유사\s*고$", r"조선왕조실록\s*태$", r"고려사\s*세$", r"한국사\s*고$",
    r"서울특별시\s*[가-힣]$", r"경기도\s*[가-힣]$", r"충청북도\s*[가-힣]$", r"한국문화재보호재단\s*[가-힣]$",
    r"국립중앙박물관\s*[가-힣]$", r"서울역사박물관\s*[가-힣]$", r"[가-힣]{2,3}왕\s*[가-힣]$", r"[가-힣]{2,3}제\s*[가-힣]$",
    r"년\s*[가-힣]$", r"세기\s*[가-힣]$", r"대\s*[가-힣]$",
)
SINGLE_CHAR_CUTS = (
    r"[가-힣]{2,}\s*[가나다라마바사아자차카타파하]$", r"[가-힣]{2,}\s*[의를을에서는이가와과로]$",
)
PROBLEM_ENDINGS = (
    "몽", "토", "백", "성", "왕", "제", "풍", "납", "동", "촌", "결", "과", "SPD", "가", "나", "다", "라", "마", "바",
    "사", "아", "자", "차", "카", "타", "파", "하", "갑", "을", "병", "정", "무", "기", "경", "신", "임", "계",
    "를", "을", "의", "에", "서", "는", "이", "가", "한", "된", "할", "될", "와", "과", "로", "으로",
    "측정치를", "분포를", "연대", "시대", "토기", "기종의", "형태를", "비교한", "후", "주요", "결과", "분기로", "나눌",
    "수", "있었다", "확인되는", "시기를",
    "개보수흔적", "축조흔적", "보수흔적", "수리흔적", "건축흔적", "시설흔적", "발굴흔적", "사용흔적", "폐기흔적",
    "매몰흔적", "조성흔적",
    "유구", "유물", "토층", "구조", "형태", "양상", "특징", "현상", "상황", "조건", "방법", "과정", "절차", "단계",
    "순서", "계획", "목적", "의도", "취지", "분석", "검토", "조사", "연구", "관찰", "확인", "파악", "추정", "판단",
    "주요한", "중요한", "특별한", "일반적인", "전체적인", "부분적인", "개별적인", "다양한", "여러", "많은", "적은",
    "큰", "작은", "높은", "낮은", "깊은", "얕은",
    "그리고", "또한", "하지만", "그러나", "따라서", "그런데", "한편", "첫째", "둘째", "셋째", "마지막으로",
    "보고서", "연구서", "논문집", "학술지", "잡지", "신문", "기록", "자료", "편찬위원회", "연구소", "박물관", "재단",
    "협회", "학회",
)
PARTICLES = (
    "를", "을", "의", "에", "서", "는", "이", "가", "와", "과", "로", "으로", "부터", "까지", "에서", "에게", "께서",
    "께", "으로서", "으로써", "처럼", "같이", "보다", "만큼", "마다", "조차", "까지도", "밖에", "만", "든지", "거나",
    "든가", "던지",
)
THREE_CHAR_NOUNS = (r".*[조사연관분해석토기유물구조시설]$", r".*[건축발굴수리보수개선공사작업]$", r".*[계획방법과정절차단계순서]$")
CONNECTIVE_ENDINGS = (",", "하여", "하며", "이며", "되며", "되어", "이고", "되고", "로서", "로써")
LOOSE_JAMO = ("ㄴ", "ㄹ", "ㅁ", "ㅂ", "ㄷ", "ㅅ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ")
SENTENCE_STARTERS = (
    "그러나", "하지만", "따라서", "그런데", "또한", "그리고", "한편", "첫째", "둘째", "셋째", "다음", "마지막으로",
    "그 결과", "이에 따라", "결론적으로",
)
STRUCTURE_LINE = r"^(#|\||\[페이지 \d+\]|--- 페이지 \d+ ---|[<\[](표|그림)|[-*•·]\s)"
NO_JOIN_BEFORE = (r"^\d+[\.\)]\s", r"^[가-힣][\.\)]\s", r"^제\s*\d+\s*[장절편부]", r"^[A-Z][a-z]")
SENTENCE_END = r"[.!?](?:\s|$)"
MAX_CARRIED_LINES = 3
MIN_PROSE_LINE = 20
SIMPLE_INCOMPLETE = (
    r"하고\s*있$", r"되고\s*있$", r"하고$", r"되고$", r"하여$", r"되어$", r"하는$", r"되는$", r"을$", r"를$", r"의$", r"는$",
)
SIMPLE_PARTICLES = ("를", "을", "의", "에", "서", "는", "이", "가", "와", "과", "로", "으로")

# --- fixed values: topic transitions and domain words -----------------------------------------------------------------------
TRANSITION_KEYWORDS = {
    "temporal": (
        "그러나", "한편", "이후", "다음으로", "그 후", "뒤이어", "연이어", "시기", "시대", "년도", "세기", "기원전",
        "기원후", "당시", "이전", "동시에", "같은 시기", "그 시절",
    ),
    "spatial": (
        "반면", "다른 지역", "인근", "주변", "동쪽", "서쪽", "남쪽", "북쪽", "지역", "위치", "장소", "구역", "지점",
        "현장", "터", "지구",
    ),
    "logical": (
        "따라서", "그러므로", "결과적으로", "결론적으로", "요약하면", "즉", "다시 말해", "예를 들어", "구체적으로",
        "특히", "특별히",
    ),
    "contrast": (
        "그러나", "하지만", "반면에", "이와 달리", "이에 반해", "대조적으로", "반대로", "한편으로는",
        "다른 한편으로는",
    ),
    "structural": (
        "첫째", "둘째", "셋째", "마지막으로", "다음", "또한", "그리고", "제1장", "제2장", "제1절", "제2절", "가.",
        "나.", "1)", "2)",
    ),
}
TRANSITION_WEIGHTS = {"temporal": 1.0, "spatial": 1.0, "logical": 1.5, "contrast": 1.0, "structural": 2.0}
TRANSITION_STRUCTURES = (
    r"^제\s*\d+\s*[장절]", r"^\d+\.\s+[가-힣]", r"^[가-힣]\.\s+[가-힣]", r"^【[^】]+】", r"^##+\s",
)
DOMAIN_KEYWORDS = (
    "구석기", "신석기", "청동기", "철기", "삼국시대", "통일신라", "고려", "조선", "토기", "석기", "유적", "유물", "유구",
    "출토품", "발굴", "조사", "탐사", "시굴", "확인조사", "구제발굴", "시굴조사", "방사성탄소", "연대측정", "형식학",
    "층위", "편년", "분류", "분석", "몽촌토성", "풍납토성", "한성", "백제", "고구려", "신라",
)

# --- fixed values: stop words ---------------------------------------------------------------------------------------------------
CLEAN_STOPWORDS = (
    "이", "그", "저", "의", "가", "을", "를", "에", "와", "과", "도", "로", "으로", "는", "은", "이다", "있다", "없다",
    "하다", "되다", "수", "것", "등", "및", "또는", "또한", "즉", "만", "제", "위",
)
QUERY_STOPWORDS = (
    "이", "그", "저", "의", "가", "을", "를", "에", "와", "과", "도", "로", "으로", "는", "은", "에서", "부터", "까지",
    "보다", "처럼", "같이", "마다", "마저", "조차", "이다", "있다", "없다", "하다", "되다", "시키다", "당하다", "받다",
    "주다", "이것", "그것", "저것", "여기", "거기", "저기", "이곳", "그곳", "저곳", "하나", "둘", "셋", "넷", "다섯",
    "한", "두", "세", "네", "모든", "모든지", "어떤", "어느", "무슨", "다른", "매우", "아주", "정말", "너무", "많이",
    "조금", "약간", "대단히", "상당히", "또한", "또는", "그리고", "하지만", "그러나", "따라서", "그래서", "즉", "아",
    "어", "오", "우", "음", "으", "헉", "우와", "수", "것", "등", "및", "만", "제", "위", "때", "중", "들", "말", "점",
    "곳", "바", "듯", "채", "편", "쪽", "번", "개", "명",
)
FALLBACK_STOPWORDS = (
    "은", "는", "이", "가", "을", "를", "에", "에서", "로", "으로", "와", "과", "의", "에게", "한테", "께", "뭐", "무엇",
    "어떤", "어떻게", "왜", "언제", "어디", "누구", "얼마나", "몇", "어느", "알려줘", "알려주세요", "설명해줘",
    "설명해주세요", "말해줘", "말해주세요", "가르쳐줘", "가르쳐주세요",
)
QUESTION_STOPWORDS = (
    "뭐", "무엇", "어떤", "어떻게", "왜", "언제", "어디", "누구", "얼마나", "몇", "어느", "알려줘", "알려주세요",
    "설명해줘", "설명해주세요", "말해줘", "말해주세요", "궁금", "궁금해요", "입니다", "하세요", "해줘",
)
QUESTION_SUFFIXES = (
    "에서는", "에서의", "에는", "으로는", "으로", "로는", "에게서", "에게", "한테", "에서", "의", "를", "을", "는", "은",
    "가", "이", "와", "과", "로", "도", "만", "까지", "부터",
)

# --- fixed values: query intent and context words ------------------------------------------------------------------------------
INTENT_TRIGGERS = (
    ("what", ("무엇", "뭐", "어떤", "정의", "개념", "의미")),
    ("how", ("어떻게", "방법", "어떤방법", "어떤식", "과정", "절차")),
    ("when", ("언제", "시기", "기간", "일정", "시점")),
    ("where", ("어디", "장소", "위치", "곳")),
    ("why", ("왜", "이유", "원인", "목적", "까닭")),
    ("who", ("누가", "누구", "담당", "책임")),
)
INTENT_KEYWORDS = {
    "what": ("정의", "개념", "의미", "설명", "내용", "특징", "성질"),
    "how": ("방법", "절차", "과정", "단계", "수행", "방식", "기법"),
    "when": ("시기", "기간", "일정", "날짜", "시점", "언제", "시간"),
    "where": ("위치", "장소", "곳", "지역", "영역", "어디", "공간"),
    "why": ("이유", "원인", "목적", "배경", "근거", "까닭", "동기"),
    "who": ("담당자", "책임자", "관리자", "주체", "기관", "누구", "담당"),
}
CONTEXT_TRIGGERS = (
    (("문서", "자료", "정보", "데이터"), ("문서", "자료", "정보", "데이터", "파일")),
    (("시스템", "기술", "프로그램", "소프트웨어"), ("시스템", "기술", "솔루션", "프로그램", "개발")),
    (("관리", "운영", "정책", "절차"), ("관리", "운영", "정책", "절차", "프로세스")),
    (("법", "규정", "지침", "가이드"), ("법령", "규정", "지침", "가이드라인", "기준")),
    (
        ("토기", "유물", "발굴", "유적", "파수", "고배", "옹", "호", "시루"),
        ("유물", "토기", "발굴", "유적", "백제", "고구려", "출토품"),
    ),
    (("몽촌토성", "몽촌", "토성"), ("몽촌토성", "백제", "한성", "왕성", "토성", "발굴조사")),
)
DOMAIN_TERMS = {
    "it": ("시스템", "정보", "데이터", "서버", "네트워크", "소프트웨어", "하드웨어", "프로그램"),
    "security": ("보안", "암호화", "인증", "권한", "방화벽", "접근제어", "보호"),
    "management": ("관리", "운영", "정책", "계획", "전략", "조직", "업무"),
    "government": ("행정", "정부", "공공", "기관", "법령", "규정", "정책"),
    "development": ("개발", "구축", "설계", "구현", "프로그래밍", "시스템개발"),
    "quality": ("품질", "표준", "기준", "평가", "검사", "인증", "규격"),
    "archaeology": ("발굴", "유물", "토기", "유적", "고고학", "출토", "문화재", "유구"),
    "history": ("백제", "고구려", "신라", "삼국시대", "역사", "왕조", "시대"),
    "pottery": ("토기", "도기", "자기", "그릇", "파수", "고배", "호", "옹", "시루"),
}
SIMPLE_EXPANSIONS = {"몽촌토성": "몽촌토성 몽촌 토성", "백제": "백제 한성백제", "시스템": "시스템 정보시스템"}
SPECIFIC_TERMS = ("우각형파수편", "고배", "토기편", "파수편")
SPECIFIC_TRIGGERS = ("뭐야", "무엇")
SPECIFIC_SUFFIX = " 백제 토기 유물"
STATIC_EXPANSIONS = {
    "몽촌토성": "몽촌토성 몽촌 토성 백제 한성 왕성 토성 백제왕성 백제토성 한성백제토성",
    "몽촌": "몽촌 몽촌토성 백제 한성",
    "토성": "토성 몽촌토성 성곽 성벽 토축성 판축",
    "백제": "백제 한성백제 백제시대 백제왕조 백제왕국 백제토기",
    "고구려": "고구려 고구려시대 고구려토기 고구려유물",
    "한성": "한성 한성백제 한성시대 한성도읍 서울",
    "발굴": "발굴 발굴조사 고고학 유적 출토 조사 시굴 정밀발굴",
    "유물": "유물 토기 유구 출토품 출토유물 도자기 자기",
    "토기": "토기 도기 자기 그릇 토제품 백제토기 고구려토기",
    "유적": "유적 유구 유물 흔적 건물지 주거지",
    "북문": "북문 북문지 북쪽문 북측",
    "남문": "남문 남문지 남쪽문 남측",
    "동문": "동문 동문지 동쪽문 동측",
    "서문": "서문 서문지 서쪽문 서측",
    "삼국시대": "삼국시대 백제 고구려 신라 삼국",
    "통일신라": "통일신라 통일신라시대 신라",
    "시스템": "정보시스템 시스템 전산시스템 IT시스템",
    "구축": "구축 건설 개발 설치 도입 구현",
    "운영": "운영 관리 유지보수 운용 administration",
    "지침": "지침 가이드 규정 가이드라인 매뉴얼 안내서",
    "보안": "보안 security 정보보호 보호 사이버보안",
    "관리": "관리 management 관리자 운영관리 시스템관리",
}
# The synonym dictionary is a parameter (see operators.expansion): this is only the small part that the tests pin.
SYNONYMS = {
    "시스템": ("정보시스템", "전산시스템", "IT시스템", "컴퓨터시스템", "시스템", "체계", "프로그램"),
    "정보시스템": ("시스템", "전산시스템", "IT시스템", "정보화시스템", "정보체계", "DB시스템"),
    "구축": ("건설", "개발", "설치", "도입", "구현", "설립", "조성", "건립"),
    "운영": ("관리", "운용", "가동", "실행", "진행", "수행", "administration"),
    "발굴": ("발굴", "발굴조사", "고고학", "유적", "발굴보고서", "출토"),
    "토기": ("토기", "토기편", "옹", "호", "시루", "고배", "도기", "그릇"),
    "백제": ("백제", "한성백제", "백제시대", "백제토기", "백제유물", "백제문화"),
}

# --- fixed values: quality, importance and answer layout --------------------------------------------------------------------------
LIST_MARKS = ("1.", "2.", "•", "-", "가.", "나.")
PROFESSIONAL_TERMS = (
    "시스템", "정보", "구축", "운영", "관리", "지침", "규정", "법령", "발굴", "유물", "토기", "백제", "고구려", "출토", "유적",
    "조사", "파수", "고배", "호", "옹", "시루", "토성", "몽촌토성",
)
INFO_PATTERNS = (r"\d{4}년", r"\d+월", r"\d+일", r"\d+%", r"\d+개", r"\d+명")
BROKEN_CONTEXT = (r"[가-힣]+\n###\s*[가-힣]", r"[가-힣]+\s*\n\s*[가-힣]{1,2}\.", r"『[^』]*\n[^』]*』")
SECTION_ORDER = (("summary", "핵심 요약"), ("details", "상세 설명"), ("references", "참고 자료"))
SECTION_ALIASES = {
    "summary": ("핵심 요약", "핵심정리", "요약", "요점 정리", "한줄 요약"),
    "details": ("상세 설명", "자세한 설명", "세부 내용", "본문", "상세"),
    "references": ("참고 자료", "출처", "근거", "참고문헌", "참고"),
}
SECTION_PLACEHOLDERS = {
    "summary": "- 답변이 충분히 생성되지 않았습니다. 다시 질문해보세요.",
    "details": "- 관련 문서에서 추가 정보를 찾지 못했습니다.",
    "references": "- 관련 문서 정보를 자동으로 수집하지 못했습니다.",
}
ERROR_KEYWORDS = ("오류", "에러", "키", "다시 시도", "업로드", "문서를", "없습니다")
UNKNOWN_NAME = "알 수 없음"
QUALITY_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
IMPROVEMENTS = (
    ("sentence", 85.0, "불완전한 문장들을 다음 문장과 연결하여 완성도를 높여주세요"),
    ("spacing", 85.0, "띄어쓰기 오류를 수정하여 가독성을 개선해주세요"),
    ("context", 80.0, "문맥 연결성을 강화하여 논리적 흐름을 개선해주세요"),
    ("structure", 80.0, "마크다운 구조를 보완하여 문서 형태를 개선해주세요"),
)
NO_IMPROVEMENT = "품질이 우수합니다. 추가 개선 불필요"
REPORT_IMPROVEMENTS = (
    ("context_score", "문맥 연결 개선: ContextConnectorAgent 재실행 권장"),
    ("structure_score", "문서 구조 개선: 헤딩 계층 구조 재조정 필요"),
    ("readability_score", "가독성 개선: 문장 길이 조정 및 특수문자 정리 필요"),
)
MODEL_LIMITS = (
    ("openai", "gpt-3.5-turbo", 16385), ("openai", "gpt-4", 8192), ("openai", "gpt-4-turbo-preview", 128000),
    ("openai", "gpt-4o", 128000), ("openai", "gpt-4o-mini", 128000), ("openai", "gpt-4.1", 1000000),
    ("openai", "gpt-4.1-mini", 1000000), ("openai", "gpt-4.1-nano", 1000000),
    ("google", "gemini-1.5-flash", 1048576), ("google", "gemini-1.5-flash-8b", 1048576),
    ("google", "gemini-2.5-flash", 1048576), ("google", "gemini-1.5-pro", 2097152),
    ("google", "gemini-2.5-pro", 2097152), ("google", "gemini-1.0-pro", 32760),
    ("anthropic", "claude-3-5-sonnet-20241022", 200000), ("anthropic", "claude-3-haiku-20240307", 200000),
    ("anthropic", "claude-3-sonnet-20240229", 200000), ("anthropic", "claude-3-opus-20240229", 200000),
    ("local", "local-model", 4096),
)
DEFAULT_MODEL_LIMIT = 4096
SYSTEM_PROMPT_TOKENS = 500
PROMPT_TOKENS = {"default": 800, "local": 600}
MIN_CONTEXT = {"default": 4000, "local": 2000}
MAX_CONTEXT = {"default": 500000, "gpt-3.5": 30000}
SAFETY_MARGIN = 0.7
CHARS_PER_TOKEN = 4
NO_ANSWER = "죄송합니다. 관련 정보를 찾을 수 없습니다."
EXTRA_HEADING = "[추가 정보]"
