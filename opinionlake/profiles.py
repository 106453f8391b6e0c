"""Per-shop rule sets. One pipeline reads them; a new shop is a new Profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import Column

# --- Fixed values: they decide results and are stated as they are. -----------
# Text read as missing when a CSV is loaded.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Character ranges every shop keeps; punctuation marks differ per shop.
KEPT_RANGES = (("0", "9"), ("A", "Z"), ("a", "z"), ("가", "힣"))
# Exact tokens dropped before weighting.
STOPWORDS = ("책", "구매", "배송", "포장", "진짜", "너무", "좋아요")
WEEKDAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
ROUTE_LABELS = ("chat", "subject_info", "rag_review")
DEFAULT_ROUTE = "chat"
# Accepted date spellings, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.MM.dd", "yyyy/MM/dd")
# Rows collected per shop, and rows per shop in the retrieval corpus.
COLLECT_TARGETS = {"aladin": 550, "kyobo": 600, "yes24": 550}
CORPUS_CAP = 500
NEIGHBOURS = 4
NO_HITS_MESSAGE = (
    "리뷰 데이터를 찾지 못했습니다. 먼저 리뷰 CSV를 준비하거나 FAISS 인덱스를 생성해 주세요."
)
SUBJECT_MISSING_MESSAGE = "어떤 대상의 정보를 원하시는지 알려주세요."
SUBJECT_FIELD_DEFAULT = "정보 없음"
# Labels of a subject's lines, and of the fields of a hit line.
SUBJECT_LABELS = {"title": "제목", "author": "저자", "summary": "요약", "keywords": "키워드"}
HIT_FIELDS = ("rating", "date")
HIT_UNKNOWN_SOURCE = "unknown"
HIT_MISSING = "NA"
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """Rules of one shop.

    Text keeps the characters of ``KEPT_RANGES`` and ``marks``; all others,
    whitespace included, become blanks and runs of blanks become one.
    ``tokenizer`` replaces the token rule: cleaned text to an array of tokens.
    """

    site: str
    rating_min: float
    rating_max: float
    rating_scale: int
    marks: str = ""
    cutoff: str = "midnight"  # 'midnight' | 'instant'
    min_chars: int = 1
    min_words: int = 0
    max_chars: int | None = None
    length_quantile: float | None = None
    dedupe: tuple[str, ...] = ()
    tokens: str = "blank"  # 'blank' | 'word'
    tokenizer: Callable[[Column], Column] | None = None
    lowercase: bool = True
    stopwords: tuple[str, ...] = ()
    bigrams: bool = True
    min_df: int = 1
    max_features: int = 1000


ALADIN = Profile(
    site="aladin", rating_min=1, rating_max=5, rating_scale=5,
    marks=".,!?:;-()[]\"'/",
    min_chars=5, lowercase=False, min_df=1, max_features=200,
)
KYOBO = Profile(
    site="kyobo", rating_min=0, rating_max=10, rating_scale=10,
    marks="", cutoff="instant",
    min_chars=1, min_words=2, max_chars=3000,
    dedupe=("date", "rating", "content_clean"),
    tokens="word", bigrams=False, min_df=2, max_features=1000,
)
YES24 = Profile(
    site="yes24", rating_min=1, rating_max=5, rating_scale=5,
    marks=".,!?…",
    min_chars=5, length_quantile=0.99,
    stopwords=STOPWORDS, min_df=2, max_features=1000,
)

PROFILES: dict[str, Profile] = {p.site: p for p in (ALADIN, KYOBO, YES24)}
SITES: tuple[str, ...] = tuple(PROFILES)
