"""Configuration: fixed values that results depend on, and default parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES. These must equal the reference's word lists for equal results.
# Stop words, one per line of the original list, in file order (the last line
# is "- " and becomes "-" after strip).
# ---------------------------------------------------------------------------
STOPWORDS_FIXED = [
    "的", "了", "在", "是", "被", "而", "與", "也", "就", "都",
    "一個", "以及", "與此同時", "根據", "標註為", "以", "於", "由", "本次", "輪到",
    "擔任", "指", "為", "對", "若", "當", "這", "意味著", "這時候", "會",
    "把", "這些", "方向", "明明", "下意識", "，", "。", "、", "：", "；",
    "「", "」", "（", "）", "(", ")", "/", ">", "･", "- ",
]

# Custom dictionary words, one per line of the original list, in file order
# (98 lines, 95 distinct: 公共牌 x3, 底牌 x2).
CUSTOM_WORDS_FIXED = [
    "盲注", "小盲注", "大盲注", "下注", "底牌", "翻牌前", "翻牌後", "公共牌", "翻牌圈", "轉牌圈",
    "河牌圈", "限注", "無限注", "彩池限注", "跟注", "跟注者", "加注", "加注者", "棄牌", "棄牌者",
    "過牌", "過牌者", "發牌", "發牌者", "最佳手牌", "次大牌", "公共牌", "公牌", "起手牌", "皇家同花順",
    "同花順", "四條", "鐵支", "葫蘆", "同花", "順子", "三條", "兩對", "對子", "一對",
    "高牌", "盲注位", "小盲位", "大盲位", "早期位", "中期位", "後期位", "前中位", "槍口位", "關煞位",
    "莊家", "按鈕位", "後位", "叫注", "對手", "我們", "詐唬", "切牌", "開始", "行動",
    "下注圈", "順時針", "數字", "德州撲克", "限注式", "牌型", "踢牌", "底牌", "公共牌", "等於",
    "大於", "小於", "中等對子", "小對子", "2與4法則", "百分之2", "百分之4", "百分之5", "底池賠率", "範圍",
    "最低防守頻率", "極化", "抓雞", "阻擋牌效應", "阻擋牌", "公式", "期望值", "底池總額", "補牌", "機率",
    "新手", "錦標賽", "蓋牌", "a_k_q_j_10_9_8_7_6_5_4_3_2", "a_k_q_j_10", "cbet", "3bet", "4bet",
]

# Numeric constants of the reference's index and search.
MIN_DF_FIXED = 2            # absolute document count, inclusive
MAX_DF_FIXED = 0.9          # fraction of documents, inclusive
RRF_K_FIXED = 60            # contribution 1 / (k + rank), rank 1-based
MINMAX_EPS_FIXED = 1e-9     # (x - lo) / (hi - lo + eps)
BLEND_COS_FIXED = 0.6       # legacy blend: 0.6 * cosine + 0.4 * fuzzy / 100
BLEND_FUZZ_FIXED = 0.4
SNIPPET_CHARS_FIXED = 80    # legacy display: first 80 chars + "..."
DEFAULT_SOURCE_FIXED = "本地知識庫"   # source shown when the column is absent
JUDGE_WORDS_FIXED = {1: "命中", 0: "沒中", None: "略過"}   # hit / miss / skipped

# fixed values: question columns that help a judge, shown where they are there
EVAL_OPTIONAL_FIXED = ("reference_answer", "note", "category")


def stopwords() -> list[str]:
    """Stop words as loaded by the reference: stripped, blanks dropped, distinct."""
    out: list[str] = []
    for w in STOPWORDS_FIXED:
        w = w.strip()
        if w and w not in out:
            out.append(w)
    return out


def custom_words() -> list[str]:
    """Distinct dictionary words (duplicates are harmless)."""
    out: list[str] = []
    for w in CUSTOM_WORDS_FIXED:
        w = w.strip()
        if w and w not in out:
            out.append(w)
    return out


@dataclass(frozen=True)
class IndexConfig:
    min_df: int = MIN_DF_FIXED
    max_df: float = MAX_DF_FIXED
    remove_stopwords: bool = True
    hash_dims: int = 64
    stopwords: tuple[str, ...] = field(default_factory=lambda: tuple(stopwords()))
    dictionary: tuple[str, ...] = field(default_factory=lambda: tuple(custom_words()))


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 3
    candidate_k: int = 20
    rrf_k: int = RRF_K_FIXED
    alpha: float = 0.5
    score_digits: int = 6     # scores are rounded before ranking (float sums differ in the last bits)
    # Broadcast only sides whose row count was checked below this bound.
    broadcast_max_rows: int = 2_000_000


# ---------------------------------------------------------------------------
# Curation inputs (data, not reference values). Edits are applied in seq
# order; the keys are strings that occur in the driver's documents, and edit 4
# only matches text produced by edit 1 (sequential semantics).
# ---------------------------------------------------------------------------
PATCH_EDITS = [
    (1, "Released under the MIT License.", " See the LICENSE file for the full text."),
    (2, "Licensed under CC BY-NC 4.0.", " Attribution is required for any reuse."),
    (3, "no passage contains this key", " This sentence is never appended."),
    (4, "See the LICENSE file", " Contact the maintainers for other terms."),
    (5, "worthless", " (sic)"),
]

# Rows appended unless some document already contains the marker.
APPEND_ROWS = [
    ("Contributor covenant overview",
     "Contributor covenant overview: be respectful, assume good faith, credit the work of others, "
     "and report problems to the maintainers in private.", "curated", "en"),
    ("Apache License", "Apache License overview: permissive, with a patent grant.", "curated", "en"),
]
