"""Column functions for job postings: salary, years of experience, level, degree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Formats of pay, required years, levels and degrees.
_N = r"(\d+(?:\.\d+)?)"
DAY_PAY = rf"^{_N}(?:\s*-\s*{_N})?\s*元?\s*/\s*天"
YEAR_PAY = rf"^{_N}(?:\s*-\s*{_N})?\s*(万|千)?\s*/\s*年"
RANGE_PAY = rf"^{_N}\s*(万|千)?\s*-\s*{_N}\s*(万|千)?"
SINGLE_PAY = rf"^{_N}\s*(万|千)\s*(?:及以下|以上)"
PAY_MONTHS = r"[·・]\s*(\d+)\s*薪"
WORK_DAYS = 22
YEAR_FIGURES = (
    r"(\d{1,2})\s*[-~至]\s*\d{1,2}\s*年(?:以上|及以上)?[^，。；;\n]{0,20}经验",
    r"(\d{1,2})\s*年(?:以上|及以上)?[^，。；;\n]{0,20}经验",
    r"经验[：:]?\s*(?:需|需要)?\s*(\d{1,2})\s*年",
    r"(?:工作年限|年限要求|经验要求|工作经历)[：:.\s]*(\d{1,2})\s*(?:[-~至]\s*\d{1,2}\s*)?年",
    r"经验[：:]?\s*(\d{1,2})\s*[-~至]\s*\d{1,2}\s*年",
    r"(\d{1,2})\s*(?:[-~至]\s*\d{1,2}\s*)?年(?:以上|及以上)?[^，。；;\n]{0,12}经历",
    r"(?i)(\d{1,2})\s*\+?\s*(?:[-~to]+\s*\d{0,2}\s*)?years?",
    r"(?:工作|从事|相关|行业|本岗|岗位|开发|运维|测试|研发)\D{0,6}(\d{1,2})\s*年(?:以上|及以上)",
    r"(\d{1,2})\s*年(?:以上|及以上)(?:的)?(?:工作|相关|项目|行业|从业|开发|运维|测试|管理|研究)",
)
_HAN = "[一二两三四五六七八九十]{1,3}"
YEAR_NUMERALS = (
    rf"({_HAN})\s*年(?:以上|及以上)?[^，。；;\n]{{0,20}}经验",
    rf"(?:工作年限|年限要求|经验要求|工作经历)[：:.\s]*({_HAN})\s*年",
    rf"经验[：:]?\s*({_HAN})\s*年",
    rf"({_HAN})\s*年(?:以上|及以上)?[^，。；;\n]{{0,12}}经历",
)
NO_EXPERIENCE = r"无(?:需|需相关|相关|工作)?经验|经验不限|不限经验"
FRESH_WELCOME = r"接受应届|欢迎应届|应届生亦可|应届毕业(?:生)?[亦可]|亦招应届|可接收应届"
TITLE_FRESH = "实习|应届"
TITLE_LEVELS = (("L4", r"专家|首席|总监|架构师|(?i)\b(?:principal|staff|expert)\b"), ("L3", r"高级|资深|(?i)\bsenior\b"), ("L2", "中级"), ("L1", r"初级|助理|(?i)\bjunior\b"))
MAX_YEARS = 15
DEGREE_CONTEXT = "学历|学位|毕业|文凭|本科|大专|专科|硕士|博士|研究生|高中|中专"
DEGREES = (
    ("学历不限", r"学历不限|不限学历|学历\s*[:：]?\s*不限"),
    ("高中及中专", "高中|中专|技校|职高"),
    ("大专", "大专|专科|高职"),
    ("本科", "本科|学士"),
    ("硕士", "硕士|研究生"),
    ("博士", "博士"),
)
_DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def _group(text: Column, pattern: str, group: int) -> Column:
    """The group as a number, null where it or the pattern doesn't match."""
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _unit(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "万", 10000.0).when(found == "千", 1000.0)


def salary_monthly(text: Column) -> Column:
    """Monthly pay: by day (22 days), by year, a range whose left side inherits the right's unit, a single bound; `N薪` pays N
    months a year. Null for blank, negotiable and unknown forms."""
    s = F.trim(text)
    day = (_group(s, DAY_PAY, 1) + F.coalesce(_group(s, DAY_PAY, 2), _group(s, DAY_PAY, 1))) / 2 * WORK_DAYS
    year_low = _group(s, YEAR_PAY, 1)
    year = (year_low + F.coalesce(_group(s, YEAR_PAY, 2), year_low)) / 2 * F.coalesce(_unit(s, YEAR_PAY, 3), F.lit(1.0)) / 12
    right = F.coalesce(_unit(s, RANGE_PAY, 4), F.lit(1.0))
    between = (_group(s, RANGE_PAY, 1) * F.coalesce(_unit(s, RANGE_PAY, 2), right) + _group(s, RANGE_PAY, 3) * right) / 2
    single = _group(s, SINGLE_PAY, 1) * _unit(s, SINGLE_PAY, 2)
    months = F.coalesce(_group(s, PAY_MONTHS, 1) / 12, F.lit(1.0))
    return F.when(~s.contains("面议"), F.round(F.coalesce(day, year, between, single) * months, 2))


def han_number(text: Column) -> Column:
    """Chinese numerals 1 to 99; null for other texts."""
    digit = F.create_map(*[F.lit(x) for pair in _DIGITS.items() for x in pair])
    one = F.when(F.length(text) == 1, F.try_element_at(digit, text))
    head, tail = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    tens = F.when(head == "", 1).otherwise(F.try_element_at(digit, head))
    rest = F.when(tail == "", 0).otherwise(F.coalesce(F.try_element_at(digit, tail), F.lit(0)))
    return F.coalesce(one, F.when(text.contains("十") & (F.length(text) <= 3), tens * 10 + rest))


def text_years(text: Column) -> Column:
    """The highest number of years a text asks for, 15 at most; 0 if it says that none are needed; else null."""
    head = F.substring(text, 1, 6000)
    figures = F.concat(*(F.transform(F.regexp_extract_all(head, F.lit(p), 1), lambda x: x.try_cast("int")) for p in YEAR_FIGURES))
    numerals = F.concat(*(F.transform(F.regexp_extract_all(head, F.lit(p), 1), han_number) for p in YEAR_NUMERALS))
    most = F.array_max(F.concat(figures, numerals))
    return F.coalesce(F.when(most.isNotNull(), F.least(most, F.lit(MAX_YEARS))), F.when(F.regexp_like(head, F.lit(NO_EXPERIENCE)), 0))


def years_level(years: Column) -> Column:
    return F.when(years <= 2, "L1").when(years <= 4, "L2").when(years <= 9, "L3").when(years.isNotNull(), "L4")


def _column_years(column: Column) -> Column:
    span = F.regexp_extract(column, r"(\d{1,2})\s*[-~至]\s*\d{1,2}\s*年", 1).try_cast("int")
    single = F.regexp_extract(column, r"(\d{1,2})\s*年", 1).try_cast("int")
    return F.when(F.regexp_like(column, F.lit("无需经验|无经验|不限")), 0).otherwise(F.coalesce(span, single))


def title_level(title: Column) -> Column:
    """L0 for interns and graduates, else the highest level word."""
    level = F.when(F.regexp_like(title, F.lit(TITLE_FRESH)), "L0")
    for name, words in TITLE_LEVELS:
        level = level.when(F.regexp_like(title, F.lit(words)), name)
    return level


def resolve_level(work_year: Column, title: Column, text: Column, category: Column) -> Column:
    """Struct (level, source): the experience column, then years in the text, graduates welcome, title words, category words;
    both empty if nothing tells."""
    fresh = F.when(F.regexp_like(work_year, F.lit("在校生|应届")), "L0")
    by_column = F.coalesce(fresh, years_level(_column_years(work_year)))
    by_text = F.coalesce(years_level(text_years(text)), F.when(F.regexp_like(text, F.lit(FRESH_WELCOME)), "L0"))
    told = [(by_column, "work_year"), (by_text, "text"), (title_level(title), "title"), (title_level(category), "funtype")]
    pairs = [F.when(level.isNotNull(), F.struct(level.alias("level"), F.lit(source).alias("source"))) for level, source in told]
    return F.coalesce(*pairs, F.struct(F.lit("").alias("level"), F.lit("").alias("source")))


def degree_gate(text: Column) -> Column:
    """The lowest degree a text that speaks of degrees names; empty if it doesn't."""
    gate = F.when(~F.coalesce(F.regexp_like(text, F.lit(DEGREE_CONTEXT)), F.lit(False)), "")
    for name, words in DEGREES:
        gate = gate.when(F.regexp_like(text, F.lit(words)), name)
    return gate.otherwise("")


def city(place: Column) -> Column:
    """First part of a place before `-` or `·`."""
    return F.split(place, "[-·]")[0]


def salary_band(pay: Column, bounds: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """Name of the half-open band [low, high) that holds the pay."""
    band = F.when(pay.isNull(), None)
    for bound, name in zip(bounds, names):
        band = band.when(pay < bound, name)
    return band.otherwise(names[-1])
