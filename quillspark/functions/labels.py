"""Table labels, page-scoped labels and metadata lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Fixed label patterns; the three differ on purpose.
EVALUATED = r"(?i)(?:표|表)\s*(?:<\s*)?([0-9]+(?:\.[0-9]+)*(?:-[0-9]+)?)(?:\s*>)?"
VISUAL = r"(?i)(?:표|table)\s*(?:<\s*)?([0-9]+(?:\.[0-9]+)?-[0-9]+)(?:\s*>)?"
JUDGED = r"(?i)(?:table|표)\s*(?:<\s*)?([0-9]+(?:\.[0-9]+)*(?:-[0-9]+)?)"
PAGE_REFERENCE = r"(?i)\bp\.?\s*([0-9]+)\b"
PAGE_PREFIX = "__page_table__:"

# Fixed: words that every table holds.
GENERIC_TOKENS = ["구분", "항목", "비고", "내용", "값", "항목명", "단위", "소계", "합계"]

# Fixed: issue types in order, and the patterns that name them in free text.
TABLE_ISSUES = {
    "missing_header": [r"\bmissing(?:\s+\w+){0,2}\s+header\b", r"\bheader\s+missing\b", r"\bmissing\s+column\s+headers?\b", "머리글", "헤더", "표 형태로 렌더링되지", "행/열 구조", "구조 보존이 미흡"],
    "split_multipage_table": [r"\bsplit(?:\s+\w+){0,2}\s+table\b", r"\bmulti[\s-]?page\s+table\b", r"\btable\s+(?:continues|continuation)\b", r"\bcontinued\s+on\s+next\s+page\b", "다음 페이지", "계속"],
    "merged_cell_loss": [r"\bmerged?\s+cells?\b", r"\browspan\b", r"\bcolspan\b", r"\bspanning\s+cells?\b", r"병합\s*셀", "열 배치가 어색"],
    "numeric_token_break": [r"\bnumeric\s+token\s+break\b", r"\bnumber\s+token\s+break\b", r"\bdecimal\s+split\b", r"\bbroken\s+numbers?\b", r"\bsplit\s+digits?\b", "숫자.*깨", "소수점", "단위.*오", "값이 비어", r"누락된\s*셀", r"누락된\s*값"],
    "table_text_duplication": [r"\btable\s+text\s+duplication\b", r"\bduplicated?\s+table\s+text\b", r"\brepeated\s+table\s+text\b", r"\btable\s+text\s+repeated\b", "중복", "반복"],
}


def distinct(found: Column) -> Column:
    """First-seen order."""
    return F.array_distinct(found)


def table_labels(text: Column) -> Column:
    """Distinct label numbers in order of first appearance."""
    return distinct(F.regexp_extract_all(text, F.lit(EVALUATED), 1))


def judged_labels(text: Column, limit: int | None = None) -> Column:
    found = distinct(F.regexp_extract_all(text, F.lit(JUDGED), 1))
    return found if limit is None else F.slice(found, 1, limit)


def label_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, VISUAL, 1), F.lit(""))


def canonical_label(label: Column) -> Column:
    return F.coalesce(F.concat(F.lit("표 "), label_number(label)), T.strip(label))


def page_label(page: Column, index: Column | None = None) -> Column:
    own = F.concat(F.lit(PAGE_PREFIX), page.cast("string"))
    return own if index is None else F.concat(own, F.lit(":"), index.cast("string"))


def page_selector(label: Column) -> Column:
    """(page, index) of a page-scoped label; nulls for others."""
    part = lambda k: F.regexp_extract(label, rf"^{PAGE_PREFIX}([0-9]+)(?::([0-9]+))?$", k).try_cast("int")
    return F.struct(part(1).alias("page"), part(2).alias("index"))


def page_references(text: Column) -> Column:
    return distinct(F.transform(F.regexp_extract_all(text, F.lit(PAGE_REFERENCE), 1), lambda x: x.cast("int")))


def issue_types(text: Column) -> Column:
    """Table issue types that a remark names, in the fixed order."""
    return F.filter(F.array(*(F.when(text.rlike("(?i)" + "|".join(ps)), F.lit(name)) for name, ps in TABLE_ISSUES.items())), lambda x: x.isNotNull())


def table_tokens(text: Column) -> Column:
    """Distinct tokens without numbers and generic header words."""
    return F.array_distinct(F.filter(T.words(text), lambda t: ~t.rlike("^[0-9]+$") & ~t.isin(GENERIC_TOKENS)))


def table_numbers(text: Column) -> Column:
    return F.array_distinct(T.numbers(text))


def source_context(text: Column, label: Column, size: int = 240) -> Column:
    """The characters behind a label's first place; empty if it is not there."""
    at = F.position(label, text)
    return F.when(at > 0, F.substring(text, at + F.length(label), F.lit(size))).otherwise("")


def from_metadata(found: Column, labels: list[Column]) -> Column:
    """The first variant of a label that a map holds."""
    return F.coalesce(*(F.try_element_at(found, x) for x in labels))


def task_key(label: Column, page: Column, issues: Column) -> Column:
    return F.concat_ws("|", label, F.coalesce(page.cast("string"), F.lit("")), F.array_join(F.array_sort(issues), ","))


def valid_page(page: Column, n_pages: Column) -> Column:
    return F.coalesce((page >= 1) & (page <= n_pages), F.lit(False))
