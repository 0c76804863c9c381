"""File types from names: expressions over path and media type."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: suffixes read as text, image suffixes, and the parser of each structured suffix.
TEXT_SUFFIXES = [".txt", ".md", ".markdown", ".csv", ".json", ".yaml", ".yml", ".html", ".htm", ".xml"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tiff", ".tif"]
PARSERS = {
    ".docx": "docx-structured", ".pptx": "pptx-structured", ".xlsx": "xlsx-structured", ".odt": "odt-structured", ".csv": "csv-structured", ".html": "html-structured",
    ".htm": "html-structured", ".json": "data-structured", ".yaml": "data-structured", ".yml": "data-structured", ".xml": "xml-structured",
}
PDF_PARSERS = ["opendataloader-pdf", "layout-first-pdf", "text-fallback"]
DEFAULT = "application/octet-stream"
MIN_OCR_CHARS = 50


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for s in sorted({*TEXT_SUFFIXES, *IMAGE_SUFFIXES, *PARSERS, ".pdf"}) if (t := mimetypes.guess_type(f"a{s}")[0]) for x in (s, t)))
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit(DEFAULT))


def is_pdf(media: Column, path: Column) -> Column:
    return (media == "application/pdf") | (suffix(path) == ".pdf")


def is_image(media: Column, path: Column) -> Column:
    return media.startswith("image/") | suffix(path).isin(IMAGE_SUFFIXES)


def is_text_like(media: Column, path: Column) -> Column:
    return media.startswith("text/") | suffix(path).isin(TEXT_SUFFIXES)


def base_parser(of: Column, media: Column) -> Column:
    """By structured suffix, image, text, else the first PDF parser."""
    table = F.create_map(*(F.lit(x) for kv in PARSERS.items() for x in kv))
    image = media.startswith("image/") | of.isin(IMAGE_SUFFIXES)
    text = media.startswith("text/") | of.isin(".md", ".markdown", ".txt")
    return F.coalesce(F.try_element_at(table, of), F.when(image, "source-text").when(text, "text-fallback").otherwise(PDF_PARSERS[0]))


def source_class(media: Column, path: Column) -> Column:
    """How a source is evaluated: pdf, structured (its suffix has a parser of its own) or text."""
    return F.when(is_pdf(media, path), "pdf").when(suffix(path).isin(list(PARSERS)), "structured").otherwise("text")


def should_run_ocr(enabled: bool, provider: Column, media: Column, path: Column, text: Column) -> Column:
    return F.lit(enabled) & provider.isNotNull() & (is_image(media, path) | (is_pdf(media, path) & (F.length(F.coalesce(F.trim(text), F.lit(""))) < MIN_OCR_CHARS)))
