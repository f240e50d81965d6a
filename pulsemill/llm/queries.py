"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from .curve_packing import op10_packing
from . import decontamination, license_scan, url_filter
from .html_extraction import op9_html_text
from .katz_lm import op3_katz
from .language_id import language_pages, op1_language_id
from .media_columns import op7_media
from .quality_classifier import op2_quality
from .simhash_dedup import op4_simhash

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_katz": op3_katz,
    "op4_simhash": op4_simhash,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_media": op7_media,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_html_text": op9_html_text,
    "op10_packing": op10_packing,
    "language_pages": language_pages,
    "benchmark_proximity": decontamination.benchmark_proximity,
}
ORACLE_SQL = {"op5_url_filter": url_filter.ORACLE, "op6_decontamination": decontamination.ORACLE, "op8_license_scan": license_scan.ORACLE}
