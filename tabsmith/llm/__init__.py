"""Operators for large training corpora: packing, decontamination, de-duplication, WARC, HTML
extraction, language-model scoring, language identification and token counts."""
