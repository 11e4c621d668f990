"""Schemas of the line-delimited records that the stages exchange."""

from __future__ import annotations

MANIFEST = "id string, clip string, source_id string, source_title string, source_url string, start double, end double, duration double, asr_draft string, asr_model string, transcript string, roman string, status string, notes string, verified_by string, confidence double"
CORPUS = "id string, source_url string, source_site string, title string, register string, scripts array<string>, text string, text_origin string, text_devanagari string, n_lines int, status string, collected_at string, notes string"
CARDS = "video_id string, source_url string, source_title string, n int, win_start double, win_end double, frame_t double, frame string, clip_ids array<string>, english string, hindi string, kutchi_roman string, kutchi_guj_draft string, needs_native_verify boolean, notes string"
PHRASEBOOK = "id int, video_id string, kutchi_guj string, kutchi_roman string, english string, source_url string"
WORDS = "video_id string, words array<struct<w: string, s: double, e: double>>"
STATE = MANIFEST + ", hyp_a string, hyp_b string, hyp_local string, ear_models array<string>, lang_a string, lang_b string, lang_flag string, agreement double, mv_verdict string"
DECISIONS = "id string, transcript string, status string, notes string"
