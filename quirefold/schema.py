"""Types of the tables that operators exchange."""

from __future__ import annotations

FORM = "struct<type:string,options:array<string>,display:array<string>,`on`:array<string>,`values`:array<string>,flags:map<string,boolean>>"
ELEMENTS = (
    "doc_id bigint, elem_idx int, page_no int, kind string, top double, left double, width double, height double, stretch double, "
    f"text string, font_family string, font_size double, styles array<string>, rgb int, form {FORM}"
)
CELLS = "doc_id bigint, table_id int, row int, col int, text string, elem_ids array<int>, v_merged boolean, h_merged boolean"
RECTANGLES, GRAPHICAL = ("text", "form", "image", "inline_block"), ("hline", "vline", "page_break")
