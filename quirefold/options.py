"""Settings of layout analysis: one frozen record, read from JSON or combined with others."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields, replace


#: Settings of reading text from images.
NEED_IMAGES = ("ocr_engine", "image_based_char_detection", "enable_hand_written_text_detection", "page_level_ocr", "pages_to_ocr", "scanned")


@dataclass(frozen=True)
class Options:
    """All settings; None stands for the default of whatever reads it.

    Those that ask for reading images, for which there is no engine here, are refused when they are set.
    """

    tabular_noise_patterns: tuple[str, ...] = ()
    semantic_jump_calculator: Callable | None = None
    disable_table_detection: bool = False
    disable_header_footer_detection: bool = False
    enable_grid_based_table_detection: str | None = None
    positional_grouping_max_distance_factor: float = 2.0
    detect_underline: bool = False
    is_page_numbered_doc: bool = False
    ocr_engine: str | None = None
    line_merge_epsilon: float = 1.0
    max_text_element_to_line_count_ratio: float | None = None
    ignore_non_renderable_text: bool = False
    underline_detection: bool = False
    font_change_segmentation: bool = True
    image_based_char_detection: bool = False
    pages_to_ocr: tuple[int, ...] = ()
    enable_dynamic_space_width_computation: bool = False
    scanned: bool = False
    enable_hand_written_text_detection: bool = False
    page_level_spacing_scaling: bool = False
    allowed_scannedness: float = 1.0
    page_level_ocr: bool = False
    max_pages_allowed: int = 2**31 - 1
    compat_millions: bool = False

    def __post_init__(self) -> None:
        plain = {f.name: f.default for f in fields(self)}
        asked = [n for n in NEED_IMAGES if getattr(self, n) != plain[n]]
        if asked:
            raise NotImplementedError(f"no engine reads images here: {', '.join(asked)}")

    def combine_and_override_with(self, other: Options) -> Options:
        """These settings with those of ``other`` that differ from the defaults."""
        plain = Options()
        return replace(self, **{f.name: v for f in fields(self) if (v := getattr(other, f.name)) != getattr(plain, f.name)})

    @staticmethod
    def command_line() -> Options:
        """Defaults of the whole chain from files to output."""
        return Options(line_merge_epsilon=10.0, max_text_element_to_line_count_ratio=3.5, allowed_scannedness=0.6, is_page_numbered_doc=True, enable_grid_based_table_detection="true")

    @staticmethod
    def from_json(text: str) -> Options:
        """Settings from a list of ``{"customizationType": NAME, "params": [..]}``; names in camel or upper case."""
        known = {f.name.replace("_", ""): f for f in fields(Options)}
        found = {}
        for entry in json.loads(text):
            name = next((entry[k] for k in ("customizationType", "customization_type", "type") if k in entry), "")
            f = known.get(name.replace("_", "").lower())
            if f is None:
                raise ValueError(f"unknown setting {name!r}")
            if f.name == "semantic_jump_calculator":
                raise ValueError("a function cannot be given in JSON")
            params, kind = [str(p) for p in entry.get("params", [])], str(f.type)
            if kind.startswith("tuple[str"):
                found[f.name] = tuple(params)
            elif kind.startswith("tuple[int"):
                found[f.name] = tuple(int(p) for p in params)
            elif kind == "bool":
                found[f.name] = (params or ["true"])[0].lower() == "true"
            elif kind.startswith("float"):
                found[f.name] = float(params[0])
            elif kind == "int":
                found[f.name] = int(params[0])
            else:
                found[f.name] = params[0]
        return Options(**found)
